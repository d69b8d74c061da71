"""Operators for preparing large text corpora for language-model training.

Nothing outside this folder imports it; deleting it leaves the rest working.
"""
