"""Scalar and column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Multipliers and modulus of the deterministic order that replaces random shuffles.
USER_STEP, ITEM_STEP, MODULUS = 7919, 104729, 1000003


def hash_order(user: str | Column, item: str | Column, seed: int = 42) -> Column:
    """A pseudo-random number below MODULUS that any SQL engine can repeat."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.pmod(col(user).cast("long") * USER_STEP + col(item).cast("long") * ITEM_STEP + seed, F.lit(MODULUS))


def half_even(x: Column) -> Column:
    """Round half to even."""
    return F.bround(x)


def sigmoid_gradient(x: Column) -> Column:
    return 1 / (1 + F.exp(x))


def confidence(data: Column, scaling: str = "linear", alpha: float = 1.0, epsilon: float = 1.0) -> Column:
    """Confidence of an implicit interaction."""
    if scaling == "linear":
        return 1 + alpha * data
    if scaling == "log":
        return 1 + alpha * F.log(1 + data / epsilon)
    if scaling == "popularity":  # data is how many interactions the item has
        return F.log(data)
    raise ValueError(f"unknown scaling {scaling!r}")


def release_year(title: Column) -> Column:
    """The four digits in parentheses that end a title; null if there are none."""
    return F.nullif(F.regexp_extract(title, r"\(([0-9]{4})\)$", 1), F.lit("")).cast("int")


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", " ")), " +"), lambda w: w != "")


def biggest_unit(seconds: Column) -> Column:
    """struct(value, unit) in the biggest unit that fits."""
    cases = [(365.0 * 86400, "years"), (86400.0, "days"), (3600.0, "hours"), (60.0, "minutes")]
    out = F.struct(seconds.cast("double").alias("value"), F.lit("seconds").alias("unit"))
    for size, name in reversed(cases):
        out = F.when(seconds >= size, F.struct((seconds / size).alias("value"), F.lit(name).alias("unit"))).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rank_in(group: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))
