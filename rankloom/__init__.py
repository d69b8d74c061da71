"""Top-N recommendation analytics expressed as Spark plans."""
