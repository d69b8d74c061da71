"""Tables in the shared folder, size-checked broadcasts and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import run_folder

#: A side of a join is broadcast only if rows x width is below this.
BROADCAST_BYTES = 32 << 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs neither repeat it nor lose it with an executor."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(kept: DataFrame, width: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """kept with a broadcast hint if its counted rows fit in `limit` bytes, else as it is (a shuffled join)."""
    return F.broadcast(kept) if kept.count() * (width + 16) <= limit else kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b); root is the least node that links reach.

    Each round hooks every node to its least neighbour, follows that once more and contracts the links, so the
    number of rounds grows with the logarithm of the longest path. Nulls and self-links are ignored.
    """
    e = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = keep(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).select("n", F.least("n", "p").alias("p")), "hook")
        small = maybe_broadcast(up, 16)
        hint = (lambda df: F.broadcast(df)) if small is not up else (lambda df: df)
        up = keep(up.join(hint(up.select(F.col("n").alias("p"), F.col("p").alias("pp"))), "p").select("n", F.col("pp").alias("p")), "hook")
        if found is None:
            found = up.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            found = keep(found.join(hint(up), found["root"] == up["n"], "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        a, b = up.select(F.col("n").alias("a"), F.col("p").alias("pa")), up.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        e = e.join(hint(a), "a").join(hint(b), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = keep(e, "links")
    if found is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (node, root) after further links (a, b)."""
    if labels is None:
        found = components(links)
        return None if found.isEmpty() else found
    known = maybe_broadcast(labels, 16)
    mapped = links.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    more = components(mapped.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    if more.isEmpty():
        return labels
    over = maybe_broadcast(more.select(F.col("node").alias("root"), F.col("root").alias("top")), 16)
    old = labels.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return keep(old.union(more.join(known.select("node"), "node", "left_anti")), "labels")
