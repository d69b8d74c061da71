"""Coordinate matrices: encoding, construction and cleaning.

A matrix is a DataFrame (row, col, data) or, for interactions, (user_id, item_id, data); a missing cell is 0, so zeros
are dropped and repeated coordinates are summed first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build(frame: DataFrame, row: str, col: str, data: str | Column) -> DataFrame:
    """Sum repeated coordinates, then drop zeros."""
    value = F.col(data) if isinstance(data, str) else data
    return frame.groupBy(row, col).agg(F.sum(value.cast("double")).alias("data")).where("data <> 0")


def dense_index(frame: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """frame with a dense number from 0 in the given total order.

    The rows are sorted into ranges, numbered in each, and moved by the counts of the ranges before, so no task sees more than a range."""
    from ..sources.store import checkpointed

    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = checkpointed(frame.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    # one row for each range
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__b")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return ranged.withColumn("__k", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__k") - 1).cast("long")).drop("__p", "__k", "__b")


def id_mapper(frames: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(original_id, idx): dense index in first-seen order over (frame, id column, position column) triples."""
    parts = [f.select(F.col(i).cast("string").alias("original_id"), F.lit(k).alias("k"), F.col(p).cast("long").alias("p")) for k, (f, i, p) in enumerate(frames)]
    seen = reduce(DataFrame.unionByName, parts).where("original_id is not null").groupBy("original_id").agg(F.min(F.struct("k", "p")).alias("at"))
    return dense_index(seen.select("original_id", "at.k", "at.p"), "k", "p", "original_id").select("original_id", "idx")


def encode(frame: DataFrame, mapper: DataFrame, column: str, unknown: str = "ignore") -> DataFrame:
    """Replace the ids of `column` by their index; unknown ids are dropped, or kept as null with unknown="null"."""
    m = mapper.select(F.col("original_id").alias("__id"), F.col("idx").alias("__idx"))
    joined = frame.join(m, frame[column].cast("string") == m["__id"], "inner" if unknown == "ignore" else "left")
    return joined.select(*[F.col("__idx").alias(column) if c == column else F.col(c) for c in frame.columns])


def extend_mapper(mapper: DataFrame, frame: DataFrame, column: str) -> DataFrame:
    """mapper with the new ids of a frame appended in id order."""
    new = frame.select(F.col(column).cast("string").alias("original_id")).where("original_id is not null").distinct().join(mapper, "original_id", "left_anti")
    base = mapper.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("base"))
    rows = dense_index(new, "original_id", name="k").crossJoin(F.broadcast(base))
    return mapper.select("original_id", "idx").unionByName(rows.select("original_id", (F.col("base") + F.col("k")).cast("long").alias("idx")))


def compact_mapper(mapper: DataFrame, removed: DataFrame) -> DataFrame:
    """mapper without the indices in removed (idx), numbered densely again in the old order."""
    left = mapper.join(removed, "idx", "left_anti")
    return dense_index(left.select("original_id", F.col("idx").alias("old")), "old").select("original_id", "idx")


def invert_mapper(mapper: DataFrame) -> DataFrame:
    """(idx, original_id, bijective): bijective says whether every id and index occurs once."""
    same = mapper.agg((F.count("*") == F.countDistinct("idx")).alias("a"), (F.count("*") == F.countDistinct("original_id")).alias("b"))
    return mapper.crossJoin(F.broadcast(same)).select("idx", "original_id", (F.col("a") & F.col("b")).alias("bijective"))


def merge_features(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Concatenate two feature matrices along the features; those of the second are moved by `offset`."""
    return first.unionByName(second.withColumn("feature_id", F.col("feature_id") + offset))


def stack_rows(first: DataFrame, second: DataFrame, offset: int, weight: float = 1.0) -> DataFrame:
    """Put the rows of second below those of first; its data times weight."""
    return first.unionByName(second.select((F.col("row") + offset).alias("row"), "col", (F.col("data") * weight).alias("data")))


def binarise(m: DataFrame, least: float | None = None) -> DataFrame:
    """1.0 for every cell (of at least `least`)."""
    return (m if least is None else m.where(F.col("data") >= least)).withColumn("data", F.lit(1.0))


def shift(m: DataFrame, bias: float) -> DataFrame:
    return m.withColumn("data", F.col("data") + F.lit(bias)).where("data <> 0")


def column_slices(m: DataFrame, col: str, width: int) -> DataFrame:
    """m with the number of its slice of `width` columns."""
    return m.withColumn("slice", F.floor(F.col(col) / width).cast("long"))


def dedup_latest(frame: DataFrame, keys: list[str], by: str, *ties: str) -> DataFrame:
    """One row per key: that with the highest `by` (nulls lose), then the highest of `ties`."""
    order = [F.col(c).desc_nulls_last() for c in (by, *ties)]
    return frame.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def remove_empty(m: DataFrame, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Non-zero cells, and the feature rows of items that still occur."""
    m = m.where("data <> 0")
    return m, None if features is None else features.join(m.select("item_id").distinct(), "item_id", "left_semi")


def filter_features(icm: DataFrame, n_items: DataFrame, least: int = 5, most_share: float = 0.30) -> DataFrame:
    """Cells of features that at least `least` and at most most_share of the items have; n_items has one row (n)."""
    often = icm.groupBy("feature_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n_items)).where((F.col("k") >= least) & (F.col("k") <= F.col("n") * most_share))
    return icm.join(often.select("feature_id"), "feature_id", "left_semi")


def remove(m: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Cells whose `column` is not among ids (one column)."""
    return m.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_anti").select(m.columns)


def keep_only(m: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return m.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi").select(m.columns)


def warm_users(m: DataFrame, least: int) -> DataFrame:
    """Interactions of users with at least `least` of them."""
    return keep_only(m, "user_id", m.groupBy("user_id").count().where(F.col("count") >= least).select("user_id"))


def cold(dimension: DataFrame, m: DataFrame, column: str) -> DataFrame:
    """Ids of the dimension (one column) without a cell in m."""
    return dimension.join(m.select(F.col(column).alias(dimension.columns[0])), dimension.columns[0], "left_anti")


def core_round(m: DataFrame, k: int) -> DataFrame:
    """One round of the k-core: users with fewer than k cells go, then items."""
    m = warm_users(m, k)
    return keep_only(m, "item_id", m.groupBy("item_id").count().where(F.col("count") >= k).select("item_id"))


def k_core(m: DataFrame, k: int = 5, rounds: int | None = None) -> DataFrame:
    """The cells whose user and item have at least k cells each among the result; the core is unique.

    Each round is cut from its lineage by a checkpoint in the shared folder, or unrolled if `rounds` is given."""
    if rounds is not None:
        for _ in range(rounds):
            m = core_round(m, k)
        return m
    from ..sources.store import checkpointed

    m = checkpointed(m)
    n = m.count()
    while True:
        m = checkpointed(core_round(m, k))
        now = m.count()
        if now == n:
            return m
        n = now


def implicit_sample(m: DataFrame, candidates: DataFrame, count: int, order: Column) -> DataFrame:
    """m and the first `count` candidate cells (row, col) by `order` that it does not have, with data 0."""
    new = candidates.join(m, ["row", "col"], "left_anti").orderBy(order, "row", "col").limit(count)
    return m.unionByName(new.select("row", "col", F.lit(0.0).alias("data")))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
