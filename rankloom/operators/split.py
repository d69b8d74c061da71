"""Train, validation and test splits in a deterministic hash order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ITEM_STEP, MODULUS, USER_STEP, half_even, hash_order, rank_in
from ..sources.store import checkpointed, scratch
from .matrix import dense_index
from .packed import Packed, Rows, dealt, made, pack, some_rows


def holdout_user_wise(m: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """m with split 'train' or 'test': of a user's n cells round(n * share) train, and at least one tests if n > 1."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    ranked = m.withColumn("k", rank_in(["user_id"], hash_order("user_id", "item_id", seed), F.col("item_id"))).withColumn("n", n)
    train = half_even(F.col("n") * share)
    train = F.when((train == F.col("n")) & (F.col("n") > 1), F.col("n") - 1).otherwise(train)
    return ranked.select(*m.columns, F.when(F.col("k") <= train, "train").otherwise("test").alias("split"))


def holdout_global(m: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """m with its split: the first round(cells * share) of all cells train.

    The border is found from counts per hash value, so that only the cells of one value are ranked."""
    value = hash_order("user_id", "item_id", seed)
    hashed = m.withColumn("h", value)
    counts = hashed.groupBy("h").agg(F.count("*").alias("c"))
    line = counts.withColumn("before", F.sum("c").over(Window.orderBy("h")) - F.col("c"))
    total = m.agg(half_even(F.count("*") * F.lit(share)).alias("quota"))
    border = line.crossJoin(F.broadcast(total)).select("h", (F.col("quota") - F.col("before")).alias("room"))
    inner = F.row_number().over(Window.partitionBy("h").orderBy("user_id", "item_id"))
    return hashed.withColumn("k", inner).join(border, "h").select(*m.columns, F.when(F.col("k") <= F.col("room"), "train").otherwise("test").alias("split"))


def leave_k_out(m: DataFrame, k: int = 1, validation: bool = True, order: Column | None = None, seed: int = 42, strict_ranks: bool = False) -> DataFrame:
    """m with its split: per user the first k cells in order test, the next k validate, the rest train.

    Users need (parts - 1) * k + 1 cells, others are dropped. Without validation the next k train too, unless strict_ranks."""
    least = (2 if validation else 1) * k + 1
    n = F.count("*").over(Window.partitionBy("user_id"))
    first = hash_order("user_id", "item_id", seed) if order is None else order
    ranked = m.withColumn("n", n).where(F.col("n") >= least).withColumn("r", rank_in(["user_id"], first, F.col("item_id")))
    second = F.when(F.col("r") <= 2 * k, F.lit("validation") if validation else F.lit(None if strict_ranks else "train")).otherwise("train")
    return ranked.select(*m.columns, F.when(F.col("r") <= k, "test").otherwise(second).alias("split")).where("split is not null")


def cold_items(m: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """m with its split: round(items * share) of the items in hash order train, the cells of the others test."""
    items = m.select("item_id").distinct()
    n = items.agg(half_even(F.count("*") * F.lit(share)).alias("n"))
    ranked = dense_index(items.withColumn("h", hash_order(F.lit(0), "item_id", seed)), "h", "item_id", name="k").crossJoin(F.broadcast(n))
    return m.join(ranked.select("item_id", F.when(F.col("k") < F.col("n"), "train").otherwise("test").alias("split")), "item_id").select(*m.columns, "split")


def three_way(m: DataFrame, quotas: tuple[float, float, float] = (0.7, 0.1, 0.2), user_wise: bool = True, seed: int = 42) -> DataFrame:
    """train, validation and test: the test is split off first, then the validation from what is left."""
    train, validation, test = quotas
    one = holdout_user_wise if user_wise else holdout_global
    outer = one(m, train + validation, seed)
    inner = one(outer.where("split = 'train'").drop("split"), train / (train + validation), seed + 1)
    return outer.where("split = 'test'").unionByName(inner.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("validation")))


def quotas(split: DataFrame) -> DataFrame:
    """(split, cells, percent) as realised."""
    n = split.groupBy("split").agg(F.count("*").alias("cells"))
    total = n.agg(F.sum("cells").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("split", "cells", (F.col("cells") * 100.0 / F.col("total")).alias("percent"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells that both hold; 0 for disjoint matrices."""
    return a.select("user_id", "item_id").intersect(b.select("user_id", "item_id")).agg(F.count("*").alias("shared"))


def bpr_triples(m: DataFrame, items: DataFrame, draws: int = 5, seed: int = 42) -> DataFrame:
    """(user_id, positive, negative): for every cell the first of `draws` hashed items that its user has not seen.

    items is (item_id, idx) with a dense idx; a cell without an unseen draw gives no triple."""
    n = items.agg(F.count("*").alias("n"))
    tries = m.select("user_id", F.col("item_id").alias("positive")).crossJoin(F.broadcast(n)).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    tries = tries.withColumn("idx", F.pmod(hash_order("user_id", "positive", seed) * 31 + F.col("d") * 15485863, F.col("n")))
    drawn = tries.join(items, "idx").select("user_id", "positive", "d", F.col("item_id").alias("negative"))
    unseen = drawn.join(m.select("user_id", F.col("item_id").alias("negative")), ["user_id", "negative"], "left_anti")
    return unseen.groupBy("user_id", "positive").agg(F.min_by("negative", "d").alias("negative"))


def packed_triples(m: Packed, items: DataFrame, draws: int = 5, seed: int = 42) -> Packed:
    """`bpr_triples` of cells packed by user, as rows of the user with the positives as columns and the negatives as data.

    The draws of a cell are looked up where the cell is, so no draws are joined. Item ids are held as doubles, so they lie within 2^53."""
    with scratch() as stay:
        offered = checkpointed(items.select(F.col("idx").cast("long").alias("idx"), F.col("item_id").cast("long").alias("item_id"), F.lit(0.0).alias("data")))
        n = offered.count()
        offered = pack(offered, "idx", "item_id", cells=n, span=(0, n))
        low, width = m.span()

        def make(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows, out = Rows(offered), []
            for keys, starts, cols, _ in some_rows(m, k):
                size = np.diff(starts)
                user, row = np.repeat(keys, size), np.repeat(np.arange(len(keys)), size)
                base, own = (user * USER_STEP + cols * ITEM_STEP + seed) % MODULUS * 31, row * width + cols - low
                negative, left = np.zeros(len(cols), np.int64), np.arange(len(cols))
                for d in range(1, draws + 1):
                    asked, place = np.unique((base[left] + d * 15485863) % n, return_inverse=True)
                    drawn = rows.take(*rows.find(asked))[1][place]
                    code = row[left] * width + drawn - low
                    seen = (drawn >= low) & (drawn < low + width) & (own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code)
                    negative[left[~seen]] = drawn[~seen]
                    left = left[seen]
                    if not len(left):
                        break
                use = np.ones(len(cols), bool)
                use[left] = False
                out.append((user[use], cols[use], negative[use].astype(float)))
            if n and out:
                yield tuple(np.concatenate(c) for c in zip(*out))

        return stay(made(m, make))


def triples_of(triples: DataFrame | Packed) -> Packed:
    """(user_id, positive, negative) as `packed_triples` gives them."""
    return triples if isinstance(triples, Packed) else pack(checkpointed(triples.select("user_id", "positive", "negative")), "user_id", "positive", "negative")


def triple_sides(t: Packed) -> Packed:
    """Packed triples by each of their two items: columns are twice the user, and one more where the item is the negative; data are the other item."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                negative = t.load(k)[3]
                yield pa.RecordBatch.from_arrays([pa.array([int(negative.min())]), pa.array([int(negative.max())])], names=["least", "most"])

    found = [tuple(r) for r in t.tasks().mapInArrow(ends, "least long, most long").collect()] + [(p[5], p[6]) for p in t.parts]
    low, high = (min(f[0] for f in found), max(f[1] for f in found)) if found else (0, 0)

    def make(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for keys, starts, positive, negative in some_rows(t, k):
            user = 2 * np.repeat(keys, np.diff(starts))
            yield positive, user, negative
            yield negative.astype(np.int64), user + 1, positive.astype(float)

    return dealt(t, lambda: make, (low, high - low + 1), 2 * t.size())


def bernoulli(m: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """m with its split: every cell trains with probability `share`, by its hash alone."""
    return m.withColumn("split", F.when(hash_order("user_id", "item_id", seed) < F.lit(int(share * MODULUS)), "train").otherwise("test"))


def _draw(spark, draws: int, n: DataFrame, seed: int) -> DataFrame:
    """(d, idx): hashed numbers below n (one row), with replacement."""
    return spark.range(1, draws + 1).withColumnRenamed("id", "d").crossJoin(F.broadcast(n)).select("d", F.pmod(F.col("d") * 15485863 + seed * 7919, F.col("n")).alias("idx"))


def sample_interactions(m: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """(d, user_id, item_id, data): uniform draws of cells, with replacement; users come in proportion to their profiles."""
    cells = dense_index(m.select("user_id", "item_id", "data"), "user_id", "item_id")
    return _draw(m.sparkSession, draws, m.agg(F.count("*").alias("n")), seed).join(cells, "idx").select("d", "user_id", "item_id", "data")


def sample_pairs(m: DataFrame, items: DataFrame, draws: int, tries: int = 5, seed: int = 42) -> DataFrame:
    """(d, user_id, positive, negative): uniform draws of cells, each with the first of `tries` hashed items that its user has not seen."""
    drawn = sample_interactions(m, draws, seed).select("d", "user_id", F.col("item_id").alias("positive"))
    n = items.agg(F.count("*").alias("n"))
    offered = drawn.crossJoin(F.broadcast(n)).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    offered = offered.withColumn("idx", F.pmod(hash_order("user_id", "positive", seed) * 31 + F.col("d") * 104729 + F.col("t") * 15485863, F.col("n"))).join(items, "idx")
    unseen = offered.withColumnRenamed("item_id", "negative").join(m.select("user_id", F.col("item_id").alias("negative")), ["user_id", "negative"], "left_anti")
    return unseen.groupBy("d", "user_id", "positive").agg(F.min_by("negative", "t").alias("negative"))


def sample_ratings(m: DataFrame, items: DataFrame, per_user: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id, data): all cells, and hashed unseen items of each user with data 0."""
    zero = sample_negatives(m, items, per_user, seed).select("user_id", "item_id", F.lit(0.0).alias("data"))
    return m.select("user_id", "item_id", "data").unionByName(zero)


def impression_negatives(m: DataFrame, impressions: DataFrame, items: DataFrame, per_user: int, mode: str = "inside", seed: int = 42) -> DataFrame:
    """(user_id, item_id): items that a user has no cell for, among those shown to them ("inside") or hashed ones not shown ("outside").

    impressions holds (user_id, item_id). Of the shown ones the first per_user in hash order are taken."""
    if mode == "outside":
        return sample_negatives(m, items, per_user, seed).join(impressions, ["user_id", "item_id"], "left_anti")
    open_ = impressions.select("user_id", "item_id").distinct().join(m, ["user_id", "item_id"], "left_anti")
    ranked = open_.withColumn("k", rank_in(["user_id"], hash_order("user_id", "item_id", seed), F.col("item_id")))
    return ranked.where(F.col("k") <= per_user).drop("k")


def sample_negatives(m: DataFrame, items: DataFrame, per_user: int, seed: int = 42) -> DataFrame:
    """(user_id, item_id): hashed items that the user has not seen, at most per_user draws each."""
    users = m.select("user_id").distinct()
    n = items.agg(F.count("*").alias("n"))
    tries = users.crossJoin(F.broadcast(n)).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(per_user))))
    tries = tries.withColumn("idx", F.pmod(F.col("user_id") * 7919 + F.col("d") * 15485863 + seed, F.col("n")))
    return tries.join(items, "idx").select("user_id", "item_id").distinct().join(m, ["user_id", "item_id"], "left_anti")
