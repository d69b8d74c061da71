"""Consistency checks and descriptive statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import dense_index


def density(m: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """One row: cells, users, items, density, and least, mean, median and most cells of a user."""
    per = users.join(m.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").fillna(0, ["n"])
    one = per.agg(F.count("*").alias("users"), F.sum("n").alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median"))
    return one.crossJoin(items.agg(F.count("*").alias("items"))).withColumn("density", F.col("cells") / (F.col("users") * F.col("items")))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row (gini) of a non-negative column, each value moved by 1e-7."""
    # equal values share the sum of their ranks, so only distinct values are put in order
    x, c = F.col("x"), F.col("c")
    counts = values.groupBy((F.col(column) + 1e-7).alias("x")).agg(F.count("*").alias("c"))
    before = counts.withColumn("b", F.sum("c").over(Window.orderBy("x")) - c)
    n = F.col("n")
    ranks = c * F.col("b") + c * (c + 1) / 2
    return before.crossJoin(F.broadcast(values.agg(F.count("*").alias("n")))).agg((F.sum((2 * ranks - (n + 1) * c) * x) / (F.max("n") * F.sum(c * x))).alias("gini"))


def popularity_slices(m: DataFrame) -> DataFrame:
    """(part, mean): mean interactions of the most popular tenth of items, the least popular tenth, and the tenth around the median."""
    n = dense_index(m.groupBy("item_id").agg(F.count("*").alias("n")), "n", "item_id", name="k")
    sized = n.crossJoin(F.broadcast(n.agg(F.count("*").alias("m")))).withColumn("tenth", F.floor(F.col("m") / 10))
    part = F.when(F.col("k") >= F.col("m") - F.col("tenth"), "head").when(F.col("k") < F.col("tenth"), "tail").when((F.col("k") >= F.floor(F.col("m") * 0.45)) & (F.col("k") < F.floor(F.col("m") * 0.55)), "middle")
    return sized.withColumn("part", part).where("part is not null").groupBy("part").agg(F.avg("n").alias("mean"))


def checks(m: DataFrame, items: DataFrame, users: DataFrame, parts: list[DataFrame] | None = None) -> DataFrame:
    """(check, bad): how many cells break each rule; 0 everywhere for consistent data."""
    rows = [("zero cells", m.where("data = 0")), ("repeated cells", m.groupBy("user_id", "item_id").count().where("count > 1")), ("unknown items", m.join(items, "item_id", "left_anti")), ("unknown users", m.join(users, "user_id", "left_anti"))]
    for a in range(len(parts or [])):
        for b in range(a):
            rows.append((f"shared cells {b} {a}", parts[a].select("user_id", "item_id").intersect(parts[b].select("user_id", "item_id"))))
    out = [d.agg(F.count("*").alias("bad")).select(F.lit(n).alias("check"), "bad") for n, d in rows]
    return reduce(DataFrame.union, out)


def split_report(m: DataFrame, split: DataFrame, wanted: dict[str, float], tolerance: float = 20.0) -> DataFrame:
    """(split, cells, percent, wanted, in_quota, cold_users) of a split of m; in_quota says whether it holds its share within `tolerance` per cent of it.

    cold_users counts users of a part that have no cell in the train part."""
    total = m.agg(F.count("*").alias("total"))
    names = m.sparkSession.createDataFrame(list(wanted.items()), "split string, wanted double")
    cells = split.groupBy("split").agg(F.count("*").alias("cells"))
    train = split.where("split = 'train'").select("user_id").distinct()
    cold = split.where("split <> 'train'").select("split", "user_id").distinct().join(train, "user_id", "left_anti").groupBy("split").agg(F.count("*").alias("cold_users"))
    out = names.join(cells, "split", "left").join(cold, "split", "left").fillna(0, ["cells", "cold_users"]).crossJoin(F.broadcast(total))
    share = F.col("cells") * 100.0 / F.col("total")
    return out.select("split", "cells", share.alias("percent"), "wanted", ((F.col("cells") > 0) & (F.abs(share - F.col("wanted")) <= F.col("wanted") * tolerance / 100)).alias("in_quota"), "cold_users")


def mapper_checks(m: DataFrame, mapper: DataFrame, column: str) -> DataFrame:
    """(check, bad) of an encoded matrix and its mapper (original_id, idx): repeated ids and indices, gaps, and cells outside it."""
    n = mapper.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("i"), F.countDistinct("original_id").alias("o"), F.coalesce(F.max("idx") + 1, F.lit(0)).alias("top"))
    rows = [n.select(F.lit(name).alias("check"), x.cast("long").alias("bad")) for name, x in (("repeated indices", F.col("n") - F.col("i")), ("repeated ids", F.col("n") - F.col("o")), ("gaps", F.col("top") - F.col("i")))]
    rows.append(m.join(mapper.select(F.col("idx").alias(column)), column, "left_anti").agg(F.count("*").alias("bad")).select(F.lit("unmapped cells").alias("check"), "bad"))
    return reduce(DataFrame.union, rows)


def implicit_violations(m: DataFrame) -> DataFrame:
    return m.where("data <> 1").agg(F.count("*").alias("bad"))
