"""Ranking and diversity metrics per cutoff.

Lists are made once for the largest cutoff; every cutoff is a filter on the rank. All means are over the evaluated
users, those with a test item; counts of items and users come from dimension tables, so cold ones count too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rank_in
from ..sources.store import checkpointed, release
from .packed import Packed, Rows, pack, ranges


def _cuts(spark: SparkSession, cutoffs: list[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c,) for c in cutoffs], "cutoff int"))


def accuracy(recommendations: DataFrame, test: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One row per cutoff with the accuracy metrics."""
    spark = test.sparkSession
    sizes = test.groupBy("user_id").agg(F.count("*").alias("t"))
    gains = test.withColumn("r", rank_in(["user_id"], F.col("data").desc(), F.col("item_id"))).withColumn("g", (F.pow(F.lit(2.0), "data") - 1) / F.log2(F.col("r") + 1))
    hits = recommendations.join(test.select("user_id", "item_id", F.col("data").alias("value")), ["user_id", "item_id"], "left")
    line = Window.partitionBy("user_id").orderBy("rank")
    hits = hits.withColumn("rel", F.col("value").isNotNull().cast("int")).withColumn("found", F.sum("rel").over(line))
    cuts = _cuts(spark, cutoffs)
    per = hits.join(cuts, F.col("rank") <= F.col("cutoff")).groupBy("cutoff", "user_id").agg(
        F.count("*").alias("l"), F.sum("rel").alias("h"), F.sum(F.col("rel") * F.col("found") / F.col("rank")).alias("ap"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.col("rank")).alias("arhr"), F.sum(F.when(F.col("rel") == 1, (F.pow(F.lit(2.0), "value") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = gains.join(cuts, F.col("r") <= F.col("cutoff")).groupBy("cutoff", "user_id").agg(F.sum("g").alias("idcg"))
    users = sizes.crossJoin(cuts).join(per, ["cutoff", "user_id"], "left").join(ideal, ["cutoff", "user_id"], "left").fillna(0, ["l", "h", "ap", "arhr", "dcg"])
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    l, h, t = F.col("l"), F.col("h"), F.col("t")
    out = users.groupBy("cutoff").agg(
        F.avg(safe(h, l)).alias("precision"), F.avg(safe(h, F.least(l, t))).alias("precision_min_den"), F.avg(h / t).alias("recall"), F.avg(safe(F.col("ap"), l)).alias("map"),
        F.avg(safe(F.col("ap"), F.least(l, t))).alias("map_min_den"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(safe(F.col("dcg"), F.col("idcg"))).alias("ndcg"),
        F.avg((h > 0).cast("int")).alias("hit_rate"), F.avg("arhr").alias("arhr_all_hits"), F.count("*").alias("users"),
    )
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def beyond_accuracy(recommendations: DataFrame, test: DataFrame, train: DataFrame, items: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One row per cutoff with novelty, popularity, coverage and diversity; items and users are the dimensions."""
    spark = test.sparkSession
    cuts = _cuts(spark, cutoffs)
    popularity = train.groupBy("item_id").agg(F.count("*").alias("p"))
    totals = popularity.agg(F.sum("p").alias("sum_p"), F.max("p").alias("max_p"))
    n_items, n_users = items.agg(F.count("*").alias("n_items")), users.agg(F.count("*").alias("n_users"))
    evaluated = test.select("user_id").distinct()
    dims = totals.crossJoin(n_items).crossJoin(n_users).crossJoin(evaluated.agg(F.count("*").alias("e"))).crossJoin(test.agg(F.countDistinct("item_id").alias("gt_items")))
    listed = recommendations.join(evaluated, "user_id", "left_semi").join(cuts, F.col("rank") <= F.col("cutoff"))
    listed = listed.join(popularity, "item_id", "left").join(test.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left").crossJoin(F.broadcast(dims))
    per_user = listed.groupBy("cutoff", "user_id").agg(
        F.sum(F.coalesce(-F.log2(F.col("p") / F.col("sum_p")), F.lit(0.0)) / F.col("n_items")).alias("novelty"), F.avg(F.coalesce("p", F.lit(0)) / F.col("max_p")).alias("pop"), F.max(F.coalesce("hit", F.lit(0))).alias("hit"),
    )
    by_user = per_user.groupBy("cutoff").agg(F.sum("novelty").alias("novelty"), F.sum("pop").alias("pop"), F.count("*").alias("u"), F.sum("hit").alias("uh"))
    counts = listed.groupBy("cutoff", "item_id").agg(F.count("*").alias("c"), F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    with_zero = items.select("item_id").crossJoin(cuts).join(counts, ["cutoff", "item_id"], "left").fillna(0, ["c", "hit"])
    # items with the same count share their ranks, so only distinct counts are put in order
    same = with_zero.groupBy("cutoff", "c").agg(F.count("*").alias("k"), F.sum("hit").alias("hit"))
    total = Window.partitionBy("cutoff")
    same = same.withColumn("before", F.sum("k").over(total.orderBy("c")) - F.col("k")).withColumn("n", F.sum("k").over(total)).withColumn("s", F.sum(F.col("c") * F.col("k")).over(total))
    share, k = F.col("c") / F.col("s"), F.col("k")
    ranks = k * F.col("before") + k * (k + 1) / 2
    by_item = same.groupBy("cutoff").agg(
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("ci"), F.sum("hit").alias("cih"), (2 * F.sum((k * (F.col("n") + 1) - ranks) / (F.col("n") + 1) * share)).alias("gini"),
        (1 - F.sum(k * share * share)).alias("herfindahl"), F.sum(F.when(F.col("c") > 0, -k * share * F.log2(share)).otherwise(0.0)).alias("entropy"), F.sum(k * F.col("c") * F.col("c")).alias("sq"),
    )
    out = by_user.join(by_item, "cutoff").crossJoin(F.broadcast(dims))
    e, k = F.col("e"), F.col("cutoff")
    return out.select(
        "cutoff", (F.col("novelty") / e).alias("novelty"), (F.col("pop") / e).alias("average_popularity"), (F.col("ci") / F.col("n_items")).alias("coverage_item"), (F.col("cih") / F.col("n_items")).alias("coverage_item_hit"),
        (F.col("gt_items") / F.col("n_items")).alias("items_in_gt"), (e / F.col("n_users")).alias("users_in_gt"), (F.col("u") / F.col("n_users")).alias("coverage_user"), (F.col("uh") / F.col("n_users")).alias("coverage_user_hit"),
        F.col("gini").alias("diversity_gini"), F.col("herfindahl").alias("diversity_herfindahl"), F.col("entropy").alias("shannon_entropy"),
        (1 - ((F.col("sq") - e * k) / k) / (e * e - e)).alias("diversity_mean_inter_list"),
    )


def train_reference(train: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """One row: the diversity metrics of the train profiles, the denominators of the ratios."""
    popularity = train.groupBy("item_id").agg(F.count("*").alias("p"))
    dims = popularity.agg(F.sum("p").alias("sum_p"), F.max("p").alias("max_p")).crossJoin(items.agg(F.count("*").alias("n_items"))).crossJoin(users.agg(F.count("*").alias("n_users")))
    cells = train.join(popularity, "item_id").crossJoin(F.broadcast(dims))
    per = cells.groupBy("user_id").agg(F.sum(-F.log2(F.col("p") / F.col("sum_p")) / F.col("n_items")).alias("novelty"), F.avg(F.col("p") / F.col("max_p")).alias("pop"), F.max("n_users").alias("n_users"))
    by_user = per.agg((F.sum("novelty") / F.max("n_users")).alias("novelty"), (F.sum("pop") / F.max("n_users")).alias("average_popularity"))
    same = items.select("item_id").join(popularity, "item_id", "left").fillna(0, ["p"]).groupBy("p").agg(F.count("*").alias("k"))
    same = same.withColumn("before", F.sum("k").over(Window.orderBy("p")) - F.col("k")).crossJoin(F.broadcast(dims))  # one row for each popularity
    share, k = F.col("p") / F.col("sum_p"), F.col("k")
    ranks = k * F.col("before") + k * (k + 1) / 2
    by_item = same.agg(
        (2 * F.sum((k * (F.col("n_items") + 1) - ranks) / (F.col("n_items") + 1) * share)).alias("diversity_gini"), (1 - F.sum(k * share * share)).alias("diversity_herfindahl"),
        F.sum(F.when(F.col("p") > 0, -k * share * F.log2(share)).otherwise(0.0)).alias("shannon_entropy"),
    )
    # computed at once, so that the shuffles of the profiles are gone before those of the lists are written
    out = by_user.crossJoin(by_item)
    row, schema = out.collect(), out.schema
    del out
    release(train.sparkSession)
    return train.sparkSession.createDataFrame(row, schema)


def ratios(beyond: DataFrame, reference: DataFrame) -> DataFrame:
    """Metric of the lists over that of the train profiles."""
    names = ["novelty", "average_popularity", "diversity_gini", "diversity_herfindahl", "shannon_entropy"]
    ref = reference.select(*[F.col(n).alias(f"ref_{n}") for n in names])
    return beyond.crossJoin(F.broadcast(ref)).select("cutoff", *[(F.col(n) / F.col(f"ref_{n}")).alias(f"ratio_{n}") for n in names])


def list_diversity(recommendations: DataFrame, diversity: DataFrame | Packed, cutoff: int) -> DataFrame:
    """(user_id, diversity): mean over the ordered pairs in a list, diversity (i, j, w) missing cells being 0; 0 for one item.

    The last item of a list gives no pairs of its own, yet the mean is over all ordered pairs. A list looks up the rows of its items
    (diversity is packed by i, or will be), so no pair is shuffled; a list is a row of ranks."""
    w = diversity if isinstance(diversity, Packed) else pack(checkpointed(diversity), "i", "j", "w")
    lists = pack(recommendations.where(F.col("rank") <= cutoff), "user_id", "item_id", "rank")

    def run(batches):
        for batch in batches:
            rows = Rows(w)
            for k in batch.column(0).to_pylist():
                keys, starts, items, ranks, _ = lists.load(k)
                for t in range(0, len(keys), 1024):
                    own = starts[t : t + 1025]
                    ids, size = items[own[0] : own[-1]].astype(np.int64), np.diff(own)
                    user = np.repeat(np.arange(len(size)), size)
                    asked, place = np.unique(ids, return_inverse=True)
                    part, start, length = rows.find(asked)
                    first, cols, data = rows.take(part, start, length)
                    use = np.flatnonzero(ranks[own[0] : own[-1]] < size[user])
                    at, n = ranges(first[place[use]], length[place[use]]), length[place[use]]
                    # the terms of other items of the same list
                    near = np.minimum(np.searchsorted(asked, cols[at]), len(asked) - 1)
                    code, have = np.repeat(user[use], n) * len(asked) + near, np.sort(user * len(asked) + place)
                    there = (asked[near] == cols[at]) & (have[np.minimum(np.searchsorted(have, code), len(have) - 1)] == code) & (np.repeat(ids[use], n) != cols[at])
                    total = np.bincount(np.repeat(user[use], n)[there], data[at][there], len(size))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(keys[t : t + 1024])), pa.array(total / np.maximum(size * (size - 1), 1))], names=["user_id", "diversity"])

    return lists.tasks().mapInArrow(run, "user_id long, diversity double")


def restrict_to(scores: DataFrame, test: DataFrame, negatives: DataFrame) -> DataFrame:
    """Scores of the test items and sampled negatives of each user only."""
    allowed = test.select("user_id", "item_id").union(negatives.select("user_id", "item_id")).distinct()
    return scores.join(allowed, ["user_id", "item_id"], "left_semi")


def prune_users(test: DataFrame, least: int = 1, ignore_items: DataFrame | None = None, ignore_users: DataFrame | None = None) -> DataFrame:
    """Test cells without ignored items and users, of users with at least `least` cells."""
    if ignore_items is not None:
        test = test.join(ignore_items, "item_id", "left_anti")
    if ignore_users is not None:
        test = test.join(ignore_users, "user_id", "left_anti")
    return test.withColumn("__n", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("__n") >= least).drop("__n")


def format_table(table: DataFrame, digits: int = 7) -> DataFrame:
    return table.select("cutoff", *[F.format_number(c, digits).alias(c) for c in table.columns if c != "cutoff"])


def evaluate(recommendations: DataFrame, test: DataFrame, train: DataFrame, items: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """All metrics of one run, a row per cutoff."""
    beyond = beyond_accuracy(recommendations, test, train, items, users, cutoffs)
    return accuracy(recommendations, test, cutoffs).join(beyond, "cutoff").join(ratios(beyond, train_reference(train, items, users)), "cutoff")
