"""Models that plain joins fit, scoring, and ranked recommendations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot, rank_in
from ..sources.store import checkpointed, remove, scratch
from .matrix import dense_index
from .packed import Mixed, Packed, Rows, best, dealt, made, multiply, pack, product
from .similarity import DIGITS, MANY_TERMS, top

#: Parts of the users whose scores are made.
USER_PARTS = 64


def item_scores(profiles: DataFrame, w: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score): sum of a user's data times the weights of the items; candidates restrict the targets."""
    if candidates is not None:
        w = w.join(candidates.select(F.col("item_id").alias("j")), "j", "left_semi")
    pairs = profiles.join(w.select(F.col("i").alias("item_id"), "j", "w"), "item_id")
    return pairs.groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum(F.col("data") * F.col("w")).alias("score"))


def user_scores(profiles: DataFrame, w: DataFrame) -> DataFrame:
    """Scores from users who have the user among their neighbours: row i of the weights times the profiles of j."""
    pairs = w.select("i", F.col("j").alias("user_id"), "w").join(profiles, "user_id")
    return pairs.groupBy(F.col("i").alias("user_id"), "item_id").agg(F.sum(F.col("data") * F.col("w")).alias("score"))


def ranked_product(a: Packed, b: Packed | Mixed, seen: Packed, cutoff: int = 10) -> DataFrame:
    """(user_id, item_id, rank, score): the best unseen columns of each row of A B, ties by item id; a row's scores stay in its task.

    `recommend(item_scores(profiles, w), profiles)` is A = profiles by user and B = w by i, `recommend(user_scores(profiles, w), profiles)`
    is A = w by i and B = profiles by user."""
    low, size = b.span()

    def keep(keys, row, col, total, known):
        part, start, length = known.find(np.asarray(keys))
        _, items, _ = known.take(part, start, length)
        own = np.repeat(np.arange(len(keys)), length)
        near = (items >= low) & (items < low + size)
        taken, asked = own[near] * size + items[near] - low, row * size + col - low
        use = np.flatnonzero(~np.isin(asked, taken, assume_unique=True))
        use = use[best(row[use], np.round(total[use], DIGITS), cutoff)]
        r = row[use]
        rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(keys)))[r] + 1
        return keys[r], col[use], rank.astype(np.int32), total[use]

    return multiply(a, b, keep, "user_id long, item_id long, rank int, score double", lambda: Rows(seen))


def packed_weights(w: DataFrame, like: Packed) -> Packed:
    """Weights (i, j, w) packed by i, whose ids lie as the columns of `like`."""
    return pack(w, "i", "j", "w", cells=2 * like.size(), span=like.span())


def item_lists(profiles: Packed, w: DataFrame | Packed | Mixed, cutoff: int = 10) -> DataFrame:
    """(user_id, item_id, rank, score) from item weights (i, j, w); profiles are packed by user."""
    return ranked_product(profiles, packed_weights(w, profiles) if isinstance(w, DataFrame) else w, profiles, cutoff)


def largest_row_sum(profiles: Packed, w: Packed) -> float:
    """The greatest sum of a user's absolute scores, 0 without any: `matrix_norm(scores, "inf")` where a user's scores are made.

    Without negative data and weights it is the product with the sums of the weights' rows; otherwise scores are formed, none is kept."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(x.load(k)[3].min()) for k in b.column(0).to_pylist()])], names=["least"])

    def sums(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys, starts, _, data, _ = w.load(k)
        yield np.asarray(keys), np.zeros(len(keys), np.int64), np.add.reduceat(data.astype(float), np.asarray(starts[:-1]))

    def keep(keys, row, col, total, _):
        return (np.bincount(row, np.abs(total), len(keys)).max(keepdims=True),)

    with scratch():
        below = False
        for x in (profiles, w):
            below = below or (x.tasks().mapInArrow(least, "least double").agg(F.min("least")).first()[0] or 0.0) < 0
        sized = multiply(profiles, w if below else made(w, sums), keep, "norm double")
        return sized.agg(F.max("norm")).first()[0] or 0.0


def user_lists(profiles: Packed, w: DataFrame | Packed, cutoff: int = 10) -> DataFrame:
    """(user_id, item_id, rank, score) from user weights (i, j, w), which may be packed by i; profiles are packed by user."""
    if isinstance(w, Packed):
        return ranked_product(w, profiles, profiles, cutoff)
    if not profiles.parts:
        return ranked_product(profiles, profiles, profiles, cutoff)
    low = profiles.parts[0][1]
    return ranked_product(pack(w, "i", "j", "w", cells=2 * profiles.size(), span=(low, profiles.parts[-1][2] - low + 1)), profiles, profiles, cutoff)


def factor_scores(users: DataFrame, items: DataFrame, singular: list[float] | None = None) -> DataFrame:
    """Scores of every user and item from (user_id, factors[, bias]) and (item_id, factors[, bias]); the items are the smaller, stated set."""
    i = items.withColumnRenamed("factors", "fi").withColumnRenamed("bias", "bi")
    u = users.withColumnRenamed("factors", "fu").withColumnRenamed("bias", "bu")
    if singular is not None:
        u = u.withColumn("fu", F.zip_with("fu", F.lit(singular), lambda a, b: a * b))
    grid = u.crossJoin(i)
    score = dot(F.col("fu"), F.col("fi"))
    for c in ("bi", "bu"):
        if c in grid.columns:
            score = score + F.col(c)
    return grid.select("user_id", "item_id", score.alias("score"))


def recommend(scores: DataFrame, seen: DataFrame | None = None, cutoff: int = 10, ignore: DataFrame | None = None, dense: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, rank, score): the best unseen items of each user, ties by item id.

    ignore holds items that are never shown. dense (item_id) fills short lists with items of score 0, in id order: as many
    of the first ids as can be needed are offered to each user."""
    if dense is not None:
        users = scores.select("user_id", F.lit(0).alias("n")).distinct() if seen is None else seen.groupBy("user_id").agg(F.count("*").alias("n"))
        fill = dense if ignore is None else dense.join(ignore, "item_id", "left_anti")
        zero = first_of(users, dense_index(fill.select("item_id").distinct(), "item_id", name="k"), 2 * cutoff).select("user_id", "item_id", F.lit(0.0).alias("score"))
        scores = scores.unionByName(zero).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))
    if seen is not None:
        scores = scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    if ignore is not None:
        scores = scores.join(ignore.select("item_id"), "item_id", "left_anti")
    ranked = scores.withColumn("rank", rank_in(["user_id"], F.round("score", DIGITS).desc(), F.col("item_id"))).where(F.col("rank") <= cutoff)
    return ranked.select("user_id", "item_id", "rank", "score")


def first_of(users: DataFrame, ranked: DataFrame, more: int) -> DataFrame:
    """For each user (user_id, n) the n + more first items of one ranking (k from 0): as many rows as profiles and lists have."""
    offered = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") + F.lit(more - 1))).alias("k"))
    return offered.join(ranked, "k").drop("k")


def most_popular(m: DataFrame, cutoff: int = 10) -> DataFrame:
    """(user_id, item_id, rank, score): the most popular items that a user has not seen."""
    best = dense_index(top_pop(m).withColumn("v", -F.col("score")), "v", "item_id", name="k").drop("v")
    users = m.groupBy("user_id").agg(F.count("*").alias("n"))
    return recommend(first_of(users, best, cutoff), m, cutoff)


def random_lists(m: DataFrame, items: DataFrame, cutoff: int = 10, seed: int = 42) -> DataFrame:
    """(user_id, item_id, rank): unseen items in a hashed order of each user's own.

    items is (item_id, idx) with a dense idx; a user draws their profile's length and twice the cutoff, so a list is short only where draws repeat."""
    n = items.agg(F.count("*").alias("items"))
    tries = m.groupBy("user_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 2 * cutoff)))
    drawn = tries.select("user_id", "d", F.pmod(F.col("user_id") * 7919 + F.col("d") * 15485863 + seed, F.col("items")).alias("idx")).join(items, "idx").groupBy("user_id", "item_id").agg(F.min("d").alias("d"))
    drawn = drawn.join(m.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return drawn.withColumn("rank", rank_in(["user_id"], F.col("d"))).where(F.col("rank") <= cutoff).select("user_id", "item_id", "rank")


def capped(recommendations: DataFrame, items: DataFrame, cutoff: int) -> DataFrame:
    """Lists of at most min(cutoff, items - 1) entries."""
    n = items.agg((F.count("*") - 1).alias("most"))
    return recommendations.crossJoin(F.broadcast(n)).where((F.col("rank") <= cutoff) & (F.col("rank") <= F.col("most"))).drop("most")


def candidate_pool(*lists: DataFrame) -> DataFrame:
    """(user_id, item_id, sources): the union of several recommenders' lists, with how many hold the item."""
    every = reduce(DataFrame.unionByName, [x.select("user_id", "item_id") for x in lists])
    return every.groupBy("user_id", "item_id").agg(F.count("*").alias("sources"))


def factor_top(users: DataFrame, items: DataFrame, cutoff: int = 10, seen: DataFrame | Packed | None = None, block: int = 4096) -> DataFrame:
    """(user_id, item_id, score): for each user the `cutoff` best unseen items, ties by item id.

    The items are packed by length, longest first; a task of users takes them block by block as matrices, holds the best so far and stops where
    the product of the lengths is below these. No row is made for a user and a block, and `recommend` ranks what is left. users and items
    hold (id, factors[, bias]); seen is (user_id, item_id), or packed by user and looked up."""
    packed_seen = seen if isinstance(seen, Packed) else None
    own = None if seen is None or packed_seen is not None else seen.groupBy("user_id").agg(F.collect_list("item_id").alias("seen"))
    u = users if own is None else users.join(own, "user_id", "left")
    u = u.select("user_id", "factors", F.col("bias") if "bias" in users.columns else F.lit(0.0).alias("bias"), F.col("seen") if own is not None else F.lit(None).cast("array<long>").alias("seen"))
    one = float("bias" in items.columns)
    with scratch() as stay:
        whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.concat("factors", F.array(F.col("bias") if one else F.lit(0.0))).alias("v"))
        whole = checkpointed(dense_index(whole.withColumn("n", -F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), "n", "item_id"))
        halves = F.array(F.shiftright("item_id", 32).cast("double"), F.col("item_id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))  # exact as doubles
        cells = whole.select("idx", F.posexplode(F.concat(halves, "v")).alias("k", "x"))
        table = stay(pack(cells, "idx", "k", "x", span=(0, whole.count())))
    k = cutoff

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and factors with the bias, of at most `block` items."""
        for p in range(len(table.parts)):
            keys, starts, _, data, _ = table.load(p)
            for t in range(0, len(keys), block):
                m = np.asarray(data[starts[t] : starts[min(t + block, len(keys))]], float).reshape(min(block, len(keys) - t), -1)
                yield m[:, 0].astype(np.int64) << 32 | m[:, 1].astype(np.int64), m[:, 2:]

    def found(f: np.ndarray, plus: np.ndarray, seen_row: np.ndarray, seen_item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items and scores of the best of some users."""
        least, size = np.full(len(f), -np.inf), np.sqrt((f * f).sum(axis=1)) * (1 + 1e-9)
        row, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for ids, m in blocks():
            bound = least - 10.0**-DIGITS
            on = np.flatnonzero(~(size * np.sqrt((m[0] * m[0]).sum()) + plus < bound))
            if not len(on):
                break
            s = f[on] @ m.T + plus[on, None]
            if len(seen_item):
                order, at = np.argsort(ids), np.full(len(f), -1)
                at[on] = np.arange(len(on))
                place = order[np.minimum(np.searchsorted(ids, seen_item, sorter=order), len(ids) - 1)]
                use = (ids[place] == seen_item) & (at[seen_row] >= 0)
                s[at[seen_row[use]], place[use]] = -np.inf
            bound = bound[on]
            if len(ids) > k and np.isinf(bound).any():
                bound = np.maximum(bound, np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - 10.0**-DIGITS)
            r, c = np.nonzero((s >= bound[:, None]) & np.isfinite(s))
            if len(r):
                row, item, score = np.concatenate([row, on[r]]), np.concatenate([item, ids[c]]), np.concatenate([score, s[r, c]])
                order = np.lexsort((item, -np.round(score, DIGITS), row))
                row, item, score = row[order], item[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(f)))[row]
                least[row[place == k - 1]] = score[place == k - 1]
                row, item, score = row[place < k], item[place < k], score[place < k]
        return row, item, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if packed_seen is None else Rows(packed_seen)
        for b in batches:
            order = np.argsort(b.column(0).to_numpy())
            for t in range(0, b.num_rows, 512):
                part = b.take(pa.array(order[t : t + 512]))
                ids = part.column(0).to_numpy()
                if known is not None:
                    places, start, length = known.find(ids)
                    seen_row, seen_item = np.repeat(np.arange(len(ids)), length), known.take(places, start, length)[1]
                else:
                    lists = part.column(3).fill_null([])
                    seen_row, seen_item = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
                f = np.array(part.column(1).to_pylist(), float)
                row, item, score = found(np.column_stack([f, np.full(len(f), one)]), part.column(2).to_numpy(), seen_row, seen_item)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(item), pa.array(score)], names=["user_id", "item_id", "score"])

    return u.select(F.col("user_id").cast("long").alias("user_id"), "factors", "bias", F.col("seen").cast("array<long>").alias("seen")).repartition(USER_PARTS, "user_id").mapInArrow(run, "user_id long, item_id long, score double")


def predefined(lists: DataFrame, cutoff: int) -> DataFrame:
    return lists.where(F.col("rank") <= cutoff)


def top_pop(m: DataFrame) -> DataFrame:
    """(item_id, score): how many interactions an item has."""
    return m.groupBy("item_id").agg(F.count("*").cast("double").alias("score"))


def global_effects(m: DataFrame, lambda_user: float = 10.0, lambda_item: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """Item and user biases as damped means of what the global mean (and the item bias) leaves."""
    mean = m.agg(F.avg("data").alias("mu"))
    left = m.crossJoin(F.broadcast(mean)).withColumn("r", F.col("data") - F.col("mu"))
    items = left.groupBy("item_id").agg((F.sum("r") / (F.count("*") + lambda_item)).alias("bias"))
    users = left.join(items, "item_id").groupBy("user_id").agg((F.sum(F.col("r") - F.col("bias")) / (F.count("*") + lambda_user)).alias("bias"))
    return items, users


def graph_walk(m: DataFrame, alpha: float = 1.0, beta: float = 0.0, least: float = 0.0, implicit: bool = False, normalise: bool = False, top_k: int = 100) -> DataFrame:
    """(i, j, w): three-step walks from item to item; beta > 0 divides by the popularity of the target to that power.

    Transition probabilities are raised to alpha; the top_k of each row, then of each column are kept. implicit only
    takes effect together with a least rating."""
    if least > 0:
        m = m.where(F.col("data") >= least)
        m = m.withColumn("data", F.lit(1.0)) if implicit else m
    cells = m.select(
        "user_id", "item_id",
        F.pow(F.col("data") / F.sum(F.abs("data")).over(Window.partitionBy("user_id")), F.lit(alpha)).alias("pui"),
        F.pow(1.0 / F.count("*").over(Window.partitionBy("item_id")), F.lit(alpha)).alias("piu"),
        F.pow(F.count("*").over(Window.partitionBy("item_id")).cast("double"), F.lit(-beta)).alias("damp"),
    )
    left = cells.select("user_id", F.col("item_id").alias("i"), "piu")
    right = cells.select("user_id", F.col("item_id").alias("j"), "pui", "damp")
    w = left.join(right, "user_id").where("i <> j").groupBy("i", "j").agg((F.sum(F.col("piu") * F.col("pui")) * F.max("damp")).alias("w"))
    w = top(w, top_k, by="i")
    if normalise:
        w = w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))
    return top(w, top_k, by="j")


def packed_walk(profiles: Packed, alpha: float = 1.0, beta: float = 0.0, least: float = 0.0, implicit: bool = False, normalise: bool = False, top_k: int = 100) -> Packed:
    """`graph_walk` of cells packed by user, packed by i: the task of a row i adds its walks up and keeps the top_k, so that no pair is joined."""

    def steps(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys, starts, cols, data, _ = profiles.load(k)
        key, data = np.repeat(keys, np.diff(starts)), data.astype(float)
        if least > 0:
            use = data >= least
            key, cols, data = key[use], cols[use], np.ones(int(use.sum())) if implicit else data[use]
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield key, cols, (data / np.repeat(np.add.reduceat(np.abs(data), first), np.diff(np.append(first, len(key))))) ** alpha

    def transposed(x: Packed) -> Packed:
        def make(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            keys, starts, cols, _, _ = x.load(k)
            yield cols.astype(np.int64), np.repeat(keys, np.diff(starts)), np.ones(len(cols))

        return dealt(x, lambda: make, x.span(), x.size())

    with scratch() as stay:
        by_user = made(profiles, steps)
        by_item = transposed(by_user)
        low, size = by_user.span()

        def popularity() -> np.ndarray:
            out = np.zeros(size)
            for k in range(len(by_item.parts)):
                keys, starts = by_item.load(k)[:2]
                out[keys - low] = np.diff(starts)
            return out

        def begin() -> Callable:
            rows, place, n = Rows(by_user), np.zeros(size, np.int32 if size < 2**31 else np.int64), popularity()

            def make(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                keys, starts, users, _, _ = by_item.load(k)
                for own, row, col, total in product(keys, starts, users, np.ones(len(users)), rows, low, place):
                    use = np.flatnonzero(col != own[row])
                    row, col, total = row[use], col[use], total[use]
                    w = total * (1.0 / n[own - low])[row] ** alpha * n[col - low] ** -beta
                    use = best(row, np.round(w, DIGITS), top_k)
                    row, col, w = row[use], col[use], w[use]
                    if normalise:
                        w = w / np.bincount(row, w, len(own))[row]
                    yield col, own[row], w

            return make

        def shortened(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            keys, starts, cols, data, _ = by_target.load(k)
            row = np.repeat(np.arange(len(keys)), np.diff(starts))
            use = best(row, np.round(data, DIGITS), top_k)
            yield cols[use].astype(np.int64), np.asarray(keys)[row[use]], data[use].astype(float)

        by_target = dealt(by_item, begin, (low, size), min(top_k * sum(p[3] for p in by_item.parts), MANY_TERMS * by_item.size()), lambda: [remove(x.folder) for x in (by_user, by_item)])
        return stay(dealt(by_target, lambda: shortened, (low, size), by_target.size()))


def combine_scores(first: DataFrame, second: DataFrame, alpha: float, norms: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """alpha * first + (1 - alpha) * second, each divided by its norm (one row, norm) if given."""
    parts = []
    for k, (s, a) in enumerate(((first, alpha), (second, 1 - alpha))):
        if norms is not None:
            s = s.crossJoin(F.broadcast(norms[k])).withColumn("score", F.when(F.col("norm") == 0, 0.0).otherwise(F.col("score") / F.col("norm")))
        parts.append(s.select("user_id", "item_id", (F.col("score") * a).alias("score")))
    return parts[0].unionByName(parts[1]).groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))


def asymmetric_user_factors(m: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, factors): data-weighted sum of the item factors over the root of the profile length."""
    parts = m.join(items, "item_id").select("user_id", "data", F.posexplode("factors").alias("p", "x"))
    one = parts.groupBy("user_id", "p").agg((F.sum(F.col("data") * F.col("x")) / F.sqrt(F.count("*"))).alias("x"))
    return one.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("factors"))


def user_groups(m: DataFrame, groups: int = 20) -> DataFrame:
    """(user_id, grp): users by profile length in blocks of floor(n / groups); the rest of the longest is left out."""
    n = m.groupBy("user_id").agg(F.count("*").alias("n"))
    size = n.agg(F.floor(F.count("*") / groups).alias("size"))
    ranked = dense_index(n, "n", "user_id", name="k").crossJoin(F.broadcast(size))
    return ranked.select("user_id", F.floor(F.col("k") / F.col("size")).cast("long").alias("grp")).where(F.col("grp") < groups)


def rerank_table(candidates: DataFrame, test: DataFrame, popularity: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates with a label (in the test) and features for a second-stage ranker."""
    hit = test.select("user_id", "item_id", F.lit(1).alias("hit"))
    lengths = profiles.groupBy("user_id").agg(F.count("*").alias("profile_length"))
    out = candidates.join(hit, ["user_id", "item_id"], "left").join(popularity.withColumnRenamed("score", "popularity"), "item_id", "left").join(lengths, "user_id", "left")
    return out.select("user_id", "item_id", "rank", F.coalesce("hit", F.lit(0)).cast("long").alias("label"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), F.coalesce("profile_length", F.lit(0)).cast("long").alias("profile_length"))
