"""Gradient trainers as whole-table steps: rating factors with biases, asymmetric factors, SLIM by squared error and by pairs.

Every epoch is a few joins and grouped means, so it runs on any number of cells; nothing depends on the order of samples, and
the same input gives the same model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rank_in
from ..sources.store import checkpointed, scratch
from .factor import _dense_gram, _profiles, _solve, _start, _starts
from .packed import LOOKED_UP, Packed, Rows, best, made, pack, ranges, some_rows
from .recommend import asymmetric_user_factors
from .similarity import DIGITS
from .split import triple_sides, triples_of

#: Sides of triples whose profiles are looked up at once, weights' terms put in order at once, and terms of a target that are not held at once.
ASKED, TERMS, HOT_TERMS = 32_000, 128_000, 4_000_000


def mf_mse(m: DataFrame, factors: int = 10, epochs: int = 10, rate: float = 0.05, reg: float = 0.01, biases: bool = True, steps: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame, float]:
    """(users, items, mean) with factors[, bias] by gradient steps on the squared error of the cells, users and items in turn.

    Cells with data 0 count as they are, so sampled negatives take part. A prediction is mean + both biases + the inner product of the factors."""
    mean = (m.agg(F.avg("data")).first()[0] or 0.0) if biases else 0.0
    width = factors + 2 * biases

    def kernel(fixed: int):
        def step(y: np.ndarray, x: np.ndarray, gram: np.ndarray, old) -> np.ndarray:
            new = np.array(old)
            for _ in range(steps):
                move = y.T @ (x - mean - y @ new) / len(x) - reg * new
                if biases:
                    move[fixed] = 0.0
                new = new + rate * move
            return new

        return step

    def widened(ids: DataFrame, key: str, s: int, one: int) -> DataFrame:
        """Start factors, then the own bias and a one where the other side has its bias."""
        base = _start(ids, key, factors, s)
        if not biases:
            return checkpointed(base)
        tail = [F.lit(1.0), F.lit(0.0)] if one == 0 else [F.lit(0.0), F.lit(1.0)]
        return checkpointed(base.select(key, F.concat("factors", F.array(*tail)).alias("factors")))

    by_user, by_item = checkpointed(_profiles(m, "user_id", "item_id")), checkpointed(_profiles(m, "item_id", "user_id"))
    # a user is (factors, bias, 1), an item (factors, 1, bias)
    users, items = widened(by_user, "user_id", seed, 1), widened(by_item, "item_id", seed + 1, 0)
    for _ in range(epochs):
        users = checkpointed(_solve(by_user, "user_id", items, "item_id", kernel(width - 1), users))
        items = checkpointed(_solve(by_item, "item_id", users, "user_id", kernel(width - 2), items))
    if not biases:
        return users, items, mean
    cut = lambda t, key, at: t.select(key, F.slice("factors", 1, factors).alias("factors"), F.col("factors")[at].alias("bias"))
    return cut(users, "user_id", factors), cut(items, "item_id", factors + 1), mean


def asy_svd(m: DataFrame, factors: int = 10, epochs: int = 5, rate: float = 0.05, reg: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(profile factors, item factors): a user is the weighted sum of the profile factors of their items over the root of the profile length.

    Both tables are (item_id, factors); the squared error of the cells moves the items, then the profile factors that make the users."""
    by_item, by_user = checkpointed(_profiles(m, "item_id", "user_id")), checkpointed(_profiles(m, "user_id", "item_id"))
    items, own = checkpointed(_start(by_item, "item_id", factors, seed)), checkpointed(_start(by_item, "item_id", factors, seed + 1))

    def step(y: np.ndarray, x: np.ndarray, gram: np.ndarray, old) -> np.ndarray:
        old = np.array(old)
        return old + rate * (y.T @ (x - y @ old) / len(x) - reg * old)

    def pull(y: np.ndarray, x: np.ndarray, gram: np.ndarray, old) -> np.ndarray:
        # what the user's error asks of the sum that makes the user
        return y.T @ (x - y @ np.array(old)) / len(x)

    for _ in range(epochs):
        users = checkpointed(asymmetric_user_factors(m, own))
        items = checkpointed(_solve(by_item, "item_id", users, "user_id", step, items))
        wish = checkpointed(_solve(by_user, "user_id", items, "item_id", pull, users))
        size = m.groupBy("user_id").agg(F.sqrt(F.count("*")).alias("n"))
        parts = m.join(wish, "user_id").join(size, "user_id").select("item_id", (F.col("data") / F.col("n")).alias("c"), F.posexplode("factors").alias("p", "x"))
        move = parts.groupBy("item_id", "p").agg(F.avg(F.col("c") * F.col("x")).alias("x")).groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("g"))
        own = checkpointed(own.join(move, "item_id", "left").select("item_id", F.when(F.col("g").isNull(), F.col("factors")).otherwise(F.zip_with("factors", "g", lambda f, g: f + rate * (g - reg * f))).alias("factors")))
    return own, items


def slim_mse(m: DataFrame, epochs: int = 50, rate: float = 0.5, reg: float = 0.0, top_k: int | None = 100, block: int = 128) -> DataFrame:
    """(i, j, w): item weights by gradient steps on |X - X W|^2 / (2 n) + reg / 2 |W|^2 with a zero diagonal; tasks train blocks of columns.

    rate is a share of the largest stable step. The item x item matrix of products is dense, so the number of items is limited."""
    spark = m.sparkSession
    ids, g = _dense_gram(m)
    g = g / max(m.select("user_id").distinct().count(), 1)
    size = float(np.sqrt((g * g).sum())) + reg  # at least the largest eigenvalue
    shipped = spark.sparkContext.broadcast((ids, g))

    def run(batches):
        ids, g = shipped.value
        keep = len(ids) if top_k is None else min(top_k, len(ids))
        for b in batches:
            for start in b.column(0).to_pylist():
                own = np.arange(start, min(start + block, len(ids)))
                w = np.zeros((len(ids), len(own)))
                for _ in range(epochs):
                    w = w - rate / max(size, 1e-12) * (g @ w - g[:, own] + reg * w)
                    w[own, np.arange(len(own))] = 0.0
                order = np.argsort(-np.round(w, DIGITS), axis=0, kind="stable")[:keep]
                cells = np.take_along_axis(w, order, axis=0)
                use = cells != 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[use]]), pa.array(ids[np.tile(own, (keep, 1))[use]]), pa.array(cells[use])], names=["i", "j", "w"])

    return _starts(spark, len(ids), block).mapInArrow(run, "i long, j long, w double")


def slim_bpr(triples: DataFrame | Packed, profiles: DataFrame | Packed, epochs: int = 5, rate: float = 0.05, reg_positive: float = 0.0025, reg_negative: float = 0.00025, top_k: int | None = 100, symmetric: bool = False) -> DataFrame:
    """(i, j, w): how much item i of a profile speaks for item j, by full-batch steps over (user_id, positive, negative) triples.

    x = sum over the profile of w[l, positive] - w[l, negative]; each step moves the weights towards the positive up and towards the negative
    down by the mean over the triples that touch them. A profile's own positive is left out of its row. With `symmetric` w(i, j) = w(j, i).
    The top_k of each target are kept at the end. Profiles may be packed by user, and triples as `split.packed_triples` gives them.

    The weights of a target depend on the triples that name it and on their slopes g alone, so they are made anew in each step where these
    triples are and never stored: what stays of a step is the sum of each profile's weights towards the target, a number for each side of a
    triple, from which the next step takes g. Symmetric weights tie all targets together; they live in a table of touched pairs."""
    if symmetric:
        return _slim_bpr_symmetric(triples, profiles, epochs, rate, reg_positive, reg_negative, top_k)
    with scratch() as stay:
        own = profiles if isinstance(profiles, Packed) else stay(pack(checkpointed(profiles.select("user_id", "item_id", F.lit(1.0).alias("data"))), "user_id", "item_id"))
        sides = stay(triple_sides(triples_of(triples)))
        low, width = own.span()
        past: list[Packed] = []

        def weights(k: int, past: list[Packed]) -> Iterator[tuple]:
            """Targets of a part, and of some of them at a time: row of each weight among them, l, weight, and what gives the sums of the profiles of their cells."""
            known, before = Rows(own), [Rows(c) for c in past]
            held = [c.load(k)[3] for c in past]
            at = 0
            for keys, starts, cols, partner in some_rows(sides, k, ASKED):
                side = 1.0 - 2 * (cols & 1)
                g = [np.full(len(cols), 0.5)]
                for c, sums in zip(before, held):
                    with np.errstate(over="ignore"):
                        g.append(1 / (1 + np.exp(side * (sums[at : at + len(cols)] - _sums_of(c, partner.astype(np.int64), cols & -2)))))
                at += len(cols)
                g = g[: max(epochs, 0)]
                reg = np.where(side > 0, reg_positive, reg_negative)
                users, place = np.unique(cols >> 1, return_inverse=True)
                part, start, length = known.find(users)
                n = length[place]
                upto = np.concatenate(([0], np.cumsum(n)))
                whole = known.take(part, start, length) if length.sum() <= LOOKED_UP else None

                def profiles_of(c: int, d: int, n=n, place=place, whole=whole, part=part, start=start, length=length) -> np.ndarray:
                    """The items of the profiles of cells c to d, one after the other."""
                    if whole is not None:
                        return whole[1][ranges(whole[0][place[c:d]], n[c:d])]
                    some, again = np.unique(place[c:d], return_inverse=True)
                    first, items, _ = known.take(part[some], start[some], length[some])
                    return items[ranges(first[again], n[c:d])]

                t = 0
                while t < len(keys):
                    u = max(t + 1, int(np.searchsorted(upto[starts], upto[starts[t]] + TERMS, "right")) - 1)
                    c, d = int(starts[t]), int(starts[u])
                    some = [x[c:d] for x in g]
                    if upto[d] - upto[c] > HOT_TERMS:
                        yield keys[t:u], *_hot_target(int(keys[t]), low, width, c, upto[c : d + 1] - upto[c], profiles_of, side[c:d], reg[c:d], some, rate, LOOKED_UP)
                        t = u
                        continue
                    row = np.repeat(np.arange(u - t), np.diff(starts[t : u + 1]))
                    cell = np.repeat(np.arange(d - c), n[c:d])
                    l = profiles_of(c, d) - low
                    use = np.flatnonzero(l != (keys[t:u] - low)[row[cell]])
                    cell, l = cell[use], l[use]
                    code = row[cell] * width + l
                    order = np.argsort(code)
                    code, cell = code[order], cell[order]
                    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
                    size = np.diff(np.append(first, len(code)))
                    w = np.zeros(len(first))
                    if len(first):
                        decay = np.add.reduceat(reg[c:d][cell], first) / size
                        for x in some:
                            w = w + rate * (np.add.reduceat((x * side[c:d])[cell], first) / size - decay * w)
                    code = code[first]
                    r = code // max(1, width)
                    yield keys[t:u], r, code - r * width + low, w, lambda w=w, cell=cell, size=size, m=d - c: np.bincount(cell, np.repeat(w, size), m)
                    t = u

        def summed(k: int, past: list[Packed]) -> Iterator[tuple]:
            keys, starts, cols, _, _ = sides.load(k)
            sums = np.concatenate([found[4]() for found in weights(k, past)])
            yield np.repeat(keys, np.diff(starts)), cols.astype(np.int64), sums

        for _ in range(1, epochs):
            past.append(stay(made(sides, lambda k, past=list(past): summed(k, past))))

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                for keys, row, l, w, _ in weights(k, past):
                    use = np.flatnonzero(w != 0)
                    if top_k is not None:
                        use = use[best(row[use], np.round(w[use], DIGITS), top_k)]
                    yield pa.RecordBatch.from_arrays([pa.array(l[use]), pa.array(np.asarray(keys)[row[use]]), pa.array(w[use])], names=["i", "j", "w"])

    return sides.tasks().mapInArrow(run, "i long, j long, w double")


def _sums_of(sums: Rows, items: np.ndarray, users: np.ndarray) -> np.ndarray:
    """The data at the first column of each item's row that is not less than twice the user (`users`), by binary search in the files."""
    asked, place = np.unique(items, return_inverse=True)
    part, start, length = sums.find(asked)
    out = np.empty(len(items))
    for p in np.unique(part):
        here = np.flatnonzero(part[place] == p)
        if p not in sums.open:
            sums.open[p] = sums.packed.load(p)
        cols, data = sums.open[p][2:4]
        low, high, user = start[place[here]], (start + length)[place[here]], users[here]
        while (low < high).any():
            mid = (low + high) >> 1
            less = (low < high) & (cols[np.minimum(mid, len(cols) - 1)] < user)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        out[here] = data[low]
    return out


def _hot_target(target: int, low: int, width: int, c: int, upto: np.ndarray, profiles_of, side: np.ndarray, reg: np.ndarray, g: list, rate: float, most: int) -> tuple:
    """What `weights` gives of one target with too many terms to be held at once: they are added up piece by piece, with a place for each item."""
    cut = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], most)), len(side)))

    def pieces():
        for a, b in zip(cut[:-1], cut[1:]):
            cell, l = np.repeat(np.arange(a, b), np.diff(upto[a : b + 1])), profiles_of(c + a, c + b) - low
            use = l != target - low
            yield cell[use], l[use]

    size, decay, push = np.zeros(width), np.zeros(width), [np.zeros(width) for _ in g]
    for cell, l in pieces():
        size += np.bincount(l, minlength=width)
        decay += np.bincount(l, reg[cell], width)
        for total, x in zip(push, g):
            total += np.bincount(l, (x * side)[cell], width)
    w, n = np.zeros(width), np.maximum(size, 1)
    for total in push:
        w = w + rate * (total / n - decay / n * w)
    there = np.flatnonzero(size)
    return np.zeros(len(there), np.int64), there + low, w[there], lambda: sum(np.bincount(cell, w[l], len(side)) for cell, l in pieces())


def _slim_bpr_symmetric(triples: DataFrame | Packed, profiles: DataFrame | Packed, epochs: int, rate: float, reg_positive: float, reg_negative: float, top_k: int | None) -> DataFrame:
    if isinstance(triples, Packed):
        triples = triples.cells("user_id", "positive").select("user_id", "positive", F.col("data").cast("long").alias("negative"))
    if isinstance(profiles, Packed):
        profiles = profiles.cells("user_id", "item_id")
    t = checkpointed(triples.select("user_id", "positive", "negative").withColumn("t", F.xxhash64("user_id", "positive", "negative")))
    seen = profiles.select("user_id", F.col("item_id").alias("l"))
    touched = t.join(seen, "user_id")
    sides = touched.where("l <> positive").select("t", "l", F.col("positive").alias("j"), F.lit(1.0).alias("side")).unionByName(touched.where("l <> negative").select("t", "l", F.col("negative").alias("j"), F.lit(-1.0).alias("side")))
    sides = checkpointed(sides.select("t", F.least("l", "j").alias("l"), F.greatest("l", "j").alias("j"), "side"))
    w = None
    for _ in range(epochs):
        if w is None:
            x = t.select("t", F.lit(0.0).alias("x")).distinct()
        else:
            x = sides.join(w, ["l", "j"], "left").groupBy("t").agg(F.sum(F.col("side") * F.coalesce("w", F.lit(0.0))).alias("x"))
        pull = x.select("t", (1 / (1 + F.exp("x"))).alias("g"))
        move = sides.join(pull, "t").groupBy("l", "j").agg(F.avg(F.col("g") * F.col("side")).alias("m"), F.avg(F.when(F.col("side") > 0, reg_positive).otherwise(reg_negative)).alias("r"))
        old = move.withColumn("w", F.lit(0.0)) if w is None else move.join(w, ["l", "j"], "left").fillna(0.0, ["w"])
        w = checkpointed(old.select("l", "j", (F.col("w") + rate * (F.col("m") - F.col("r") * F.col("w"))).alias("w")))
    if w is None:
        w = sides.select("l", "j", F.lit(0.0).alias("w")).distinct()
    out = w.select(F.col("l").alias("i"), "j", "w").where("w <> 0")
    out = out.unionByName(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    if top_k is None:
        return out
    return out.withColumn("__k", rank_in(["j"], F.round("w", DIGITS).desc(), F.col("i"))).where(F.col("__k") <= top_k).drop("__k")
