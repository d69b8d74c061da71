"""Linear and factor models: joins build the sparse part, dense kernels run in Arrow batches.

A side's factors are broadcast only while rows x factors fit in BROADCAST_BYTES; beyond that they are joined to the cells and
each row gathers the factors of its own profile. Models that need a dense item x item matrix say so and refuse more than
MOST_ITEMS items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpointed, filesystem, remove, scratch
from .packed import PARTS, Packed, Rows, _folder, _written, dense_rows, made, made_together, pack, some_rows
from .similarity import normalise, similarity, top
from .split import triple_sides, triples_of

BROADCAST_BYTES = 64 << 20
MOST_ITEMS = 12_000


def _dense_gram(m: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted item ids and the item x item matrix of inner products."""
    n = m.select("item_id").distinct().count()
    if n > MOST_ITEMS:
        raise ValueError(f"{n} items: a dense item x item matrix is limited to {MOST_ITEMS}; use a neighbourhood or graph model")
    left, right = m.select("user_id", F.col("item_id").alias("i"), F.col("data").alias("x")), m.select("user_id", F.col("item_id").alias("j"), F.col("data").alias("y"))
    pairs = left.join(right, "user_id").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("d")).toArrow()
    i, j, d = (pairs.column(k).to_numpy() for k in range(3))
    ids = np.unique(i)
    a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
    g = np.zeros((len(ids), len(ids)))
    g[a, b] = d
    g[b, a] = d
    return ids, g


def ease_r(m: DataFrame, l2: float = 1000.0, top_k: int | None = None, normalise_matrix: bool = False, chunk: int = 64) -> DataFrame:
    """(i, j, w) = -P / diag(P) by column with P = inverse of the ridge Gram matrix, diagonal 0.

    One task inverts the matrix once and sends on its rows, which are its columns; the rest works on these. With normalise_matrix
    users and then items are scaled to length one first."""
    spark = m.sparkSession
    if normalise_matrix:
        m = normalise(normalise(m, "user_id", "2"), "item_id", "2")
    shipped = spark.sparkContext.broadcast(_dense_gram(m))

    def inverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            ids, g = shipped.value
            p = np.linalg.inv(g + l2 * np.eye(len(ids)))
            for k in range(0, len(ids), chunk):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, min(k + chunk, len(ids)))), pa.array(list(p[k : k + chunk]), pa.list_(pa.float64()))], names=["place", "p"])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shipped.value[0]
        keep = len(ids) if top_k is None else min(top_k, len(ids))
        for b in batches:
            for j, row in zip(b.column(0).to_pylist(), b.column(1)):
                w = row.values.to_numpy()
                w = w / -w[j]
                w[j] = 0.0
                order = np.argsort(-np.round(np.abs(w), 9), kind="stable")[:keep]
                order = order[w[order] != 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(np.full(len(order), ids[j])), pa.array(w[order])], names=["i", "j", "w"])

    rows = checkpointed(spark.range(0, 1, 1, 1).mapInArrow(inverse, "place long, p array<double>"))
    return rows.mapInArrow(columns, "i long, j long, w double")


def _starts(spark: SparkSession, n: int, block: int) -> DataFrame:
    """First columns of blocks, dealt over tasks."""
    return spark.range(0, n, block).repartition(max(1, min(64, -(-n // block))))


def pure_svd(m: DataFrame, factors: int = 50) -> tuple[DataFrame, DataFrame]:
    """(user_id, factors) with the singular values in them, and (item_id, factors), from the Gram matrix."""
    spark = m.sparkSession
    shipped = spark.sparkContext.broadcast(_dense_gram(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            ids, g = shipped.value
            value, vector = np.linalg.eigh(g)
            v = vector[:, np.argsort(-value)[: min(factors, len(ids))]]
            v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v), pa.list_(pa.float64()))], names=["item_id", "factors"])

    items = checkpointed(spark.range(0, 1, 1, 1).mapInArrow(run, "item_id long, factors array<double>"))
    return project(m, items), items


def project(m: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, factors): each user's data times the item factors."""
    n = len(items.first()["factors"])
    parts = m.join(items, "item_id")
    sums = parts.groupBy("user_id").agg(*[F.sum(F.col("data") * F.col("factors")[k]).alias(f"f{k}") for k in range(n)])
    return sums.select("user_id", F.array(*[f"f{k}" for k in range(n)]).alias("factors"))


def item_similarity_from_factors(items: DataFrame, top_k: int) -> DataFrame:
    """(i, j, w): inner products of item factors, the top_k of each column, diagonal kept."""
    a, b = items.select(F.col("item_id").alias("i"), F.col("factors").alias("x")), items.select(F.col("item_id").alias("j"), F.col("factors").alias("y"))
    w = a.crossJoin(b).select("i", "j", F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t).alias("w"))
    return top(w.where("w <> 0"), top_k)


def scaled(m: DataFrame, users: float = 1.0, items: float = 1.0) -> DataFrame:
    """m with each cell times powers of its row's and its column's number of cells."""
    u = m.groupBy("user_id").agg(F.pow(F.count("*") + F.lit(1e-6), F.lit(users)).alias("fu"))
    i = m.groupBy("item_id").agg(F.pow(F.count("*") + F.lit(1e-6), F.lit(items)).alias("fi"))
    return m.join(u, "user_id").join(i, "item_id").select("user_id", "item_id", (F.col("data") * F.col("fu") * F.col("fi")).alias("data"))


def _profiles(m: DataFrame, key: str, other: str) -> DataFrame:
    """(key, ids, data): one row per user or item with what it is linked to."""
    cells = m.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("o"), F.col("data").alias("x")))).alias("c"))
    return cells.select(key, F.transform("c", lambda s: s["o"]).alias("ids"), F.transform("c", lambda s: s["x"]).alias("data"))


def _solve(profiles: DataFrame, key: str, other: DataFrame, other_key: str, kernel: Callable, own: DataFrame | None = None) -> DataFrame:
    """(key, factors) from kernel(factors of the profile, data, gram of all other factors, own old factors)."""
    spark = profiles.sparkSession
    width = len(other.first()["factors"])
    n = other.count()
    gram = np.zeros((width, width))
    for r in other.mapInArrow(_partial_gram, "g array<double>").collect():  # one small matrix per task
        gram += np.array(r[0]).reshape(width, width)
    if own is not None:
        profiles = profiles.join(own, key)
    has_own = own is not None
    schema = f"{key} long, factors array<double>"
    if n * width * 8 <= BROADCAST_BYTES:
        t = other.select(other_key, "factors").toArrow()
        ids = t.column(0).to_numpy()
        order = np.argsort(ids)
        table = np.array(t.column(1).to_pylist())[order] if n else np.zeros((0, width))
        shipped = spark.sparkContext.broadcast((ids[order], table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, table = shipped.value
            for b in batches:
                old = b.column(3).to_pylist() if has_own else [None] * b.num_rows
                out = [kernel(table[np.searchsorted(ids, b.column(1)[r].values.to_numpy())], b.column(2)[r].values.to_numpy(), gram, old[r]) for r in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "factors"])

        return profiles.mapInArrow(run, schema)
    cells = profiles.select(key, F.explode(F.arrays_zip("ids", "data")).alias("c"), *(["factors"] if has_own else []))
    cells = cells.select(key, F.col("c.ids").alias("o"), F.col("c.data").alias("x"), *([F.col("factors").alias("old")] if has_own else []))
    joined = cells.join(other.select(F.col(other_key).alias("o"), F.col("factors").alias("f")), "o")
    rows = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "x", "f"))).alias("c"), *([F.first("old").alias("old")] if has_own else []))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(2).to_pylist() if has_own else [None] * b.num_rows
            out = []
            for r in range(b.num_rows):
                c = b.column(1)[r].as_py()
                out.append(kernel(np.array([s["f"] for s in c]), np.array([s["x"] for s in c]), gram, old[r]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "factors"])

    return rows.mapInArrow(run_joined, schema)


def _partial_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        x = np.array(b.column(b.schema.get_field_index("factors")).to_pylist())
        if len(x):
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])


def _start(ids: DataFrame, key: str, width: int, seed: int, positive: bool = False) -> DataFrame:
    """Reproducible small factors from hashes of id and place."""
    unit = lambda k: F.pmod(F.xxhash64(F.col(key), F.lit(seed), k), F.lit(1_000_003)) / F.lit(1_000_003.0)
    value = (lambda k: unit(k) + 0.01) if positive else (lambda k: (unit(k) - 0.5) * 0.2)
    return ids.select(F.col(key).cast("long").alias(key), F.transform(F.sequence(F.lit(1), F.lit(width)), value).alias("factors"))


def _start_packed(like: Packed, key: str, width: int, seed: int, positive: bool = False) -> Packed:
    """The factors of `_start` for the rows of a packed matrix, written where the rows are."""
    folder = _folder(like.spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                own = np.asarray(like.load(k)[0])
                for t in range(0, len(own), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(own[t : t + 10_000])], names=[key])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = filesystem(folder)
        disk.create_dir(top, recursive=True)
        for b in batches:
            if b.num_rows:
                yield _written(disk, top, *_cells(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, width)))

    parts = _start(like.tasks().mapInArrow(keys, f"{key} long"), key, width, seed, positive).mapInArrow(write, PARTS).collect()
    return Packed(folder, sorted((tuple(p) for p in parts), key=lambda p: p[1]), like.spark)


def _cells(keys: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, columns and data of dense rows."""
    return np.repeat(keys, factors.shape[1]), np.tile(np.arange(factors.shape[1]), len(keys)), factors.ravel()


def _factors(x: Packed, key: str, width: int) -> DataFrame:
    """(key, factors) of packed factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                keys, _, _, data, _ = x.load(k)
                for t in range(0, len(keys), 10_000):
                    own = np.asarray(keys[t : t + 10_000])
                    flat = pa.array(data[t * width : (t + len(own)) * width].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)], names=[key, "factors"])

    return x.tasks().mapInArrow(run, f"{key} long, factors array<double>")


def _gram(x: Packed, width: int) -> np.ndarray:
    """Inner products of the columns of packed factors; one small matrix comes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                f = x.load(k)[3].astype(float).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array([(f.T @ f).ravel()], pa.list_(pa.float64()))], names=["g"])

    return np.sum([r[0] for r in x.tasks().mapInArrow(run, "g array<double>").collect()] or [np.zeros(width * width)], axis=0).reshape(width, width)


def _step(by: Packed, other: Packed, width: int, kernel: Callable, own: Packed | None = None) -> Packed:
    """New factors of the rows of `by` from kernel(factors of all cells, data, starts of the rows, gram of all other factors, old factors).

    A task looks up the factors that its rows name, so no factors are shuffled or sent to all tasks."""
    gram = _gram(other, width)

    def make(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, before, out = Rows(other), None if own is None else Rows(own), []
        for keys, starts, cols, data in some_rows(by, k):
            old = None if before is None else dense_rows(before, keys, width)
            out.append(_cells(keys, kernel(dense_rows(rows, cols, width), data, starts, gram, old)))
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))

    return made(by, make)


def _alternate(m: DataFrame | Packed, factors: int, epochs: int, kernel: Callable, seed: int, positive: bool) -> tuple[DataFrame, DataFrame]:
    """(user_id, factors) and (item_id, factors) after steps of the users and the items in turn; m is (user_id, item_id, data), or packed by user."""
    with scratch() as stay:
        by_user = m if isinstance(m, Packed) else pack(checkpointed(m), "user_id", "item_id")
        by_item = pack(by_user.cells("user_id", "item_id"), "item_id", "user_id", cells=by_user.size(), span=by_user.span())
        users, items = _start_packed(by_user, "user_id", factors, seed, positive), _start_packed(by_item, "item_id", factors, seed + positive, positive)
        for _ in range(epochs):
            old, users = users, _step(by_user, items, factors, kernel, users if positive else None)
            remove(old.folder)
            old, items = items, _step(by_item, users, factors, kernel, items if positive else None)
            remove(old.folder)
        stay(users), stay(items)
    return _factors(users, "user_id", factors), _factors(items, "item_id", factors)


def ials(m: DataFrame | Packed, factors: int = 20, epochs: int = 5, alpha: float = 1.0, reg: float = 1e-3, scaling: str = "linear", epsilon: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Implicit alternating least squares: every cell is a preference of 1 with confidence from its data."""

    def kernel(y: np.ndarray, x: np.ndarray, starts: np.ndarray, gram: np.ndarray, _old) -> np.ndarray:
        c = 1 + alpha * x if scaling == "linear" else 1 + alpha * np.log(1 + x / epsilon)
        side = np.add.reduceat(y * c[:, None], starts[:-1])
        a = np.stack([row.T @ (row * w[:, None]) for row, w in ((y[s:t], c[s:t] - 1) for s, t in zip(starts[:-1], starts[1:]))])
        return np.linalg.solve(a + gram + reg * np.eye(len(gram)), side[:, :, None])[:, :, 0]

    return _alternate(m, factors, epochs, kernel, seed, False)


def nmf(m: DataFrame | Packed, factors: int = 10, epochs: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors by multiplicative updates of the squared error."""

    def kernel(y: np.ndarray, x: np.ndarray, starts: np.ndarray, gram: np.ndarray, old: np.ndarray) -> np.ndarray:
        return old * np.add.reduceat(y * x[:, None], starts[:-1]) / np.maximum(old @ gram, 1e-12)

    return _alternate(m, factors, epochs, kernel, seed, True)


def slim_elastic_net(m: DataFrame, l1_ratio: float = 0.1, alpha: float = 1.0, positive: bool = True, top_k: int = 100, steps: int = 60, block: int = 128) -> DataFrame:
    """(i, j, w): per item an elastic net on all other items, by accelerated proximal steps on the Gram matrix.

    Objective: |y - X w|^2 / (2 n) + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) / 2 * |w|^2 with w_j = 0 for itself."""
    spark = m.sparkSession
    ids, g = _dense_gram(m)
    n = max(m.select("user_id").distinct().count(), 1)
    g = g / n
    size = float(np.sqrt((g * g).sum())) + alpha * (1 - l1_ratio)  # at least the largest eigenvalue
    shipped = spark.sparkContext.broadcast((ids, g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, g = shipped.value
        for b in batches:
            for start in b.column(0).to_pylist():
                own = np.arange(start, min(start + block, len(ids)))
                y = g[:, own]
                w = np.zeros((len(ids), len(own)))
                ahead, t = w, 1.0
                for _ in range(steps):
                    step = ahead - (g @ ahead - y + alpha * (1 - l1_ratio) * ahead) / size
                    new = np.sign(step) * np.maximum(np.abs(step) - alpha * l1_ratio / size, 0)
                    if positive:
                        new = np.maximum(new, 0)
                    new[own, np.arange(len(own))] = 0
                    t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
                    ahead, w = new + (before - 1) / t * (new - w), new
                order = np.argsort(-np.abs(w), axis=0, kind="stable")[:top_k]
                cells = np.take_along_axis(w, order, axis=0)
                use = cells != 0
                j = np.tile(own, (len(order), 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[use]]), pa.array(ids[j[use]]), pa.array(cells[use])], names=["i", "j", "w"])

    return _starts(spark, len(ids), block).mapInArrow(run, "i long, j long, w double")


def cfw_d(cf: DataFrame, icm: DataFrame, damp: float = 0.0, top_k: int = 300) -> tuple[DataFrame, DataFrame]:
    """Feature weights that best explain a collaborative similarity by common features, and the similarity they give.

    The normal equations are joins; only their features x features matrix comes to the driver."""
    spark = cf.sparkSession
    left = icm.select(F.col("item_id").alias("i"), "feature_id", F.col("data").alias("x"))
    right = icm.select(F.col("item_id").alias("j"), "feature_id", F.col("data").alias("y"))
    rows = cf.join(left, "i").join(right, ["j", "feature_id"]).select("i", "j", "feature_id", (F.col("x") * F.col("y")).alias("x"), F.col("w").alias("s"))
    rows = checkpointed(rows)
    a = rows.select("i", "j", F.col("feature_id").alias("f"), "x").join(rows.select("i", "j", F.col("feature_id").alias("g"), F.col("x").alias("y")), ["i", "j"])
    gram = a.groupBy("f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("v")).collect()
    side = rows.groupBy("feature_id").agg(F.sum(F.col("x") * F.col("s")).alias("v")).collect()
    names = sorted(r[0] for r in side)
    place = {f: k for k, f in enumerate(names)}
    left_side, right_side = damp**2 * np.eye(len(names)), np.zeros(len(names))
    for f, g, v in gram:
        left_side[place[f], place[g]] += v
    for f, v in side:
        right_side[place[f]] = v
    found = np.linalg.lstsq(left_side, right_side, rcond=None)[0]
    weights = spark.createDataFrame([(f, float(w)) for f, w in zip(names, found)], "feature_id string, weight double")
    cells = icm.select(F.col("feature_id").alias("row"), F.col("item_id").alias("col"), "data")
    return weights, similarity(cells, normalize=False, top_k=top_k, row_weights=weights.withColumnRenamed("feature_id", "row"))


def factorization_machine(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Predictions of a second-order factorization machine."""
    return w0 + x @ w + 0.5 * ((x @ v) ** 2 - (x**2) @ (v**2)).sum(axis=1)


def bpr_factors(triples: DataFrame | Packed, factors: int = 10, epochs: int = 300, rate: float = 0.05, reg: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Pairwise ranking factors by full-batch gradient steps over (user_id, positive, negative) triples, which may be packed (`split.packed_triples`).

    A task of users or of items looks up the factors that its triples name; each triple is weighed on both sides, so nothing is sent between them and
    an epoch is one job. Fewer than some hundred epochs leave the factors near their hashed start."""

    def slope(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(x))

    def moved(old: np.ndarray, push: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return old + rate * (np.add.reduceat(push, starts[:-1]) / np.diff(starts)[:, None] - reg * old)

    with scratch() as stay:
        by_user = triples_of(triples)
        by_item = triple_sides(by_user)
        users, items = _start_packed(by_user, "user_id", factors, seed), _start_packed(by_item, "item_id", factors, seed + 1)
        for _ in range(epochs):

            def of_users(k: int, users=users, items=items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                own, other, out = Rows(users), Rows(items), []
                for keys, starts, positive, negative in some_rows(by_user, k):
                    old = dense_rows(own, keys, factors)
                    d = dense_rows(other, positive, factors) - dense_rows(other, negative.astype(np.int64), factors)
                    g = slope((np.repeat(old, np.diff(starts), axis=0) * d).sum(axis=1))
                    out.append(_cells(keys, moved(old, d * g[:, None], starts)))
                if out:
                    yield tuple(np.concatenate(c) for c in zip(*out))

            def of_items(k: int, users=users, items=items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                own, other, out = Rows(items), Rows(users), []
                for keys, starts, cols, partner in some_rows(by_item, k):
                    old, side = dense_rows(own, keys, factors), 1.0 - 2 * (cols & 1)
                    u = dense_rows(other, cols >> 1, factors) * side[:, None]
                    g = slope((u * (np.repeat(old, np.diff(starts), axis=0) - dense_rows(own, partner.astype(np.int64), factors))).sum(axis=1))
                    out.append(_cells(keys, moved(old, u * g[:, None], starts)))
                if out:
                    yield tuple(np.concatenate(c) for c in zip(*out))

            before = users, items
            users, items = made_together((by_user, of_users), (by_item, of_items))
            for x in before:
                remove(x.folder)
        stay(users), stay(items)
    return _factors(users, "user_id", factors), _factors(items, "item_id", factors)
