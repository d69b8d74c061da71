"""Column similarities of sparse matrices, feature weighting and top-k.

The product of a matrix with its transpose is formed from packed files (`packed.py`): the task that holds a target column looks up
the rows that it lies in, and sends on the best of what it adds up. A row with l cells makes l*l terms, none of which is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rank_in
from ..sources.store import checkpointed, remove, scratch
from .packed import Light, Packed, Rows, best, made, multiply, pack, product, ranges, scaled_rows, some_rows, turned

EPSILON = 1e-6
#: Weights are ranked after rounding, so that the order of summation decides no tie.
DIGITS = 9


INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Columns with so many places between the least and the greatest id may be as sparse as they are: a task keeps 12 bytes for each place.
DENSE_SPAN = 1 << 22
#: A matrix whose product has so many terms a cell is of long rows: its equal columns are put together first.
MANY_TERMS = 500
#: In such a matrix, rows of more cells are long and bounded instead of multiplied, if they hold no more cells than LONG_CELLS; and columns of them looked at at once.
LONG_ROW, LONG_CELLS, LOOKED_AT = 4 * MANY_TERMS, 1 << 23, 500_000
#: Rows with more cells are split before their pairs are formed.
HOT_ROW = 512


def idf(m: DataFrame, n_rows: DataFrame, smoothed: bool = True) -> DataFrame:
    """(col, idf): ln(N / (1 + df)), or ln(N / df) if not smoothed; n_rows has one row (n)."""
    df = m.groupBy("col").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_rows))
    return df.select("col", F.log(F.col("n") / (F.col("df") + F.lit(1 if smoothed else 0))).alias("idf"))


def extreme_features(m: DataFrame, n_rows: DataFrame, k: int) -> DataFrame:
    """(end, rank, col, idf): the k features with the highest and the k with the lowest un-smoothed IDF, ties by feature."""
    table = idf(m, n_rows, smoothed=False).withColumn("v", F.round("idf", DIGITS))
    out = []
    for end, order in (("highest", F.col("v").desc()), ("lowest", F.col("v").asc())):
        best = table.orderBy(order, "col").limit(k)
        out.append(best.select(F.lit(end).alias("end"), F.row_number().over(Window.orderBy(order, "col")).cast("long").alias("rank"), "col", "idf"))
    return out[0].unionByName(out[1])


def weighted_profiles(m: DataFrame, kind: str, n_items: DataFrame, by: str = "item_id") -> DataFrame:
    """Interactions whose data are replaced by TF-IDF or BM25 weights, with the rows of the weighting on the `by` side; both fit and scoring use them."""
    other = "user_id" if by == "item_id" else "item_id"
    cells = m.select(F.col(by).alias("row"), F.col(other).alias("col"), "data")
    out = {"TF-IDF": tf_idf, "BM25": bm25}[kind](cells, n_items)
    return out.select(F.col("row").alias(by), F.col("col").alias(other), "data").select("user_id", "item_id", "data")


def normalise(m: DataFrame, by: str, kind: str = "2") -> DataFrame:
    """Data divided by the L1 or L2 norm of their row or column; rows of norm 0 stay."""
    x = F.sum(F.abs("data") if kind == "1" else F.col("data") * F.col("data")).over(Window.partitionBy(by))
    size = x if kind == "1" else F.sqrt(x)
    return m.withColumn("data", F.when(size == 0, F.col("data")).otherwise(F.col("data") / size))


def select_features(weights: DataFrame, quota: float, absolute: bool = False) -> DataFrame:
    """The floor(quota * n) features (feature_id, weight) of greatest weight, ties by feature."""
    from .matrix import dense_index

    value = F.round(F.abs("weight") if absolute else F.col("weight"), DIGITS)
    n = weights.agg(F.floor(F.count("*") * F.lit(quota)).alias("n"))
    ranked = dense_index(weights.withColumn("v", -value), "v", "feature_id", name="k").crossJoin(F.broadcast(n))
    return ranked.where("k < n").select("feature_id", "weight")


def shared_features(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, common, either): features that both items of a pair (i, j) have, and that one of them has, in order."""
    lists = features.groupBy("item_id").agg(F.array_sort(F.collect_set("feature_id")).alias("f"))
    both = pairs.join(lists.select(F.col("item_id").alias("i"), F.col("f").alias("a")), "i", "left").join(lists.select(F.col("item_id").alias("j"), F.col("f").alias("b")), "j", "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    return both.select("i", "j", F.array_sort(F.array_intersect(a, b)).alias("common"), F.array_sort(F.array_union(a, b)).alias("either"))


def tf_idf(m: DataFrame, n_rows: DataFrame) -> DataFrame:
    """sqrt(x) * ln(N / (1 + df)); n_rows has one row (n), which counts empty rows too."""
    df = m.groupBy("col").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_rows)).select("col", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))
    return m.join(df, "col").select("row", "col", (F.sqrt("data") * F.col("idf")).alias("data"))


def bm25(m: DataFrame, n_rows: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 weights; the mean length is over all rows."""
    df = m.groupBy("col").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_rows)).select("col", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))
    total = m.agg(F.sum("data").alias("total")).crossJoin(n_rows).select((F.col("total") / F.col("n")).alias("mean"))
    sized = m.withColumn("length", F.sum("data").over(Window.partitionBy("row"))).crossJoin(F.broadcast(total))
    below = k1 * ((1 - b) + b * F.col("length") / F.col("mean")) + F.col("data")
    below = F.when(below == 0, F.lit(1e-9)).otherwise(below)
    return sized.join(df, "col").select("row", "col", (F.col("data") * (k1 + 1) / below * F.col("idf")).alias("data"))


def centred(m: DataFrame, by: str) -> DataFrame:
    """m minus the mean of the cells of each row or column."""
    return m.withColumn("data", F.col("data") - F.avg("data").over(Window.partitionBy(by)))


def _pairs(m: DataFrame, norm, row_weights: DataFrame | None) -> DataFrame:
    """(i, j, ni, nj, d) for i < j.

    A row with more than HOT_ROW cells is cut into parts by the column: each cell meets every part as the smaller column and
    lies in one as the greater, so a hot row is as many join keys as it has parts."""
    cells = m.select("row", "col", "data", norm.alias("norm"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("row")) / HOT_ROW).cast("int")
    cells = cells.withColumn("parts", parts)
    left = cells.select("row", F.col("col").alias("i"), F.col("data").alias("x"), F.col("norm").alias("ni"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    if row_weights is not None:
        left = left.join(row_weights, "row").select("row", "part", "i", (F.col("x") * F.col("weight")).alias("x"), "ni")
    right = cells.select("row", F.pmod(F.xxhash64("col"), F.col("parts")).cast("int").alias("part"), F.col("col").alias("j"), F.col("data").alias("y"), F.col("norm").alias("nj"))
    return left.join(right, ["row", "part"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.max("ni").alias("ni"), F.max("nj").alias("nj"))


def _numbered(m: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """m with dense numbers in place of a column's values, and (column, idx)."""
    from .matrix import dense_index

    names = checkpointed(dense_index(m.select(column).where(F.col(column).isNotNull()).distinct(), column))
    return m.join(names, column).drop(column).withColumnRenamed("idx", column), names


def _packed(m: DataFrame) -> Packed:
    """m by row; the table that Spark samples and packs is gone afterwards."""
    with scratch() as stay:
        return stay(pack(checkpointed(m.select("row", "col", "data")), "row", "col"))


def _rows(x: Packed) -> tuple[int, int]:
    """Least row and how many places there are to the greatest."""
    return (x.parts[0][1], x.parts[-1][2] - x.parts[0][1] + 1) if x.parts else (0, 0)


def _terms(x: Packed) -> float:
    """Terms of the product of a matrix, packed by row, with its transpose."""

    def run(batches):
        for b in batches:
            n = [float((np.diff(x.load(k)[1]).astype(float) ** 2).sum()) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])

    return x.tasks().mapInArrow(run, "n double").agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]


def _classes(targets: Packed) -> DataFrame:
    """(col, first): the least of the columns that equal it in all cells, by 128 bits of hashes of these; targets are packed by column."""

    def mixed(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                keys, starts, rows, data, _ = targets.load(k)
                out = []
                for salt in (0x632BE59BD9B4E019, 0xA24BAED4963EE407):
                    cell = mixed(mixed(rows.astype(np.int64).view(np.uint64), salt) + data.astype(float).view(np.uint64), salt)
                    out.append(pa.array(np.add.reduceat(cell, np.asarray(starts[:-1])).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys)), *out], names=["col", "a", "b"])

    signed = checkpointed(targets.tasks().mapInArrow(run, "col long, a long, b long"))
    return checkpointed(signed.join(signed.groupBy("a", "b").agg(F.min("col").alias("first")), ["a", "b"]).select("col", "first"))


def _long_rows(x: Packed) -> np.ndarray | None:
    """The long rows of a matrix packed by row, in order; None where these cannot be bounded (negative data), are too many cells or the most of all."""
    longest = LONG_ROW

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                keys, starts, _, data, _ = x.load(k)
                n = np.diff(starts)
                for r in np.flatnonzero(n > longest):
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[r])]), pa.array([int(n[r])]), pa.array([float(data[starts[r] : starts[r + 1]].min())])], names=["row", "n", "least"])

    found = x.tasks().mapInArrow(run, "row long, n long, least double").collect()
    n = sum(r.n for r in found)
    return np.array(sorted(r.row for r in found)) if found and n <= min(LONG_CELLS, x.size() // 2) and all(r.least >= 0 for r in found) else None


class _Long:
    """What a task knows of the cells of long rows: `cells` are those packed by column, `order` the columns (from `low` on) of each row by norm and id."""

    def __init__(self, cells: Packed, order: Packed, norm: np.ndarray, low: int, rows: int):
        self.norm, self.low = norm, low
        count, ids, data = np.zeros(len(norm), np.int64), [np.zeros(0, np.int32)], [np.zeros(0)]
        for k in range(len(cells.parts)):
            keys, starts, own, x, _ = cells.load(k)
            count[keys - low] = np.diff(starts)
            ids.append(own), data.append(x)
        self.first, self.ids, self.data = np.concatenate(([0], np.cumsum(count))), np.concatenate(ids), np.concatenate(data).astype(float)
        self.columns = [np.zeros(0, np.int64)] * rows
        for k in range(len(order.parts)):
            keys, starts, _, x, _ = order.load(k)
            for r, s, t in zip(keys, starts[:-1], starts[1:]):
                self.columns[r] = x[s:t].astype(np.int64)
        self.norms = [norm[c] for c in self.columns]
        self.least = np.array([n[0] if len(n) else np.inf for n in self.norms])
        self.most = np.zeros(rows)
        np.maximum.at(self.most, self.ids, self.data)
        self.place = np.full(rows, -1)

    def of(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the columns (from 0) the cells of long rows belong to, and where these are."""
        n = self.first[columns + 1] - self.first[columns]
        return np.repeat(np.arange(len(columns)), n), ranges(self.first[columns], n)


def _long_lists(keys, row, col, total, known: _Long, below: float, k: int):
    """Lists (i, j, w) of the targets `keys` from products `total` without the long rows, whose part is bounded first and added where it can decide.

    A column with a product is left out only if it stays below the k-th best with the most that long rows can add. One without any is weighed by long
    rows alone, which is less the greater its norm is; such columns are taken in the order of norms for as long as they can come in. The weight is
    the product over that of the norms and `below`."""

    def weight(d, i, j):
        return d / (i * j + below)

    norm, low, size = known.norm, known.low, len(known.norm)
    own, target = norm[keys - low], np.asarray(keys) - low
    use = col != keys[row]
    row, col, total = row[use], col[use] - low, total[use]
    there = row * size + col  # in order
    cell_row, at = known.of(target)
    long, x = known.ids[at], known.data[at]
    bound = np.bincount(cell_row, x * known.most[long], len(keys))
    asked, place = np.unique(long, return_inverse=True)
    known.place[asked] = np.arange(len(asked))
    table = np.zeros((len(keys), len(asked) + 1))  # the last column is of rows that no target has
    table[cell_row, place] = x

    def added(row, col):
        of, at = known.of(col)
        return np.bincount(of, table[row[of], known.place[known.ids[at]]] * known.data[at], len(col))

    def kth(row, w):
        """The k-th best of each row, or minus infinity where there are not as many above 0."""
        out, b = np.full(len(keys), -np.inf), best(row, w, k)
        n = np.bincount(row[b], minlength=len(keys))
        full = n == k
        value = w[b[np.cumsum(n)[full] - 1]]
        out[full] = np.where(value > 0, value, -np.inf)
        return out

    def alone(use, n):
        """Best columns without a product among the first n columns of the long rows of the cells `use`."""
        out, t = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        upto = np.concatenate(([0], np.cumsum(n)))
        while t < len(use):
            u = max(t + 1, int(np.searchsorted(upto, upto[t] + LOOKED_AT, "right")) - 1)
            while u < len(use) and cell_row[use[u]] == cell_row[use[u - 1]]:
                u += 1  # all of a target at once
            code = np.unique(np.concatenate([cell_row[c] * size + known.columns[long[c]][:m] for c, m in zip(use[t:u], n[t:u])]))
            if len(there):
                code = code[there[np.minimum(np.searchsorted(there, code), len(there) - 1)] != code]
            r = code // size
            c = code - r * size
            other = c != target[r]
            r, c = r[other], c[other]
            w = weight(added(r, c), norm[c], own[r])
            b = np.sort(best(r, np.round(w, DIGITS), k))
            out.append((r[b], c[b], w[b]))
            t = u
        return tuple(np.concatenate(c) for c in zip(*out))

    margin = 2 * 10.0**-DIGITS
    least = kth(row, weight(total, norm[col], own[row]))
    near = np.flatnonzero(weight(total + bound[row], norm[col], own[row]) >= least[row] - margin)
    row, col = row[near], col[near]
    w = weight(total[near] + added(row, col), norm[col], own[row])
    few = np.flatnonzero(np.isinf(least)[cell_row])
    if len(few):
        r, _, v = alone(few, np.minimum(4 * k, [len(known.norms[e]) for e in long[few]]))
        r, v = np.concatenate([row, r]), np.concatenate([w, v])
        order = np.argsort(r, kind="stable")
        least = np.maximum(least, kth(r[order], v[order]))
    # the greatest norm of a column that long rows alone can bring in
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where((least > margin) & (own > 0), (bound / (least - margin) - below) / own * (1 + 1e-9), np.inf)
    live = np.flatnonzero(known.least[long] <= reach[cell_row])
    if len(live):
        r, c, v = alone(live, np.array([np.searchsorted(known.norms[long[e]], reach[cell_row[e]], "right") for e in live]))
        row, col, w = np.concatenate([row, r]), np.concatenate([col, c]), np.concatenate([w, v])
        order = np.lexsort((col, row))
        row, col, w = row[order], col[order], w[order]
    known.place[asked] = -1
    use = np.flatnonzero(w != 0)
    use = use[best(row[use], np.round(w[use], DIGITS), k)]
    return col[use] + low, keys[row[use]], w[use]


def _long_cells(targets: Packed, long: np.ndarray, norms, low: int) -> tuple[Packed, Packed]:
    """Cells of the long rows packed by column, their rows numbered; and the columns (from `low` on) of each of these rows by norm and id, written by one task."""

    def cut(k: int):
        keys, starts, rows, data, _ = targets.load(k)
        place = np.minimum(np.searchsorted(long, rows), len(long) - 1)
        use = long[place] == rows
        yield np.repeat(keys, np.diff(starts))[use], place[use], data[use].astype(float)

    hot = made(targets, cut)

    def ordered(k: int):
        if k:
            return
        norm, parts = norms(), [hot.load(p) for p in range(len(hot.parts))]
        col = np.concatenate([np.repeat(p[0], np.diff(p[1])) for p in parts]) - low
        row = np.concatenate([p[2] for p in parts]).astype(np.int64)
        order = np.lexsort((col, norm[col], row))
        row = row[order]
        yield row, np.arange(len(row)) - np.searchsorted(row, row), col[order].astype(float)

    return hot, made(targets, ordered)


def _by_target(targets: Packed, b: Packed | Light, keep, shared) -> Packed:
    """What `multiply` gives as (i, j, w), packed by j where it is made."""
    low, width = b.span()

    def make(k: int):
        extra, out = shared(), []
        for found in product(*targets.load(k)[:4], b.rows(), low, np.zeros(width, np.int32 if width < 2**31 else np.int64)):
            i, j, w = keep(*found, extra)
            order = np.lexsort((i, j))
            out.append((j[order], i[order], w[order]))
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))

    return made(targets, make)


def _of_members(member: DataFrame, lists: Packed, top_k: int) -> Packed:
    """The lists of all columns, packed by column, from those of their classes (one place longer and with the class itself)."""
    with scratch() as stay:
        known = pack(member.withColumn("one", F.lit(1.0)), "col", "first", "one")

        def make(k: int):
            rows = Rows(lists)
            for keys, _, first, _ in some_rows(known, k):
                asked, place = np.unique(first, return_inverse=True)
                begin, i, w = rows.take(*(found := rows.find(asked)))
                n = found[2][place]
                r, at = np.repeat(np.arange(len(keys)), n), ranges(begin[place], n)
                use = i[at] != keys[r]
                r, at = r[use], at[use]
                use = np.sort(best(r, np.round(w[at], DIGITS), top_k))
                yield keys[r[use]], i[at[use]], w[at[use]]

        return stay(made(known, make))


def _common(found, keys, known: Rows, low: int, size: int):
    """The (i, j, w) that `known` has as well, with its data."""
    i, j, w = found
    part, start, length = known.find(np.asarray(keys))
    _, cols, v = known.take(part, start, length)
    use = (cols >= low) & (cols < low + size)
    code, v = (np.repeat(np.arange(len(keys)), length) * size + cols - low)[use], v[use]
    asked = np.searchsorted(keys, j) * size + i - low
    at = np.searchsorted(code, asked)
    ok = np.flatnonzero(at < len(code))
    ok = ok[code[at[ok]] == asked[ok]]
    return i[ok], j[ok], w[ok], v[at[ok]]


def similarity(
    m: DataFrame | Packed, kind: str = "cosine", shrink: float = 0.0, normalize: bool = True, top_k: int | None = 50, asymmetric_alpha: float = 0.5,
    tversky_alpha: float = 1.0, tversky_beta: float = 1.0, row_weights: DataFrame | None = None, packed: bool | str = False, beside: Packed | None = None,
) -> DataFrame | Packed:
    """(i, j, w): weight of column i for target column j, without the diagonal and zeros; the top_k of each target.

    m is (row, col, data), or packed by row. Columns that are no integers, or too sparse ones, are numbered first. With `packed` the weights
    come packed by i, or by j if it is "j". With `beside`, weights packed by j, only the cells that both have come, as (i, j, w, v) with v of these."""
    sets = kind in ("jaccard", "tanimoto", "dice", "tversky")
    if isinstance(m, Packed):
        x, m = (m, m.cells("row", "col")) if not sets and kind not in ("adjusted", "pearson") else (None, m.cells("row", "col"))
    else:
        x = None
    kinds, names, given = dict(m.dtypes), None, x is not None
    if kinds["row"] not in INTEGERS:
        m, rows = _numbered(m, "row")
        row_weights = None if row_weights is None else row_weights.join(rows, "row").select(F.col("idx").alias("row"), "weight")
    if kinds["col"] not in INTEGERS:
        m, names = _numbered(m, "col")
    if sets:
        m = m.withColumn("data", F.lit(1.0))
    elif kind in ("adjusted", "pearson"):
        m = centred(m, "row" if kind == "adjusted" else "col")
    x = _packed(m) if x is None else x
    targets = pack(x.cells("row", "col"), "col", "row", cells=x.size(), span=x.span())
    if x.span()[1] > max(DENSE_SPAN, 8 * sum(p[3] for p in targets.parts)):
        m, names = _numbered(x.cells("row", "col"), "col")
        x = _packed(m)
        targets = pack(x.cells("row", "col"), "col", "row", cells=x.size(), span=x.span())
    if row_weights is not None:
        with scratch() as stay:
            scaled = stay(scaled_rows(x, pack(row_weights.withColumn("col", F.lit(0)), "row", "col", "weight", cells=x.size(), span=_rows(x))))
        if not given:
            remove(x.folder)
        x = scaled
    member = long = None
    if top_k is not None and row_weights is None and _terms(x) > MANY_TERMS * x.size():
        long = _long_rows(x) if kind == "cosine" and normalize and shrink >= 0 else None
        member = _classes(targets) if long is None else None
    if member is not None:
        with scratch() as stay:
            first = member.where("col = first").select("col")
            x = stay(_packed(x.cells("row", "col").join(first, "col", "left_semi")))
            targets = stay(pack(x.cells("row", "col"), "col", "row", cells=x.size(), span=x.span()))
            # a list shows no more than its length and the target itself of any class
            shown = Window.partitionBy("first").orderBy("col")
            firsts = member.select("first", "col", F.row_number().over(shown).alias("k")).where(F.col("k") <= top_k + 1)
            firsts = stay(pack(checkpointed(firsts), "first", "col", "k", cells=targets.size(), span=_rows(targets)))
    low, size = _rows(targets)
    alpha, s = float(asymmetric_alpha), float(shrink)

    def weight(d, i, j):
        if kind in ("jaccard", "tanimoto"):
            return d / (i + j - d + s + EPSILON)
        if kind == "dice":
            return d / (i + j + s + EPSILON)
        if kind == "tversky":
            return d / (d + (j - d) * tversky_alpha + (i - d) * tversky_beta + s + EPSILON)
        if not normalize:
            return d / s if shrink else d
        if kind == "asymmetric":
            return d / ((j + EPSILON) ** (2 * alpha) * (i + EPSILON) ** (2 * (1 - alpha)) + s + EPSILON)
        return d / (i * j + s + EPSILON)

    def norms() -> np.ndarray:
        out = np.zeros(size)
        for k in range(len(targets.parts)):
            keys, _, _, _, squares = targets.load(k)
            out[keys - low] = squares
        return out if sets else np.sqrt(out)

    def keep(keys, row, col, total, norm):
        use = col != keys[row]
        row, col, total = row[use], col[use], total[use]
        w = weight(total, norm[col - low], norm[keys[row] - low])
        use = np.flatnonzero(w != 0)
        if top_k is not None:
            use = use[best(row[use], np.round(w[use], DIGITS), top_k)]
        return col[use], keys[row[use]], w[use]

    def keep_classes(keys, row, col, total, shared):
        """Lists of classes, one place longer and with the class itself: the best classes by their first columns have the best columns."""
        norm, known = shared
        w = weight(total, norm[col - low], norm[keys[row] - low])
        use = np.flatnonzero(w != 0)
        use = use[best(row[use], np.round(w[use], DIGITS), top_k + 1)]
        asked, place = np.unique(col[use], return_inverse=True)
        part, start, length = known.find(asked)
        begin, columns, _ = known.take(part, start, length)
        n = length[place]
        r, i, v = np.repeat(row[use], n), columns[ranges(begin[place], n)], np.repeat(w[use], n)
        order = np.lexsort((i, r))
        r, i, v = r[order], i[order], v[order]
        use = best(r, np.round(v, DIGITS), top_k + 1)
        r = r[use]
        return i[use], keys[r], v[use], (np.arange(len(r)) - np.searchsorted(r, np.arange(len(keys)))[r]).astype(np.int32)

    b, shared = x, norms
    if long is not None:
        hot, order = _long_cells(targets, long, norms, low)
        b, shared, rows = Light(x, LONG_ROW), lambda: _Long(hot, order, norms(), low, rows), len(long)

        def keep(keys, row, col, total, known):
            return _long_lists(keys, row, col, total, known, s + EPSILON, top_k)

    if packed == "j" and names is None and top_k is not None:
        lists = _by_target(targets, b, keep if member is None else lambda *found: keep_classes(*found)[:3], shared if member is None else lambda: (norms(), Rows(firsts)))
        return lists if member is None else _of_members(member, lists, top_k)
    if packed is True and member is None and names is None and top_k is not None:
        return turned(targets, b, keep, shared, x.span(), min(top_k * sum(p[3] for p in targets.parts), MANY_TERMS * x.size()), lambda: remove(targets.folder))
    if beside is not None and member is None and names is None:
        return multiply(targets, b, lambda *found: _common(keep(*found[:4], found[4][0]), found[0], found[4][1], low, size), "i long, j long, w double, v double", lambda: (shared(), Rows(beside)))
    if member is None:
        out = multiply(targets, b, keep, "i long, j long, w double", shared)
    else:
        lists = multiply(targets, x, keep_classes, "i long, j long, w double, at int", lambda: (norms(), Rows(firsts)))
        lists = checkpointed(lists.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("at", "i", "w"))).alias("l")).withColumnRenamed("j", "first"))
        own = F.slice(F.filter("l", lambda e: e["i"] != F.col("col")), 1, top_k)
        out = member.join(lists, "first").select(F.col("col").alias("j"), F.explode(own).alias("e")).select("e.i", "j", "e.w")
    if names is not None:
        for c in ("i", "j"):
            out = out.join(names.select(F.col("col").alias(f"__{c}"), F.col("idx").alias(c)), c).drop(c).withColumnRenamed(f"__{c}", c)
    out = out.select("i", "j", "w")
    if beside is not None:
        return out.join(beside.cells("j", "i").withColumnRenamed("data", "v").hint("merge"), ["i", "j"]).select("i", "j", "w", "v")
    if packed == "j":
        return pack(out, "j", "i", "w")
    return pack(out, "i", "j", "w", cells=2 * x.size(), span=None if names is not None else x.span()) if packed else out


def euclidean(m: DataFrame, mode: str = "lin", shrink: float = 0.0, normalize: bool = False, n_rows: DataFrame | None = None, top_k: int | None = 50) -> DataFrame:
    """(i, j, w) from Euclidean distances of all pairs of columns, whether they share a row or not.

    All pairs are the definition here: the columns form a stated set, and top_k of each target is kept as they are made."""
    norms = m.groupBy("col").agg(F.sum(F.col("data") * F.col("data")).alias("n"))
    dots = _pairs(m, F.lit(0.0), None).select("i", "j", "d")
    left, right = norms.select(F.col("col").alias("i"), F.col("n").alias("ni")), norms.select(F.col("col").alias("j"), F.col("n").alias("nj"))
    grid = left.join(right, F.col("i") < F.col("j")).join(dots, ["i", "j"], "left")
    square = F.greatest(F.lit(0.0), F.col("ni") + F.col("nj") - 2 * F.coalesce("d", F.lit(0.0)))
    if normalize:
        square = square / F.sqrt(F.col("ni") * F.col("nj"))
    if n_rows is not None:
        grid = grid.crossJoin(F.broadcast(n_rows.select(F.col("n").alias("rows"))))
        square = square / F.col("rows")
    x = F.sqrt(square)
    x = {"lin": x, "exp": F.exp(x), "log": F.log(x + 1)}[mode]
    w = 1 / (x + shrink + 1e-9)
    both = F.array(F.struct("i", "j", w.alias("w")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), w.alias("w")))
    out = grid.select(F.explode(both).alias("p")).select("p.i", "p.j", "p.w")
    return out if top_k is None else top(out, top_k)


def top(w: DataFrame, k: int, by: str = "j", absolute: bool = False) -> DataFrame:
    """The k largest weights of each target (by="j") or each row (by="i"), ties by the other id."""
    value = F.round(F.abs("w") if absolute else F.col("w"), DIGITS)
    return w.withColumn("__k", rank_in([by], value.desc(), F.col("i" if by == "j" else "j"))).where(F.col("__k") <= k).drop("__k")


def combine(first: DataFrame, second: DataFrame, alpha: float, top_k: int | None = None) -> DataFrame:
    """alpha * first + (1 - alpha) * second."""
    both = first.withColumn("w", F.col("w") * alpha).unionByName(second.withColumn("w", F.col("w") * (1 - alpha)))
    out = both.groupBy("i", "j").agg(F.sum("w").alias("w")).where("w <> 0")
    return out if top_k is None else top(out, top_k)


def common_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """(i, j, delta): second minus first on the cells of both."""
    # weights made in tasks are taken for a few kilobytes, and would be broadcast
    return first.join(second.withColumnRenamed("w", "v").hint("merge"), ["i", "j"]).select("i", "j", (F.col("v") - F.col("w")).alias("delta"))


def norm(values: DataFrame, column: str, kind: str) -> DataFrame:
    """One row (norm): L1, L2, Linf or L-inf of a column."""
    x = F.abs(column)
    return values.agg({"1": F.sum(x), "2": F.sqrt(F.sum(x * x)), "inf": F.max(x), "-inf": F.min(x)}[kind].alias("norm"))


def matrix_norm(w: DataFrame, kind: str) -> DataFrame:
    """One row (norm): the largest column sum (1) or row sum (inf) of absolute values."""
    return w.groupBy("j" if kind == "1" else "i").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s").alias("norm"))
