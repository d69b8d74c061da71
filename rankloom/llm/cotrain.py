"""Quality classifier by co-training.

Two views of a document: its content (which words it holds, and figures of the text such as its share of marks) and its
metadata (language, source and declared length, and pairs of them). Each view has a log-odds model over its features,
fitted by counting. In every round each view, calibrated on labelled rows that it was not fitted on, hands the documents that it is sure
of to the other as pseudo-labelled examples; the last scores of both views are combined by a logistic regression on these
labelled rows and give every document its probability.

1. A scan of the labelled rows (at most FIT_ROWS of them, chosen by a hash of their ids) finds the candidates: features whose classes differ at
   least weakly. Features are 64-bit hashes, so none share a weight, and there are as many as the labelled rows show.
2. One scan of all rows reduces each to its candidates. Fitting works on that table only, which holds some numbers for each row.
3. A candidate counts if its classes differ clearly among labelled and pseudo-labelled rows, and at least weakly the same
   way among the labelled ones: what labelled rows are too few to decide is decided by those that the other view is sure of.
   Each round looks at what is left: rejected rows that the view's features already explain do not hide the signs of the others.

The content score is corrected by what chance words against a clean document of that length add up to; what speaks for a document is
mostly said many times over and saturates. Near copies share one document's weight, so that a group of them does not vouch
for its own words.

A label row says whether an id is acceptable; of several for one id the least wins, null labels and ids are left out, and without
both classes every document is accepted. A null text is empty, null metadata is a value of its own. Rows that share an id
share its label. A probability of one half is accepted. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import keep, maybe_broadcast

U = np.uint64
#: A longer word is also held by its first bytes, so many.
PREFIXES = (4, 6)
#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 500_000
ROUNDS = 2
#: A view hands on what it puts above SURE or below 1 - SURE.
SURE = 0.98
#: Least log-likelihood ratio (nats) of a feature whose classes differ to one whose classes don't, as a candidate and in the model:
#: e^-12 is less than one in the features that a corpus shows by chance, e^-3.5 is not.
HELD, GAIN = 2, (3.5, 12.0)
#: Weaker features are left out: they are many, go together and would outvote the clear ones.
LEAST_ODDS, CLIP = 4.0, 6.0
#: Rows of a lower score are explained.
EXPLAINED = -2.0
#: What the features in favour of a row add up to saturates here.
FOR = 1.0
#: Score bins of the calibration.
BINS, SPAN = 64, 16.0
#: Weight of a document without near copies.
UNIT = 1000
#: Bytes of text whose features are found at once: scratch arrays take about 40 times as much, in each Python worker of an executor.
SLICE = 1 << 20


@dataclass
class View:
    """Sorted features with their log-odds, what those against a row add up to by chance for each word, and for each bin of the score the share of acceptable rows."""

    keys: np.ndarray
    weight: np.ndarray
    chance: float = 0.0
    share: np.ndarray | None = None

    def score(self, row: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Scores of rows from (row, place among the keys) pairs and their numbers of words."""
        x, rows = self.weight[at], len(words)
        against = np.bincount(row, np.minimum(x, 0), rows) + self.chance * words
        return np.minimum(against, 0) + np.minimum(np.bincount(row, np.maximum(x, 0), rows), FOR)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.share[_place(score)]


def _bin(x: np.ndarray, steps: float) -> np.ndarray:
    return np.floor(np.asarray(x, float) * steps).astype(np.int64)


def _features(b: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, tc.Words]:
    """(row, feature) pairs, distinct, of both views, and numbers of words. Columns: id, text, lang, source, length, ..."""
    data, off = tc.raw(tc.text_column(b, "text"))
    rows = b.num_rows
    w = tc.words(data, off, tc.LOWER, tc.PUNCTUATION)
    own, every = [w.doc], [w.hash]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        own.append(w.doc[long])
        every.append(tc.mix(tc.span_hash(data, w.start[long], w.start[long] + n, tc.LOWER) ^ U(0xC2B2AE3D27D4EB4F)))
    row, key = _distinct(np.concatenate(own), np.concatenate(every))

    size = np.maximum(off[1:] - off[:-1], 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / size
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, newline = (data >= 48) & (data <= 57), data == 10
    space = np.frombuffer(data.tobytes().translate(tc.SPACE), bool)
    mark = np.frombuffer(data.tobytes().translate(tc.PUNCTUATION), bool) & ~space
    odd = mark & ~np.isin(data, np.frombuffer(b".,;:'\"()-?", np.uint8))
    n = np.maximum(w.count, 1)
    distinct = np.bincount(row, minlength=rows)  # words and their beginnings
    letters = np.maximum(share(upper) + share(lower), 1e-9)
    figures = [
        _bin(np.log2(size), 1), _bin(share(upper) / letters, 10), _bin(np.sqrt(share(digit)), 10), _bin(np.sqrt(share(odd)), 12), _bin(np.sqrt(share(mark)), 12),
        _bin(np.sqrt(share(newline)), 20), _bin(distinct / n, 10), _bin(np.minimum(size / n, 40), 0.5), _bin(np.log2(n), 1),
    ]
    row, key = _with(row, key, [tc.mix(tc.mix(f.astype(np.uint64) + U(1)) + U(k)) for k, f in enumerate(figures)], rows)
    lang, source = (tc.string_hash(b.column(k)) for k in (2, 3))
    length = _bin(np.log2(np.maximum(b.column(4).fill_null(-1).to_numpy(zero_copy_only=False).astype(float) + 2, 0.5)), 2).astype(np.uint64)
    cols = [tc.mix(tc.mix(x + U(0x51)) + U(k)) for k, x in enumerate((lang, source, length, lang * U(31) + source, lang * U(31) + length))]
    meta = _with(np.zeros(0, np.int64), np.zeros(0, np.uint64), cols, rows)
    return [(row, key), meta], w.count, w


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _with(row: np.ndarray, key: np.ndarray, cols: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and one of each column for every row, by row."""
    row, key = np.concatenate([row, *[np.arange(rows)] * len(cols)]), np.concatenate([key, *cols])
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _found(keys: np.ndarray, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among the sorted keys) of the pairs whose feature is one of them."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    return row[hit], at[hit]


def _gain(held: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features held by so many rows of both classes, and the log-likelihood ratio, with the sign of the odds."""
    share = (held + 0.5) / (rows[:, None] + 1)
    expected = held.sum(axis=0) * rows[:, None] / max(rows.sum(), 1e-9)
    gain = (held * np.log(np.maximum(held, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    return np.clip(np.log(share[1] / share[0]), -CLIP, CLIP), gain * np.sign(share[1] - share[0])


def candidates(labelled: DataFrame) -> list[np.ndarray]:
    """For each view the sorted features that differ at least weakly between the classes of the labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text", SLICE):
            label = b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            for view, (row, key) in enumerate(_features(b)[0]):
                u, inv = np.unique(key, return_inverse=True)
                n = [np.bincount(inv, label[row] == c, len(u)).astype(np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), view, np.int32)), pa.array(u.view(np.int64)), *map(pa.array, n)], names=["view", "feature", "n0", "n1"])

    rows = np.array(labelled.agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first(), float)
    found = labelled.mapInArrow(run, "view int, feature long, n0 long, n1 long").groupBy("view", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n0 + n1 >= {HELD}")

    def weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds, gain = _gain(np.stack([b.column(k).to_numpy() for k in (2, 3)]).astype(float), rows)
            yield b.filter(pa.array((np.abs(gain) >= GAIN[0]) & (np.abs(odds) >= LEAST_ODDS / 2)))

    # no more than FIT_ROWS labelled rows show
    got = found.mapInArrow(weak, found.schema).select("view", "feature").toArrow()
    view, feature = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
    return [np.sort(feature[view == k]) for k in (0, 1)]


def _facts(src: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """(id, sign, words, content, metadata) of every row: places of the candidates that it holds, and the least hash of its five-word shingles."""
    shipped = src.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text", SLICE):
            pairs, words, w = _features(b)
            cols = []
            for k, (row, key) in enumerate(pairs):
                row, at = _found(shipped.value[k], row, key)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32))))
            grams = tc.shingles(w, 5)
            own = (grams >> U(tc.GRAM_BITS)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            sign, none = np.zeros(b.num_rows, np.int64), np.ones(b.num_rows, bool)
            # shingles are sorted, so a row's first is its least
            sign[own[first]], none[own[first]] = (grams[first] & tc.GRAM_MASK).astype(np.int64), False
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sign, mask=none), pa.array(words.astype(np.int32)), *cols], names=["id", "sign", "words", "content", "metadata"])

    return keep(src.mapInArrow(run, "id long, sign long, words int, content array<int>, metadata array<int>"), "facts")


def _pairs(b: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(row, place) pairs of both views and numbers of words of a batch of facts."""
    out = []
    for k in (3, 4):
        size = np.diff(b.column(k).offsets.to_numpy())
        out.append((np.repeat(np.arange(b.num_rows), size), b.column(k).flatten().to_numpy()))
    return out, b.column(2).to_numpy()


def _count(facts: DataFrame, views: list[View] | None, keys: list[np.ndarray]) -> list[np.ndarray]:
    """For each view a table (labelled rows or these and what the other view is sure of, 2 classes, features and then rows and words).

    Rejected rows that the view explains already are left out."""
    shipped = facts.sparkSession.sparkContext.broadcast(views)
    sizes = [len(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shipped.value
        tables = [np.zeros((2, 2, k + 2), np.int64) for k in sizes]
        for b in batches:
            if not b.num_rows:
                continue
            pairs, words = _pairs(b)
            weight = b.column(6).to_numpy().astype(np.int64)
            label = b.column(5).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            scores = given and [v.score(*p, words) for p, v in zip(pairs, given)]
            for k in (0, 1):
                use, open_ = label, True
                if given is not None:
                    other = given[1 - k].probability(scores[1 - k])
                    use = np.where(use >= 0, use, np.where(other > SURE, 1, np.where(other < 1 - SURE, 0, -1)))
                    open_ = scores[k] > EXPLAINED
                for j, who in enumerate((label, use)):
                    for c in (0, 1):
                        mass = np.where((who == c) & (open_ | (c == 1)), weight, 0)
                        tables[k][j, c, :-2] += np.bincount(pairs[k][1], mass[pairs[k][0]], sizes[k]).astype(np.int64)
                        tables[k][j, c, -2:] += mass.sum(), (mass * words).sum()
        for k, t in enumerate(tables):
            cells = t.ravel()
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)), pa.array(cells[at])], names=["part", "cell", "n"])

    got = facts.mapInArrow(run, "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow()
    part, cell, n = (got.column(k).to_numpy() for k in range(3))
    out = [np.zeros(4 * (k + 2), np.int64) for k in sizes]
    for k in (0, 1):
        out[k][cell[part == k]] = n[part == k]
    return [x.reshape(2, 2, -1) for x in out]


def _fit(keys: np.ndarray, table: np.ndarray, before: View | None, lengthy: bool) -> View:
    """`before` and the further features whose classes differ clearly; what is handed on is mostly of one class, so they must also differ, the same way, among the labelled rows."""
    labelled, table = table / UNIT
    weight = np.zeros(len(keys)) if before is None else before.weight
    if table[:, -2].min():
        odds, gain = _gain(table[:, :-2], table[:, -2])
        own = _gain(labelled[:, :-2], labelled[:, -2])[1]
        use = (np.abs(gain) >= GAIN[1]) & (own * np.sign(gain) >= GAIN[0]) & (np.abs(odds) >= LEAST_ODDS)
        weight = np.where(weight != 0, weight, np.where(use, odds, 0.0))
    chance = float((-np.minimum(weight, 0) * (table[1, :-2] + 0.5)).sum() / max(table[1, -1], 1)) if lengthy else 0.0
    return View(keys, weight, chance)


def _histogram(held: DataFrame, views: list[View]) -> np.ndarray:
    """Labelled rows by score bin of either view and label."""
    shipped = held.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, total = shipped.value, np.zeros(BINS * BINS * 2, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            pairs, words = _pairs(b)
            a, m = (_place(v.score(*p, words)) for p, v in zip(pairs, given))
            label = b.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            total += np.bincount((a * BINS + m) * 2 + label, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["cell", "n"])

    got = held.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS * BINS * 2, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(BINS, BINS, 2)


def _place(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + SPAN) / (2 * SPAN) * BINS).astype(np.int64), 0, BINS - 1)


def _rising(good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of good in each bin, made monotone by pooling neighbours; every pool is drawn to one half by one row."""
    pools: list[list[float]] = []
    for g, c in zip(good.tolist(), n.tolist()):
        pools.append([g, c, 1])
        while len(pools) > 1 and (pools[-2][0] + 0.5) / (pools[-2][1] + 1) >= (pools[-1][0] + 0.5) / (pools[-1][1] + 1):
            g, c, k = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + c, pools[-1][2] + k]
    return np.concatenate([np.full(k, (g + 0.5) / (c + 1)) for g, c, k in pools])


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights (offset last) of a logistic regression on counted points, by Newton steps with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    n = good + bad

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((n * np.logaddexp(0, z) - good * z).sum() + 0.005 * beta @ beta)

    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta)), x.T @ (good - n * p) - 1e-2 * beta)
        size, now = 1.0, loss(beta)
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(step).max() < 1e-8:
            break
        beta = beta + size * step
    return beta


def _calibrate(views: list[View], hist: np.ndarray) -> None:
    for k, v in enumerate(views):
        side = hist.sum(axis=1 - k)
        v.share = _rising(side[:, 1], side.sum(axis=1))


@dataclass
class Model:
    """Both views and the weights of their calibrated log-odds (offset last)."""

    views: list[View]
    beta: np.ndarray

    def judge(self, pairs: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Scores of both views and probabilities."""
        scores = [v.score(*p, words) for p, v in zip(pairs, self.views)]
        x = [_logit(v.probability(s)) for v, s in zip(self.views, scores)]
        return scores, 1 / (1 + np.exp(-np.clip(self.beta[0] * x[0] + self.beta[1] * x[1] + self.beta[2], -30, 30)))


def _source(docs: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    return docs.select(*((F.lit(None) if columns[c] is None else F.col(columns[c])).cast(kind).alias(c) for c, kind in (("id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("length", "long"))))


def near_copies(facts: DataFrame) -> DataFrame:
    """(sign, weight) of the least shingle hashes that several rows share: UNIT over how many do."""
    return keep(facts.where("sign is not null").groupBy("sign").agg(F.count("*").alias("n")).where("n > 1").select("sign", F.greatest(F.lit(1), (F.lit(UNIT) / F.col("n")).cast("int")).alias("weight")), "copies")


def fit(docs: DataFrame, labels: DataFrame, columns: dict[str, str | None], label_id: str = "doc_id", label_col: str = "good", rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> tuple[Model, DataFrame]:
    """The model co-trained on all rows, and their facts; label_col is boolean or 0/1."""
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)))
    # a third of the labelled rows is kept for calibration, which thus sees what a view is worth on other rows
    known = keep(known.withColumn("apart", F.pmod(F.xxhash64("id"), F.lit(3)) == 0), "known")
    src = _source(docs, columns)
    # at most fit_rows ids
    labelled = src.join(F.broadcast(known.where("not apart")), "id").select(*src.columns, "label")
    keys = candidates(labelled)
    facts = _facts(src, keys)
    marked = facts.join(maybe_broadcast(near_copies(facts), 12), "sign", "left").join(F.broadcast(known), "id", "left")
    marked = keep(marked.select("id", "sign", "words", "content", "metadata", "label", F.coalesce("weight", F.lit(UNIT)).cast("int").alias("weight"), "apart"), "marked")
    held = marked.where("apart")
    train = marked.withColumn("label", F.when(~F.col("apart"), F.col("label")))
    own = _count(train.where("label is not null"), None, keys)
    views = [_fit(k, t, None, v == 0) for v, (k, t) in enumerate(zip(keys, own))]
    hist = _histogram(held, views)
    both = bool(hist.sum(axis=(0, 1)).all())
    _calibrate(views, hist)
    for _ in range(rounds if both else 0):
        views = [_fit(k, t, w, v == 0) for v, (k, t, w) in enumerate(zip(keys, _count(train, views, keys), views))]
        hist = _histogram(held, views)
        _calibrate(views, hist)
    if not both:
        return Model(views, np.array([0.0, 0.0, 30.0])), facts
    grid = np.stack(np.meshgrid(*(_logit(v.share) for v in views), indexing="ij"), axis=-1).reshape(-1, 2)
    cells = hist.reshape(-1, 2)
    some = cells.sum(axis=1) > 0
    return Model(views, _logistic(grid[some], cells[some, 1], cells[some, 0])), facts


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str | None = "n_chars", **fitting) -> DataFrame:
    """(id, content_score, metadata_score, probability, accepted) per row."""
    model, facts = fit(docs, labels, {"id": id_col, "text": text_col, "lang": lang_col, "source": source_col, "length": length_col}, **fitting)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, p = shipped.value.judge(*_pairs(b))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (*scores, p, p >= 0.5))], names=["id", "content_score", "metadata_score", "probability", "accepted"])

    return facts.mapInArrow(run, "id long, content_score double, metadata_score double, probability double, accepted boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str | None = "n_chars", **fitting) -> DataFrame:
    """The rows of docs that are accepted, with all their columns."""
    model, _ = fit(docs, labels, {"id": id_col, "text": text_col, "lang": lang_col, "source": source_col, "length": length_col}, **fitting)
    # only what has a weight is shipped
    used = [v.weight != 0 for v in model.views]
    model = Model([View(v.keys[u], v.weight[u], v.chance, v.share) for v, u in zip(model.views, used)], model.beta)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in tc.slices(batches, text_col, SLICE):
            own = [b.column(b.schema.get_field_index(c)) for c in (text_col, lang_col, source_col)]
            length = pa.nulls(b.num_rows, pa.int64()) if length_col is None else b.column(b.schema.get_field_index(length_col)).cast(pa.int64())
            pairs, words, _ = _features(pa.RecordBatch.from_arrays([own[0], *own, length], names=["id", "text", "lang", "source", "length"]))
            yield b.filter(pa.array(model.judge([_found(v.keys, *p) for v, p in zip(model.views, pairs)], words)[1] >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def acceptable(labels: DataFrame) -> DataFrame:
    """(doc_id, good): of good quality and not toxic."""
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
