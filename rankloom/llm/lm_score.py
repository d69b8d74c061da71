"""Cross-entropy difference scores from two matched n-gram language models.

Both models are bigram models over all words of the corpus. They differ only in the texts they count: the target (a given set of
ids) and the background (all texts). Every text is counted, and words and bigrams grow with the corpus.

1. The FREQUENT most frequent words are found by a count of all words; bigrams of two of them are counted in a dense table that is
   broadcast, so that no shard gets a hot word.
2. Every other token goes, in packets of packed arrays, to the shard of its word, or of the word before if only that is rare. A
   shard holds every occurrence of its words and bigrams, so it counts them and sends each text its part of the losses back.
   There is a shard for every SHARD tokens of the corpus.
3. The parts are summed by packet.

A word is predicted as (c(v, w) + MU p1(w)) / (c(v) + MU) with p1(w) = (c(w) + 1) / (N + V), c(v) without last words; the score of a
text is the mean over its words of target loss minus background loss in nats, so lower is closer to the target. A null text is empty;
an empty text has no scores (null). Without target texts both models are the background's, and all scores are 0. Rows that
share an id with a target id all belong to the target. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import keep, maybe_broadcast

U = np.uint64
#: Words whose bigrams with each other are counted in a dense table.
FREQUENT = 1024
MU = 500.0
#: Distinct words that a task gathers before it sends them on.
GATHER = 300_000
#: Tokens of the corpus for each shard, and rare tokens in a packet.
SHARD = PACKET = 1_000_000
#: Stands before the first word of a text.
START = U(0x9AE16A3B2F90404F)
#: Marks of a token in a shard: of a target text, followed by another word, a frequent word after a rare one.
HIT, NEXT, AFTER = 1, 2, 4
PARTS = "packet long, shard int, a binary, b binary, c binary, d binary"
SCORES = "id long, n_tokens long, target_loss double, background_loss double, score double"


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, inv = np.unique(k, return_inverse=True)
    return u, np.bincount(inv, c, len(u)).astype(np.int64)


def vocabulary(src: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the `size` most frequent words of all texts (of equals the least hash), and the number of different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for b in tc.slices(batches, "text"):
            data, off = tc.raw(tc.text_column(b, "text"))
            u, c = np.unique(tc.words(data, off, tc.LOWER).hash, return_counts=True)
            keys.append(u)
            counts.append(c)
            if sum(map(len, keys)) > 3 * GATHER:
                u, c = _merge(keys, counts)
                if len(u) > GATHER:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["word", "n"])
                    keys, counts = [], []
                else:
                    keys, counts = [u], [c]
        if keys:
            u, c = _merge(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])

    n = keep(src.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = n.orderBy(F.desc("n"), "word").limit(size).select("word").collect()  # at most `size` numbers
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)), n.count()


class _Tokens:
    """Tokens of a slice: hash, place among the frequent words (-1 if rare), the same of the word before (`size` at a start), marks."""

    def __init__(self, b: pa.RecordBatch, vocab: np.ndarray, size: int):
        data, off = tc.raw(tc.text_column(b, "text"))
        w = tc.words(data, off, tc.LOWER)
        self.count, self.doc, self.hash = w.count, w.doc, w.hash
        self.place = np.full(len(w.hash), -1)
        if len(vocab):
            at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
            self.place = np.where(vocab[at] == w.hash, at, -1)
        first = w.first[:-1][w.count > 0]
        self.before, self.previous = np.roll(self.place, 1), np.roll(w.hash, 1)
        self.before[first], self.previous[first] = size, START
        self.hit = b.column(2).to_numpy(zero_copy_only=False).astype(bool)[self.doc]
        self.next = np.ones(len(w.hash), bool)
        self.next[w.first[1:][w.count > 0] - 1] = False
        self.dense = (self.place >= 0) & (self.before >= 0)
        self.cell = self.before * size + self.place


def count_frequent(src: DataFrame, vocab: np.ndarray, size: int) -> np.ndarray:
    """Background and target counts: bigrams of frequent words and starts, frequent words, these (and starts) as a word before, all tokens."""
    ends = np.cumsum([(size + 1) * size, size, size + 1, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, ends[-1]), np.int64)
        for b in tc.slices(batches, "text"):
            t = _Tokens(b, vocab, size)
            for k, of in enumerate((np.ones(len(t.hash), bool), t.hit)):
                np.add.at(total[k], t.cell[t.dense & of], 1)
                total[k, ends[0] : ends[1]] += np.bincount(t.place[(t.place >= 0) & of], minlength=size)
                total[k, ends[1] : ends[2]] += np.bincount(t.before[(t.before >= 0) & of], minlength=size + 1)
                total[k, -1] += of.sum()
        at = np.flatnonzero(total[0])
        for k in range(0, len(at), 1 << 16):
            x = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[0, x]), pa.array(total[1, x])], names=["cell", "background", "target"])

    part = src.mapInArrow(run, "cell long, background long, target long")
    # a bounded number of cells, whatever the corpus
    got = part.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, ends[-1]))
    for k in (0, 1):
        out[k, got.column(0).to_numpy()] = got.column(1 + k).to_numpy()
    return out


class Model:
    """One model: what it has of the frequent words; sums over the tokens of a shard complete it."""

    def __init__(self, counts: np.ndarray, size: int, words: int):
        n = (size + 1) * size
        self.total, self.words = counts[-1], words
        self.one = self.chance(counts[n : n + size])
        self.pair = -np.log(counts[:n].reshape(size + 1, size) + MU * self.one).ravel()
        self.context = np.log(counts[n + size : -1] + MU)

    def chance(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / max(self.total + self.words, 1)

    def local(self, t: _Tokens) -> np.ndarray:
        """Loss of each token as far as frequent words decide it."""
        out = np.zeros(len(t.hash))
        out[t.dense] = self.pair[t.cell[t.dense]]
        known = t.before >= 0
        out[known] += self.context[t.before[known]]
        return out

    def rest(self, word: np.ndarray, pair: np.ndarray, mark: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """What the tokens of a shard add; word is its number in the shard, or its place among the frequent ones after a rare word."""
        after, follows = mark & AFTER > 0, mark & NEXT > 0
        one = np.empty(len(word))
        one[after] = self.one[word[after]]
        own = word[~after]
        one[~after] = self.chance(np.bincount(own, counted[~after]))[own] if len(own) else 0
        out = -np.log(np.bincount(pair, counted)[pair] + MU * one)
        k = np.flatnonzero(~after & follows)
        if len(k):
            out[k] += np.log(np.bincount(word[k], counted[k])[word[k]] + MU)
        return out


def _packets(src: DataFrame, shipped, size: int, shards: int) -> DataFrame:
    """(packet, shard, ...): for each shard word, pair, text and mark of its tokens; under a number below 0, one for each partition, id, length and known losses of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, models = shipped.value
        own = TaskContext.get().partitionId()
        base, number = own << 32, 0
        held: list[tuple] = []
        texts: list[tuple] = []

        def send() -> pa.RecordBatch:
            shard, *cols = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(shard, kind="stable")
            cols = [c[order] for c in cols]
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cut))
            rows = [[c[cut[k] : cut[k + 1]].tobytes() for c in cols] for k in some]
            rows.append([np.concatenate(x).tobytes() for x in zip(*texts)])
            names = np.concatenate([some, [-1 - own]]).astype(np.int32)
            out = [pa.array(np.full(len(names), base + number)), pa.array(names), *(pa.array(x, pa.binary()) for x in zip(*rows))]
            return pa.RecordBatch.from_arrays(out, names=["packet", "shard", "a", "b", "c", "d"])

        n = rows = 0
        for b in tc.slices(batches, "text"):
            t = _Tokens(b, vocab, size)
            rare = np.flatnonzero(~t.dense)
            word, place, previous = t.hash[rare], t.place[rare], t.previous[rare]
            after = place >= 0
            pair = tc.mix(tc.mix(previous) + word)
            key = np.where(after, previous, word)
            mark = (t.hit[rare] * HIT + t.next[rare] * NEXT + after * AFTER).astype(np.uint8)
            shard = (tc.mix(key ^ START) % U(shards)).astype(np.int32)
            held.append((shard, np.where(after, place.astype(np.uint64), word), pair, (t.doc[rare] + rows).astype(np.uint32), mark))
            ids = b.column(0)
            losses = np.stack([np.bincount(t.doc, m.local(t), b.num_rows) for m in models], axis=1)
            texts.append((ids.fill_null(0).to_numpy(), t.count.astype(np.int64), losses, ids.is_null().to_numpy(zero_copy_only=False)))
            n, rows = n + len(rare), rows + b.num_rows
            if n + rows >= PACKET:
                yield send()
                held, texts, n, rows, number = [], [], 0, 0, number + 1
        if texts:
            yield send()

    return src.mapInArrow(run, PARTS)


def _numbers(t: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for c in t.column(column).chunks for x in c]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FREQUENT) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) per row; target holds the ids of the target texts."""
    spark = docs.sparkSession
    ids = keep(target.select(F.col(target.columns[0]).cast("long").alias("id")).where("id is not null").distinct().withColumn("hit", F.lit(True)), "target-ids")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    side = maybe_broadcast(ids, 9)
    src = src.join(side, "id", "left").select("id", "text", F.coalesce("hit", F.lit(False)).alias("hit"))
    if side is ids:  # after a shuffle too, a task that runs again must cut the same packets
        src = src.sortWithinPartitions("id", F.xxhash64("text"))
    vocab, words = vocabulary(src, size)
    counts = count_frequent(src, vocab, size)
    some = counts[1, -1] > 0
    models = (Model(counts[1 if some else 0], size, words), Model(counts[0], size, words))
    shards = int(counts[0, -1] // SHARD) + 1
    shipped = spark.sparkContext.broadcast((vocab, models))
    packets = _packets(src, shipped, size, shards)

    def shard(t: pa.Table) -> pa.Table:
        if t.column("shard")[0].as_py() < 0:
            return t
        models = shipped.value[1]
        packet = t.column("packet").to_numpy()
        docs = _numbers(t, "c", np.uint32)
        ends = np.cumsum([0, *map(len, docs)])
        word, pair, mark = (np.concatenate(_numbers(t, c, k)) for c, k in (("a", U), ("b", U), ("d", np.uint8)))
        own = np.flatnonzero(mark & AFTER == 0)
        place = word.astype(np.int64)
        place[own] = np.unique(word[own], return_inverse=True)[1]
        pair = np.unique(pair, return_inverse=True)[1]
        one = np.ones(len(pair))
        near, far = models[0].rest(place, pair, mark, (mark & HIT).astype(float) if some else one), models[1].rest(place, pair, mark, one)
        rows = []
        for k, d in enumerate(docs):
            # tokens of a packet lie in the order of its texts
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            rows.append((d[at].tobytes(), *(np.add.reduceat(x[ends[k] : ends[k + 1]], at).tobytes() for x in (near, far)), b""))
        return pa.Table.from_arrays([pa.array(packet), t.column("shard"), *(pa.array(x, pa.binary()) for x in zip(*rows))], names=["packet", "shard", "a", "b", "c", "d"])

    def whole(t: pa.Table) -> pa.Table:
        names = t.column("shard").to_numpy()
        texts = t.filter(pa.array(names < 0))
        id_, n, loss, none = (_numbers(texts, c, k)[0] for c, k in (("a", np.int64), ("b", np.int64), ("c", float), ("d", bool)))
        loss = loss.reshape(-1, 2).copy()
        parts = t.filter(pa.array(names >= 0))
        for d, *x in zip(_numbers(parts, "a", np.uint32), _numbers(parts, "b", float), _numbers(parts, "c", float)):
            loss[d] += np.stack(x, axis=1)  # a text occurs once in a part
        a, c = loss.T / np.maximum(n, 1)
        return pa.Table.from_arrays([pa.array(id_, mask=none), pa.array(n), *(pa.array(x, mask=n == 0) for x in (a, c, a - c))], names=["id", "n_tokens", "target_loss", "background_loss", "score"])

    out = packets.groupBy("shard").applyInArrow(shard, PARTS).groupBy("packet").applyInArrow(whole, SCORES)
    return out.withColumnRenamed("id", id_col)
