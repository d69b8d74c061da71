"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Tokens are words without case and ASCII punctuation. An item of n tokens leaks into a document if some stretch of it is
within floor(rate * n) token edits of the item. The items are the stated query set and go to all executors, in blocks of
bounded size; documents are scanned whole.

1. Item-sized windows: only windows that share enough 3-token grams with an item can be within its bound (an edit spoils
   at most three grams), so the other starts are skipped without loss.
2. CGK: a random walk over the window repeats or advances each token by a coin that step and token fix. Strings at a small edit
   distance give sequences at a small Hamming distance. Several walks are used.
3. Repeated bit sampling: a repetition hashes a few sampled coordinates; a window that agrees with an item in any
   repetition is a candidate. The number of repetitions grows until simulated copies at the edit bound reach the recall
   asked for.
4. Every candidate is verified by exact edit distance against the stretch around it.

Null texts are empty, and so are null items; an item without tokens leaks nowhere. Rows that share an id are reported
each. Of equally near stretches the first is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

U = np.uint64
RATE = 0.2
RECALL = 0.99
GRAM = 3
#: Walks, coordinates per repetition, and most repetitions (if they don't reach the recall, all windows are candidates).
WALKS, SAMPLE, MOST = 4, 3, 1024
#: Items per block: each block is one scan of the documents.
ITEM_BLOCK = 20_000
_BITMAP = 20


class Items:
    """One block of items: tokens, gram table, walks and LSH tables."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, recall: float):
        texts = [t or "" for _, t in rows]
        data, off = tc.raw(pa.array(texts, pa.string()))
        w = tc.words(data, off, tc.LOWER, tc.PUNCTUATION)
        tokens = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(rows))]
        use = [i for i, t in enumerate(tokens) if len(t)]
        self.ids = [rows[i][0] for i in use]
        self.tokens = [tokens[i] for i in use]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.bound = np.floor(rate * self.size + 1e-9).astype(np.int64)
        # an edit spoils at most g grams of g tokens; short items use shorter grams
        self.gram = np.maximum(1, np.minimum(GRAM, self.size // (self.bound + 1)))
        self.need = np.maximum(1, self.size - self.gram + 1 - self.gram * self.bound)
        self.tables = {}
        for g in sorted(set(self.gram.tolist())):
            own = [i for i in range(len(self.ids)) if self.gram[i] == g]
            grams = np.concatenate([tc.rolling(self.tokens[i], g) for i in own])
            item = np.concatenate([np.full(self.size[i] - g + 1, i) for i in own])
            pos = np.concatenate([np.arange(self.size[i] - g + 1) for i in own])
            order = np.argsort(grams, kind="stable")
            bits = np.zeros(1 << _BITMAP, bool)
            bits[(grams & U((1 << _BITMAP) - 1)).astype(np.int64)] = True
            self.tables[g] = (grams[order], item[order], pos[order], bits)
        self.lsh = {int(n): self._tables(int(n), recall) for n in sorted(set(self.size.tolist()))}

    def _tables(self, n: int, recall: float):
        """Samples of coordinates and, for each, the sorted keys of the items of n tokens."""
        own = np.flatnonzero(self.size == n)
        e = int(self.bound[own[0]])
        x = np.stack([self.tokens[i] for i in own])
        clean = embed(x, n)
        rng = np.random.default_rng(n)
        if e:
            trial = np.repeat(x, max(1, 64 // len(own)), axis=0)[:512]
            noised = embed(np.stack([_noised(t, e, rng) for t in trial]), n)
            same = [np.repeat(a, max(1, 64 // len(own)), axis=0)[:512] == b for a, b in zip(clean, noised)]
        samples, found = [], None
        while len(samples) < MOST:
            for _ in range(WALKS):
                k = len(samples) % WALKS
                s = rng.choice(clean[k].shape[1], min(SAMPLE, clean[k].shape[1]), replace=False)
                samples.append((k, s))
                if e:
                    hit = same[k][:, s].all(axis=1)
                    found = hit if found is None else found | hit
            if not e or found.mean() >= recall and len(samples) >= 16:
                break
        # at the limit without the recall asked for: every window is verified
        sure = bool(not e or found.mean() >= recall)
        keys = []
        for k, s in samples:
            v = _key(clean[k][:, s])
            order = np.argsort(v, kind="stable")
            keys.append((v[order], own[order]))
        return samples, keys, own, sure

    def candidates(self, walks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of windows of n tokens that agree with an item in some repetition."""
        samples, keys, own, sure = self.lsh[n]
        if not sure:
            return np.repeat(np.arange(walks.shape[1]), len(own)), np.tile(own, walks.shape[1])
        pairs = []
        for (k, s), (table, item) in zip(samples, keys):
            v = _key(walks[k][:, s])
            lo, hi = np.searchsorted(table, v, "left"), np.searchsorted(table, v, "right")
            at = np.flatnonzero(hi > lo)
            if len(at):
                c = hi[at] - lo[at]
                idx = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[at], c)
                pairs.append(np.stack([np.repeat(at, c), item[idx]], axis=1))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.unique(np.concatenate(pairs), axis=0)
        return p[:, 0], p[:, 1]


def _noised(t: np.ndarray, e: int, rng: np.random.Generator) -> np.ndarray:
    """t after e random token edits, cut or filled to its own length as a window would be."""
    x = list(t)
    for _ in range(e):
        kind, at = rng.integers(3), int(rng.integers(max(len(x), 1)))
        new = U(rng.integers(1 << 62))
        if kind == 0 and x:
            x[at] = new
        elif kind == 1 and len(x) > 1:
            del x[at]
        else:
            x.insert(at, new)
    x = x[: len(t)] + [U(rng.integers(1 << 62)) for _ in range(len(t) - len(x))]
    return np.array(x, np.uint64)


def embed(x: np.ndarray, n: int) -> np.ndarray:
    """CGK walks (walk, row, step) of rows of at most n tokens, 3 n steps; past its end a row reads as 0.

    The first 3 m steps of a row of m tokens are the same whatever n is."""
    padded = np.concatenate([x, np.zeros((len(x), 1), np.uint64)], axis=1)
    rows = np.arange(len(x))[None, :]
    at, out = np.zeros((WALKS, len(x)), np.int64), np.empty((WALKS, len(x), 3 * n), np.uint64)
    walk = np.arange(1, WALKS + 1, dtype=np.uint64)[:, None]
    for j in range(3 * n):
        c = padded[rows, at]
        out[:, :, j] = c
        coin = tc.mix(c ^ ((U(j * WALKS) + walk) * U(0x9E3779B97F4A7C15))) >> U(63)
        at = np.minimum(at + coin.astype(np.int64), n)
    return out


def _key(x: np.ndarray) -> np.ndarray:
    h = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        h = tc.mix(h * U(0xD1342543DE82EF95) + x[:, j])
    return h


def best_stretch(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to any stretch of text, and that stretch (the first such that ends first)."""
    m = len(text)
    d, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    j = np.arange(m + 1)
    big, low = 32, (1 << 32) - 1
    for c in item:
        # distance and start in one number: of equal distances the later start, which is the shorter stretch
        v = (d << big) + (low - start)
        up = v + (1 << big)
        up[1:] = np.minimum(up[1:], v[:-1] + ((text != c).astype(np.int64) << big))
        w = np.minimum.accumulate(up - (j << big)) + (j << big)
        d, start = w >> big, low - (w & low)
    end = int(np.argmin(d))
    return int(d[end]), int(start[end]), end


def _scan(w: tc.Words, items: Items, rows: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first token, token after the last), the best stretch of each row and item."""
    starts = []
    doc = w.doc
    for g, (table, item, pos, bits) in items.tables.items():
        grams = tc.rolling(w.hash, g)
        at = np.flatnonzero(bits[(grams & U((1 << _BITMAP) - 1)).astype(np.int64)] & tc.inside(w, g))
        lo, hi = np.searchsorted(table, grams[at], "left"), np.searchsorted(table, grams[at], "right")
        c = hi - lo
        if not c.sum():
            continue
        idx = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
        at = np.repeat(at, c)
        own, which = doc[at], item[idx]
        # the gram bound over the whole document keeps a superset of what the bound over a window would
        pair = own * len(items.ids) + which
        _, inv, n = np.unique(pair, return_inverse=True, return_counts=True)
        ok = n[inv] >= items.need[which]
        first = np.clip(at[ok] - pos[idx[ok]], w.first[own[ok]], None)
        starts.append(np.stack([items.size[which[ok]], first], axis=1))
    if not starts:
        return []
    starts = np.unique(np.concatenate(starts), axis=0)
    hits = []
    padded = np.concatenate([w.hash, np.zeros(int(items.size.max()), np.uint64)])
    for cut in range(0, len(starts), 4096):
        part = starts[cut : cut + 4096]
        size, first = part[:, 0], part[:, 1]
        most = int(size.max())
        place = first[:, None] + np.arange(most)
        # a window ends after its item's number of tokens, or with its text
        grid = np.where(place < np.minimum(first + size, w.first[doc[first] + 1])[:, None], padded[place], U(0))
        walks = embed(grid, most)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            win, which = items.candidates(walks[:, at], n)
            hits.append(np.stack([doc[first[at[win]]], which, first[at[win]]], axis=1))
    if not hits:
        return []
    hits = np.unique(np.concatenate(hits), axis=0)
    out = []
    cuts = np.flatnonzero((hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1])) + 1
    for group in np.split(hits, cuts):
        r, i = int(group[0, 0]), int(group[0, 1])
        item, n, e = items.tokens[i], int(items.size[i]), int(items.bound[i])
        lo, hi = int(w.first[r]), int(w.first[r + 1])
        best = next(((0, s, s + n) for s in group[:, 2].tolist() if s + n <= hi and np.array_equal(w.hash[s : s + n], item)), None)
        if best is None and e:
            # starts no further apart than the bound lie in one stretch of text
            for run in np.split(group[:, 2], np.flatnonzero(np.diff(group[:, 2]) > e) + 1):
                a, b = max(int(run[0]) - e, lo), min(int(run[-1]) + n + e, hi)
                d, x, y = best_stretch(w.hash[a:b], item)
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + x, a + y)
        if best is not None:
            out.append((r, i, *best))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """(id, item, distance, item_tokens, start, end): every item that leaks into a row, with its nearest stretch in code points."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, {item_col} long, distance long, item_tokens long, start long, end long"
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    out = None
    block: list[tuple[int, str]] = []

    def one(block: list[tuple[int, str]]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(Items(block, rate, recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shipped.value
            for b in tc.slices(batches, "text", 4 << 20):
                data, off = tc.raw(tc.text_column(b, "text"))
                w = tc.words(data, off, tc.LOWER, tc.PUNCTUATION)
                found = _scan(w, items, b.num_rows) if len(items.ids) and len(w.hash) else []
                if not found:
                    continue
                points = {r: tc.code_points(data[off[r] : off[r + 1]]) for r in {x[0] for x in found}}
                cols = [(r, items.ids[i], d, int(items.size[i]), int(points[r][w.start[s] - off[r]]), int(points[r][w.end[t - 1] - off[r]])) for r, i, d, s, t in found]
                r, *rest = zip(*cols)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), *(pa.array(x, pa.int64()) for x in rest)], names=[id_col, item_col, "distance", "item_tokens", "start", "end"])

        return src.mapInArrow(run, schema)

    # every block of items is one scan of the documents; a scan's block is broadcast, so memory goes with ITEM_BLOCK and the number of scans with the benchmark
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEM_BLOCK:
            out, block = (one(block) if out is None else out.union(one(block))), []
    if block or out is None:
        out = one(block) if out is None else out.union(one(block))
    return out
