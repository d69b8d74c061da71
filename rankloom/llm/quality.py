"""Quality rules and cross-document line frequency.

Per text: word, symbol, repeated-line and repeated-word counts. Across texts: every line is normalised (ASCII lower
case, digits as 0, white space as one blank) and hashed with its host; the distinct documents of the host that hold it are counted, with
one row per line and batch before the shuffle, so a line that a third of all rows share costs a row per batch. A line
in LINE_DOCS of them is boilerplate, however large the host, and is removed from the text; a document is rejected if too little is
left. The boilerplate lines are broadcast while they fit (8 bytes each), and otherwise joined to the lines of the documents by a shuffle.

A null text is empty and fails the base rules. A null host is a host of its own. Rows that share an id count as documents
of their own. Texts are read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import BROADCAST_BYTES, keep

U = np.uint64
LEAST_WORDS = 10
REPEAT_WIDTH = 5
#: In per cent of the words.
MOST_REPEATED = 20
# The symbols that count.
SYMBOLS = b"#*$%&|<>"
#: A line is boilerplate of a host if it is in at least LINE_DOCS of its documents.
LINE_DOCS = 20
#: A document whose other lines hold less than this share of its words, or under LEAST_WORDS words, is depleted.
LEAST_LEFT = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _lines(data: np.ndarray, off: np.ndarray, w: tc.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines with a word: text, first word, number of words."""
    new = np.zeros(len(w.start), bool)
    if len(new):
        ends = np.concatenate([[0], np.cumsum(data == 10)])
        new[1:] = ends[w.start[1:]] != ends[w.start[:-1]]
        new[w.first[:-1][w.count > 0]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(w.start)]]))
    return w.doc[first], first, size


def _sequence(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of words."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(h)) - np.repeat(first, size)
    salt = tc.mix(place.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(0xD6E8FEB86659FD93))
    return tc.mix(np.add.reduceat(tc.mix(h ^ salt), first) + size.astype(np.uint64))


def _again(own: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: equal to another of the same text; and not the first such."""
    order = np.lexsort((key, own))
    same = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same  # lexsort is stable, so the first of equals comes first
    return twice, later


def _line_table(b: pa.RecordBatch):
    """Bytes and offsets, folded words, and for lines with a word: text, number of words, hash with the host."""
    data, off = tc.raw(tc.text_column(b, "text"))
    w = tc.words(data, off, tc.LOWER_DIGITS)
    own, first, size = _lines(data, off, w)
    host = tc.mix(tc.string_hash(b.column(0)) + U(1))
    return data, off, w, own, size, tc.mix(_sequence(w.hash, first, size) ^ host[own])


def line_documents(src: DataFrame) -> DataFrame:
    """(line, docs): distinct documents of a host that hold the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text", 8 << 20):
            _, _, _, own, _, key = _line_table(b)
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            one = np.ones(len(key), bool)
            one[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            line, n = np.unique(key[one], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(line.view(np.int64)), pa.array(n.astype(np.int64))], names=["line", "n"])

    part = src.select("host", "text").mapInArrow(run, "line long, n long")
    return part.groupBy("line").agg(F.sum("n").alias("docs"))


def _common_of(src: DataFrame, limits: DataFrame) -> DataFrame:
    """(row, common): the boilerplate lines of each row that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text"):
            _, _, _, own, _, key = _line_table(b)
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(key) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(own[at])), pa.array(key[at].view(np.int64))], names=["row", "line"])

    lines = src.mapInArrow(run, "row long, line long")
    # rows that agree in all columns have one number, and a text has no more lines here than it holds
    return lines.join(limits, "line").groupBy("row").agg(F.collect_set("line").alias("common"))


def _without(text: bytes, gone: set[int]) -> str:
    return b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone).decode()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Counts and verdicts per row: base_failed by the row alone, kept also by the lines it shares with others.

    clean_text is the text without boilerplate lines (rows that fail the base rules, null texts too, are left as they are)."""
    src = docs.select(F.col(host_col).cast("string").alias("host"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    limits = keep(line_documents(src).where(F.col("docs") >= line_docs).select("line"), "common-lines")
    few = limits.count() * 8 <= BROADCAST_BYTES
    shipped = docs.sparkSession.sparkContext.broadcast(np.sort(limits.toArrow().column(0).to_numpy()) if few else np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text"):
            data, off, w, own, size, key = _line_table(b)
            exact = tc.words(data, off)
            n = exact.count
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.bincount(exact.doc, heads[exact.end] - heads[exact.start], b.num_rows).astype(np.int64)
            begin, end, raw = _raw_lines(data, off, own, w, size)
            _, dup = _again(own, raw)
            ok = np.flatnonzero(tc.inside(exact, REPEAT_WIDTH))
            twice, _ = _again(exact.doc[ok], tc.rolling(exact.hash, REPEAT_WIDTH)[ok])
            cover = np.zeros(len(exact.hash) + 1, np.int64)
            np.add.at(cover, ok[twice], 1)
            np.add.at(cover, ok[twice] + REPEAT_WIDTH, -1)
            repeat = np.bincount(exact.doc, np.cumsum(cover)[:-1] > 0, b.num_rows).astype(np.int64)
            failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
            line = key.view(np.int64)
            if few:
                table = shipped.value
                common = table[np.minimum(np.searchsorted(table, line), len(table) - 1)] == line if len(table) else np.zeros(len(line), bool)
            else:
                sets, lo = b.column(3), np.searchsorted(own, np.arange(b.num_rows + 1))
                common = np.zeros(len(line), bool)
                for i in np.flatnonzero(sets.is_valid().to_numpy(zero_copy_only=False)):
                    common[lo[i] : lo[i + 1]] = np.isin(line[lo[i] : lo[i + 1]], sets[i].values.to_numpy())
            hit = np.flatnonzero(common & ~failed[own])
            lost = np.bincount(own[hit], size[hit], b.num_rows).astype(np.int64)
            left = n - lost
            kept = ~failed & (left >= LEAST_WORDS) & (left >= least_left * n)
            text = b.column(2)
            if len(hit):
                feeds = np.concatenate([[0], np.cumsum(data == 10)])
                number = feeds[begin[hit]] - feeds[off[own[hit]]]
                gone: dict[int, set[int]] = {}
                for i, k in zip(own[hit].tolist(), number.tolist()):
                    gone.setdefault(i, set()).add(k)
                text = text.to_pylist()
                for i, which in gone.items():
                    text[i] = _without(data[off[i] : off[i + 1]].tobytes(), which)
                text = pa.array(text, pa.string())
            cols = [n, chars, symbols[off[1:]] - symbols[off[:-1]], np.bincount(own, dup, b.num_rows).astype(np.int64), repeat, failed, kept, lost]
            yield pa.RecordBatch.from_arrays([b.column(1), *map(pa.array, cols), text.cast(pa.string())], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words", "clean_text"])

    if not few:
        src = src.withColumn("row", F.xxhash64("id", "host", "text"))
        src = src.join(_common_of(src, limits), "row", "left").select("host", "id", "text", "common")
    out = src.mapInArrow(run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_common_words long, clean_text string")
    return out.withColumnRenamed("id", id_col)


def _raw_lines(data: np.ndarray, off: np.ndarray, own: np.ndarray, w: tc.Words, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of the exact bytes of each line with a word."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    nl = np.flatnonzero(data == 10)
    start = w.start[at]
    lo = np.searchsorted(nl, start)
    begin = np.maximum(np.where(lo > 0, nl[np.maximum(lo - 1, 0)] + 1, 0) if len(nl) else 0, off[own])
    end = np.minimum(np.where(lo < len(nl), nl[np.minimum(lo, max(len(nl) - 1, 0))], len(data)) if len(nl) else len(data), off[own + 1])
    n = end - begin
    lead = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(int(n.sum())) - np.repeat(lead, n)
    chars = data[place + np.repeat(begin, n)].astype(np.uint64)
    return begin, end, tc.mix(np.add.reduceat(tc.mix(chars + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), lead) + n.astype(np.uint64))
