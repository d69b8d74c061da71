"""Removal of repeated passages with sharded Aho-Corasick automata.

A passage repeats if some window of `width` consecutive words starts at two places of the corpus, in one text or in two.

1. Confirmed phrases: of the PHRASE-word phrases in a window the one with the least hash stands for it (the leftmost of
   equals), its seed. Equal windows have equal seeds, so a repeated window has a seed that a count over all texts finds
   twice. Phrases are kept as the symbols that the automata read, two of six bits for a word.
2. Automata: confirmed phrases are sharded by the texts that hold them. A shard compiles its phrases, which come to it
   from the count, and streams its texts through the automaton: only that tells where a phrase occurs, and
   windows around no occurrence are not looked at any more. Every text is streamed once, through all phrases that it can
   hold, so the work grows with the text and not with text x phrases. Texts and phrases meet by a shuffle at every size.
3. Windows whose seed was located are counted over all texts. A task sends at most two rows for a window, however many
   texts of its own hold it: that of the first place, and one that settles it.
4. Words under a repeated window are removed, all occurrences alike.

Texts that are equal as a whole are counted once with their number. Windows and whole texts are told apart by hashes of 64 bits. A null
text has no words; rows that share an id count as texts of their own. Words are compared unchanged. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import keep, maybe_broadcast

U = np.uint64
WIDTH = 35
PHRASE = 8
#: Symbols for a word.
SYMBOLS = 2
_SLICE = 4 << 20
#: Windows that a task remembers to have sent.
SEEN = 8 << 20


class _Slice:
    """Words, phrase hashes and the seed of every window of one slice of texts."""

    def __init__(self, b: pa.RecordBatch, width: int):
        data, off = tc.raw(tc.text_column(b, "text"))
        self.words = w = tc.words(data, off)
        self.width, self.phrase = width, min(PHRASE, width)
        self.grams = tc.rolling(w.hash, self.phrase)
        ok = tc.inside(w, width)
        self.at = np.flatnonzero(ok)
        span = width - self.phrase + 1  # phrases in a window
        if len(self.at):
            # places beside the hashes, as a text can be of any length; of equal hashes the left one stays
            low, place, size = self.grams, np.arange(len(self.grams)), 1
            while size < span:
                step = min(size, span - size)
                right = low[step:] < low[:-step]
                low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
                size += step
            self.seed = place[self.at]
        else:
            self.seed = np.zeros(0, np.int64)

    def code(self) -> bytes:
        """The words as symbols of the automata, SYMBOLS for each."""
        out = np.empty((len(self.words.hash), SYMBOLS), np.uint8)
        for k in range(SYMBOLS):
            out[:, k] = 48 + ((self.words.hash >> U(6 * k)) & U(63)).astype(np.uint8)
        return out.tobytes()

    def seeds(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(text, phrase, occurrences as a seed), distinct by both."""
        place = np.unique(self.seed)
        own, gram = self.words.doc[place], self.grams[place]
        order = np.lexsort((gram, own))
        own, gram = own[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        code, size = self.code(), SYMBOLS * self.phrase
        return own[at], [code[SYMBOLS * p : SYMBOLS * p + size] for p in place[order][at].tolist()], np.diff(np.concatenate([at, [len(gram)]]))

    def located(self, phrases: pa.Array) -> np.ndarray:
        """Which windows have a seed at a place where the automaton of `phrases` finds one of them."""
        hit = np.zeros(len(self.words.hash), bool)
        hit[np.fromiter(_occurrences(phrases.unique().to_pylist(), self.code().decode("ascii")), np.int64)] = True
        # a phrase that runs over the end of a text is no seed
        return hit[self.seed + self.phrase - 1] if len(self.seed) else np.zeros(0, bool)


def _occurrences(phrases: list[bytes], stream: str) -> Iterator[int]:
    """Last words of all occurrences of the phrases in the coded words of a shard."""
    if not phrases:
        return
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for x in phrases:
        machine.add_word(x.decode("ascii"))
    machine.make_automaton()
    for end, _ in machine.iter(stream):
        if end % SYMBOLS == SYMBOLS - 1:
            yield end // SYMBOLS


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, tid, n, head) of every row, and the (tid, n, head) of texts that occur as a whole more than once."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    same = src.where("text <> ''").groupBy("tid").agg(F.count("*").alias("n"), F.min(F.coalesce("id", F.lit(-(2**63)))).alias("head")).where("n > 1")
    same = keep(same, "copies")
    return src.join(maybe_broadcast(same, 24), "tid", "left").select("id", "text", "tid", F.coalesce("n", F.lit(1)).alias("n"), F.expr("head is null or head = coalesce(id, -9223372036854775808)").alias("head")), same


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The rows (id, text, tid, n, head), and (tid, runs): word ranges of window starts that repeat, of texts that occur once."""
    rows, _ = _texts(docs, id_col, text_col)
    heads = rows.where("head").select("tid", "n", "text")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text", _SLICE):
            own, phrase, n = _Slice(b, width).seeds()
            times = b.column(1).to_numpy()[own]
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.binary()), b.column(0).take(pa.array(own)), pa.array(n * times)], names=["phrase", "tid", "n"])

    found = heads.mapInArrow(seeds, "phrase binary, tid long, n long")
    confirmed = keep(found.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase"), "phrases")
    lists = found.select("phrase", "tid").join(confirmed.hint("shuffle_hash"), "phrase", "left_semi").groupBy("tid").agg(F.collect_list("phrase").alias("phrases"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)  # keys sent as the first of the task, sorted
        told = np.zeros(0, np.uint64)  # of these, keys that were settled since
        for b in tc.slices(batches, "text", _SLICE):
            s = _Slice(b, width)
            at = s.at[s.located(b.column(3).flatten())]
            own = s.words.doc[at]
            place = at - s.words.first[own]
            key = tc.rolling(s.words.hash, width)[at]
            tid, times = b.column(0).to_numpy()[own], b.column(1).to_numpy()[own]
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            group = np.cumsum(new) - 1
            keys = sorted_key[new]
            before = _isin(keys, seen)
            often = before.copy()
            if len(key):
                often |= np.bincount(group, times[order]) > 1
            sure = np.empty(len(key), bool)
            sure[order] = often[group] if len(key) else []
            # settled here: runs of windows, under keys of their own; a text that occurs as a whole twice needs none
            k = np.flatnonzero(sure & (times == 1))
            cut = np.ones(len(k), bool)
            cut[1:] = (own[k][1:] != own[k][:-1]) | (place[k][1:] != place[k][:-1] + 1)
            first = k[cut]
            last = k[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(k) - 1]])] if len(k) else k
            run_key = tc.mix(tid[first].view(np.uint64) + place[first].astype(np.uint64) * U(0x9E3779B97F4A7C15))
            # one row for a window that is new to the task, with its place if it is still open; one more when it is met again
            again = before & ~_isin(keys, told)
            one = order[new][~before | again]
            open_ = ~sure[one]
            runs = place[last] + 1 - place[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([run_key, key[one]]).view(np.int64)),
                    pa.array(np.concatenate([tid[first], np.where(open_, tid[one], 0)])),
                    # place, and above it the length of a settled run, 0 for an open window, -1 for a row that only counts
                    pa.array(np.concatenate([place[first] + (runs << 32), np.where(open_, place[one], -1)]).astype(np.int64)),
                ],
                names=["key", "tid", "at"],
            )
            seen, told = _with(seen, keys[~before]), _with(told, keys[again])
            if len(seen) > SEEN:
                seen = told = np.zeros(0, np.uint64)

    texts = heads.join(lists.hint("merge"), "tid").select("tid", "n", "text", "phrases")
    marked = texts.mapInArrow(windows, "key long, tid long, at long")
    runs = marked.withColumn("c", F.expr("count(*) over (partition by key)")).where("at >= 0 and (c > 1 or at >= 4294967296)")
    runs = runs.selectExpr("tid", "cast(at & 4294967295 as int) as first", "cast((at & 4294967295) + greatest(shiftright(at, 32), 1) as int) as last")
    return rows, runs.groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """x in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _with(table: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.insert(table, np.searchsorted(table, more), more) if len(more) else table


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept) per row; kept holds the words that stay, joined by one space."""
    rows, runs = repeated(docs, id_col, text_col, width)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text", _SLICE):
            data, off = tc.raw(b.column(1))
            data = data.tobytes()
            times, lists = b.column(2).to_numpy(), b.column(3)
            n, gone, kept = [], [], []
            for i in range(b.num_rows):
                words = data[off[i] : off[i + 1]].split()
                n.append(len(words))
                if times[i] > 1 and len(words) >= width:
                    words = []
                elif lists[i].is_valid:
                    x = lists[i].values
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, x.field("first").to_numpy(), 1)
                    np.add.at(cover, x.field("last").to_numpy() + width - 1, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    out = rows.join(runs.hint("merge"), "tid", "left").select("id", "text", "n", "runs").mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
