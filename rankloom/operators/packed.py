"""Sparse products without a row for each term.

A matrix is packed once into files of the shared folder: rows in ranges of their key, each with its columns and data. A product
A B is formed where the rows of A are: a task looks up the rows of B that its rows name, adds them up in numpy and sends on only
what the caller keeps of each row. So neither terms nor sums are shuffled, and disk holds the two matrices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import filesystem, release, remove, run_folder, stored

#: Cells that a file of a packed matrix should hold, and the files at least and at most.
CELLS, LEAST_FILES, MOST_FILES = 500_000, 12, 4_096
#: Cells for which a task of `made` is started, as far as there are parts.
LEAST_CELLS = 20_000
#: Rounds in which rows written by one key are read by the other; what a round has read is removed.
ROUNDS = 4
#: Cells of rows looked up at once, cells of rows that look them up at once, and terms and rows added up at once.
LOOKED_UP, ASKING, TERMS, ROWS = 2_000_000, 64_000, 32_000, 64

Array = np.ndarray


@dataclass
class Packed:
    """Rows `key` with their columns `col`, both long; parts are (file, first key, last key, rows, cells, least column, greatest column, kinds of columns and data), by key."""

    folder: str
    parts: list[tuple]
    spark: SparkSession = field(repr=False, default=None)

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "parts": self.parts, "spark": None}

    def span(self) -> tuple[int, int]:
        """Least column and how many there are from it to the greatest."""
        if not self.parts:
            return 0, 0
        low = min(p[5] for p in self.parts)
        return low, max(p[6] for p in self.parts) - low + 1

    def size(self) -> int:
        return sum(p[4] for p in self.parts)

    def rows(self) -> Rows:
        return Rows(self)

    def load(self, k: int) -> tuple[Array, Array, Array, Array, Array]:
        """Keys, starts (one more than keys), columns, data and sums of squares of the rows of a part; local files are mapped, not read."""
        disk, top = filesystem(self.folder)
        name, _, _, rows, cells, _, _, short, single = self.parts[k]
        out, at = [], 0
        path = f"{top}/{name}"
        if disk.type_name == "local":
            whole = np.asarray(np.memmap(path, np.uint8, "r"))
        else:
            with disk.open_input_file(path) as f:
                whole = np.frombuffer(f.read(), np.uint8)
        for n, kind in ((rows, np.int64), (rows + 1, np.int64), (rows, np.float64), (cells, single), (cells, short)):
            size = n * np.dtype(kind).itemsize
            out.append(whole[at : at + size].view(kind))
            at += size
        return out[0], out[1], out[4], out[3], out[2]

    def cells(self, key: str, col: str) -> DataFrame:
        """(key, col, data)"""
        packed = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    keys, starts, cols, data, _ = packed.load(k)
                    for r in range(0, len(keys), 10_000):
                        own = starts[r : r + 10_001]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(keys[r : r + 10_000], np.diff(own))), pa.array(cols[own[0] : own[-1]].astype(np.int64)), pa.array(data[own[0] : own[-1]].astype(float))], names=[key, col, "data"])

        return self.tasks().mapInArrow(run, f"{key} long, {col} long, data double")

    def tasks(self) -> DataFrame:
        """A row and task for each part."""
        n = len(self.parts)
        return self.spark.range(0, n, 1, max(1, n))


def pack(m: DataFrame, key: str, col: str, data: str = "data", cells: int | None = None, span: tuple[int, int] | None = None) -> Packed:
    """m (key, col, data), cells of distinct coordinates, in files by ranges of the key.

    Spark samples the keys for the ranges, which computes m once more. With the span (least key, places) and the cells known, ranges are
    equal parts of the span, and m is computed once."""
    spark = m.sparkSession
    m = m.select(F.col(key).cast("long").alias("key"), F.col(col).cast("long").alias("col"), F.col(data).cast("double").alias("data")).where("key is not null and col is not null")
    n = min(MOST_FILES, max(LEAST_FILES, -(-(m.count() if cells is None else cells) // CELLS)))
    folder = _folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = filesystem(folder)
        disk.create_dir(top, recursive=True)
        held, n = [], 0
        for b in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in b.columns[:3]])
            n += b.num_rows
            if n >= 4 * CELLS:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last row may go on
                if cut:
                    yield _written(disk, top, *(c[:cut] for c in whole))
                held, n = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if n:
            yield _written(disk, top, *(np.concatenate(c) for c in zip(*held)))

    if span is None:
        dealt = m.repartitionByRange(n, "key")
    else:
        low, size = span
        dealt = m.repartitionById(n, F.least(F.greatest(F.floor((F.col("key") - low) * F.lit(n / max(1, size))), F.lit(0)), F.lit(n - 1)).cast("int"))
    parts = dealt.sortWithinPartitions("key", "col").mapInArrow(run, PARTS).collect()
    del dealt, m
    release(spark)
    return Packed(folder, sorted((tuple(p) for p in parts), key=lambda p: p[1]), spark)


def _folder(spark: SparkSession) -> str:
    return stored(f"{run_folder(spark)}/packed-{uuid.uuid4().hex}")


PARTS = "file string, low long, high long, rows long, cells long, least long, most long, cols string, kind string"


def made(x: Packed, make: Callable) -> Packed:
    """A packed matrix of the (keys, columns, data) that make(part of x) yields, by key and column and within the part's keys; each part is written where it is made, nothing is shuffled."""
    return made_together((x, make))[0]


def made_together(*each: tuple[Packed, Callable]) -> list[Packed]:
    """What `made` gives of each (x, make), in one job."""
    spark, folders = each[0][0].spark, [_folder(x.spark) for x, _ in each]
    first = np.cumsum([0] + [len(x.parts) for x, _ in each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                t = int(np.searchsorted(first, k, "right")) - 1
                disk, top = filesystem(folders[t])
                disk.create_dir(top, recursive=True)
                for keys, cols, data in each[t][1](k - int(first[t])):
                    if len(keys):
                        out = _written(disk, top, keys, cols, data)
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([t])], names=[*out.schema.names, "at"])

    n = int(first[-1])
    tasks = max(1, min(n, sum(x.size() for x, _ in each) // LEAST_CELLS))
    parts = [tuple(p) for p in spark.range(0, n, 1, tasks).mapInArrow(run, f"{PARTS}, at long").collect()]
    return [Packed(f, sorted((p[:-1] for p in parts if p[-1] == t), key=lambda p: p[1]), x.spark) for t, (f, (x, _)) in enumerate(zip(folders, each))]


def dealt(x: Packed, begin: Callable, span: tuple[int, int], cells: int, done: Callable = lambda: None) -> Packed:
    """Cells (i, j, w) that are made part by part of x, packed by i: `pack` without Spark's shuffle. begin() is called once in a task and gives make(part), which yields them.

    A task writes its cells in the order of i, a file for each round; in a round, tasks of ranges of i read their slices of all its files and
    write them by row, and the files go. span is the least i and its places, cells how many there may be; done is called once x is read."""
    spark = x.spark
    low, size = span
    per = -(-min(MOST_FILES, max(LEAST_FILES, -(-cells // CELLS))) // ROUNDS)
    edges = low + np.arange(ROUNDS * per + 1) * max(1, size) // (ROUNDS * per)
    folders = [_folder(spark) for _ in range(ROUNDS)]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = filesystem(folders[0])
        tops = [filesystem(f)[1] for f in folders]
        for top in tops:
            disk.create_dir(top, recursive=True)
        make = None

        def written(held: list) -> pa.RecordBatch:
            i, j, w = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(i, kind="stable")
            i, j, w = i[order], j[order], w[order]
            cut, names = np.searchsorted(i, edges), []
            for q, top in enumerate(tops):
                own = cut[q * per : (q + 1) * per + 1]
                names.append(uuid.uuid4().hex)  # of this attempt, as below
                with disk.open_output_stream(f"{top}/{names[-1]}", compression=None) as f:
                    f.write((own - own[0]).astype(np.int64).data)
                    x, y = i[own[0] : own[-1]], j[own[0] : own[-1]]
                    kinds = [_short(x), _short(y)]
                    for c in (x.astype(np.int32) if kinds[0] else x, y.astype(np.int32) if kinds[1] else y, w[own[0] : own[-1]], np.array(kinds, np.int64)):
                        f.write(np.ascontiguousarray(c).data)
            return pa.RecordBatch.from_arrays([pa.array([names])], names=["files"])

        for batch in batches:
            for k in batch.column(0).to_pylist():
                make = begin() if make is None else make
                held, n = [], 0
                for found in make(k):
                    held.append(found)
                    n += len(found[0])
                    if n >= 4 * CELLS:
                        yield written(held)
                        held, n = [], 0
                if n:
                    yield written(held)

    files = [r[0] for r in x.tasks().mapInArrow(slices, "files array<string>").collect()]
    done()
    folder, parts = _folder(spark), []
    for q in range(ROUNDS):
        source, names = folders[q], [f[q] for f in files]

        def gathered(batches: Iterator[pa.RecordBatch], source=source, names=names) -> Iterator[pa.RecordBatch]:
            disk, top = filesystem(folder)
            disk.create_dir(top, recursive=True)
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    yield from _by_row(disk, top, [_slice(disk, f"{filesystem(source)[1]}/{n}", p, per) for n in names])

        parts += spark.range(0, per, 1, per).mapInArrow(gathered, PARTS).collect()
        remove(source)
    return Packed(folder, sorted((tuple(p) for p in parts), key=lambda p: p[1]), spark)


def turned(a: Packed, b: Packed | Light, keep: Callable, shared: Callable, span: tuple[int, int], cells: int, done: Callable = lambda: None) -> Packed:
    """What `multiply` gives as (i, j, w), packed by i as `dealt` does."""
    low, width = b.span()

    def begin() -> Callable:
        rows, scratch, extra = b.rows(), np.zeros(width, np.int32 if width < 2**31 else np.int64), shared()

        def make(k: int) -> Iterator[tuple[Array, Array, Array]]:
            for found in product(*a.load(k)[:4], rows, low, scratch):
                yield keep(*found, extra)

        return make

    return dealt(a, begin, span, cells, done)


def _short(x: Array) -> bool:
    return not len(x) or (-(2**31) <= int(x.min()) and int(x.max()) < 2**31)


def _slice(disk, path: str, p: int, per: int) -> tuple[Array, Array, Array]:
    """i, j and w of a range in a file of `turned`."""
    with disk.open_input_file(path) as f:
        cut = np.frombuffer(f.read_at(8 * (per + 1), 0), np.int64)
        kinds = np.frombuffer(f.read_at(16, f.size() - 16), np.int64)
        at, out = 8 * (per + 1), []
        for kind in (np.int32 if kinds[0] else np.int64, np.int32 if kinds[1] else np.int64, np.float64):
            one = np.dtype(kind).itemsize
            out.append(np.frombuffer(f.read_at(one * int(cut[p + 1] - cut[p]), at + one * int(cut[p])), kind))
            at += one * int(cut[-1])
    return tuple(out)


def _by_row(disk, top: str, slices: list) -> Iterator[pa.RecordBatch]:
    """Cells (i, j, w), each slice in the order of i, written by row; so many at a time that they take no more than `pack` holds."""
    slices = [s for s in slices if len(s[0])]
    if not slices:
        return
    least, most = min(int(s[0][0]) for s in slices), max(int(s[0][-1]) for s in slices)
    if sum(len(s[0]) for s in slices) > 4 * CELLS and least < most:
        half = least + (most - least) // 2
        at = [int(np.searchsorted(s[0], half, "right")) for s in slices]
        yield from _by_row(disk, top, [tuple(x[:t] for x in s) for s, t in zip(slices, at)])
        yield from _by_row(disk, top, [tuple(x[t:] for x in s) for s, t in zip(slices, at)])
        return
    i, j, w = (np.concatenate(c) for c in zip(*slices))
    order = np.lexsort((j, i))
    yield _written(disk, top, i[order].astype(np.int64), j[order].astype(np.int64), w[order])


def scaled_rows(x: Packed, weights: Packed) -> Packed:
    """x with the data of each row times its weight (rows and one column of `weights`), without the rows that have none; each part is written anew where it is, nothing is shuffled."""

    def make(k: int) -> Iterator[tuple[Array, Array, Array]]:
        keys, starts, cols, data, _ = x.load(k)
        part, start, length = (known := Rows(weights)).find(np.asarray(keys))
        have, size = length > 0, np.diff(starts)
        if have.any():
            factor = np.zeros(len(keys))
            factor[have] = known.take(part, start, length)[2]
            use = np.repeat(have, size)
            yield np.repeat(keys, size)[use], cols[use], (data * np.repeat(factor, size))[use]

    return made(x, make)


def some_rows(x: Packed, k: int, cells: int = ASKING) -> Iterator[tuple[Array, Array, Array, Array]]:
    """Keys, starts from 0, columns and data of a part's rows, so many at a time that they have about `cells` cells."""
    keys, starts, cols, data, _ = x.load(k)
    t = 0
    while t < len(keys):
        u = max(t + 1, int(np.searchsorted(starts, starts[t] + cells, "right")) - 1)
        own = slice(starts[t], starts[u])
        yield np.asarray(keys[t:u]), starts[t : u + 1] - starts[t], cols[own].astype(np.int64), data[own].astype(float)
        t = u


def dense_rows(rows: Rows, keys: Array, width: int) -> Array:
    """Rows of a packed table with `width` cells in each, by keys that it has, in any order and repeated."""
    asked, place = np.unique(keys, return_inverse=True)
    return rows.take(*rows.find(asked))[2].reshape(-1, width)[place]


def _written(disk, top: str, keys: Array, cols: Array, values: Array) -> pa.RecordBatch:
    """What one file holds; ids and data take four bytes where nothing is lost."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    squares = np.add.reduceat(values * values, first)
    least, most = int(cols.min()), int(cols.max())
    short = cols.astype(np.int32) if -(2**31) <= least and most < 2**31 else cols
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    single = single if (single == values).all() else values
    name = uuid.uuid4().hex  # of this attempt; only what a finished task reports counts
    with disk.open_output_stream(f"{top}/{name}", compression=None) as f:
        for x in (keys[first], np.append(first, len(keys)).astype(np.int64), squares, single, short):
            f.write(np.ascontiguousarray(x).data)
    row = [name, int(keys[0]), int(keys[-1]), len(first), len(keys), least, most, short.dtype.str, single.dtype.str]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "low", "high", "rows", "cells", "least", "most", "cols", "kind"])


class Rows:
    """Rows of a packed matrix looked up by key, in a task."""

    def __init__(self, packed: Packed):
        self.packed, self.open = packed, {}
        self.mapped = filesystem(packed.folder)[0].type_name == "local"
        self.low = np.array([p[1] for p in packed.parts], np.int64)

    def find(self, keys: Array) -> tuple[Array, Array, Array]:
        """Part, start and length of the rows of sorted keys; length 0 where there is none."""
        part = np.searchsorted(self.low, keys, "right") - 1
        start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for p in np.unique(part[part >= 0]):
            if p not in self.open:
                if len(self.open) >= 8 and not self.mapped:
                    self.open.clear()  # only files that had to be read take memory
                self.open[p] = self.packed.load(p)
            own, starts = self.open[p][:2]
            here = np.flatnonzero(part == p)
            at = np.minimum(np.searchsorted(own, keys[here]), len(own) - 1)
            ok = own[at] == keys[here]
            start[here[ok]], length[here[ok]] = starts[at[ok]], starts[at[ok] + 1] - starts[at[ok]]
        return part, start, length

    def take(self, part: Array, start: Array, length: Array) -> tuple[Array, Array, Array]:
        """First places, columns and data of found rows, one after the other."""
        first = np.concatenate(([0], np.cumsum(length)))
        cols, data = np.empty(first[-1], np.int64), np.empty(first[-1])
        for p in np.unique(part[length > 0]):
            here = np.flatnonzero((part == p) & (length > 0))
            if p not in self.open:
                self.open[p] = self.packed.load(p)
            own = ranges(start[here], length[here])
            to = ranges(first[here], length[here])
            cols[to], data[to] = self.open[p][2][own], self.open[p][3][own]
        return first[:-1], cols, data


@dataclass
class Light:
    """A packed matrix whose rows of more than `longest` cells are not found where rows are looked up."""

    packed: Packed
    longest: int

    def span(self) -> tuple[int, int]:
        return self.packed.span()

    def rows(self) -> LightRows:
        return LightRows(self.packed, self.longest)


class LightRows(Rows):
    def __init__(self, packed: Packed, longest: int):
        super().__init__(packed)
        self.longest = longest

    def find(self, keys: Array) -> tuple[Array, Array, Array]:
        part, start, length = super().find(keys)
        return part, start, np.where(length > self.longest, 0, length)


@dataclass
class Mixed:
    """The sum of packed matrices, each times a factor, which is formed where rows are looked up and nowhere stored."""

    terms: list[tuple[Packed, float]]

    def span(self) -> tuple[int, int]:
        found = [x.span() for x, _ in self.terms if x.parts]
        low = min((a for a, _ in found), default=0)
        return low, max((a + n for a, n in found), default=low) - low

    def rows(self) -> MixedRows:
        return MixedRows(self)


class MixedRows:
    """`Rows` of a `Mixed`: a row holds those of its terms one after the other, so a column may come several times."""

    def __init__(self, mixed: Mixed):
        self.terms = [(Rows(x), factor) for x, factor in mixed.terms]

    def find(self, keys: Array) -> tuple[Array, Array, Array]:
        found = [rows.find(keys) for rows, _ in self.terms]
        part, start, size = (np.stack(x, axis=1) for x in zip(*found))
        return np.stack([part, size], axis=2), start, size.sum(axis=1)

    def take(self, part: Array, start: Array, length: Array) -> tuple[Array, Array, Array]:
        first = np.concatenate(([0], np.cumsum(length)))
        cols, data, at = np.empty(first[-1], np.int64), np.empty(first[-1]), first[:-1].copy()
        for k, (rows, factor) in enumerate(self.terms):
            size = part[:, k, 1]
            _, own, x = rows.take(part[:, k, 0], start[:, k], size)
            to = ranges(at, size)
            cols[to], data[to] = own, x * factor
            at += size
        return first[:-1], cols, data


def ranges(start: Array, length: Array) -> Array:
    """start, start + 1, ... of each range, one after the other."""
    before = np.concatenate(([0], np.cumsum(length)))
    return np.arange(before[-1]) + np.repeat(start - before[:-1], length)


def product(keys: Array, starts: Array, ids: Array, x: Array, b: Rows | MixedRows, low: int, scratch: Array) -> Iterator[tuple[Array, Array, Array, Array]]:
    """Rows of A B as (keys of some rows, row among them, column, sum), with every column that a term has; columns are in order within a row.

    ids and x are the cells of A between starts; scratch has a place for every column of B from `low` on."""
    t = 0
    while t < len(keys):
        u = max(t + 1, int(np.searchsorted(starts, starts[t] + ASKING, "right")) - 1)
        while True:
            own = slice(starts[t], starts[u])
            asked, place = np.unique(ids[own], return_inverse=True)
            part, start, length = b.find(asked)
            if u == t + 1 or length.sum() <= LOOKED_UP:
                break
            u = t + max(1, (u - t) // 2)
        if length.sum() <= LOOKED_UP:
            first, cols, data = b.take(part, start, length)
            yield from _summed(keys[t:u], starts[t : u + 1] - starts[t], place, np.asarray(x[own]), first, length, cols - low, data, low, scratch)
        else:
            # one row that names more than can be held at once: its terms are added up piece by piece
            total, seen = np.zeros(len(scratch)), np.zeros(len(scratch), bool)
            factor = np.bincount(place, np.asarray(x[own]), len(asked))
            cut = np.unique(np.searchsorted(np.cumsum(length), np.arange(0, length.sum(), LOOKED_UP)))
            for p, q in zip(cut, np.append(cut[1:], len(asked))):
                _, cols, data = b.take(part[p:q], start[p:q], length[p:q])
                np.add.at(total, cols - low, data * np.repeat(factor[p:q], length[p:q]))
                seen[cols - low] = True
            c = np.flatnonzero(seen)
            yield keys[t:u], np.zeros(len(c), np.int64), c + low, total[c]
        t = u


def _summed(keys, starts, place, x, first, length, cols, data, low, scratch):
    size = length[place]
    upto = np.concatenate(([0], np.cumsum(size)))[starts]  # terms before each row
    t = 0
    while t < len(keys):
        u = min(t + ROWS, max(t + 1, int(np.searchsorted(upto, upto[t] + TERMS, "right")) - 1))
        own = slice(starts[t], starts[u])
        n = size[own]
        at = ranges(first[place[own]], n)
        c = cols[at]
        v = data[at] * np.repeat(x[own], n)
        # columns of these rows in order, without sorting the terms
        count = np.arange(len(c), dtype=scratch.dtype)
        scratch[c] = count
        names = np.sort(c[scratch[c] == count])
        scratch[names] = np.arange(len(names), dtype=scratch.dtype)
        row = np.repeat(np.arange(u - t), upto[t + 1 : u + 1] - upto[t:u])
        cell = row * len(names) + scratch[c]
        there = np.zeros((u - t) * len(names), bool)
        there[cell] = True
        total = np.bincount(cell, v, len(there))
        cell = np.flatnonzero(there)
        row = cell // max(1, len(names))
        yield keys[t:u], row, names[cell - row * len(names)] + low, total[cell]
        t = u


def best(row: Array, value: Array, k: int) -> Array:
    """Places of the k greatest values of each row, greatest first, ties by place; rows are in order."""
    if not len(row):
        return np.zeros(0, np.int64)
    first = np.searchsorted(row, np.arange(row[-1] + 2))
    order = np.argsort(-value)
    # radix sort
    order = order[np.argsort(row[order].astype(np.uint16) if row[-1] < 65_536 else row[order], kind="stable")]
    last = np.minimum(first[:-1] + k, first[1:]) - 1
    least = np.where(last >= first[:-1], value[order[np.maximum(last, 0)]], np.inf)
    near = np.flatnonzero(value >= least[row])
    near = near[np.lexsort((near, -value[near], row[near]))]
    r = row[near]
    return near[np.arange(len(r)) - np.searchsorted(r, np.arange(row[-1] + 1))[r] < k]


def multiply(a: Packed, b: Packed | Light | Mixed, keep: Callable, schema: str, shared: Callable | None = None) -> DataFrame:
    """keep(keys, row, column, sum, what `shared` makes in the task) for some rows of A B at a time, as rows of the schema."""
    low, size = b.span()
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = scratch = extra = None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if rows is None:
                    rows, scratch, extra = b.rows(), np.zeros(size, np.int32 if size < 2**31 else np.int64), shared() if shared else None
                held, n = [], 0
                for found in product(*a.load(k)[:4], rows, low, scratch):
                    out = keep(*found, extra)
                    held.append(out)
                    n += len(out[0])
                    if n >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                        held, n = [], 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    return a.tasks().mapInArrow(run, schema)
