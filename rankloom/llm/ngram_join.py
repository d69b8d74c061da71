"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence matrix.

1. Documents with the same set of word shingles form one class; from here on a class is one matrix row.
2. Columns get one global order and only the leading `n - ceil(t n) + 1` columns of a row of size n enter the first
   product; two rows whose overlap reaches the bound must meet there. Columns that many rows lead with ("hot") move behind
   all others, so boilerplate does not make candidates. Any set of hot columns gives the same result; it only decides how
   much work there is.
3. A column is cut into groups of rows of about equal size: rows that can link lie in the same or in neighbouring size classes.
4. Groups of at most SMALL rows are expanded into their pairs, and these are summed over all columns: a pair's overlap is at most
   that sum, plus the leading columns that lie in larger groups, plus what follows the leading columns. A pair below the
   bound that both sizes set is discarded.
5. Larger groups are never expanded. Their rows first meet one row of the group; only groups that then still hold different
   components are worked through in pairs of blocks of rows, under the bounds of sizes, places and parity sketches (a lower
   bound of the symmetric difference). A row sends on its most similar partner there, in BEST rounds at most while links are
   found; a last round sends what is left.
6. The full rows of surviving pairs are multiplied one block of columns after the other; a pair leaves as soon as its sum and what is left of the
   smaller row cannot reach the bound. Links merge components, and pairs within one need no product.

Rows with a null id or text: a null text is empty; an empty text has no shingles and links with nothing. Rows that share
an id are kept as they are. Ties have no effect: links are symmetric and components are named by their least id. An empty table gives no rows.
Shingles are told apart by hashes of 52 bits and sets by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import keep, maybe_broadcast, merge

U = np.uint64
#: A column that more than this many rows lead with is hot.
HOT = 16
#: At most this many hot columns go to the executors (8 bytes each); with more, HOT is doubled until they fit.
HOT_COLUMNS = 2_000_000
HOT_ROUNDS = 1
#: Groups of at most this many rows are expanded into pairs.
SMALL = 16
#: Rounds in which rows meet one row of their group, and in which each row sends on one partner.
STARS, BEST = 1, 2
#: Rows of one column in a block.
BLOCK_ROWS = 512
#: Bytes of sketches that are compared at once, and pairs whose rows are multiplied at once.
PAIR_BYTES, PAIRS = 1 << 21, 64
#: Column blocks of the exact product.
BLOCKS = 8
#: Classes that a task remembers to have sent already.
SEEN = 100_000
#: In a short sketch differences of small sets fall on the same bits, and pairs below the bound pass.
SKETCH_BITS = 1024
_BITMAP = 22
NO_ID = -(2**63)


def _sets(batch: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their shingles, and the number of shingles of each row of the batch."""
    data, off = tc.raw(tc.text_column(batch, text))
    keys = tc.shingles(tc.words(data, off, tc.LOWER), width)
    own = (keys >> U(tc.GRAM_BITS)).astype(np.int64)
    return own, keys & tc.GRAM_MASK, np.bincount(own, minlength=batch.num_rows)


def _classes(own: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; 0 if it is empty."""
    total = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        first = np.concatenate([[0], np.cumsum(size)])[some]
        total[some] = np.add.reduceat(tc.mix(grams ^ U(0x5851F42D4C957F2D)), first)
        total[some] = tc.mix(total[some] + size[some].astype(np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    return total


def _sketches(own: np.ndarray, grams: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """Parity of the number of shingles that fall on each of 2^k bits, at least SKETCH_BITS and twice the shingles; folding halves gives the shorter sketch."""
    out: list[bytes | None] = [None] * len(size)
    bits = np.maximum(SKETCH_BITS.bit_length() - 1, np.ceil(np.log2(np.maximum(size, 1))).astype(int) + 1)
    base = np.concatenate([[0], np.cumsum(np.where(size > 0, 1 << bits, 0))])
    where = base[own] + (tc.mix(grams ^ U(0xA24BAED4963EE407)) & ((U(1) << bits[own].astype(np.uint64)) - U(1))).astype(np.int64)
    odd = np.packbits((np.bincount(where, minlength=base[-1]) & 1).astype(bool)) if len(where) else np.zeros(0, np.uint8)
    for i in np.flatnonzero(size):
        out[i] = odd[base[i] // 8 : base[i + 1] // 8].tobytes()
    return out


def sets_table(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, cls, sketch) of every row; cls is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text"):
            own, grams, size = _sets(b, "text", width)
            cls = _classes(own, grams, size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64), mask=size == 0), pa.array(_sketches(own, grams, size), pa.binary())],
                names=["id", "n", "cls", "sketch"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n long, cls long, sketch binary")


def _lead(size, num: int, den: int):
    """Leading columns of a row; a pair that links shares one of them."""
    return size - (num * size + den - 1) // den + 1


def _leading(src: DataFrame, width: int, num: int, den: int, hot) -> DataFrame:
    """(gram, cls, n, pos) for the leading columns of every class, under the order (hot, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value if hot is not None else np.zeros(0, np.uint64)
        bits = np.zeros(1 << _BITMAP, bool)
        bits[(table & U((1 << _BITMAP) - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for b in tc.slices(batches, "text"):
            own, grams, size = _sets(b, "text", width)
            cls = _classes(own, grams, size)
            fresh = np.zeros(len(size), bool)
            for i in np.flatnonzero(size):
                c = int(cls[i])
                if c not in seen:
                    fresh[i] = True
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
            lead = _lead(size, num, den)
            if len(table):
                at = np.flatnonzero(bits[(grams & U((1 << _BITMAP) - 1)).astype(np.int64)])
                at = at[table[np.minimum(np.searchsorted(table, grams[at]), len(table) - 1)] == grams[at]]
                keys = (own.astype(np.uint64) << U(tc.GRAM_BITS + 1)) | grams
                keys[at] |= U(1 << tc.GRAM_BITS)
                keys.sort()
                own, grams = (keys >> U(tc.GRAM_BITS + 1)).astype(np.int64), keys & tc.GRAM_MASK
            rank = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
            use = fresh[own] & (rank < lead[own])
            cols = (grams[use].view(np.int64), cls[own[use]].view(np.int64), size[own[use]].astype(np.int32), rank[use].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "cls", "n", "pos"])

    return src.select("text").mapInArrow(run, "gram long, cls long, n int, pos int")


def _hot_columns(counted: DataFrame) -> np.ndarray:
    """The columns that more than HOT rows lead with, or the HOT_COLUMNS at most above the least power of two that has so few."""
    often = counted.where(F.col("rows") > HOT)
    counts = often.groupBy(F.floor(F.log2(F.col("rows") - 1)).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()  # at most 63 rows
    total, least = 0, None
    for k, n in counts:
        total += n
        if total > HOT_COLUMNS:
            break
        least = k
    found = often.where(F.floor(F.log2(F.col("rows") - 1)) >= F.lit(64 if least is None else least)).select("gram").toArrow()
    return np.sort(found.column(0).to_numpy()).view(np.uint64)


def _fold(s: np.ndarray, n: int) -> np.ndarray:
    while len(s) > n:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _pruned(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parity sketches allow a link, with the share of the sketch in which they differ."""
    left = table.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = table.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            sa, sb = b.column(3).to_pylist(), b.column(5).to_pylist()
            most = (na + nb) - 2 * -(-num * (na + nb) // (num + den))
            differ = np.zeros(b.num_rows, np.int64)
            for i in range(b.num_rows):
                x, y = np.frombuffer(sa[i], np.uint8), np.frombuffer(sb[i], np.uint8)
                m = min(len(x), len(y))
                differ[i] = int(np.bitwise_count(_fold(x, m) ^ _fold(y, m)).sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(differ / (na + nb))], names=["a", "b", "far"]).filter(pa.array(differ <= most))
        tc.release()

    allowed = (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    # the hint-free join keys are unique on the table's side, so a hot row is only replicated as often as it has pairs
    both = pairs.join(left, "a").join(right, "b").where(allowed).select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(run, "a long, b long, far double")


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each row the pair (a, b) with the least `far`."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "far").union(pairs.select("b", "a", "far"))
    return both.groupBy("x").agg(F.min(F.struct("far", "y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()


def _blocks(rows: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Pairs (a, b, far) of different components that share a group and pass the bounds, by pairs of blocks of a group's rows.

    A row goes to as many block pairs as its group has blocks; with `best` a block pair sends on one pair for each row at most."""
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("gram", "slot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "top", "cls", "root", "n", "pos", "sketch")
    dealt = dealt.repartition("gram", "slot", "i", "j").sortWithinPartitions("gram", "slot", "i", "j")
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def one(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, own, top, cls, root, n, pos = (t.column(k).to_numpy().astype(np.int64) for k in ("i", "j", "own", "top", "cls", "root", "n", "pos"))
        if i[0] == j[0]:
            left = right = np.arange(len(n))
        else:
            left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        if not len(left) or not len(right):
            return none
        na, nb = n[left][:, None], n[right][None, :]
        ok = (root[left][:, None] != root[right][None, :]) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
        ok &= (num + den) * np.minimum(na - pos[left][:, None], nb - pos[right][None, :]) >= num * (na + nb)
        ok &= (top[left][:, None] | top[right][None, :]) > 0  # else they meet in the group before
        if i[0] == j[0]:
            ok &= left[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        if not len(x):
            return none
        sketch = [np.frombuffer(v, np.uint8) for v in t.column("sketch").to_pylist()]
        size = np.array([len(v) for v in sketch])
        least = np.minimum(size[x], size[y])
        most = (n[x] + n[y]) - 2 * -(-num * (n[x] + n[y]) // (num + den))
        differ = np.zeros(len(x), np.int64)
        for m in np.unique(least).tolist():
            use = np.flatnonzero(size >= m)
            place = np.zeros(len(size), np.int64)
            place[use] = np.arange(len(use))
            folded = np.stack([_fold(sketch[k], m) for k in use]).view(np.uint64)
            at = np.flatnonzero(least == m)
            step = max(1, PAIR_BYTES // m)
            for c in range(0, len(at), step):
                k = at[c : c + step]
                differ[k] = np.bitwise_count(folded[place[x[k]]] ^ folded[place[y[k]]]).sum(axis=1)
        good = np.flatnonzero(differ <= most)
        x, y, far = x[good], y[good], differ[good] / (n[x[good]] + n[y[good]])
        if best and len(x):
            order = np.argsort(far, kind="stable")
            x, y, far = x[order], y[order], far[order]
            one = np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])
            x, y, far = x[one], y[one], far[one]
        a, b = cls[x], cls[y]
        return np.minimum(a, b), np.maximum(a, b), far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def groups(t: pa.Table, last: bool):
            key = [t.column(k).to_numpy() for k in ("gram", "slot", "i", "j")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            edge = [0, *cut.tolist(), t.num_rows]
            pairs = [one(t.slice(s, e - s)) for s, e in zip(edge[:-1], edge[1:] if last else edge[1:-1]) if e - s > 1]
            rest = None if last else t.slice(edge[-2])
            return pairs, rest

        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs]) if pairs else none[k]) for k in range(3)], names=["a", "b", "far"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            pairs, held = groups(held, False)
            yield batch(pairs)
        if held is not None and held.num_rows:
            yield batch(groups(held, True)[0])
        held = None
        tc.release()

    return dealt.mapInArrow(run, "a long, b long, far double")


def _rows_of(src: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, grams) of the documents with the ids in `wanted` (id); grams are sorted 8-byte hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "text"):
            own, grams, size = _sets(b, "text", width)
            cls = _classes(own, grams, size)
            at = np.concatenate([[0], np.cumsum(size)])
            blobs = [grams[at[i] : at[i + 1]].tobytes() for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(blobs, pa.binary())], names=["cls", "grams"])

    return src.join(wanted, "id", "left_semi").select("text").mapInArrow(run, "cls long, grams binary")


def _product(both: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of rows (ga, gb) that link: overlaps summed block by block of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, PAIRS):
                b = big.slice(s, PAIRS)
                n = b.num_rows
                rows = [[np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3)]
                na, nb = (np.array([len(x) for x in r]) for r in rows)
                need = -(-num * (na + nb) // (num + den))
                edge = np.arange(1, BLOCKS, dtype=np.uint64) * U(2**tc.GRAM_BITS // BLOCKS)
                cuts = [[np.searchsorted(x, edge) for x in r] for r in rows]
                live, total = np.ones(n, bool), np.zeros(n, np.int64)
                left = [na.copy(), nb.copy()]
                for k in range(BLOCKS):
                    idx = np.flatnonzero(live)
                    part = []
                    for side in (0, 1):
                        lo = [0 if k == 0 else int(cuts[side][i][k - 1]) for i in idx]
                        hi = [len(rows[side][i]) if k == BLOCKS - 1 else int(cuts[side][i][k]) for i in idx]
                        part.append([rows[side][i][x:y] for i, x, y in zip(idx, lo, hi)])
                        left[side][idx] -= np.array(hi, int) - np.array(lo, int)
                    if len(idx):
                        key = np.concatenate([np.concatenate(p) for p in part])
                        row = np.concatenate([np.repeat(np.arange(len(idx)), [len(x) for x in p]) for p in part])
                        order = np.lexsort((key, row))
                        key, row = key[order], row[order]
                        hit = np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1]))
                        total[idx] += np.bincount(row[hit], minlength=len(idx))
                    live &= total + np.minimum(left[0], left[1]) >= need
                ok = live & (den * total >= num * (na + nb - total))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))
        tc.release()

    return both.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, n_copies) per row; two rows link if den * overlap >= num * union of their shingle sets.

    component_id is the least id that links reach; n_copies counts the rows with the same set.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = keep(sets_table(docs, id_col, text_col, width), "sets")
    key = F.coalesce("id", F.lit(NO_ID))
    reps = keep(table.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    wide = reps.select("cls", "n", "sketch")

    hot = None
    for _ in range(HOT_ROUNDS):
        counted = keep(_leading(src, width, num, den, hot).groupBy("gram").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT), "hot-columns")
        hot = spark.sparkContext.broadcast(_hot_columns(counted))
    lead = _leading(src, width, num, den, hot)
    shared = lead.groupBy("gram").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("gram")
    posts = keep(lead.join(keep(shared, "columns").hint("shuffle_hash"), "gram", "left_semi").distinct(), "postings")

    # a little more than den / num, so that rounding keeps neighbours in size together
    place = F.floor(F.log("n") / F.lit(math.log(max(den / num, 1.0001) * (1 + 1e-6)))).cast("int")
    slots = posts.select("gram", "cls", "n", "pos", F.explode(F.array(F.struct(place.alias("slot"), F.lit(True).alias("top")), F.struct((place + 1).alias("slot"), F.lit(False).alias("top")))).alias("s")).select("gram", "s.slot", "s.top", "cls", "n", "pos")
    useful = keep(slots.groupBy("gram", "slot").agg(F.count("*").alias("rows"), F.max("top").alias("any")).where("rows > 1 and any").select("gram", "slot", "rows"), "useful")
    groups = keep(slots.join(useful, ["gram", "slot"]), "groups")
    # the rows whose places allow a link if this is the first column that both hold; another first column is met on its own
    enough = f"{den} * least(na, nb) >= {num} * greatest(na, nb) and (ta or tb)"
    side = lambda k: groups.select("gram", "slot", F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"), F.col("top").alias(f"t{k}"))
    large = groups.where((F.col("rows") > SMALL) & F.col("top")).groupBy("cls").agg(F.countDistinct("gram").alias("m"))
    large = large.union(groups.where((F.col("rows") > SMALL) & ~F.col("top")).groupBy("cls").agg(F.countDistinct("gram"))).groupBy("cls").agg(F.sum("m").alias("m"))
    few = groups.where(F.col("rows") <= SMALL).select("gram", "slot")
    both = side("a").join(groups.where(F.col("rows") <= SMALL).select("gram", "slot", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("top").alias("tb")), ["gram", "slot"]).where(f"a < b and {enough}")
    summed = both.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    summed = summed.join(large.select(F.col("cls").alias("a"), F.col("m").alias("la")), "a", "left").join(large.select(F.col("cls").alias("b"), F.col("m").alias("lb")), "b", "left")
    rest = lambda n: f"(({num} * {n} + {den - 1}) div {den} - 1)"
    need = f"(({num} * (na + nb) + {num + den - 1}) div {num + den})"
    bound = f"met + least(coalesce(la, 0), coalesce(lb, 0)) + greatest({rest('na')}, {rest('nb')}) >= {need}"
    pairs = keep(_pruned(summed.where(bound).select("a", "b"), wide, num, den), "pairs")

    def verified(labels: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame | None, bool]:
        """labels after the links among `pairs`, and whether there are any."""
        if pairs.isEmpty():
            return labels, False
        need = keep(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls").select(F.col("rep").alias("id")), "wanted")
        rows = keep(_rows_of(src, maybe_broadcast(need, 8), width).dropDuplicates(["cls"]), "rows")
        both = pairs.join(rows.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a").join(rows.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
        links = keep(_product(both.select("a", "b", "ga", "gb"), num, den), "linked")
        return merge(labels, links), not links.isEmpty()

    labels, _ = verified(None, pairs)

    big = groups.where(F.col("rows") > SMALL)
    big = None if big.isEmpty() else big

    def open_groups(labels: DataFrame | None) -> DataFrame:
        """Rows of the large groups that hold different components, with their components."""
        named = big if labels is None else big.join(maybe_broadcast(labels, 16), big["cls"] == labels["node"], "left")
        named = named.select("gram", "slot", "top", "cls", "n", "pos", (F.col("cls") if labels is None else F.coalesce("root", "cls")).alias("root"))
        mixed = keep(named.groupBy("gram", "slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("gram", "slot", "rows"), "mixed")
        return keep(named.join(maybe_broadcast(mixed, 20), ["gram", "slot"]), "open")

    for k in range(STARS if big is not None else 0):
        rows = open_groups(labels)
        if rows.isEmpty():
            break
        order = F.struct(F.col("pos") if k == 0 else F.xxhash64("cls"), "cls", "n", "top", "root")
        heads = keep(rows.groupBy("gram", "slot").agg(F.min(order).alias("h")).selectExpr("gram", "slot", "h.cls as a", "h.n as na", "h.top as ta", "h.root as ra"), "heads")
        met = rows.selectExpr("gram", "slot", "cls as b", "n as nb", "top as tb", "root as rb").join(maybe_broadcast(heads, 40), ["gram", "slot"]).where(f"ra <> rb and {enough}")
        labels, _ = verified(labels, keep(_nearest(_pruned(met.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), wide, num, den)), "nearest"))
    some = True
    for k in range(BEST + 1 if big is not None else 0):
        last = k == BEST or not some
        rows = open_groups(labels)
        if rows.isEmpty():
            break
        found = _blocks(rows.join(wide.select("cls", "sketch"), "cls"), num, den, not last)
        labels, some = verified(labels, keep(found.select("a", "b").distinct() if last else _nearest(found), "nearest"))
        if last:
            break

    # one row for each class, then for each row its class
    named = reps.select("cls", "copies", "least", F.col("cls").alias("grp"))
    if labels is not None:
        named = named.join(maybe_broadcast(labels, 16), named["cls"] == labels["node"], "left").select("cls", "copies", "least", F.coalesce("root", "grp").alias("grp"))
    least = keep(named.groupBy("grp").agg(F.min("least").alias("component_id")), "least")
    classes = keep(named.join(least, "grp").select("cls", "copies", "component_id"), "components")
    return table.select("id", "n", "cls").join(classes, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies")
    )
