"""Vectorised word and n-gram hashing over Arrow string columns.

Words are the byte runs between the ASCII white-space bytes 09-0D and 20, so
they can be found in UTF-8 without decoding. All hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20

def _table(values) -> bytes:
    return np.asarray(values, np.uint8).tobytes()


_space = np.zeros(256, np.uint8)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
SPACE = _table(_space)
_mark = np.ones(256, np.uint8)
_mark[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
#: White space and ASCII punctuation.
PUNCTUATION = _table(_mark)
_low = np.arange(256)
_low[65:91] += 32
LOWER = _table(_low)
_low[48:58] = 48
#: Lower case, and every digit counts as 0.
LOWER_DIGITS = _table(_low)

_BASE = U(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Shingles keep this many bits of their hash, so that a text's number fits above them in one sortable word.
GRAM_BITS = 52
GRAM_MASK = U((1 << GRAM_BITS) - 1)
SLICE_ROWS = 2048


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column without nulls (a null text is empty)."""
    a = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(a, "") if a.null_count else a


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each (one more than texts)."""
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that scratch arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        off = raw(text_column(b, text))[1]
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), at + SLICE_ROWS, b.num_rows)
            yield b.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back: a Python worker outlives its task, and on an executor several wait for the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@dataclass
class Words:
    """Words of consecutive texts: byte span, hash, and the first word of each text (one more than texts)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _spans(src: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    # eight bytes at a time, so that the work goes with the words rather than the bytes
    src += b"\0" * 8
    eight = np.ndarray((len(src) - 7,), "<u8", src, strides=(1,))
    out = mix((eight[start] & _TAIL[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _BASE))
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        part = eight[start[at] + k] & _TAIL[np.minimum(size[at] - k, 8)]
        out[at] = mix(out[at] * U(_STEP) + part)
        k += 8
        at = at[size[at] > k]
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bytes | None = None) -> np.ndarray:
    """Hash of the bytes of each span, as `words` hashes a word."""
    src = data.tobytes()
    return _spans(src if fold is None else src.translate(fold), start, end)


def words(data: np.ndarray, off: np.ndarray, fold: bytes | None = None, gaps: bytes = SPACE) -> Words:
    """Find and hash the words of texts that lie at `off` in `data`; `fold` maps bytes before hashing, `gaps` marks those between words."""
    src = data.tobytes()
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = np.frombuffer(src.translate(gaps), bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    solid = ~gap[1:-1]
    start = np.flatnonzero(solid & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(solid & (gap[2:] | edge[1:])) + 1
    first = np.searchsorted(start, off)
    return Words(start, end, _spans(src if fold is None else src.translate(fold), start, end), first)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries of h, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    whole, width, power = None, 0, _STEP
    block, size = h, 1
    left = n
    while True:
        if left & 1:
            if whole is None:
                whole, width = block, size
            else:
                m = len(h) - (width + size) + 1
                whole = whole[:m] * U(power) + block[width : width + m]
                width += size
        left >>= 1
        if not left:
            return mix(whole)
        m = len(h) - 2 * size + 1
        block = block[:m] * U(power) + block[size : size + m]
        size *= 2
        power = power * power % 2**64


def inside(w: Words, n: int) -> np.ndarray:
    """For each start of n words in the whole run: whether these lie in one text."""
    m = max(len(w.hash) - n + 1, 0)
    last = np.repeat(w.first[1:], np.diff(w.first))[:m]
    return np.arange(m) + n <= last


def shingles(w: Words, n: int) -> np.ndarray:
    """Distinct n-word shingles as text << GRAM_BITS | hash, sorted; a shorter text with words is one shingle.

    There must be no more texts than fit above the hash (SLICE_ROWS do, with a bit to spare)."""
    at = np.flatnonzero(inside(w, n))
    doc = w.doc.astype(np.uint64)
    keys = (rolling(w.hash, n)[at] & GRAM_MASK) | (doc[at] << U(GRAM_BITS))
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        extra = [int(mix(rolling(w.hash[w.first[d] : w.first[d + 1]], int(w.count[d])) + U(int(w.count[d])))[0]) & int(GRAM_MASK) | int(d) << GRAM_BITS for d in short]
        keys = np.concatenate([keys, np.array(extra, np.uint64)])
    keys.sort()
    if len(keys):
        keep = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=keep[1:])
        keys = keys[keep]
    return keys


def string_hash(a: pa.Array) -> np.ndarray:
    """A stable number for each string; null is one of its own."""
    d = a.dictionary_encode()
    x = d.dictionary.to_pylist()
    table = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "little") for s in x] + [0], np.uint64)
    return table[d.indices.fill_null(len(x)).to_numpy(zero_copy_only=False)]


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points start before each byte; one more entry than bytes."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
