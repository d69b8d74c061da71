import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import textcore as tc

TEXTS = st.lists(st.text(alphabet="abAB \n\t\x0b\x0cé漢.,!0", max_size=40), max_size=8)


def found(texts, fold=None):
    data, off = tc.raw(pa.array(texts, pa.string()))
    return data, off, tc.words(data, off, fold)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, off, w = found(texts)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [re.findall(tc.WORD, t) for t in texts]
    flat = [x for t in got for x in t]
    names = {}
    for x, h in zip(flat, w.hash.tolist()):
        assert names.setdefault(h, x) == x
    assert len(names) == len(set(flat))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_shingles(texts, n):
    _, _, w = found(texts, tc.LOWER)
    own = (tc.shingles(w, n) >> np.uint64(tc.GRAM_BITS)).astype(int)
    for k, t in enumerate(texts):
        ws = re.findall(tc.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        want = {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()
        assert (own == k).sum() == len(want)


def test_rolling_matches_equal_windows():
    h = np.array([5, 6, 7, 5, 6, 7, 5, 6, 7, 9] * 5, np.uint64)
    for n in (1, 2, 3, 8, 35):
        r = tc.rolling(h, n)
        names = {}
        for k in range(len(h) - n + 1):
            assert names.setdefault(tuple(h[k : k + n].tolist()), r[k]) == r[k]
        assert len(set(r.tolist())) == len(names)


def test_long_words_and_slices():
    texts = ["x" * 100_000 + " " + "x" * 99_999, "y " * 50_000, "", None, "z"]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = list(tc.slices([b], "t", 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    _, _, w = found([t or "" for t in texts])
    assert w.count.tolist() == [2, 50_000, 0, 0, 1] and w.hash[0] != w.hash[1]
