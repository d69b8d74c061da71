"""Weights are packed by the other key without a shuffle of them, which took the disk of a large table (F5, F10, F13)."""

import numpy as np
import pytest

from rankloom.operators import packed as pk
from rankloom.operators import similarity as sm


@pytest.mark.parametrize("low, cells", [(0, 500_000), (-(2**33), 60)])
def test_weights_by_row_equal_the_packed_frame(spark, monkeypatch, low, cells):
    monkeypatch.setattr(pk, "CELLS", cells)
    rng = np.random.default_rng(3)
    m = spark.createDataFrame([(int(r), int(c) + low, float(rng.integers(1, 9))) for r in range(80) for c in rng.choice(40, 9, replace=False)], "row long, col long, data double")
    x = pk.pack(m, "row", "col")
    want = sorted(map(tuple, sm.similarity(x, shrink=10, top_k=7).collect()))

    def dealt(*_, **__):
        raise AssertionError("weights are shuffled")

    frame = type(m)
    turn = pk.turned

    def alone(*a, **k):
        with monkeypatch.context() as p:
            p.setattr(frame, "repartitionById", dealt)
            p.setattr(frame, "repartitionByRange", dealt)
            return turn(*a, **k)

    monkeypatch.setattr(sm, "turned", alone)
    w = sm.similarity(x, shrink=10, top_k=7, packed=True)
    assert sorted(map(tuple, w.cells("i", "j").collect())) == want and want
    assert all(a[2] < b[1] for a, b in zip(w.parts, w.parts[1:]))
