"""Long rows, as of item features, made so many terms that the models with them took more than their time on large tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rankloom.operators import similarity as sm
from rankloom.operators.packed import Light

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def asked(monkeypatch):
    """Which matrices are looked up by products, where many terms and long rows begin early."""
    out = []
    monkeypatch.setattr(sm, "MANY_TERMS", 2)
    monkeypatch.setattr(sm, "LONG_ROW", 20)
    for name in ("multiply", "turned"):
        real = getattr(sm, name)
        monkeypatch.setattr(sm, name, lambda a, b, *rest, real=real: (out.append(b), real(a, b, *rest))[1])
    return out


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_long_rows_are_bounded_and_make_the_same_lists(spark, asked, monkeypatch, sign):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(300):
        n = int(rng.integers(0, 12)) if c % 7 else 0  # some columns are of long rows only
        rows += [(int(r), c - 9, sign ** int(rng.integers(2)) * float(rng.integers(1, 4))) for r in rng.choice(400, n, False)]
        rows += [(1000 + int(rng.integers(3)), c - 9, 2.0), (1010 + int(rng.integers(5)), c - 9, float(rng.integers(1, 3)))]
    m = spark.createDataFrame(rows, "row long, col long, data double")
    got = sorted(map(tuple, sm.similarity(m, shrink=2, top_k=15).collect()))
    assert all(isinstance(b, Light) for b in asked) and asked
    packed = sm.similarity(m, shrink=2, top_k=15, packed=True).cells("i", "j").select("i", "j", "data")
    monkeypatch.setattr(sm, "MANY_TERMS", 1e18)
    want = sorted(map(tuple, sm.similarity(m, shrink=2, top_k=15).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want]) and len(got) > 4000
    assert sorted(map(tuple, packed.collect())) == got


@pytest.mark.parametrize("name", ["itemknn_cfcbf", "userknn_cfcbf"])
def test_queries_with_long_rows_equal_their_sql(spark, asked, monkeypatch, name):
    monkeypatch.setattr(sm, "LONG_ROW", 55)  # more than profiles have, less than items of a brand or users of a nation
    got = entry.queries()[name](spark, DATA)
    assert any(isinstance(b, Light) for b in asked)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
