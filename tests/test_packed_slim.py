"""slim_bpr made a row for each triple and item of its profile, which took the disk of a large table."""

import os

import duckdb
import pytest
from test_packed_triples import DATA, joined, matrix

import __spark_entry__ as entry
from rankloom.operators import matrix as mx
from rankloom.operators import split as sp
from rankloom.operators import trainers


def test_slim_bpr_joins_nothing(spark, monkeypatch):
    monkeypatch.setattr(sp, "bpr_triples", joined)
    got = entry.queries()["slim_bpr"](spark, DATA)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT i, j, w FROM ({entry.oracle_sql()['slim_bpr']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("looked_up, hot", [(2_000_000, 50), (60, 4_000_000), (60, 50)])
def test_slim_bpr_of_hot_targets_and_long_profiles(spark, monkeypatch, looked_up, hot):
    _, m = matrix(spark, 1)
    triples = sp.bpr_triples(m, mx.dense_index(m.select("item_id").distinct(), "item_id"))
    show = lambda: {(r.i, r.j): r.w for r in trainers.slim_bpr(triples, m, 3, rate=0.3, top_k=None).collect()}
    want = show()
    monkeypatch.setattr(trainers, "LOOKED_UP", looked_up)
    monkeypatch.setattr(trainers, "HOT_TERMS", hot)
    monkeypatch.setattr(trainers, "TERMS", 20)
    got = show()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
