"""Queries on triples whose draws and profiles were joined, which took the disk of a large table."""

import os

import duckdb
import numpy as np

import __spark_entry__ as entry
from rankloom.operators import matrix as mx
from rankloom.operators import split as sp
from rankloom.operators.factor import bpr_factors
from rankloom.operators.packed import pack

DATA = "/root/testdata/sf0.001"


def joined(*_, **__):
    raise AssertionError("draws are joined")


def matrix(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((40, 30)) < 0.3
    x[3] = True  # all seen: no triple
    x[:, 7] = True  # a target of all users
    return x, spark.createDataFrame([(int(u), int(i) - 5, 1.0) for u, i in zip(*np.nonzero(x))], "user_id long, item_id long, data double")


def test_packed_triples_equal_the_joined_ones(spark):
    _, m = matrix(spark)
    items = mx.dense_index(spark.createDataFrame([(k - 5,) for k in range(33)], "item_id long"), "item_id")
    want = sorted(tuple(r) for r in sp.bpr_triples(m, items, 3).collect())
    got = sp.packed_triples(pack(m, "user_id", "item_id"), items, 3).cells("user_id", "positive").collect()
    assert sorted((r.user_id, r.positive, int(r.data)) for r in got) == want and want


def test_bpr_factors_against_a_dense_control(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(u), int(p), int(n)) for u, p, n in rng.integers(0, 12, (90, 3)) if p != n})
    triples = spark.createDataFrame(rows, "user_id long, positive long, negative long")
    start = [{r[0]: np.array(r.factors) for r in t.collect()} for t in bpr_factors(triples, 3, 0)]
    users, items = start
    for _ in range(3):
        moves = ({k: [] for k in users}, {k: [] for k in items})
        for u, p, n in rows:
            g = 1 / (1 + np.exp(users[u] @ (items[p] - items[n])))
            moves[0][u].append(g * (items[p] - items[n]))
            moves[1][p].append(g * users[u])
            moves[1][n].append(-g * users[u])
        users, items = ({k: f + 0.5 * (np.mean(m[k], axis=0) - 0.1 * f) for k, f in t.items()} for t, m in zip((users, items), moves))
    for table, want in zip(bpr_factors(triples, 3, 3, rate=0.5, reg=0.1), (users, items)):
        got = {r[0]: r.factors for r in table.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_bpr_factors_joins_nothing(spark, monkeypatch):
    monkeypatch.setattr(sp, "bpr_triples", joined)
    got = entry.queries()["bpr_factors"](spark, DATA)
    con = duckdb.connect()
    assert got.count() == con.execute(f"SELECT count(DISTINCT o_custkey) FROM '{DATA}/orders.parquet'").fetchone()[0]
