"""score_hybrid_linf joined all pairs and all scores, which took the disk of a large table."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rankloom.operators import recommend as rc
from rankloom.operators import similarity as sm
from rankloom.operators.packed import Mixed, multiply, pack

DATA = "/root/testdata/sf0.001"


def test_score_hybrid_linf_joins_no_pairs_or_scores(spark, monkeypatch):
    def joined(*_, **__):
        raise AssertionError("pairs or scores are joined")

    for module, name in ((rc, "item_scores"), (rc, "graph_walk"), (rc, "combine_scores"), (sm, "matrix_norm")):
        monkeypatch.setattr(module, name, joined)
    got = entry.queries()["score_hybrid_linf"](spark, DATA)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT user_id, item_id, rank, score FROM ({entry.oracle_sql()['score_hybrid_linf']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def frame(spark, x, row="user_id", col="item_id", data="data"):
    return spark.createDataFrame([(int(u) + 3, int(i) - 4, float(x[u, i])) for u, i in zip(*np.nonzero(x))], f"{row} long, {col} long, {data} double")


@pytest.mark.parametrize("more", [{}, {"alpha": 0.7, "beta": 0.4, "normalise": True}, {"least": 0.5, "implicit": True, "top_k": 4}])
def test_packed_walk_equals_the_joined_one(spark, more):
    rng = np.random.default_rng(5)
    m = frame(spark, np.where(rng.random((30, 25)) < 0.3, rng.random((30, 25)), 0))
    more = {"top_k": 6} | more
    want = {(r.i, r.j): r.w for r in rc.graph_walk(m, **more).collect()}
    got = {(r.i, r.j): r.data for r in rc.packed_walk(pack(m, "user_id", "item_id"), **more).cells("i", "j").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want


@pytest.mark.parametrize("least", [0.0, -0.5])
def test_norm_and_mixed_product_against_numpy(spark, least):
    rng = np.random.default_rng(6)
    a, b, c = (np.where(rng.random((20, 20)) < 0.3, rng.random((20, 20)) + least, 0) for _ in range(3))
    # the columns of the first are the rows of the others
    pa = pack(frame(spark, a), "user_id", "item_id")
    pb, pc = (pack(frame(spark, x, "i", "j", "w").selectExpr("i - 7 i", "j", "w"), "i", "j", "w") for x in (b, c))
    assert abs(rc.largest_row_sum(pa, pb) - np.abs(a @ b).sum(axis=1).max()) < 1e-12
    got = np.zeros((20, 20))
    for r in multiply(pa, Mixed([(pb, 2.0), (pc, -3.0)]), lambda keys, row, col, total, _: (keys[row], col, total), "u long, j long, x double").collect():
        got[r.u - 3, r.j + 4] += r.x
    assert np.allclose(got, a @ (2 * b - 3 * c))
