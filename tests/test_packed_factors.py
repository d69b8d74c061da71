"""Factor models on packed matrices: they ran out of disk by joins of factors and cells."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from rankloom.operators import factor as fc
from rankloom.operators import packed as pk
from rankloom.operators import recommend as rc

DATA = "/root/testdata/sf0.001"


def ratings(spark, users=25, items=18):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((users, items)) < 0.4, rng.integers(1, 6, (users, items)), 0).astype(float)
    a[:, 0] += 1
    return a, spark.createDataFrame([(int(u) * 7, int(i) * 3 - 9, float(a[u, i])) for u, i in np.argwhere(a)], "user_id long, item_id long, data double")


def start(spark, ids, key, width, seed, positive=False):
    df = fc._start(spark.createDataFrame([(int(k),) for k in ids], f"{key} long"), key, width, seed, positive)
    return np.array([f for _, f in sorted((r[0], r[1]) for r in df.collect())])


def dense(df):
    return np.array([f for _, f in sorted((r[0], r[1]) for r in df.collect())])


def test_ials_against_a_dense_control(spark, monkeypatch):
    monkeypatch.setattr(pk, "ASKING", 20)
    a, m = ratings(spark)
    y = start(spark, np.arange(18) * 3 - 9, "item_id", 3, 42)
    side = lambda y, a: np.array([np.linalg.solve(y.T @ y + (y * r[:, None]).T @ y + 0.1 * np.eye(3), y.T @ np.where(r > 0, 1 + r, 0)) for r in a])
    for _ in range(2):
        x = side(y, a)
        y = side(x, a.T)
    u, i = fc.ials(m, 3, 2, reg=0.1)
    assert np.allclose(dense(u), x) and np.allclose(dense(i), y)


def test_nmf_against_a_dense_control(spark):
    a, m = ratings(spark)
    x, y = start(spark, np.arange(25) * 7, "user_id", 3, 42, True), start(spark, np.arange(18) * 3 - 9, "item_id", 3, 43, True)
    for _ in range(3):
        x = x * (a @ y) / np.maximum(x @ (y.T @ y), 1e-12)
        y = y * (a.T @ x) / np.maximum(y @ (x.T @ x), 1e-12)
    u, i = fc.nmf(m, 3, 3)
    assert np.allclose(dense(u), x) and np.allclose(dense(i), y)


@pytest.mark.parametrize("name", ["ials", "nmf"])
def test_queries_join_no_factors_to_cells(spark, monkeypatch, name):
    def joined(*_, **__):
        raise AssertionError("factors are joined")

    monkeypatch.setattr(fc, "_solve", joined)
    monkeypatch.setattr(fc, "_profiles", joined)
    assert entry.queries()[name](spark, DATA).count() > 100


def test_best_items_stop_at_short_ones_without_loss(spark):
    rng = np.random.default_rng(8)
    users = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(30)], "user_id long, factors array<double>")
    items = spark.createDataFrame([(k * 5 + (k % 3 << 40) - 70, (rng.normal(size=4) * 2.0 ** -(k % 9)).tolist()) for k in range(200)], "item_id long, factors array<double>")
    ids = [r.item_id for r in items.collect()]
    known = spark.createDataFrame([(k, ids[(k * j) % 200], 1.0) for k in range(0, 30, 2) for j in range(1, 60)], "user_id long, item_id long, data double").distinct()
    show = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 8)) for r in df.collect())
    want = show(rc.recommend(rc.factor_scores(users, items), known, 7))
    for seen in (known, pk.pack(known, "user_id", "item_id")):
        assert show(rc.recommend(rc.factor_top(users, items, 7, seen, block=10), None, 7)) == want
