import numpy as np
import pytest

from rankloom.operators import matrix as mx
from rankloom.operators import recommend as rc
from rankloom.operators import split as sp
from rankloom.operators import trainers


def cells(spark, x):
    return spark.createDataFrame([(int(u), int(i) + 100, float(x[u, i])) for u, i in zip(*np.nonzero(x))], "user_id long, item_id long, data double")


@pytest.fixture(scope="module")
def ratings():
    rng = np.random.default_rng(4)
    low = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 20)) + rng.normal(size=(30, 1)) + 5
    return np.where(rng.random((30, 20)) < 0.5, np.round(low * 2) / 2 + 0.25, 0.0)


def test_mf_mse_against_a_dense_control(spark, ratings):
    m = cells(spark, ratings)
    us, it, mean = trainers.mf_mse(m, 3, 4, rate=0.1, reg=0.02)
    start_u, start_i, _ = trainers.mf_mse(m, 3, 0)
    u = {r.user_id: np.array([*r.factors, r.bias, 1.0]) for r in start_u.collect()}
    i = {r.item_id: np.array([*r.factors, 1.0, r.bias]) for r in start_i.collect()}
    on = [(a, b + 100, ratings[a, b]) for a, b in zip(*np.nonzero(ratings))]

    def step(own, other, k, fixed):
        out = {}
        for key, old in own.items():
            rows = [(other[c[1 - k]], c[2]) for c in on if c[k] == key]
            move = sum(y * (x - mean - y @ old) for y, x in rows) / len(rows) - 0.02 * old
            move[fixed] = 0
            out[key] = old + 0.1 * move
        return out

    for _ in range(4):
        u = step(u, i, 0, 4)
        i = step(i, u, 1, 3)
    for r in us.collect():
        assert np.allclose([*r.factors, r.bias], u[r.user_id][:4])
    for r in it.collect():
        assert np.allclose([*r.factors, r.bias], [*i[r.item_id][:3], i[r.item_id][4]])
    error = lambda n: sum((x - mean - u[a] @ i[b]) ** 2 for a, b, x in on) / len(on)
    assert error(0) < np.var([c[2] for c in on])


def test_slim_mse_lowers_the_error(spark, ratings):
    m = cells(spark, ratings)
    loss = []
    for epochs in (1, 10, 60):
        w = np.zeros((20, 20))
        for r in trainers.slim_mse(m, epochs, rate=0.9, top_k=None, block=7).collect():
            w[r.i - 100, r.j - 100] = r.w
        assert np.all(np.diag(w) == 0)
        loss.append(((ratings - ratings @ w) ** 2).sum())
    assert loss[0] > loss[1] > loss[2]


def test_slim_bpr_against_a_dense_control(spark, ratings):
    m = cells(spark, ratings)
    items = mx.dense_index(m.select("item_id").distinct(), "item_id")
    triples = sp.bpr_triples(m, items)
    rows = [(r.user_id, r.positive - 100, r.negative - 100) for r in triples.collect()]
    for symmetric in (False, True):
        got = np.zeros((20, 20))
        for r in trainers.slim_bpr(triples, m, 3, rate=0.2, reg_positive=0.1, reg_negative=0.02, top_k=None, symmetric=symmetric).collect():
            got[r.i - 100, r.j - 100] = r.w
        w = np.zeros((20, 20))
        place = (lambda a, b: (min(a, b), max(a, b))) if symmetric else (lambda a, b: (a, b))
        for _ in range(3):
            total, n, reg = np.zeros((20, 20)), np.zeros((20, 20)), np.zeros((20, 20))
            for u, p, q in rows:
                mine = np.flatnonzero(ratings[u])
                x = sum(w[place(k, p)] for k in mine if k != p) - sum(w[place(k, q)] for k in mine if k != q)
                g = 1 / (1 + np.exp(x))
                for k in mine:
                    for j, side, r in ((p, 1, 0.1), (q, -1, 0.02)):
                        if k != j:
                            total[place(k, j)] += side * g
                            n[place(k, j)] += 1
                            reg[place(k, j)] += r
            on = n > 0
            w[on] += 0.2 * (total[on] / n[on] - reg[on] / n[on] * w[on])
        want = w + w.T if symmetric else w
        assert np.allclose(got, want)


def test_asy_svd_lowers_the_error(spark, ratings):
    x = ratings / ratings.max()
    m = cells(spark, x)
    errors = []
    for epochs in (0, 4, 12):
        own, items = trainers.asy_svd(m, 4, epochs, rate=0.5, reg=0.0)
        q = {r.item_id: np.array(r.factors) for r in items.collect()}
        u = {r.user_id: np.array(r.factors) for r in rc.asymmetric_user_factors(m, own).collect()}
        errors.append(sum((v - u[a] @ q[b + 100]) ** 2 for (a, b), v in np.ndenumerate(x) if v))
    assert errors[0] > errors[1] > errors[2]


def test_factor_top_is_the_best_of_all_scores(spark):
    rng = np.random.default_rng(3)
    users = spark.createDataFrame([(k, rng.normal(size=4).round(1).tolist(), float(k)) for k in range(40)], "user_id long, factors array<double>, bias double")
    items = spark.createDataFrame([(k * 3, rng.normal(size=4).round(1).tolist(), float(k % 3)) for k in range(57)], "item_id long, factors array<double>, bias double")
    seen = spark.createDataFrame([(k, (k * j) % 57 * 3, 1.0) for k in range(0, 40, 2) for j in range(1, 30)], "user_id long, item_id long, data double").distinct()
    show = lambda df: sorted((r.user_id, r["rank"], r.item_id, round(r.score, 8)) for r in df.collect())
    for known in (None, seen):
        want = show(rc.recommend(rc.factor_scores(users, items), known, 7))
        assert show(rc.recommend(rc.factor_top(users, items, 7, known, block=10), known, 7)) == want


def test_dense_index_of_ties_nulls_and_nothing(spark):
    rows = [(None, 1), (None, 2), (3, 1), (3, 0), (-5, 9)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    got = {(r.a, r.b): r.idx for r in mx.dense_index(df, "a", "b").collect()}
    assert got == {(None, 1): 0, (None, 2): 1, (-5, 9): 2, (3, 0): 3, (3, 1): 4}
    assert mx.dense_index(df.limit(0), "a").count() == 0
