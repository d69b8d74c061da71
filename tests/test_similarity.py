import numpy as np
import pytest

from rankloom.operators import similarity as sm

# The small matrices that similarity results are stated for.
M1 = np.array([[1, 1, 0, 1], [0, 1, 1, 1], [1, 0, 1, 0]], float)
M2 = np.array([[1, 2, 0, 1], [0, 1, 4, 1], [1, 3, 1, 0]], float)


def frame(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(a)], "row long, col long, data double")


def dense(w, n):
    out = np.zeros((n, n))
    for r in w.collect():
        out[r.i, r.j] = r.w
    return out


def off(a):
    a = a.copy()
    np.fill_diagonal(a, 0)
    return a


def test_cosine_with_shrink(spark):
    n = np.sqrt((M1**2).sum(axis=0))
    assert np.allclose(dense(sm.similarity(frame(spark, M1), shrink=5), 4), off(M1.T @ M1 / (np.outer(n, n) + 5 + 1e-6)))


def test_plain_product_and_top_k(spark):
    got = dense(sm.similarity(frame(spark, M1), normalize=False, top_k=1), 4)
    want = off(M1.T @ M1)
    assert ((got > 0).sum(axis=0) <= 1).all() and np.allclose(got.max(axis=0), want.max(axis=0))


@pytest.mark.parametrize("kind", ["jaccard", "dice", "tversky"])
def test_set_measures(spark, kind):
    b = (M2 > 0).astype(float)
    d, c = b.T @ b, b.sum(axis=0)
    ci, cj = c[:, None], c[None, :]
    want = {"jaccard": d / (ci + cj - d + 1e-6), "dice": d / (ci + cj + 1e-6), "tversky": d / (d + (cj - d) * 0.4 + (ci - d) * 1.5 + 1e-6)}[kind]
    got = dense(sm.similarity(frame(spark, M2), kind, tversky_alpha=0.4, tversky_beta=1.5), 4)
    assert np.allclose(got, off(want), atol=1e-6)


@pytest.mark.parametrize("kind,axis", [("adjusted", 1), ("pearson", 0)])
def test_centred(spark, kind, axis):
    on = M2 != 0
    mean = M2.sum(axis=axis, keepdims=True) / on.sum(axis=axis, keepdims=True)
    a = np.where(on, M2 - mean, 0)
    n = np.sqrt((a**2).sum(axis=0))
    assert np.allclose(dense(sm.similarity(frame(spark, M2), kind), 4), off(a.T @ a / (np.outer(n, n) + 1e-6)), atol=1e-6)


def test_asymmetric_and_row_weights(spark):
    n = np.sqrt((M2**2).sum(axis=0)) + 1e-6
    got = dense(sm.similarity(frame(spark, M2), "asymmetric", asymmetric_alpha=0.3), 4)
    assert np.allclose(got, off(M2.T @ M2 / (np.outer(n**1.4, n**0.6) + 1e-6)), atol=1e-6)
    weights = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 0.5)], "row long, weight double")
    got = dense(sm.similarity(frame(spark, M2), normalize=False, row_weights=weights), 4)
    assert np.allclose(got, off(M2.T @ np.diag([2, 3, 0.5]) @ M2))


def test_euclidean(spark):
    d = np.sqrt(((M1[:, :, None] - M1[:, None, :]) ** 2).sum(axis=0))
    assert np.allclose(dense(sm.euclidean(frame(spark, M1), top_k=None), 4), off(1 / (d + 1e-9)), rtol=1e-6)


def test_random_matrix(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((200, 60)) < 0.1, rng.integers(1, 6, (200, 60)), 0).astype(float)
    assert np.allclose(dense(sm.similarity(frame(spark, a), normalize=False, top_k=60), 60), off(a.T @ a))


def test_empty(spark):
    assert sm.similarity(spark.createDataFrame([], "row long, col long, data double")).count() == 0


@pytest.mark.parametrize("hot", [3, 50, 512])
def test_long_rows_are_split(spark, monkeypatch, hot):
    monkeypatch.setattr(sm, "HOT_ROW", hot)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((60, 200)) < 0.1, rng.random((60, 200)), 0.0)
    a[0] = rng.random(200) + 0.1  # one row with every column
    n = np.sqrt((a**2).sum(axis=0))
    w = dense(sm.similarity(frame(spark, a), shrink=1, top_k=None, row_weights=spark.createDataFrame([(k, 1.0 + k % 2) for k in range(60)], "row long, weight double")), 200)
    weights = 1.0 + np.arange(60) % 2
    assert np.allclose(w, off((a * weights[:, None]).T @ a / (np.outer(n, n) + 1 + 1e-6)))
