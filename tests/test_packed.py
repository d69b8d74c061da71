import numpy as np

from rankloom.operators import packed as pk
from rankloom.operators import recommend as rc
from rankloom.operators import similarity as sm


def cells(spark, a, step=1, row="row", col="col"):
    return spark.createDataFrame([(int(r) * 3 + 1, int(c) * step - 5, float(a[r, c])) for r, c in np.argwhere(a)], f"{row} long, {col} long, data double")


def ratings(rows, cols, share, seed=7):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((rows, cols)) < share, rng.integers(1, 9, (rows, cols)), 0).astype(float)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def off(a):
    np.fill_diagonal(a, 0)
    return a


def test_best_breaks_ties_by_place():
    row, value = np.array([0, 0, 0, 2, 2]), np.array([1.0, 2.0, 1.0, 3.0, 3.0])
    assert pk.best(row, value, 2).tolist() == [1, 0, 3, 4] and pk.best(row[:0], value[:0], 2).tolist() == []


def test_product_in_small_pieces(spark, monkeypatch):
    a = ratings(40, 30, 0.3)
    x = pk.pack(cells(spark, a), "row", "col")
    t = pk.pack(x.cells("row", "col"), "col", "row", cells=x.size(), span=x.span())
    low, size = x.span()
    for looked_up, asking, terms in ((2_000_000, 64_000, 32_000), (100, 50, 40), (12, 1, 1)):
        for name, n in (("LOOKED_UP", looked_up), ("ASKING", asking), ("TERMS", terms)):
            monkeypatch.setattr(pk, name, n)
        got = np.zeros((30, 30))
        for k in range(len(t.parts)):
            for keys, row, col, total in pk.product(*t.load(k)[:4], pk.Rows(x), low, np.zeros(size, np.int32)):
                got[keys[row] + 5, col + 5] = total
        assert np.allclose(got, a.T @ a)


def test_similarity_shuffles_no_pairs_and_takes_any_ids(spark):
    a = ratings(50, 20, 0.3)
    w = sm.similarity(cells(spark, a), normalize=False, top_k=None)
    assert "Exchange" not in plan(w)
    wide = sm.similarity(cells(spark, a, step=10**12), normalize=False, top_k=None)
    named = sm.similarity(cells(spark, a).selectExpr("concat('r', row) row", "concat('c', col + 5) col", "data"), normalize=False, top_k=None)
    got = np.zeros((3, 20, 20))
    for r in w.collect():
        got[0, r.i + 5, r.j + 5] = r.w
    for r in wide.collect():
        got[1, (r.i + 5) // 10**12, (r.j + 5) // 10**12] = r.w
    for r in named.collect():
        got[2, int(r.i[1:]), int(r.j[1:])] = r.w
    assert np.allclose(got, off(a.T @ a))


def test_item_and_user_lists_as_by_joins_without_a_shuffle(spark):
    a = ratings(60, 40, 0.2)
    m = cells(spark, a, row="user_id", col="item_id")
    x = pk.pack(m, "user_id", "item_id")
    w = sm.similarity(x, shrink=3, top_k=7)
    v = sm.similarity(m.selectExpr("item_id row", "user_id col", "data"), shrink=3, top_k=7)
    for got, scores in ((rc.item_lists(x, w, 5), rc.item_scores(m, w)), (rc.user_lists(x, v, 5), rc.user_scores(m, v))):
        assert "Exchange" not in plan(got)
        want = rc.recommend(scores, m, 5)
        rows = lambda df: sorted((r.user_id, r.rank, r.item_id, round(r.score, 9)) for r in df.collect())
        assert rows(got) == rows(want) and got.count() > 100


def test_no_cells(spark):
    x = pk.pack(spark.createDataFrame([], "user_id long, item_id long, data double"), "user_id", "item_id")
    w = sm.similarity(x)
    assert w.count() == 0 and rc.item_lists(x, w).count() == 0 and rc.user_lists(x, w).count() == 0
