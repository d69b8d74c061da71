import numpy as np
import pytest

from rankloom.functions.stem import stem
from rankloom.operators import evaluate as ev
from rankloom.operators import factor as fc
from rankloom.operators import matrix as mx
from rankloom.operators import recommend as rc
from rankloom.operators import search as se
from rankloom.operators import split as sp
from rankloom.sources import readers, store

CELLS = [(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(10) if (u * 7 + i * 3) % 4]


@pytest.fixture(scope="module")
def urm(spark):
    return spark.createDataFrame(CELLS, "user_id long, item_id long, data double")


def matrix():
    a = np.zeros((12, 10))
    for u, i, x in CELLS:
        a[u, i] = x
    return a


def test_build_sums_and_drops_zeros(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 2, -1.0)], "u long, i long, x double")
    assert [tuple(r) for r in mx.build(df, "u", "i", "x").collect()] == [(1, 1, 2.0)]


def test_mapper_round_trip(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "id string, p long")
    m = mx.id_mapper([(df, "id", "p")])
    assert {r.original_id: r.idx for r in m.collect()} == {"b": 0, "a": 1}
    assert {r.original_id: r.idx for r in mx.extend_mapper(m, spark.createDataFrame([("c",), ("a",)], "id string"), "id").collect()} == {"b": 0, "a": 1, "c": 2}
    assert mx.invert_mapper(m).where("bijective").count() == 2


def test_core_is_a_core(urm):
    rows = [tuple(r) for r in mx.k_core(urm, 6).select("user_id", "item_id").collect()]
    us, its = np.unique([r[0] for r in rows], return_counts=True), np.unique([r[1] for r in rows], return_counts=True)
    assert (us[1] >= 6).all() and (its[1] >= 6).all()


@pytest.mark.parametrize("one", [sp.holdout_user_wise, sp.holdout_global, sp.cold_items])
def test_splits_are_complete_and_disjoint(urm, one):
    s = one(urm)
    a, b = s.where("split = 'train'"), s.where("split = 'test'")
    assert a.count() + b.count() == len(CELLS) and sp.overlap(a, b).first().shared == 0


def test_three_way(urm):
    s = sp.three_way(urm)
    assert {r.split for r in s.select("split").distinct().collect()} == {"train", "validation", "test"} and s.count() == len(CELLS)


def test_leave_k_out_sizes(urm):
    per = {(r.user_id, r.split): r["count"] for r in sp.leave_k_out(urm, 2).groupBy("user_id", "split").count().collect()}
    assert all(n == 2 for (_, s), n in per.items() if s != "train")


def test_metrics_by_hand(spark):
    test = spark.createDataFrame([(0, i, float(v)) for i, v in ((2, 5), (4, 4), (5, 3), (10, 2))], "user_id long, item_id long, data double")
    recs = spark.createDataFrame([(0, i, k + 1, 1.0 / (k + 1)) for k, i in enumerate([1, 2, 3, 4, 5])], "user_id long, item_id long, rank int, score double")
    r = ev.accuracy(recs, test, [5]).first()
    assert r.recall == 3 / 4 and r.precision == 3 / 5 and r.mrr == 1 / 2
    assert np.isclose(r.map_min_den, (1 / 2 + 2 / 4 + 3 / 5) / 4) and np.isclose(r.map, (1 / 2 + 2 / 4 + 3 / 5) / 5)
    gain, disc = lambda v: 2**v - 1, lambda k: np.log2(k + 1)
    assert np.isclose(r.ndcg, sum(gain(v) / disc(k) for k, v in ((2, 5), (4, 4), (5, 3))) / sum(gain(v) / disc(k) for k, v in ((1, 5), (2, 4), (3, 3), (4, 2))))


def test_hit_rate_times_coverage(spark, urm):
    s = sp.holdout_user_wise(urm)
    train, test = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    items, users = urm.select("item_id").distinct(), urm.select("user_id").distinct()
    recs = rc.recommend(train.select("user_id").distinct().crossJoin(rc.top_pop(train)), train, 3)
    r = ev.evaluate(recs, test, train, items, users, [3]).first()
    assert np.isclose(r.hit_rate * r.users_in_gt, r.coverage_user_hit) and 0 <= r.ndcg <= 1


def test_dense_fill_and_ignore(spark, urm):
    scores = spark.createDataFrame([(0, 3, 1.0)], "user_id long, item_id long, score double")
    seen = spark.createDataFrame([(0, 0, 1.0)], "user_id long, item_id long, data double")
    items = spark.createDataFrame([(k,) for k in range(6)], "item_id long")
    got = rc.recommend(scores, seen, 4, ignore=spark.createDataFrame([(1,)], "item_id long"), dense=items)
    assert [r.item_id for r in got.orderBy("rank").collect()] == [3, 2, 4, 5]


def test_ease(spark, urm):
    a = matrix()
    p = np.linalg.inv(a.T @ a + 10 * np.eye(10))
    want = p / -np.diag(p)
    np.fill_diagonal(want, 0)
    got = np.zeros((10, 10))
    for r in fc.ease_r(urm, 10.0).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, want)


def test_pure_svd(urm):
    a = matrix()
    u, s, v = np.linalg.svd(a)
    users, items = fc.pure_svd(urm, 3)
    got = {(r.user_id, r.item_id): r.score for r in rc.factor_scores(users, items).collect()}
    want = u[:, :3] * s[:3] @ v[:3]
    assert all(np.isclose(x, want[k]) for k, x in got.items())


def test_ials_and_joined_path(urm, monkeypatch):
    def run():
        u, i = fc.ials(urm, 3, 2, reg=0.1)
        return {r.user_id: r.factors for r in u.collect()}, {r.item_id: r.factors for r in i.collect()}

    u, i = run()
    y, c = np.array([i[k] for k in range(10)]), np.where(matrix() > 0, 1 + matrix(), 0)
    monkeypatch.setattr(fc, "BROADCAST_BYTES", 0)
    v, j = run()
    assert np.allclose([u[k] for k in sorted(u)], [v[k] for k in sorted(v)]) and np.allclose([i[k] for k in range(10)], [j[k] for k in range(10)])
    assert y.shape == (10, 3) and c.shape == (12, 10)


def test_nmf_lowers_error(urm):
    def error(epochs):
        u, i = fc.nmf(urm, 3, epochs)
        got = {(r.user_id, r.item_id): r.score for r in rc.factor_scores(u, i).collect()}
        return sum((matrix()[k] - x) ** 2 for k, x in got.items())

    assert error(4) < error(1)


def test_slim(urm):
    w = fc.slim_elastic_net(urm, 0.1, 0.1, steps=400).collect()
    a = matrix()
    g, got = a.T @ a / 12, np.zeros((10, 10))
    for r in w:
        got[r.i, r.j] = r.w
    assert (got >= 0).all() and (np.diag(got) == 0).all()
    grad = g @ got - g + 0.1 * 0.9 * got + 0.01
    active = got > 1e-6
    assert np.abs(grad[active]).max() < 1e-2 and grad[~active & ~np.eye(10, dtype=bool)].min() > -1e-2


def test_search():
    space = {"x": se.Space(0.0, 1.0), "k": se.Space(1, 10, integer=True)}
    best = se.bayesian_search(space, lambda p: -((p["x"] - 0.3) ** 2), 20).best
    assert abs(best[0]["x"] - 0.3) < 0.1
    values = iter([1, 2, 1, 1, 1, 1])
    assert se.early_stopping(lambda n: None, lambda: next(values), lambda: None, 10, patience=3) == (2, 2)
    assert len(se.grid({"a": [1, 2], "b": [3]})) == 2


def test_search_resumes_and_keeps_time(tmp_path):
    from rankloom.operators import spaces
    from rankloom.operators.search import bayesian_search, load_trials, search

    space, path, runs = spaces.MODELS["rp3beta"], f"{tmp_path}/trials.json", []

    def objective(p):
        runs.append(p)
        return -abs(p["alpha"] - 1.2) - abs(p["beta"] - 0.4)

    whole = bayesian_search(space, objective, 9, starts=4, seed=1)
    n = len(runs)
    first = bayesian_search(space, objective, 6, starts=4, seed=1, path=path)
    assert len(load_trials(path).trials) == 6 and len(runs) == n + 6
    again = bayesian_search(space, objective, 9, starts=4, seed=1, path=path)
    assert len(runs) == n + 9 and again.trials == whole.trials and first.trials == whole.trials[:6]
    assert bayesian_search(space, objective, 9, seconds=-1).trials == []
    found = search(space, lambda p: p, lambda p: -abs(p["alpha"] - 1.2), lambda p: {"map": p["alpha"]}, cases=8, seed=3)
    assert found["test"]["map"] == found["best"]["alpha"] and found["metric"] == found["result"].best[1]
    assert set(spaces.knn("cosine", weighting=True, hybrid=True)) == {"top_k", "shrink", "normalize", "feature_weighting", "feature_weight"}


def test_stem():
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "relational", "triplicate", "adjustment", "controlling", "happy")] == ["caress", "poni", "hop", "relat", "triplic", "adjust", "control", "happi"]


def test_readers(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::10::4.5::100\n1::11::3::101\n")
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path / "r.dat"), "1m").collect()] == [("1", "10", 4.5, 100), ("1", "11", 3.0, 101)]
    (tmp_path / "m.dat").write_text("10::Film (1999)::Drama|War\n11::No year::Drama\n")
    genres, years = readers.movies(spark, str(tmp_path / "m.dat"), "1m")
    assert genres.count() == 3 and [tuple(r) for r in years.collect()] == [("10", "1999", 1.0)]
    (tmp_path / "t.dat").write_text("1::10::the running-gag::5\n2::10::running::6\n")
    assert {(r.feature_id, r.data) for r in readers.tags(spark, str(tmp_path / "t.dat"), "10m").collect()} == {("run", 2.0), ("gag", 1.0)}
    (tmp_path / "c.csv").write_text("a,x,1,5\na,x,2,\na,x,3,4\n")
    assert [tuple(r) for r in readers.interactions(spark, str(tmp_path / "c.csv"), timestamp=True, dedup=True).collect()] == [("a", "x", 1.0, 5.0)]


def test_store_round_trip(spark, tmp_path, urm):
    path = f"file://{tmp_path}/data"
    store.save(spark, path, {"urm": urm, "name": "x", "inner": {"urm": urm, "k": [1, 2]}})
    got = store.load(spark, path)
    assert got["name"] == "x" and got["inner"]["k"] == [1, 2] and mx.equal(got["urm"], urm)
