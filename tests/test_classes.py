import numpy as np
import pytest

from rankloom.operators import similarity as sm


@pytest.mark.parametrize("kind", ["cosine", "jaccard", "tversky"])
def test_equal_columns_are_put_together_and_make_the_same_lists(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(300):  # three features of few values: most columns have copies, and ties abound
        rows += [(int(rng.integers(3)), c, 1.0), (3 + int(rng.integers(4)), c, 1.0), (7 + int(rng.integers(3)), c, 1.0)]
    m = spark.createDataFrame(rows, "row long, col long, data double")
    want = sorted(map(tuple, sm.similarity(m, kind, 2, top_k=20).collect()))
    asked = []
    monkeypatch.setattr(sm, "MANY_TERMS", 2)
    real = sm.multiply
    monkeypatch.setattr(sm, "multiply", lambda a, b, *rest: (asked.append(sum(p[3] for p in a.parts)), real(a, b, *rest))[1])
    got = sorted(map(tuple, sm.similarity(m, kind, 2, top_k=20).collect()))
    assert asked == [len({tuple(sorted(r for r, c, _ in rows if c == k)) for k in range(300)})] and asked[0] < 40
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want]) and len(got) == 6000


def test_sim_hybrid_forms_no_pairs_of_all_items(spark, monkeypatch):
    """At 6 x sf0.1 the pairs of items that share a feature took the query beyond its time."""
    import __spark_entry__ as entry

    sizes = []
    real = sm._classes
    monkeypatch.setattr(sm, "MANY_TERMS", 2)
    monkeypatch.setattr(sm, "_classes", lambda targets: (sizes.append(targets.size()), real(targets))[1])
    want = sorted(map(tuple, entry.queries()["sim_hybrid"](spark, "/root/testdata/sf0.001").collect()))
    assert len(sizes) == 2
    monkeypatch.setattr(sm, "MANY_TERMS", 1e18)
    assert want == sorted(map(tuple, entry.queries()["sim_hybrid"](spark, "/root/testdata/sf0.001").collect())) and want
