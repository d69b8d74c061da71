"""bpr_factors ran two epochs, which left the factors at their hashed start: about half of the triples were ranked rightly."""

import numpy as np

import __spark_entry__ as entry
from rankloom.operators import factor


def test_the_query_trains_its_factors(spark, monkeypatch):
    found, real = [], factor.bpr_factors

    def fit(triples, *rest, **more):
        found.append(triples.cells("user_id", "positive").collect())
        out = real(triples, *rest, **more)
        found.extend({r[0]: np.array(r.factors) for r in t.collect()} for t in out)
        return out

    monkeypatch.setattr(factor, "bpr_factors", fit)
    entry.queries()["bpr_factors"](spark, "/root/testdata/sf0.001")
    triples, users, items = found
    right = np.mean([users[u] @ (items[p] - items[int(n)]) > 0 for u, p, n in triples])
    assert right > 0.7
