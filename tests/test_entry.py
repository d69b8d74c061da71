import os

import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
CHECKED = ["urm_build", "dedup_latest", "split_userwise", "sim_cosine", "itemknn_cf", "metrics_accuracy"]


def test_registry():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) >= 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in "customer part orders lineitem events documents embeddings".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = c.sql(e.oracle_sql()[name]).df(), e.queries()[name](spark, DATA).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).values.tolist()))
    assert rows(got) == rows(want)
