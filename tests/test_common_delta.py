"""sim_common_delta broadcast all weights, which took the driver's memory on large tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.operators import similarity as sm

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("many", [60, sm.MANY_TERMS])  # 60: equal items are put together, those that are bought are not
def test_common_cells_are_found_where_weights_are_made(spark, monkeypatch, many):
    monkeypatch.setattr(sm, "MANY_TERMS", many)
    got = entry.queries()["sim_common_delta"](spark, DATA)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['sim_common_delta']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_common_delta_broadcasts_no_weights(spark):
    m = spark.createDataFrame([(r, c, 1.0) for r in range(4) for c in range(5) if r != c], "row long, col long, data double")
    out = sm.common_delta(sm.similarity(m), sm.similarity(m, "dice"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
