import duckdb

import __spark_entry__ as entry
from rankloom.operators import recommend as rc

DATA = "/root/testdata/sf0.001"


def test_users_are_not_sent_to_every_block(spark, monkeypatch):
    passed = []
    real = rc.factor_top
    monkeypatch.setattr(rc, "factor_top", lambda *a, **k: (passed.append(real(*a, **k)), passed[-1])[1])
    got = entry.queries()["factor_top_blocks"](spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['factor_top_blocks']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    assert "CoGroup" not in passed[0]._jdf.queryExecution().executedPlan().toString()
