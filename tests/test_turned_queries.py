"""Queries whose weights were shuffled to be packed by row, which took the disk of a large table."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.operators import recommend as rc

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["metrics_accuracy", "metrics_ratio"])
def test_weights_are_not_shuffled(spark, monkeypatch, name):
    def shuffled(*_, **__):
        raise AssertionError("weights are shuffled")

    monkeypatch.setattr(rc, "packed_weights", shuffled)
    got = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
