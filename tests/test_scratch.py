"""What queries leave in the shared folder while their result is still to be read: large tables ran out of disk by what no later job reads."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.operators import packed as pk
from rankloom.operators import similarity as sm
from rankloom.sources import store

DATA = "/root/testdata/sf0.001"


def folders(spark):
    path = store.filesystem(store.run_folder(spark))[1]
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def check(spark, name, most, oracle=True):
    before = folders(spark)
    got = entry.queries()[name](spark, DATA)
    left = folders(spark) - before
    assert len(left) <= most, left
    if oracle:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_sim_dot_leaves_the_packed_matrix_and_its_transpose(spark):
    check(spark, "sim_dot", 2)


def test_sim_rowweighted_leaves_the_packed_matrices(spark):
    check(spark, "sim_rowweighted", 2)


@pytest.mark.parametrize("name", ["rerank_feature_table", "user_groups_map", "metrics_ratio", "metrics_accuracy"])
def test_evaluation_leaves_the_split_and_the_lists(spark, name):
    check(spark, name, 3 if name == "user_groups_map" else 2)


def test_scaled_rows_shuffles_nothing_and_drops_rows_without_weight(spark, monkeypatch):
    x = pk.pack(spark.createDataFrame([(r, c, float(r + c)) for r in range(1, 40) for c in range(r % 7)], "row long, col long, data double"), "row", "col")
    weights = pk.pack(spark.createDataFrame([(r, 0, r / 2) for r in range(0, 60, 3)], "row long, col long, data double"), "row", "col")
    got = pk.scaled_rows(x, weights).cells("row", "col").collect()
    assert sorted(map(tuple, got)) == sorted((r, c, (r + c) * r / 2) for r in range(3, 40, 3) for c in range(r % 7))
    w = sm.similarity(x, row_weights=spark.createDataFrame([], "row long, weight double"))
    assert w.count() == 0
