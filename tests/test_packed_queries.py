import os

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.operators import recommend as rc
from rankloom.operators import similarity as sm

DATA = "/root/testdata/sf0.001"
QUERIES = ["itemknn_cf", "metric_list_diversity", "metrics_beyond", "rerank_feature_table", "user_groups_map", "metrics_ratio", "metrics_accuracy", "userknn_cf", "candidate_pool", "itemknn_cfcbf", "userknn_cfcbf", "itemknn_cf_tfidf", "sim_common_delta", "sim_dot", "sim_hybrid", "sim_rowweighted", "submission_rows", "itemknn_cbf"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_joins_no_pairs_or_scores(spark, monkeypatch, name):
    """These queries ran out of disk or time by joins of pairs and of all scores; they equal their SQL without them."""

    def joined(*_, **__):
        raise AssertionError("pairs or scores are joined")

    monkeypatch.setattr(rc, "item_scores", joined)
    monkeypatch.setattr(rc, "user_scores", joined)
    monkeypatch.setattr(sm, "_pairs", joined)
    got = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
