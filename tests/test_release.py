"""Shuffle files of a stored table lay there until the next one was stored, beside what was shuffled meanwhile."""

import time

import pytest
from pyspark.sql import functions as F

from rankloom.sources import store


@pytest.mark.parametrize("again", range(3))
def test_shuffles_of_a_stored_table_go_soon(spark, again):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    before = files()
    store.checkpointed(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(5, "k"))
    for _ in range(10):
        left = files() - before
        if not left:
            break
        time.sleep(0.3)
    assert not left


def test_release_waits_for_the_listeners_only(spark, monkeypatch):
    """sim_hybrid stores a dozen small tables and waited a fixed time after each."""

    def slept(_):
        raise AssertionError("a fixed wait")

    monkeypatch.setattr(time, "sleep", slept)
    assert store.checkpointed(spark.range(10)).count() == 10
