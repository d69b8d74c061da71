"""metrics_ratio kept the shuffles of the train profiles beside those of the lists until its end."""

from rankloom.operators import evaluate as ev


def test_reference_is_computed_before_the_lists(spark):
    train = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in range(u % 7 + 1)], "user_id long, item_id long, data double")
    reference = ev.train_reference(train, spark.range(9).withColumnRenamed("id", "item_id"), spark.range(30).withColumnRenamed("id", "user_id"))
    rows = reference.collect()
    assert len(rows) == 1 and rows[0]["novelty"] > 0
    plan = reference._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
