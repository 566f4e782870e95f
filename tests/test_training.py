from txnloom.operators import training
from txnloom.streaming import pipelines


def sizes_of(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_tasks_follow_cores_then_rows():
    assert training.tasks_for(0, 8) == training.tasks_for(1, 8) == 1
    assert training.tasks_for(training.LEAST_ROWS * 3, 8) == 3
    assert training.tasks_for(training.MOST_ROWS, 8) == 8
    for rows in (10_000_000, 60_000_000):
        tasks = training.tasks_for(rows, 12)
        assert tasks % 12 == 0 and rows / tasks <= training.MOST_ROWS


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, df: fitted.append(df))
    monkeypatch.setattr(training, "LEAST_ROWS", 10)
    monkeypatch.setattr(training, "MOST_ROWS", 50)
    rows = spark.range(1000).coalesce(1).selectExpr(
        "cast(id as int) AS step", "'PAYMENT' AS type", "cast(id as double) AS amount",
        "1.0D AS oldbalanceOrg", "2.0D AS newbalanceOrig", "3.0D AS oldbalanceDest", "4.0D AS newbalanceDest",
        "0 AS isFlaggedFraud", "cast(id % 2 as int) AS isFraud", "'C1' AS sender_id",
    )
    for fit in (training.train_forest, training.train_boosted):
        fit(rows)
        sizes = sizes_of(fitted.pop())
        assert sum(sizes) == 1000 and len(sizes) >= 20 and max(sizes) <= 60


def test_micro_batches_are_dealt_evenly(spark):
    one = pipelines.dealt(spark.range(800).coalesce(1))
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes_of(one)) == 800 and max(sizes_of(one)) <= 800 / cores + 1
    assert len(sizes_of(pipelines.dealt(spark.range(0, 800, 1, 3 * cores)))) == 3 * cores * pipelines.SPREAD
    assert pipelines.dealt(spark.range(0)).count() == 0
