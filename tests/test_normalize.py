import random

import pytest
from pyspark.sql import functions as F

from txnloom.operators.normalize import join_identity, normalize_ieee, normalize_paysim


def test_identity_join_repeats_and_keeps(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "TransactionID int, a double")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "TransactionID int, d string")
    got = join_identity(left, right)
    assert got.columns == ["TransactionID", "a", "d"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted(
        [(1, 1.0, "x"), (1, 1.0, "y"), (2, 2.0, None), (None, 3.0, None)], key=str
    )
    outer = left.join(right, "TransactionID", "left")
    assert rows == sorted((tuple(r) for r in outer.collect()), key=str)


@pytest.mark.parametrize("heavy", [1, 7, 10**6])
def test_hot_ids_are_dealt_to_parts(spark, heavy):
    """One id with a third of both sides, ids hot on one side only, and many rows without an id."""
    draw = random.Random(heavy)
    left = [(draw.choice([1, 1, 2, 3, None, draw.randrange(50)]), n) for n in range(300)] + [(60, n) for n in range(40)]
    right = [(draw.choice([1, 3, 4, None, draw.randrange(90)]), f"d{n}") for n in range(120)] + [(61, "x")] * 30
    one = spark.createDataFrame(left, "TransactionID int, a long")
    two = spark.createDataFrame(right, "TransactionID int, d string")
    got = join_identity(one, two, heavy_rows=heavy)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        map(tuple, one.join(two, "TransactionID", "left").collect()), key=str
    )


def test_a_hot_id_is_joined_in_many_tasks(spark):
    one = spark.range(4000).select(F.lit(1).alias("TransactionID"), F.col("id").alias("a"))
    two = spark.range(6).select(F.lit(1).alias("TransactionID"), F.col("id").alias("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_identity(one, two, heavy_rows=100)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == 24_000
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 12_000


def test_both_sides_are_read_once(spark, counted_reads):
    left, reads_left = counted_reads(spark.range(50).select(F.col("id").cast("int").alias("TransactionID"), "id"))
    right, reads_right = counted_reads(spark.range(20).select((F.col("id") % 7).cast("int").alias("TransactionID"), F.col("id").alias("d")))
    assert join_identity(left, right).count() == 50 + 13
    assert (reads_left(), reads_right()) == (50, 20)


def test_ids_are_stable_or_random(spark):
    rows = spark.createDataFrame([("PAYMENT", 1.0)], "type string, amount double")
    ids = {normalize_paysim(rows).first()["event_id"] for _ in range(2)}
    assert len(ids) == 1
    random_ids = {normalize_paysim(rows, stable_ids=False).first()["event_id"] for _ in range(2)}
    assert len(random_ids) == 2
    assert len(normalize_ieee(rows.withColumn("x", F.lit(1))).first()["event_id"]) == 64
