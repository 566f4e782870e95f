import pytest
from pyspark.sql import functions as F
from samples import HIGH, LOW, frame

from txnloom.functions.casts import safe_double, safe_int
from txnloom.operators import quality


def test_safe_casts(spark):
    texts = ["5", " 7 ", "3.7", "1e3", "1d", "x", "", None, "nan", "-2", "9999999999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(safe_double(rows, "t", -1).alias("d"), safe_int(rows, "t", -1).alias("i"))
    assert [tuple(r) for r in got.collect()] == [
        (5.0, 5), (7.0, 7), (3.7, -1), (1000.0, -1), (-1.0, -1), (-1.0, -1), (-1.0, -1),
        (-1.0, -1), (-1.0, -1), (-2.0, -2), (9999999999.0, -1),
    ]


def test_safe_casts_of_numbers(spark):
    rows = spark.createDataFrame([(3.7,), (float("nan"),), (None,), (float("inf"),)], "n double")
    got = rows.select(safe_double(rows, "n").alias("d"), safe_int(rows, "n").alias("i")).collect()
    assert [tuple(r) for r in got] == [(3.7, 3), (0.0, 0), (0.0, 0), (float("inf"), 0)]
    assert rows.select(safe_int(rows, "absent", 4).alias("i")).first()["i"] == 4


def test_unknown_types_reject_or_fail(spark):
    rows = frame(spark, [HIGH | {"type": "transfer"}, LOW | {"type": "INVALID_TYPE"}])
    marked = {r["event_id"]: r for r in quality.check_types(rows).collect()}
    assert marked["h"]["type"] == "TRANSFER" and marked["h"]["type_error"] is None
    assert "INVALID_TYPE" in marked["l"]["type_error"]
    with pytest.raises(Exception, match="Invalid transaction type: INVALID_TYPE"):
        quality.check_types(rows, mode="fail").collect()
    with pytest.raises(ValueError):
        quality.check_types(rows, mode="other")


def upload(spark, *rows):
    names = ["step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
             "newbalanceDest"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_clean_upload(spark):
    rows = upload(
        spark,
        ("1", " transfer ", "250000", "250000", "0", "0", "250000"),
        ("2.9", "PAYMENT", "1e2", "900", "780", "0", "0"),
        ("x", "PAYMENT", "1", "1", "1", "0", "0"),
        ("1", None, "1", "1", "1", "0", "0"),
        ("1", "PAYMENT", "", "1", "1", "0", "0"),
    )
    cleaned = quality.clean_upload(rows)
    kept = quality.accepted(cleaned).collect()
    assert [(r["step"], r["type"], r["amount"], r["isFlaggedFraud"]) for r in kept] == [
        (1, "TRANSFER", 250000.0, 0), (2, "PAYMENT", 100.0, 0),
    ]
    assert tuple(quality.upload_counts(cleaned).first()) == (5, 2, 3)
    many = cleaned.limit(1).crossJoin(spark.range(4000)).drop("id").withColumn("is_valid", F.lit(True))
    assert quality.accepted(many).count() == 4000


def test_clean_upload_requires_columns(spark):
    rows = upload(spark, ("1", "A", "1", "1", "1", "0", "0"))
    with pytest.raises(ValueError, match="Missing required columns: amount"):
        quality.clean_upload(rows.drop("amount"))
    with pytest.raises(ValueError, match="isFlaggedFraud"):
        quality.clean_upload(rows, require_flag=True)
