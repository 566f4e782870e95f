from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from samples import HIGH, LOW, frame

from txnloom.operators import logs, reports, scoring


def decided(spark):
    rows = frame(spark, [HIGH, LOW]).withColumn(
        "fraud_probability", F.when(F.col("event_id") == "h", 0.9).otherwise(0.1)
    )
    return scoring.decide(scoring.apply_rules(rows))


def test_newest_first(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "event_id string, event_time string")
    assert [r["event_id"] for r in reports.latest_rows(rows, 2).collect()] == ["2", "1"]
    both = rows.withColumn("curated_timestamp", -F.col("event_id").cast("int"))
    assert [r["event_id"] for r in reports.latest_rows(both, 2).collect()] == ["1", "2"]
    newest, total = reports.latest_and_total(rows, 1)
    assert [r["event_id"] for r in newest.collect()] == ["2"] and total == 2
    with pytest.raises(ValueError, match="recency"):
        reports.latest_rows(spark.range(9), 3)


def test_limits_are_used_as_given(spark):
    log = spark.range(700).selectExpr("string(id) AS event_id", "string(id) AS scored_at")
    assert reports.recent_scored(log, 500).count() == 500
    for limit in (0, -5):
        with pytest.raises(ValueError, match="limit"):
            reports.recent_scored(log, limit)


def test_distribution_names_missing_values(spark):
    rows = spark.createDataFrame([("HIGH",), (None,), ("",)], "risk_level string")
    got = {r["risk_level"]: r["count"] for r in reports.distribution(rows, "risk_level").collect()}
    assert got == {"HIGH": 1, "UNKNOWN": 2}


def test_strips(spark):
    rows = decided(spark)
    assert tuple(reports.kpi_risk(rows).first()) == (2, 1, 0, 1)
    assert tuple(reports.kpi_decisions(rows).first()) == (2, 1, 0, 1)
    assert tuple(reports.kpi_audit(rows).first())[:3] == (2, 1, 1)


def test_messages_and_logs(spark):
    events = scoring.scored_event(decided(spark), F.lit("now"))
    keys = {r["key"] for r in logs.messages(events).collect()}
    assert keys == {"h", "l"}
    unnamed = frame(spark, [HIGH | {"event_id": None}])
    assert logs.messages(unnamed).first()["key"] == "unknown"
    row = logs.scored_log(events).filter("event_id = 'h'").first()
    assert row["triggered_rules"].count(" | ") == 3 and len(row) == 12
    assert len(logs.alert_log(decided(spark)).columns) == 12
    assert "batch_saved_at" in logs.batch_log(decided(spark)).columns


def test_json_safe(spark):
    rows = spark.createDataFrame([(Decimal("1.50"),)], "d decimal(9,2)").withColumn(
        "t", F.lit("2024-01-02 03:04:05").cast("timestamp")
    )
    assert tuple(logs.json_safe(rows).first()) == (1.5, "2024-01-02T03:04:05.000000")
