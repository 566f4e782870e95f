import random

import pytest
from pyspark.sql import functions as F

from txnloom.operators import telemetry

START = 1704067200


def requests(spark, rows):
    """(second, status, milliseconds) rows."""
    frame = spark.createDataFrame(rows, "s long, status_code int, duration_ms double")
    return frame.select(
        F.timestamp_seconds(F.col("s") + START).alias("timestamp"), "status_code", "duration_ms",
        F.lit("POST").alias("method"), F.lit("/predict").alias("path"),
    )


def predictions(spark, seconds, level="HIGH"):
    frame = spark.createDataFrame([(s, level) for s in seconds], "s long, risk_level string")
    return frame.select(F.timestamp_seconds(F.col("s") + START).alias("created_at"), "risk_level")


def minutes(alerts, name):
    found = alerts.filter(F.col("alert") == name).select(F.unix_seconds("fires_at").alias("t"))
    return sorted((r["t"] - START) // 60 for r in found.collect())


def test_totals(spark):
    rows = requests(spark, [(0, 200, 10.0), (1, 404, 20.0), (2, 500, 33.337)])
    got = telemetry.request_totals(rows).first()
    assert tuple(got) == (3, 2, 21.11, 33.34)
    assert telemetry.request_by_endpoint(rows).first()["endpoint"] == "POST /predict"
    assert tuple(telemetry.request_totals(rows.limit(0)).first()) == (0, 0, 0.0, 0.0)
    errors = {r["status_code"]: r["errors"] for r in telemetry.request_counters(rows).collect()}
    assert errors == {200: 0, 404: 1, 500: 1}


def test_error_alert_needs_two_minutes_beyond_the_first(spark):
    # One error keeps the five-minute rate up for minutes 1 to 5.
    rows = requests(spark, [(30, 500, 1.0), (7200, 200, 1.0)])
    alerts = telemetry.alert_windows(rows, predictions(spark, []))
    assert minutes(alerts, telemetry.SERVER_ERRORS.name) == [3, 4, 5]


def test_slow_alert(spark):
    # Slow requests in minutes 0 to 2 keep p95 high at evaluations 1 to 7.
    rows = requests(spark, [(60 * m + 1, 200, 4000.0) for m in range(3)])
    alerts = telemetry.alert_windows(rows, predictions(spark, []))
    assert minutes(alerts, telemetry.SLOW_REQUESTS.name) == [6, 7]


def test_alerts_equal_a_walk_over_all_minutes(spark):
    """Busy and silent stretches over several days, some across midnight."""
    draw = random.Random(2)
    rows = []
    for start in (0, 1400, 1436, 1439, 2870, 2879, 4000, 4320 - 3):
        for m in range(start, start + draw.randrange(1, 25)):
            rows += [(60 * m + draw.randrange(60), draw.choice([200, 500, 503]), draw.choice([1.0, 3000.0, 9000.0])) for _ in range(draw.randrange(4))]
    rows += [(None, 500, 1.0)]
    frame = requests(spark, rows)
    seen = [r for r in rows if r[0] is not None]

    def expected(alert, holds):
        true = {e for e in range(1, 4500) if holds([r for r in seen if e - alert.window_minutes <= r[0] // 60 < e])}
        return [e for e in range(1, 4500) if set(range(e - alert.hold_minutes, e + 1)) <= true]

    def slow(window):
        counts = [sum(ms / 1000 <= b for _, _, ms in window) for b in telemetry.LATENCY_BOUNDS]
        rank = 0.95 * len(window)
        at = next((i for i, c in enumerate(counts) if c >= rank), None)
        if not window:
            return False
        if at is None:
            return True
        low, below = (telemetry.LATENCY_BOUNDS[at - 1], counts[at - 1]) if at else (0.0, 0)
        return low + (telemetry.LATENCY_BOUNDS[at] - low) * (rank - below) / (counts[at] - below) > 2.0

    alerts = telemetry.alert_windows(frame, predictions(spark, [])).persist()
    errors = expected(telemetry.SERVER_ERRORS, lambda w: any(500 <= s <= 599 for _, s, _ in w))
    assert minutes(alerts, telemetry.SERVER_ERRORS.name) == errors and errors
    latencies = expected(telemetry.SLOW_REQUESTS, slow)
    assert minutes(alerts, telemetry.SLOW_REQUESTS.name) == latencies and latencies
    alerts.unpersist()


def test_the_request_log_is_read_once(spark, counted_reads):
    rows, reads = counted_reads(requests(spark, [(60 * m, 500, 4000.0) for m in range(30)]))
    made, reads_made = counted_reads(predictions(spark, range(0, 600)))
    assert telemetry.alert_windows(rows, made).count() > 0
    assert (reads(), reads_made()) == (30, 600)


def test_spike_alert(spark):
    dense = [s for s in range(0, 1200)]
    alerts = telemetry.alert_windows(requests(spark, []), predictions(spark, dense))
    fired = minutes(alerts, telemetry.HIGH_RISK_SPIKE.name)
    # More than 120 in ten minutes holds from minute 3 on, for five minutes more.
    assert fired[0] == 8 and fired == list(range(8, fired[-1] + 1))
    calm = telemetry.alert_windows(requests(spark, []), predictions(spark, dense, "LOW"))
    assert calm.count() == 0


def test_histogram(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (0.55,), (1.0,), (None,)], "fraud_probability double")
    got = {r["le"]: r["cumulative_count"] for r in telemetry.probability_histogram(rows).collect()}
    assert got[0.0] == 2 and got[0.1] == 3 and got[0.5] == 3 and got[0.7] == 4 and got[1.0] == 5
    assert got[float("inf")] == 5


@pytest.mark.parametrize(
    ("latencies", "expected"),
    [([4000.0], 2.5 + 2.5 * 0.95), ([50000.0], 10.0), ([1.0] * 20, 0.005 * 0.95)],
)
def test_p95(spark, latencies, expected):
    rows = requests(spark, [(1, 200, v) for v in latencies])
    got = telemetry.latency_windows(rows).first()
    assert got["p95_seconds"] == pytest.approx(expected)
    assert got["rate_per_second"] == pytest.approx(len(latencies) / 300)


def test_missing_labels(spark):
    rows = spark.createDataFrame([(None, "APPROVE")], "risk_level string, final_decision string")
    assert telemetry.prediction_counters(rows).first()["risk_level"] == "UNKNOWN"
