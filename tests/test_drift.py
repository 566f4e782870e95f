import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnloom.operators import drift


def numbers(spark, values, name="amount"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def psi(spark, expected, actual, buckets=10):
    row = drift.psi_report(
        numbers(spark, expected), numbers(spark, actual), ["amount"], buckets
    ).first()
    return row["psi"], row["severity"]


def row_psi(expected, actual, buckets=10):
    """The definition again, with numpy."""
    points = np.unique(np.quantile(expected, [i / buckets for i in range(buckets + 1)]))
    if len(points) < 2:
        return 0.0
    shares = []
    for side in (expected, actual):
        counts = np.histogram(side, bins=points)[0]
        shares.append(np.clip(counts / max(counts.sum(), 1), 0.0001, None))
    e, a = shares
    return float(sum((a - e) * np.log(a / e)))


def test_shift_is_found(spark):
    value, level = psi(
        spark, [float(v) for v in range(100, 200, 10)], [1000.0, 1100.0, 1200.0, 1300.0, 1400.0], 5
    )
    assert value > 0.25 and level == "HIGH"


def test_edge_cases(spark):
    assert psi(spark, [5.0] * 9, [1.0, 5.0, 9.0]) == (0.0, "LOW")
    assert psi(spark, [], [1.0]) == (None, "UNKNOWN")
    assert psi(spark, [1.0, 2.0], [None, float("nan")]) == (None, "UNKNOWN")
    same = [float(v) for v in range(50)]
    assert psi(spark, same, same)[0] == pytest.approx(0.0, abs=1e-12)


def test_values_outside_the_baseline_are_left_out(spark):
    base = [float(v) for v in range(100)]
    inside, _ = psi(spark, base, base)
    with_far, _ = psi(spark, base, base + [1e9] * 500 + [-1e9] * 500)
    assert with_far == pytest.approx(inside, abs=1e-12)


# Quarters are exact, so both sides compute the same breakpoints.
values = st.lists(st.integers(-40, 40).map(lambda v: v / 4), min_size=3, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(expected=values, actual=values)
def test_psi_matches_numpy(spark, expected, actual):
    found, _ = psi(spark, expected, actual, buckets=4)
    assert found == pytest.approx(row_psi(expected, actual, 4), abs=1e-9)


def test_the_baseline_is_read_twice_for_all_features(spark, counted_reads):
    frame = spark.range(300).selectExpr("CAST(id AS DOUBLE) AS amount", "CAST(id % 9 AS DOUBLE) AS oldbalanceOrg")
    base, reads = counted_reads(frame)
    now, reads_now = counted_reads(frame.filter("amount > 50"))
    assert drift.psi_report(base, now).count() == 2
    assert (reads(), reads_now()) == (600, 249)


def test_categorical_shift_aligns_both_sides(spark):
    base = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "type string")
    now = spark.createDataFrame([("B",), ("C",)], "type string")
    got = {
        r["category"]: (r["baseline_pct"], r["current_pct"], r["absolute_change"])
        for r in drift.categorical_shift(base, now).collect()
    }
    assert got == {
        "A": (0.5, 0.0, 0.5), "B": (0.25, 0.5, 0.25), "C": (0.0, 0.5, 0.5),
        "UNKNOWN": (0.25, 0.0, 0.25),
    }


def test_report(spark):
    kinds = ["PAYMENT", "PAYMENT", "TRANSFER", "CASH_OUT"] * 2
    amounts = [100.0, 120.0, 130.0, 140.0, 150.0, 160.0, 170.0, 180.0]
    base = spark.createDataFrame(list(zip(amounts, kinds, strict=True)), "amount double, type string")
    now = spark.createDataFrame(
        [(2000.0, "TRANSFER"), (2200.0, "TRANSFER"), (2300.0, "CASH_OUT"), (2400.0, "CASH_OUT")],
        "amount double, type string",
    )
    report = drift.drift_report(base, now).collect()
    assert all(r["requires_review"] and r["high_drift_features"] == "amount" for r in report)
    assert {r["feature"] for r in report if r["kind"] == "categorical"} == {"type"}
    more = [f.withColumn("final_decision", F.lit("APPROVE")).withColumn("risk_level", F.lit(None).cast("string")) for f in (base, now)]
    found = {(r["feature"], r["category"]) for r in drift.drift_report(*more).collect() if r["kind"] == "categorical"}
    assert {("final_decision", "APPROVE"), ("risk_level", "UNKNOWN"), ("type", "TRANSFER")} <= found
    calm = drift.drift_report(base, base).collect()
    assert not any(r["requires_review"] for r in calm)
    assert math.isclose(calm[0]["psi"], 0.0, abs_tol=1e-12)
