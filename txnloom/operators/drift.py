"""Drift of numeric and categorical columns between two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.operators.ranks import quantiles

# Observed features, bucket count, share floor and severity bounds.
NUMERIC_FEATURES = (
    "amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
    "balance_diff_orig",
    "balance_diff_dest",
    "amount_to_oldbalance_ratio",
)
CATEGORICAL_FEATURES = ("type", "final_decision", "risk_level")
BUCKETS = 10
SHARE_FLOOR = 0.0001
HIGH_DRIFT = 0.25
MEDIUM_DRIFT = 0.10
UNKNOWN = "UNKNOWN"


def severity(psi: Column) -> Column:
    return (
        F.when(psi.isNull(), UNKNOWN)
        .when(psi >= HIGH_DRIFT, "HIGH")
        .when(psi >= MEDIUM_DRIFT, "MEDIUM")
        .otherwise("LOW")
    )


def _shared(baseline: DataFrame, current: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in baseline.columns and n in current.columns]


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    return df.select(*doubles).unpivot([], list(features), "feature", "value")


_OUTSIDE = -1


def _bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin number in [a, b) bins with a closed last bin; -1 outside them.

    NULL marks a missing value, and NaN counts as missing.
    """
    bins = F.lit(_OUTSIDE)
    for index in reversed(range(len(edges) - 1)):
        last = index == len(edges) - 2
        below = value <= edges[index + 1] if last else value < edges[index + 1]
        bins = F.when(below, index).otherwise(bins)
    if len(edges) > 1:
        bins = F.when(value < edges[0], _OUTSIDE).otherwise(bins)
    return F.when(value.isNotNull() & ~F.isnan(value), bins)


def _bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], side: str) -> DataFrame:
    """Rows per feature and bin.

    The bin is a CASE expression on the wide row, so only small integers are
    unpivoted, and aggregation before the exchange leaves at most features x
    bins rows per task.
    """
    binned = df.select(
        *[_bin(F.col(f).cast("double"), bounds).alias(f) for f, bounds in edges.items()]
    )
    return (
        binned.unpivot([], list(edges), "feature", "bin")
        .filter("bin IS NOT NULL")
        .groupBy("feature", "bin")
        .agg(F.count("*").alias(side))
    )


def psi_report(
    baseline: DataFrame,
    current: DataFrame,
    features: Sequence[str] = NUMERIC_FEATURES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Population stability index and severity per numeric feature.

    Breakpoints are baseline quantiles without repeats; values outside them
    leave both the counts and the totals.  A side without values gives NULL, a
    constant baseline 0.  The baseline is read twice, for the quantiles of all
    features, which also tell how many of its rows lie in each bin; reading the
    breakpoints (features x 11 numbers) is an action.  The current side is read
    once, and lazily.
    """
    features = _shared(baseline, current, features)
    shares = [i / buckets for i in range(buckets + 1)]
    found = {r["feature"]: r for r in quantiles(_long(baseline, features), "feature", "value", shares).collect()}
    known = {f: list(found[f]["edges"]) if f in found else [] for f in features}
    # Bins that no side fills still take part, with the floor share.
    expected = []
    for f in features:
        below = list(found[f]["below"]) if f in found else []
        # The last bin is closed; of a single edge only the rows outside all bins are left.
        ends = [*below[1:-1], found[f]["rows"]] if len(below) > 1 else []
        counts = [end - start for start, end in zip(below, ends, strict=False)]
        outside = found[f]["rows"] - sum(counts) if f in found else 0
        expected += [(f, b, n) for b, n in enumerate([outside, *counts], _OUTSIDE)]
    none = F.lit(0).cast("bigint")
    slots = baseline.sparkSession.createDataFrame(expected, "feature string, bin int, expected bigint")
    counted = _bin_counts(current, known, "actual").withColumn("expected", none)
    per_bin = (
        counted.unionByName(slots.withColumn("actual", none))
        .groupBy("feature", "bin")
        .agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    )
    return _index(per_bin)


def _index(per_bin: DataFrame) -> DataFrame:
    """PSI and severity from counts per feature and bin (features x 11 rows)."""
    inside = F.col("bin") != _OUTSIDE
    totals = per_bin.groupBy("feature").agg(
        F.sum("expected").alias("expected_rows"),
        F.sum("actual").alias("actual_rows"),
        F.greatest(F.sum(F.when(inside, F.col("expected"))), F.lit(1)).alias("expected_binned"),
        F.greatest(F.sum(F.when(inside, F.col("actual"))), F.lit(1)).alias("actual_binned"),
    )

    def share(count: str, total: str) -> Column:
        found = F.col(count).cast("double") / F.col(total).cast("double")
        return F.greatest(found, F.lit(SHARE_FLOOR))

    expected, actual = share("expected", "expected_binned"), share("actual", "actual_binned")
    term = F.when(inside, (actual - expected) * F.ln(actual / expected))
    measurable = (F.min("expected_rows") > 0) & (F.min("actual_rows") > 0)
    return (
        per_bin.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(F.when(measurable, F.coalesce(F.sum(term), F.lit(0.0))).alias("psi"))
        .withColumn("severity", severity(F.col("psi")))
    )


def categorical_shift(
    baseline: DataFrame, current: DataFrame, features: Sequence[str] = CATEGORICAL_FEATURES
) -> DataFrame:
    """Share of each category on both sides and its absolute change.

    Both sides are counted under one key, which is the full outer alignment of
    the two distributions with a single shuffle of pre-aggregated counts.
    """
    features = _shared(baseline, current, features)

    def tagged(df: DataFrame, is_baseline: bool) -> DataFrame:
        filled = [
            F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)).alias(f) for f in features
        ]
        long = df.select(*filled).unpivot([], features, "feature", "category")
        return long.withColumn("is_baseline", F.lit(is_baseline))

    side = F.col("is_baseline")
    counts = (
        tagged(baseline, True)
        .unionByName(tagged(current, False))
        .groupBy("feature", "category")
        .agg(F.count_if(side).alias("b"), F.count_if(~side).alias("c"))
    )
    # One row per feature.
    totals = counts.groupBy("feature").agg(F.sum("b").alias("b_total"), F.sum("c").alias("c_total"))

    def share(part: str, whole: str) -> Column:
        share_of = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
        return F.coalesce(share_of, F.lit(0.0))

    return (
        counts.join(F.broadcast(totals), "feature")
        .select(
            "feature",
            "category",
            share("b", "b_total").alias("baseline_pct"),
            share("c", "c_total").alias("current_pct"),
        )
        .withColumn("absolute_change", F.abs(F.col("current_pct") - F.col("baseline_pct")))
    )


# Layout of a drift report: numeric rows fill the first part, categories the last.
_REPORT = """
    kind string, feature string, category string, psi double, severity string,
    baseline_pct double, current_pct double, absolute_change double,
    high_drift_features string, requires_review boolean
"""


def drift_report(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row per numeric feature and per category, with the review verdict.

    The verdict needs the PSI of all features, so those (at most eight) rows
    are read here; categories stay a distributed result.
    """
    numeric = psi_report(baseline, current).collect()
    high = sorted(row["feature"] for row in numeric if row["severity"] == "HIGH")
    verdict = (", ".join(high), bool(high))
    report = baseline.sparkSession.createDataFrame(
        [
            ("numeric", r["feature"], None, r["psi"], r["severity"], None, None, None, *verdict)
            for r in numeric
        ],
        _REPORT,
    )
    if not _shared(baseline, current, CATEGORICAL_FEATURES):
        return report
    shifts = categorical_shift(baseline, current).select(
        F.lit("categorical").alias("kind"),
        "feature",
        "category",
        F.lit(None).cast("double").alias("psi"),
        F.lit(None).cast("string").alias("severity"),
        "baseline_pct",
        "current_pct",
        "absolute_change",
        F.lit(verdict[0]).alias("high_drift_features"),
        F.lit(verdict[1]).alias("requires_review"),
    )
    return report.unionByName(shifts)
