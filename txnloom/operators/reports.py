"""Dashboard aggregates: top-k views, distributions and KPI strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.functions.decisions import APPROVE, BLOCK, REVIEW

UNKNOWN = "UNKNOWN"

# Columns that order a lake table from newest to oldest.
RECENCY_COLUMNS = ("curated_timestamp", "ingestion_timestamp", "event_time")

# Engineered columns shown as averages.
RISK_FEATURES = (
    "balance_diff_orig",
    "balance_diff_dest",
    "amount_to_oldbalance_ratio",
    "is_zero_balance_after_txn",
    "sender_balance_mismatch",
    "receiver_balance_mismatch",
)

AUDIT_VIEW = (
    "event_id",
    "step",
    "transaction_type",
    "amount",
    "fraud_probability",
    "risk_level",
    "rule_risk_score",
    "rule_risk_level",
    "final_decision",
    "triggered_rules",
    "created_at",
)


def newest(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The ``limit`` newest rows.  Spark keeps a heap per task for this plan
    (TakeOrderedAndProject), so no full sort or shuffle of the table happens."""
    if limit < 1:
        raise ValueError(f"limit must be 1 or more, not {limit}")
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def latest_rows(df: DataFrame, limit: int = 100, tie: str = "event_id") -> DataFrame:
    """Newest rows by the first recency column a table has."""
    for name in RECENCY_COLUMNS:
        if name in df.columns:
            return newest(df, limit, name, *([tie] if tie in df.columns else []))
    raise ValueError(f"no recency column among {', '.join(df.columns)}")


def latest_and_total(df: DataFrame, limit: int = 100) -> tuple[DataFrame, int]:
    """The newest rows and the number of all rows of a table."""
    return latest_rows(df, limit), df.count()


def recent_scored(log: DataFrame, limit: int = 20) -> DataFrame:
    return newest(log, limit, "scored_at", "event_id")


def recent_audit(audit: DataFrame, limit: int = 50) -> DataFrame:
    return newest(audit, limit, "created_at", "event_id").select(*AUDIT_VIEW)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; a missing value counts as UNKNOWN."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))
    return df.groupBy(value.alias(column)).agg(F.count("*").alias("count"))


def average_by(df: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(measure).alias(name))


def type_distribution(log: DataFrame) -> DataFrame:
    """Types among all scored rows, with the latest event time seen."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit(UNKNOWN))
    return (
        log.groupBy(kind.alias("type"))
        .agg(F.count("*").alias("count"), F.max("event_time").alias("latest_event_time"))
        .orderBy("type")
    )


def feature_means(df: DataFrame, features: tuple[str, ...] = RISK_FEATURES) -> DataFrame:
    """Mean of each risk feature as (feature, average_value) rows."""
    present = [f for f in features if f in df.columns]
    means = df.agg(*[F.avg(f).alias(f) for f in present])
    return means.unpivot([], present, "feature", "average_value")


def analyst_view(df: DataFrame) -> DataFrame:
    """What an analyst reads next to one decision."""
    return df.select(
        "event_id",
        "amount",
        F.col("balance_diff_orig").alias("sender_balance_difference"),
        F.col("balance_diff_dest").alias("receiver_balance_difference"),
        F.col("amount_to_oldbalance_ratio").alias("amount_to_sender_balance_ratio"),
        F.when(F.col("is_zero_balance_after_txn") == 1, "Yes")
        .otherwise("No")
        .alias("sender_zero_balance"),
    )


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def kpi_risk(df: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return df.agg(
        F.count("*").alias("total"),
        _count(level == "HIGH", "high_risk"),
        _count(level == "MEDIUM", "medium_risk"),
        _count(level == "LOW", "low_risk"),
    )


def kpi_decisions(df: DataFrame) -> DataFrame:
    decision = F.col("final_decision")
    return df.agg(
        F.count("*").alias("total"),
        _count(decision == APPROVE, "approved"),
        _count(decision == REVIEW, "manual_review"),
        _count(decision == BLOCK, "blocked"),
    )


def kpi_audit(df: DataFrame) -> DataFrame:
    """Audit strip; any decision naming a manual review counts, also a block."""
    return df.agg(
        F.count("*").alias("total"),
        _count(F.col("risk_level") == "HIGH", "high_risk"),
        _count(F.upper("final_decision").contains(REVIEW), "manual_review"),
        F.avg("fraud_probability").alias("average_probability"),
    )
