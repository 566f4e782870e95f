"""Frames several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.config import Channel, new_workspace
from txnloom.operators import medallion, scoring
from txnloom.plans.fixtures import event_stream, raw_messages, transactions
from txnloom.sources.writers import publish


def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver transactions; the event time stands for the ingestion time."""
    rows = transactions(spark, sf_dir)
    return medallion.silver(rows.withColumn("ingestion_timestamp", F.col("event_timestamp")))


def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return medallion.silver(rows.withColumn("ingestion_timestamp", F.col("event_timestamp")))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with rules and decisions from the stand-in probability."""
    return scoring.decide(scoring.apply_rules(transactions(spark, sf_dir)))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scored events; the event time stands for the scoring time."""
    return scoring.scored_event(decided(spark, sf_dir), F.col("event_time"))


def raw_channel(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[Channel, str]:
    """A fresh channel holding the raw messages, and the folder around it."""
    root = new_workspace(spark, purpose)
    channel = Channel("parquet", path=f"{root}/raw")
    publish(raw_messages(spark, sf_dir), channel)
    return channel, root
