"""Bronze, silver and gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.functions.features import balance_features, mismatch_flags
from txnloom.functions.rules import HIGH_VALUE_AMOUNT
from txnloom.schemas import CANONICAL_EVENT, SCORED_EVENT

WINDOW_MINUTES = 10
WINDOW = f"{WINDOW_MINUTES} minutes"
LATENESS = "1 hour"
_UNREADABLE = "_unreadable"


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages to typed events, with both timestamps.

    A single field of the wrong type is NULL.  A message that yields no event at
    all keeps its text in ``raw_event`` and has ``is_malformed`` set, so that a
    reader can divert it.
    """
    layout = T.StructType([*CANONICAL_EVENT.fields, T.StructField(_UNREADABLE, T.StringType())])
    text = F.col(value).cast("string")
    record = F.from_json(text, layout, {"columnNameOfCorruptRecord": _UNREADABLE})
    nothing = F.coalesce(*[F.col(f"r.{n}").cast("string") for n in CANONICAL_EVENT.names]).isNull()
    return messages.select(text.alias("raw_event"), record.alias("r")).select(
        *[F.col(f"r.{name}") for name in CANONICAL_EVENT.names],
        (F.col("r").isNull() | nothing).alias("is_malformed"),
        "raw_event",
        F.try_to_timestamp("r.event_time").alias("event_timestamp"),
        F.current_timestamp().alias("ingestion_timestamp"),
    )


def readable(decoded: DataFrame) -> DataFrame:
    """Decoded events without the diversion columns: the bronze rows."""
    return decoded.filter(~F.col("is_malformed")).drop("is_malformed", "raw_event")


def unreadable(decoded: DataFrame) -> DataFrame:
    """The diverted messages of ``decode``."""
    return decoded.filter("is_malformed").select("raw_event", "ingestion_timestamp")


def landing(decoded: DataFrame) -> DataFrame:
    """Rows of the bronze table: every message once, diverted ones with their text.

    ``diverted`` (0 or 1) is the table's partition column, so that readers of
    either kind of rows never open files of the other.
    """
    text = F.when(F.col("is_malformed"), F.col("raw_event")).alias("raw_event")
    events = [c for c in decoded.columns if c not in ("is_malformed", "raw_event")]
    return decoded.select(*events, text, F.col("is_malformed").cast("int").alias("diverted"))


def landed_events(landed: DataFrame) -> DataFrame:
    """The events of the bronze table, as of ``readable``."""
    return landed.filter("diverted = 0").drop("diverted", "raw_event")


def landed_rejects(landed: DataFrame) -> DataFrame:
    """The diverted messages of the bronze table, as of ``unreadable``."""
    return landed.filter("diverted = 1").select("raw_event", "ingestion_timestamp")


def event_key() -> Column:
    """What tells an event from others: its id, else a digest of its content."""
    content = F.to_json(F.struct(*[n for n in CANONICAL_EVENT.names if n not in ("sender_id", "receiver_id")]))
    return F.coalesce(F.col("event_id"), F.concat(F.lit("#"), F.sha2(content, 256)))


def silver(events: DataFrame) -> DataFrame:
    """Events with balance features and mismatch flags, without account ids."""
    kept = [n for n in CANONICAL_EVENT.names if n not in ("sender_id", "receiver_id")]
    derived = balance_features() | mismatch_flags()
    return events.select(
        *kept,
        *[column.alias(name) for name, column in derived.items()],
        "ingestion_timestamp",
        "event_timestamp",
    )


def _measures() -> list[Column]:
    return [
        F.count("*").alias("transaction_count"),
        F.avg("amount").alias("average_amount"),
        F.count("amount").alias("amount_count"),
        F.count_if(F.col("amount") >= HIGH_VALUE_AMOUNT).alias("high_amount_count"),
        F.count_if(F.col("is_zero_balance_after_txn") == 1).alias("zero_balance_count"),
    ]


def _label(with_type: str, without_type: str) -> Column:
    return F.when(F.col("type").isNull(), without_type).otherwise(with_type)


def gold_by_type(silver_rows: DataFrame) -> DataFrame:
    """Counts and averages per source and transaction type."""
    now = F.current_timestamp()
    return (
        silver_rows.groupBy("source_dataset", "type")
        .agg(*_measures())
        .withColumn("summary_level", _label("source_dataset_type", "source_dataset"))
        .withColumn("window_start", now)
        .withColumn("window_end", now)
    )


def gold_by_window(silver_rows: DataFrame) -> DataFrame:
    """Transaction counts per ten-minute window, source and type.

    These summary rows carry counts only; their other measures are 0.  Windowed
    measures are the business of ``streaming.pipelines.windowed_measures``.
    """
    counted = silver_rows.groupBy(
        F.window("event_timestamp", WINDOW).alias("w"), "source_dataset", "type"
    ).agg(F.count("*").alias("transaction_count"))
    return counted.select(
        "source_dataset",
        "type",
        "transaction_count",
        F.lit(0.0).alias("average_amount"),
        F.lit(0).cast("bigint").alias("amount_count"),
        F.lit(0).cast("bigint").alias("high_amount_count"),
        F.lit(0).cast("bigint").alias("zero_balance_count"),
        _label("window_type", "window").alias("summary_level"),
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
    )


def gold(silver_rows: DataFrame) -> DataFrame:
    """Both summaries from one scan and one shuffle, through grouping sets.

    Equal to ``gold_by_type`` union ``gold_by_window``, which would read the
    rows twice.  Aggregation starts before the exchange, so a source or type
    holding much of the data sends one row per task.
    """
    seconds = F.unix_seconds("event_timestamp")
    width = F.lit(WINDOW_MINUTES * 60)
    binned = silver_rows.select(
        "source_dataset",
        "type",
        "amount",
        "is_zero_balance_after_txn",
        F.timestamp_seconds(seconds - F.pmod(seconds, width)).alias("window_start"),
    )
    keys = ["source_dataset", "type", "window_start"]
    grouped = binned.groupingSets([keys[:2], keys], *keys).agg(
        *_measures(), F.grouping("window_start").alias("per_type")
    )
    per_type = F.col("per_type") == 1
    now = F.current_timestamp()

    def only_per_type(name: str) -> Column:
        return F.when(per_type, F.col(name)).otherwise(F.lit(0)).alias(name)

    # A row without a usable timestamp belongs to no window.
    return grouped.filter(per_type | F.col("window_start").isNotNull()).select(
        "source_dataset",
        "type",
        "transaction_count",
        only_per_type("average_amount"),
        only_per_type("amount_count"),
        only_per_type("high_amount_count"),
        only_per_type("zero_balance_count"),
        F.when(per_type, _label("source_dataset_type", "source_dataset"))
        .otherwise(_label("window_type", "window"))
        .alias("summary_level"),
        F.when(per_type, now).otherwise(F.col("window_start")).alias("window_start"),
        F.when(per_type, now)
        .otherwise(F.col("window_start") + F.make_dt_interval(mins=F.lit(WINDOW_MINUTES)))
        .alias("window_end"),
        now.alias("updated_at"),
    )


def merge_gold(partials: DataFrame) -> DataFrame:
    """Read view over per-batch gold rows: one row per summary.

    Counts add up; an average is weighted by ``amount_count``, the rows that
    have an amount.  The time bounds of a per-type row are only the time of its
    batch, so they do not identify it.
    """
    is_window = F.col("summary_level").startswith("window")
    weighted = F.col("average_amount") * F.col("amount_count")
    mean = F.try_divide(F.sum(weighted), F.sum("amount_count"))
    return (
        partials.groupBy(
            "summary_level",
            "source_dataset",
            "type",
            F.when(is_window, F.col("window_start")).alias("window_start"),
            F.when(is_window, F.col("window_end")).alias("window_end"),
        )
        .agg(
            F.sum("transaction_count").alias("transaction_count"),
            F.when(F.col("summary_level").startswith("window"), F.lit(0.0)).otherwise(mean).alias("average_amount"),
            F.sum("amount_count").alias("amount_count"),
            F.sum("high_amount_count").alias("high_amount_count"),
            F.sum("zero_balance_count").alias("zero_balance_count"),
        )
    )


def gold_period(rows: DataFrame) -> DataFrame:
    """Add ``period``, the partition of the gold table: a day of windows, or all per-type rows."""
    day = F.date_format("window_start", "'d'yyyyMMdd")
    return rows.withColumn("period", F.when(F.col("summary_level").startswith("window"), day).otherwise("all"))


def combine_gold(rows: DataFrame) -> DataFrame:
    """Rows of the gold table joined to one per summary, with the time of the latest batch."""
    is_window = F.col("summary_level").startswith("window")
    stamps = rows.groupBy(
        "summary_level",
        "source_dataset",
        "type",
        F.when(is_window, F.col("window_start")).alias("window_start"),
        F.when(is_window, F.col("window_end")).alias("window_end"),
        "period",
    )
    weighted = F.sum(F.col("average_amount") * F.col("amount_count"))
    mean = F.try_divide(weighted, F.sum("amount_count"))
    sums = ("transaction_count", "amount_count", "high_amount_count", "zero_balance_count")
    latest = F.max("updated_at")
    merged = stamps.agg(
        *[F.sum(c).alias(c) for c in sums], F.when(is_window, F.lit(0.0)).otherwise(mean).alias("average_amount"),
        latest.alias("updated_at"),
    )
    times = {c: F.coalesce(F.col(c), F.col("updated_at")) for c in ("window_start", "window_end")}
    return merged.withColumns(times).select(*GOLD_COLUMNS, "period")


GOLD_COLUMNS = (
    "source_dataset",
    "type",
    "transaction_count",
    "average_amount",
    "amount_count",
    "high_amount_count",
    "zero_balance_count",
    "summary_level",
    "window_start",
    "window_end",
    "updated_at",
)


def scored_decisions(scored: DataFrame) -> DataFrame:
    """Scored events flattened to the decision table."""
    return scored.select(
        "event_id",
        "event_time",
        "source_dataset",
        "type",
        "amount",
        "prediction.fraud_probability",
        "prediction.risk_level",
        "prediction.rule_risk_score",
        "prediction.rule_risk_level",
        "prediction.final_decision",
        "prediction.triggered_rules",
        "prediction_log_id",
        "scored_at",
        F.current_timestamp().alias("ingestion_timestamp"),
    )


def decode_scored(messages: DataFrame, value: str = "value") -> DataFrame:
    """Scored messages to nested rows."""
    return messages.select(
        F.from_json(F.col(value).cast("string"), SCORED_EVENT).alias("r")
    ).select("r.*")
