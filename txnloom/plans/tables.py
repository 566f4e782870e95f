"""Queries over the lake: gold summaries, streaming jobs and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.config import Channel, Lake, new_workspace
from txnloom.operators import lake as lake_ops
from txnloom.operators import logs, medallion
from txnloom.plans.catalog import query
from txnloom.plans.fixtures import raw_messages, table
from txnloom.plans.inputs import (
    raw_channel,
    scored_events,
    silver_events,
    silver_rows,
)
from txnloom.plans.oracle import (
    over_decisions,
    over_events,
    over_features,
    over_messages,
)
from txnloom.sources.readers import read_messages
from txnloom.sources.writers import append, publish
from txnloom.streaming import pipelines

_BY_TYPE = """
    SELECT source_dataset, type, count(*) AS transaction_count, round(avg(amount), 2)
            AS average_amount, count(amount) AS amount_count,
        count(*) FILTER (amount >= 200000) AS high_amount_count,
        count(*) FILTER (is_zero_balance_after_txn = 1) AS zero_balance_count,
        'source_dataset_type' AS summary_level
    FROM {rows} GROUP BY source_dataset, type
"""
_BY_WINDOW = """
    SELECT source_dataset, type, count(*) AS transaction_count, 0.0::DOUBLE AS average_amount,
        0::BIGINT AS amount_count, 0::BIGINT AS high_amount_count, 0::BIGINT AS zero_balance_count,
        'window_type' AS summary_level,
        time_bucket(INTERVAL 10 MINUTE, event_timestamp) AS window_start,
        time_bucket(INTERVAL 10 MINUTE, event_timestamp) + INTERVAL 10 MINUTE AS window_end
    FROM {rows} GROUP BY ALL
"""


def _gold_sql(rows: str) -> str:
    return (
        f"SELECT *, NULL::TIMESTAMP AS window_start, NULL::TIMESTAMP AS window_end "
        f"FROM ({_BY_TYPE.format(rows=rows)}) UNION ALL BY NAME {_BY_WINDOW.format(rows=rows)}"
    )


def _rounded(gold: DataFrame) -> DataFrame:
    return gold.withColumn("average_amount", F.round("average_amount", 2))


def _without_batch_time(gold: DataFrame) -> DataFrame:
    """Per-type rows carry the run time as bounds; leave that out."""
    windowed = F.col("summary_level").startswith("window")
    return gold.withColumns(
        {c: F.when(windowed, F.col(c)) for c in ("window_start", "window_end")}
    )


@query("gold_by_type", over_features(_BY_TYPE.format(rows="feat")))
def gold_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = medallion.gold_by_type(silver_rows(spark, sf_dir))
    return _rounded(gold).drop("window_start", "window_end")


@query("gold_by_window", over_events(_BY_WINDOW.format(rows="evf")))
def gold_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.gold_by_window(silver_events(spark, sf_dir))


@query("gold_batch", over_events(_gold_sql("evf")))
def gold_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = medallion.gold(silver_events(spark, sf_dir)).drop("updated_at")
    return _rounded(_without_batch_time(gold))


_FROM_BRONZE = (
    "flagged AS (SELECT *, CAST(CASE WHEN newbalanceOrig = 0 THEN 1 ELSE 0 END AS INTEGER) "
    "AS is_zero_balance_after_txn FROM bronze)"
)


@query("gold_merged", over_messages(_gold_sql("flagged"), _FROM_BRONZE))
def gold_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel is delivered in two parts and the job runs after each, so
    windows and types recur in two batches that the gold table merges."""
    channel = Channel("parquet", path=f"{new_workspace(spark, 'gold_merged')}/raw")
    lake = Lake(channel.path.removesuffix("/raw"))
    messages = raw_messages(spark, sf_dir)
    late = F.crc32("key") % 2 == 1
    for part in (messages.filter(~late), messages.filter(late)):
        publish(part, channel)
        pipelines.run_raw_to_lake(spark, channel, lake, once=True)
    rows = spark.read.format(lake.format).load(lake.table("gold"))
    return _rounded(_without_batch_time(rows.drop("updated_at", "batches", "period")))


@query("stream_bronze", over_messages("SELECT * FROM bronze"))
def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel, root = raw_channel(spark, sf_dir, "stream_bronze")
    lake = Lake(root)
    pipelines.start_bronze(spark, channel, lake, once=True).finish()
    return lake_ops.resolve_table(spark, lake, "bronze")[1].drop("ingestion_timestamp")


_SILVER_SQL = """
    SELECT event_id, event_time, source_dataset, step, type, amount, oldbalanceOrg,
        newbalanceOrig, oldbalanceDest, newbalanceDest, isFlaggedFraud, isFraud,
        oldbalanceOrg - newbalanceOrig AS balance_diff_orig,
        newbalanceDest - oldbalanceDest AS balance_diff_dest,
        amount / (oldbalanceOrg + 1.0::DOUBLE) AS amount_to_oldbalance_ratio,
        (newbalanceOrig = 0)::INTEGER AS is_zero_balance_after_txn,
        coalesce((abs((oldbalanceOrg - amount) - newbalanceOrig) > 1)::INTEGER, 0)
            AS sender_balance_mismatch,
        coalesce((abs((oldbalanceDest + amount) - newbalanceDest) > 1)::INTEGER, 0)
            AS receiver_balance_mismatch,
        event_timestamp
    FROM bronze
"""


@query("stream_silver", over_messages(_SILVER_SQL))
def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel, root = raw_channel(spark, sf_dir, "stream_silver")
    lake = Lake(root)
    pipelines.start_bronze(spark, channel, lake, once=True).finish()
    pipelines.start_silver(spark, lake, once=True).finish()
    return spark.read.format(lake.format).load(lake.table("silver")).drop("ingestion_timestamp")


@query("stream_unique", over_messages(_SILVER_SQL))
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer sends half of its messages again, in the same delivery or
    after a restart of the job; every event arrives in silver once."""
    root = new_workspace(spark, "stream_unique")
    channel, lake = Channel("parquet", path=f"{root}/raw"), Lake(root)
    messages = raw_messages(spark, sf_dir)
    again = messages.filter(F.crc32("key") % 2 == 1)
    for part in (messages.unionAll(again.filter(F.crc32("key") % 3 == 1)), again):
        publish(part, channel)
        pipelines.start_bronze(spark, channel, lake, once=True).finish()
        pipelines.start_silver(spark, lake, once=True, unique_within="1 day").finish()
    return spark.read.format(lake.format).load(lake.table("silver")).drop("ingestion_timestamp")


@query(
    "layer_counts",
    over_messages(
        f"""
        SELECT 'bronze' AS layer, count(*) AS rows_written FROM bronze
        UNION ALL SELECT 'unreadable', count(*) FROM msg WHERE no_event
        UNION ALL SELECT 'silver', count(*) FROM bronze
        UNION ALL SELECT 'gold', count(*) FROM ({_gold_sql("flagged")})
        """,
        _FROM_BRONZE,
    ),
)
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a bounded run reports for its layers, without reading them again."""
    channel, root = raw_channel(spark, sf_dir, "layer_counts")
    run = pipelines.run_raw_to_lake(spark, channel, Lake(root), once=True)
    return spark.createDataFrame(sorted(run.rows.items()), "layer string, rows_written long")


@query(
    "stream_windows",
    over_messages(
        """
        SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end,
            source_dataset, type, count(*) AS transaction_count,
            round(sum(amount), 2) AS total_amount,
            count(*) FILTER (amount >= 200000) AS high_amount_count,
            count(*) FILTER (is_zero_balance_after_txn = 1) AS zero_balance_count
        FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, event_timestamp) AS window_start
            FROM flagged)
        WHERE window_start + INTERVAL 10 MINUTE
            <= (SELECT max(event_timestamp) FROM flagged) - INTERVAL 1 HOUR
        GROUP BY window_start, source_dataset, type
        """,
        _FROM_BRONZE,
    ),
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel, root = raw_channel(spark, sf_dir, "stream_windows")
    lake = Lake(root)
    pipelines.start_bronze(spark, channel, lake, once=True).finish()
    pipelines.start_silver(spark, lake, once=True).finish()
    pipelines.start_windows(spark, lake, once=True).finish()
    emitted = spark.read.format(lake.format).load(f"{lake.root}/gold/window_measures")
    return emitted.withColumn("total_amount", F.round("total_amount", 2))


@query(
    "stream_late",
    over_messages(
        """
        SELECT outcome, count(*) AS row_count FROM (
            SELECT CASE WHEN event_timestamp IS NULL THEN 'untimed'
                WHEN event_id::BIGINT % 7 = 3 AND event_timestamp <= (SELECT max(event_timestamp) FROM bronze
                    WHERE event_id::BIGINT % 7 <> 3) - INTERVAL 1 HOUR THEN 'late'
                ELSE 'kept' END AS outcome
            FROM bronze)
        GROUP BY outcome
        """
    ),
)
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the events of a channel whose last delivery comes late."""
    root = new_workspace(spark, "stream_late")
    channel, lake = Channel("parquet", path=f"{root}/raw"), Lake(root)
    messages = raw_messages(spark, sf_dir)
    late = F.col("key").cast("bigint") % 7 == 3
    found: dict[str, int] = {}
    for part in (messages.filter(~late), messages.filter(late)):
        publish(part, channel)
        pipelines.start_bronze(spark, channel, lake, once=True).finish()
        pipelines.start_silver(spark, lake, once=True).finish()
        windows = pipelines.start_windows(spark, lake, once=True)
        windows.finish()
        outcomes = {"kept": windows.total("kept.rows"), "late": windows.late(), "untimed": windows.total("read.untimed")}
        found = {k: found.get(k, 0) + n for k, n in outcomes.items()}
    return spark.createDataFrame([(k, n) for k, n in found.items() if n], "outcome string, row_count long")


@query(
    "scored_decisions",
    over_decisions(
        """
        SELECT event_id, event_time, source_dataset, type, amount, fraud_probability, risk_level,
            rule_risk_score, rule_risk_level, final_decision, triggered_rules,
            NULL::INTEGER AS prediction_log_id, event_time AS scored_at
        FROM dec
        """
    ),
)
def scored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_workspace(spark, "scored_decisions")
    lake, channel = Lake(root), Channel("parquet", path=f"{root}/scored")
    publish(logs.messages(scored_events(spark, sf_dir)), channel)
    pipelines.start_scored_to_gold(spark, channel, lake, once=True).awaitTermination()
    rows = spark.read.format(lake.format).load(lake.table("scored_gold"))
    return rows.drop("ingestion_timestamp").withColumn(
        "triggered_rules", F.array_join("triggered_rules", " | ")
    )


@query(
    "table_profile",
    """
    SELECT c.position, c.column_name, c.data_type, n.row_count
    FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'),
        (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
        (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'))
        AS c(position, column_name, data_type),
        (SELECT count(*) AS row_count FROM orders) AS n
    """,
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake_ops.table_profile(table(spark, sf_dir, "orders"))


_LAKE_COUNTS = f"""
    SELECT (SELECT count(*) FROM bronze) AS bronze_count,
        (SELECT count(*) FROM bronze) AS silver_count,
        (SELECT count(*) FROM ({_gold_sql("flagged")})) AS gold_count,
        (SELECT count(*) FROM orders) AS scored_gold_count,
        TRUE AS available
"""


def _filled_lake(spark: SparkSession, sf_dir: str, purpose: str) -> Lake:
    lake = Lake(new_workspace(spark, purpose))
    bronze = medallion.readable(medallion.decode(raw_messages(spark, sf_dir)))
    append(bronze, lake.table("bronze"))
    stored = spark.read.parquet(lake.table("bronze"))
    append(medallion.silver(stored), lake.table("silver"))
    append(medallion.gold(spark.read.parquet(lake.table("silver"))), lake.table("gold"))
    append(medallion.scored_decisions(scored_events(spark, sf_dir)), lake.table("scored_gold"))
    return lake


@query("lake_summary", over_messages(_LAKE_COUNTS, _FROM_BRONZE))
def lake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake_ops.lake_summary(spark, _filled_lake(spark, sf_dir, "lake_summary")).drop("latest_ingestion")


@query(
    "lake_document",
    over_messages(
        f"""
        SELECT concat('{{"bronze_count":', bronze_count, ',"silver_count":', silver_count, ',"gold_count":', gold_count,
            ',"scored_gold_count":', scored_gold_count, ',"available":true}}') AS document
        FROM ({_LAKE_COUNTS})
        """,
        _FROM_BRONZE,
    ),
)
def lake_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake summary as JSON, without the time of the run."""
    summary = lake_ops.lake_summary(spark, _filled_lake(spark, sf_dir, "lake_document"))
    return lake_ops.as_json(summary.drop("latest_ingestion"))


@query(
    "raw_replay",
    over_messages(
        "SELECT no_event AS is_malformed, count(*) AS messages FROM msg GROUP BY no_event"
    ),
)
def raw_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded read of a whole channel."""
    channel, _ = raw_channel(spark, sf_dir, "raw_replay")
    decoded = medallion.decode(read_messages(spark, channel))
    return decoded.groupBy("is_malformed").agg(F.count("*").alias("messages"))


@query(
    "commit_log_counts",
    """
    SELECT count(*) AS live_records, count(DISTINCT CAST(l_shipdate AS DATE)) AS days
    FROM lineitem
    """,
)
def commit_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table appended by ship date, as its format counts them."""
    lake = Lake(new_workspace(spark, "commit_log_counts"))
    rows = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_orderkey")
    path = f"{lake.root}/lines"
    append(rows.filter("dayofmonth(day) <= 15"), path, lake.format)
    append(rows.filter("dayofmonth(day) > 15"), path, lake.format)
    written = spark.read.format(lake.format).load(path)
    return written.agg(F.count("*").alias("live_records"), F.count_distinct("day").alias("days"))
