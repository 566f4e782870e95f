"""Raw-to-lake, scoring and scored-to-gold streaming jobs.

Every query has its own checkpoint.  ``once`` runs a bounded job over what is
available (``availableNow``); because it shares the checkpoint with the
continuous mode, a second run continues instead of duplicating rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from txnloom.config import Channel, Lake
from txnloom.functions.casts import utc_now_text
from txnloom.functions.contracts import SCORED_CONTRACT
from txnloom.functions.rules import HIGH_VALUE_AMOUNT
from txnloom.operators import logs, medallion, scoring
from txnloom.operators.explain import explain
from txnloom.operators.quality import check_contract, split_triaged, triage
from txnloom.schemas import SCORED_EVENT
from txnloom.sources.readers import MESSAGE, stream_messages, stream_table
from txnloom.sources.writers import append_stream, merge_batch, prepare_table, publish, write_batch


# Seconds between two looks at the progress of a bounded run.
POLL = 2


@dataclass
class Layer:
    """A running query with the rows that its micro-batches reported.

    Counts come from metrics observed on the stream itself, batch by batch, so
    no table is read again for them.
    """

    name: str
    query: StreamingQuery
    metrics: dict[int, dict[str, int]] = field(default_factory=dict)
    dropped: dict[int, tuple[int, int]] = field(default_factory=dict)

    def look(self) -> None:
        """Take over what recent progress reports say; a repeated batch counts once."""
        for report in self.query.recentProgress:
            for name, row in report.observedMetrics.items():
                self.metrics.setdefault(report.batchId, {}).update(
                    {f"{name}.{k}" if name != self.name else k: v for k, v in row.asDict().items()}
                )
            for operator in report.stateOperators:
                if "dedupe" in operator.operatorName.lower():
                    repeats = operator.customMetrics.get("numDroppedDuplicateRows", 0)
                    self.dropped[report.batchId] = (operator.numRowsDroppedByWatermark, repeats)

    def finish(self) -> None:
        """Wait for a bounded run, looking often enough to miss no report."""
        while not self.query.awaitTermination(POLL):
            self.look()
        self.look()

    def total(self, metric: str = "rows") -> int:
        return sum(m.get(metric) or 0 for m in self.metrics.values())

    def late(self) -> int:
        """Rows that came after the watermark had passed them."""
        return sum(late for late, _ in self.dropped.values())

    def repeated(self) -> int:
        """Rows whose event had come before."""
        return sum(repeats for _, repeats in self.dropped.values())


def _observed(df: DataFrame, name: str, **more: Column) -> DataFrame:
    columns = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]]
    return df.observe(name, *columns)


def _bronze_layout(spark: SparkSession) -> T.StructType:
    return medallion.landing(medallion.decode(spark.createDataFrame([], MESSAGE))).schema


def _bronze_table(spark: SparkSession, lake: Lake) -> DataFrame:
    return stream_table(spark, lake.table("bronze"), _bronze_layout(spark), lake.format)


def _silver_table(spark: SparkSession, lake: Lake) -> DataFrame:
    events = medallion.landed_events(spark.createDataFrame([], _bronze_layout(spark)))
    return stream_table(spark, lake.table("silver"), medallion.silver(events).schema, lake.format)


def start_bronze(spark: SparkSession, source: Channel, lake: Lake, once: bool) -> Layer:
    """The only query that reads and decodes the channel."""
    landed = medallion.landing(medallion.decode(stream_messages(spark, source)))
    counted = _observed(landed, "bronze", diverted=F.count_if(F.col("diverted") == 1))
    query = append_stream(
        counted, lake.table("bronze"), lake.checkpoint("bronze"), lake.format, once=once, by=["diverted"]
    )
    return Layer("bronze", query)


def start_unreadable(spark: SparkSession, lake: Lake, once: bool) -> Layer:
    """Messages that are no events, from the bronze table to a table of their own."""
    rejects = _observed(medallion.landed_rejects(_bronze_table(spark, lake)), "unreadable")
    path = f"{lake.root}/bronze/unreadable"
    return Layer("unreadable", append_stream(rejects, path, lake.checkpoint("unreadable"), lake.format, once=once))


def each_once(events: DataFrame, horizon: str) -> DataFrame:
    """A stream of events without those that came before, by id or content.

    An event is remembered for ``horizon`` after it was ingested, so the state
    is bounded; ingestion only moves forward, so that no event is late here.
    """
    keyed = events.withColumn("_event", medallion.event_key()).withWatermark("ingestion_timestamp", horizon)
    return keyed.dropDuplicatesWithinWatermark(["_event"]).drop("_event")


def start_silver(spark: SparkSession, lake: Lake, once: bool, unique_within: str | None = None) -> Layer:
    """Events of the bronze table with their features.

    Channels that repeat messages (a producer that sends again, a replay) need
    ``unique_within``, the time for which an event id is remembered.
    """
    events = medallion.landed_events(_bronze_table(spark, lake))
    if unique_within:
        events = each_once(events, unique_within)
    rows = _observed(medallion.silver(events), "silver")
    return Layer("silver", append_stream(rows, lake.table("silver"), lake.checkpoint("silver"), lake.format, once=once))


GOLD_KEYS = ("summary_level", "source_dataset", "type", "window_start")


def gold_batch_writer(lake: Lake, counts: dict[int, dict[str, int]] | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of the gold summaries.

    The summaries of a batch take one pass over it (see ``medallion.gold``) and
    are merged by key, so a window that recurs in later batches stays one row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = medallion.gold_period(medallion.gold(batch))
        rows = merge_batch(fresh, lake.table("gold"), batch_id, GOLD_KEYS, medallion.combine_gold, "period", lake.format)
        if counts is not None:
            counts[batch_id] = {"rows": rows}

    return write


def _start_batches(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_gold(spark: SparkSession, lake: Lake, once: bool) -> Layer:
    """Summaries of the silver table; the layer's rows are the summaries merged in."""
    counts: dict[int, dict[str, int]] = {}
    write = gold_batch_writer(lake, counts)
    query = _start_batches(_silver_table(spark, lake), write, lake.checkpoint("gold"), once)
    return Layer("gold", query, counts)


@dataclass(frozen=True)
class LakeRun:
    """Layers of a run; ``rows`` of a bounded one are those that it wrote."""

    layers: dict[str, Layer]

    @property
    def rows(self) -> dict[str, int]:
        found = {name: layer.total() for name, layer in self.layers.items()}
        if "bronze" in found:
            found["bronze"] -= self.layers["bronze"].total("diverted")
        return found


def run_raw_to_lake(
    spark: SparkSession, source: Channel, lake: Lake, *, once: bool = False, unique_within: str | None = None
) -> LakeRun:
    """Channel to bronze, bronze to silver and the diverted messages, silver to gold.

    Every layer is a query with its own checkpoint that reads the table of the
    layer before, so the channel is read and decoded once.  A bounded run
    finishes one layer before it starts the next; a continuous one starts all
    and returns when any of them stops.
    """
    prepare_table(spark, lake.table("bronze"), _bronze_layout(spark), lake.format, ["diverted"])
    events = medallion.landed_events(spark.createDataFrame([], _bronze_layout(spark)))
    prepare_table(spark, lake.table("silver"), medallion.silver(events).schema, lake.format)
    steps = (
        (lambda: start_bronze(spark, source, lake, once),),
        (lambda: start_unreadable(spark, lake, once), lambda: start_silver(spark, lake, once, unique_within)),
        (lambda: start_gold(spark, lake, once),),
    )
    layers: dict[str, Layer] = {}
    for starters in steps:
        started = [start() for start in starters]
        layers |= {layer.name: layer for layer in started}
        if once:
            for layer in started:
                layer.finish()
    if not once:
        spark.streams.awaitAnyTermination()
        for layer in layers.values():
            layer.look()
            layer.query.stop()
    return LakeRun(layers)


def on_time(silver_rows: DataFrame) -> DataFrame:
    """Each event once, if it comes before the watermark has passed it.

    Late and repeated rows are dropped by the state store operator, which counts
    both, so that read = kept + late + repeated + rows without a time.
    """
    timed = _observed(silver_rows, "read", untimed=F.count_if(F.col("event_timestamp").isNull()))
    timed = timed.filter(F.col("event_timestamp").isNotNull()).withColumn("_event", medallion.event_key())
    unique = timed.withWatermark("event_timestamp", medallion.LATENESS).dropDuplicatesWithinWatermark(["_event"])
    return _observed(unique.drop("_event"), "kept")


def windowed_measures(silver_rows: DataFrame) -> DataFrame:
    """Measures per ten-minute window, source and type on a stream.

    The watermark bounds the state: a window is emitted once, after it can get
    no more rows; rows later than one hour are dropped and counted (``on_time``).
    """
    return (
        on_time(silver_rows)
        .groupBy(
            F.window("event_timestamp", medallion.WINDOW).alias("w"), "source_dataset", "type"
        )
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("amount").alias("total_amount"),
            F.count_if(F.col("amount") >= HIGH_VALUE_AMOUNT).alias("high_amount_count"),
            F.count_if(F.col("is_zero_balance_after_txn") == 1).alias("zero_balance_count"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "source_dataset",
            "type",
            "transaction_count",
            "total_amount",
            "high_amount_count",
            "zero_balance_count",
        )
    )


def start_windows(spark: SparkSession, lake: Lake, once: bool) -> Layer:
    """Measures of the silver table; the layer also knows what came late."""
    query = append_stream(
        windowed_measures(_silver_table(spark, lake)),
        f"{lake.root}/gold/window_measures",
        lake.checkpoint("window_measures"),
        lake.format,
        once=once,
    )
    return Layer("windows", query)


# Tasks of a scored micro-batch for every partition of its source.
SPREAD = 4
# Messages, and bytes of files of messages, that a micro-batch has at most for each core.
ROWS_A_CORE = 100_000
BYTES_A_CORE = 8 << 20


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch in even parts, read once.

    A split of a file has as many rows as the row groups that begin in it, often
    none or nearly all, and a text takes far less work to read than to check and
    score.  All cores get rows; beyond that the tasks grow with the source.
    """
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(max(cores, SPREAD * batch.rdd.getNumPartitions()))


def score_batch_writer(
    model: PipelineModel, scored_sink: Channel, errors_sink: Channel, lake: Lake
) -> Callable[[DataFrame, int], None]:
    """Micro-batch scoring: one bad record never stops the stream.

    The batch is kept while its two halves are written: scored events to the
    channel, the log and the audit table, rejected ones to the dead letters and
    the error channel.  File outputs are replaced when a batch is repeated.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        triaged = triage(dealt(batch), allowed=scoring.known_types(model)).persist()
        good, bad = split_triaged(triaged)
        scored = explain(scoring.score(good, model), model)
        checked = check_scored(scored.withColumn("scored_at", utc_now_text())).persist()
        sound = checked.filter(F.col("reject_reason").isNull())
        unsound = checked.filter(F.col("reject_reason").isNotNull())
        rejected = bad.select(*REJECTED).unionByName(unsound.select(*REJECTED))
        sent = sound.select(
            F.coalesce("event_id", F.lit("unknown")).alias("key"), F.col("raw_event").alias("value")
        )

        def log(rows: DataFrame, name: str) -> None:
            write_batch(rows, f"{lake.root}/logs/{name}", batch_id, lake.format)

        try:
            _publish_batch(sent, scored_sink, batch_id)
            log(logs.scored_log(scoring.scored_event(sound, F.col("scored_at"))), "scored")
            log(logs.audit_rows(sound), "audit")
            _publish_batch(logs.error_messages(rejected), errors_sink, batch_id)
            log(logs.dead_letters(rejected), "dead_letters")
        finally:
            checked.unpersist()
            triaged.unpersist()

    return write


REJECTED = ("event_id", "source_dataset", "raw_event", "reject_reason")


def check_scored(scored: DataFrame) -> DataFrame:
    """Add the scored event as JSON (``raw_event``) and its contract error
    (``reject_reason``), both computed once for all outputs."""
    event = scoring.scored_event(scored, F.col("scored_at")).columns
    packed = scored.withColumn("prediction", scoring.as_prediction())
    members = [F.col(c) for c in event if c in packed.columns]
    texts = packed.withColumn("raw_event", F.to_json(F.struct(*members))).drop("prediction")
    checked = check_contract(texts, SCORED_CONTRACT, "raw_event", SCORED_EVENT)
    return checked.withColumnRenamed("contract_error", "reject_reason")


def _publish_batch(messages: DataFrame, channel: Channel, batch_id: int) -> None:
    if channel.format == "kafka":
        publish(messages, channel)
    else:
        write_batch(messages, channel.path, batch_id, channel.format)


def start_scoring(
    spark: SparkSession,
    source: Channel,
    model: PipelineModel,
    scored_sink: Channel,
    errors_sink: Channel,
    lake: Lake,
    once: bool,
) -> StreamingQuery:
    """Score a channel.  A micro-batch is kept while it is written, so its size is
    bounded by the cores, or by ``Channel.with_rate``; nothing is left out, it
    comes in a later one."""
    write = score_batch_writer(model, scored_sink, errors_sink, lake)
    cores = spark.sparkContext.defaultParallelism
    source = source.bounded(ROWS_A_CORE * cores, BYTES_A_CORE * cores)
    return _start_batches(stream_messages(spark, source), write, lake.checkpoint("scoring"), once)


def start_scored_to_gold(
    spark: SparkSession, source: Channel, lake: Lake, once: bool
) -> StreamingQuery:
    """Scored channel to the decision table."""
    decisions = medallion.scored_decisions(
        medallion.decode_scored(stream_messages(spark, source))
    )
    return append_stream(
        decisions,
        lake.table("scored_gold"),
        lake.checkpoint("scored_gold"),
        lake.format,
        once=once,
    )
