"""Sinks: tables, message channels, CSV exports and JSON reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from txnloom.config import Channel, new_workspace


def append(
    df: DataFrame, path: str, table_format: str = "parquet", by: Sequence[str] = ()
) -> None:
    """Add rows to a table or log; earlier files are never rewritten."""
    writer = df.write.format(table_format).mode("append")
    (writer.partitionBy(*by) if by else writer).save(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch space and read it back, so that it is computed once."""
    spark = df.sparkSession
    path = new_workspace(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def streaming_query_id(spark: SparkSession) -> str:
    """Id of the streaming query whose micro-batch runs; it lives as long as its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def write_batch(df: DataFrame, path: str, batch_id: int, table_format: str = "parquet") -> None:
    """Write one micro-batch so that a repeated batch replaces itself.

    Batch numbers start again with every new checkpoint, so the query's id is
    part of the key.  Delta keeps one table and skips a transaction it has
    (``txnAppId``, ``txnVersion``); for plain files the batch owns the folder
    ``query=<id>/batch_id=<n>``, which a replay overwrites.  Partition discovery
    reads both columns from the path; ``compact_batches`` joins old folders.
    ``df`` is evaluated once: whether it was empty is read from the footers of
    what was written, and the folder of an empty batch goes again.
    """
    spark = df.sparkSession
    query = streaming_query_id(spark)
    if table_format == "delta":
        once = {"txnAppId": f"{query}:{path}", "txnVersion": str(batch_id)}
        df.write.format("delta").mode("append").options(**once).save(path)
        return
    target = f"{path}/query={query}/batch_id={batch_id}"
    df.write.format(table_format).mode("overwrite").save(target)
    if not spark.read.format(table_format).schema(df.schema).load(target).count():
        remove_folder(spark, target)


def _hadoop_path(spark: SparkSession, path: str, act: Callable) -> None:
    """Do something with a folder on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    _hadoop_path(spark, path, lambda system, folder: system.delete(folder, True))


def prepare_table(
    spark: SparkSession, path: str, layout: T.StructType, table_format: str = "parquet", by: Sequence[str] = ()
) -> None:
    """Make a table that a stream can be read from before its first row is written.

    A folder is enough for files: the sink's log decides later which of them
    count.  Other formats get an empty table.
    """
    if table_format in ("parquet", "orc", "json", "csv"):
        _hadoop_path(spark, path, lambda system, folder: system.mkdirs(folder))
        return
    try:
        spark.read.format(table_format).load(path)
    except AnalysisException:
        append(spark.createDataFrame([], layout), path, table_format, by)


def merge_batch(
    fresh: DataFrame,
    path: str,
    batch_id: int,
    keys: Sequence[str],
    combine: Callable[[DataFrame], DataFrame],
    by: str,
    table_format: str = "parquet",
) -> int:
    """Merge the rows of one micro-batch into a table by key; returns the rows merged in.

    ``combine`` maps old and new rows to one row per key, which lies in one
    partition ``by``.  Only partitions that the batch has rows for are read and
    replaced.  Column ``batches`` (query id to last batch) tells of every
    partition what it holds, so a repeated batch changes those only that it had
    not reached.  One query may write at a time.  Delta merges in one
    transaction; plain files replace partitions one after the other, so readers
    may see a batch in some partitions first.
    """
    spark = fresh.sparkSession
    query = streaming_query_id(spark)
    fresh = written(fresh, "merge")
    rows = fresh.count()
    if not rows:
        return 0
    marks = "map<string,bigint>"
    try:
        old = spark.read.format(table_format).load(path)
    except AnalysisException:
        old = fresh.limit(0).withColumn("batches", F.lit(None).cast(marks))
    touched = fresh.select(by).distinct()
    old = old.join(touched, by, "left_semi")
    held = old.groupBy(by).agg(F.first("batches").alias("batches"))
    before = F.coalesce("batches", F.create_map().cast(marks))
    reached = F.coalesce(F.element_at(before, F.lit(query)), F.lit(-1)) >= batch_id
    others = F.map_filter(before, lambda q, _: q != F.lit(query))
    states = touched.join(held, by, "left").filter(~reached)
    states = states.select(by, F.map_concat(others, F.create_map(F.lit(query), F.lit(batch_id).cast("bigint"))).alias("batches"))
    both = old.drop("batches").unionByName(fresh.select(old.drop("batches").columns))
    merged = combine(both.join(states.select(by), by, "left_semi")).join(states, by)
    if table_format == "delta":
        merged.createOrReplaceTempView("_txnloom_merge")
        prepare_table(spark, path, merged.schema, table_format, [by])
        same = " AND ".join(f"t.`{k}` <=> s.`{k}`" for k in keys)
        merged.sparkSession.sql(
            f"MERGE INTO delta.`{path}` t USING _txnloom_merge s ON {same} AND t.`{by}` = s.`{by}` "
            "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
        )
    else:
        dynamic = merged.write.format(table_format).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dynamic.partitionBy(by).save(path)
    return rows


def compact_batches(
    spark: SparkSession, path: str, target: str, table_format: str = "parquet", files: int = 1
) -> None:
    """Copy all batch folders below ``path`` into one table of few files.

    Run it on a stopped or archived sink and read ``target`` afterwards; the
    folders stay until the deployment removes them.
    """
    rows = spark.read.format(table_format).load(path)
    rows.repartition(files).write.format(table_format).mode("overwrite").save(target)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a CSV log folder."""
    df.write.mode("append").option("header", True).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, *paths: str) -> None:
    """Write a one-row report document as JSON to each location."""
    for path in paths:
        report.coalesce(1).write.mode("overwrite").json(path)


# Messages of a channel's file: its streams take whole files.
ROWS_A_FILE = 100_000


def publish(messages: DataFrame, channel: Channel) -> None:
    """Send (key, value) messages to a channel."""
    writer = messages.write.format(channel.format)
    if channel.format == "kafka":
        writer.options(**channel.options).save()
    else:
        options = {"maxRecordsPerFile": str(ROWS_A_FILE), **channel.options}
        writer.options(**options).mode("append").save(channel.path)


def append_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    table_format: str = "parquet",
    *,
    once: bool = False,
    name: str | None = None,
    by: Sequence[str] = (),
) -> StreamingQuery:
    """Append a stream to a table; ``once`` takes what is there and ends."""
    writer = (
        df.writeStream.format(table_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if name:
        writer = writer.queryName(name)
    if by:
        writer = writer.partitionBy(*by)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
