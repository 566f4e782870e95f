"""Batch and streaming sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.config import Channel
from txnloom.functions.casts import number
from txnloom.operators.normalize import join_identity, normalize_ieee, normalize_paysim
from txnloom.schemas import IEEE_FILE, PAYSIM_FILE, REQUEST_LOG

# What a message channel delivers; Kafka adds more columns.
MESSAGE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)


def read_csv(spark: SparkSession, path: str, layout: T.StructType | None = None) -> DataFrame:
    """A CSV file by header names, all columns as text.

    Without schema inference Spark reads only the header line up front.  With a
    layout, known columns are cast (unusable values become NULL) and columns the
    file lacks are left out; the scan parses only selected columns.
    """
    raw = spark.read.option("header", True).csv(path)
    if layout is None:
        return raw
    columns = []
    for f in layout.fields:
        if f.name not in raw.columns:
            continue
        text = isinstance(f.dataType, T.StringType)
        columns.append((F.col(f.name) if text else number(raw, f.name)).alias(f.name))
    return raw.select(*columns)


def load_paysim(spark: SparkSession, path: str) -> DataFrame:
    """PaySim file as canonical events."""
    return normalize_paysim(read_csv(spark, path, PAYSIM_FILE))


def load_ieee(
    spark: SparkSession,
    transactions: str,
    identity: str | None = None,
) -> DataFrame:
    """IEEE-CIS files as canonical events; the identity file is optional."""
    rows = read_csv(spark, transactions, IEEE_FILE)
    if identity is not None:
        try:
            rows = join_identity(rows, read_csv(spark, identity).select("TransactionID"))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return normalize_ieee(rows)


def load_transactions(
    spark: SparkSession,
    dataset: str,
    paths: Sequence[str],
) -> DataFrame:
    """Canonical events of a named dataset: ``paysim`` or ``ieee``."""
    name = dataset.strip().lower()
    if name == "paysim":
        return load_paysim(spark, paths[0])
    if name == "ieee":
        return load_ieee(spark, *paths[:2])
    raise ValueError(f"no reader for dataset {dataset!r}; there are readers for paysim and ieee files")


def load_training(spark: SparkSession, path: str) -> DataFrame:
    """PaySim training file with typed columns and a stable event id."""
    return load_paysim(spark, path)


def read_messages(spark: SparkSession, channel: Channel) -> DataFrame:
    """Everything a channel holds now, as a bounded frame."""
    options = dict(channel.options)
    if channel.format == "kafka":
        options["endingOffsets"] = "latest"
        return spark.read.format("kafka").options(**options).load()
    return spark.read.format(channel.format).schema(MESSAGE).options(**options).load(channel.path)


def stream_messages(spark: SparkSession, channel: Channel) -> DataFrame:
    """A channel as a stream.  Positions live in each query's checkpoint."""
    reader = spark.readStream.format(channel.format).options(**channel.options)
    if channel.format == "kafka":
        return reader.load()
    return reader.schema(MESSAGE).load(channel.path)


def stream_table(spark: SparkSession, path: str, layout: T.StructType, table_format: str = "parquet") -> DataFrame:
    """A table that another stream appends to, as a stream.

    For files the log of the writing sink says which of them are complete, so
    every row arrives once.
    """
    reader = spark.readStream.format(table_format)
    if table_format != "delta":
        reader = reader.schema(layout)
    return reader.load(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Request log of JSON lines; the timestamp is parsed, bad ones are NULL."""
    rows = spark.read.schema(REQUEST_LOG).json(path)
    return rows.withColumn("timestamp", F.try_to_timestamp("timestamp"))


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Precondition of a job: stop when the dataset has no rows."""
    if df.isEmpty():
        raise ValueError(f"dataset is empty: {name}")
    return df
