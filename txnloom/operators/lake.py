"""Inventory of the lake: tables, counts and commit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.config import LAYER_PATHS, Lake
from txnloom.operators import medallion

# Conditions Spark reports for a path without a readable table.
_NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "DELTA_TABLE_NOT_FOUND")


def read_table(spark: SparkSession, path: str, table_format: str = "parquet") -> DataFrame | None:
    """The table at a path, or None when there is none yet."""
    try:
        return spark.read.format(table_format).load(path)
    except AnalysisException as missing:
        if missing.getCondition() in _NO_TABLE:
            return None
        raise


def resolve_table(spark: SparkSession, lake: Lake, layer: str) -> tuple[str, DataFrame | None]:
    """First candidate location that holds a table, else the first candidate.

    Of a bronze table that also holds diverted messages only the events count.
    """
    for path in lake.candidates(layer):
        table = read_table(spark, path, lake.format)
        if table is not None:
            return path, medallion.landed_events(table) if "diverted" in table.columns else table
    return lake.candidates(layer)[0], None


def table_profile(table: DataFrame) -> DataFrame:
    """Columns of a table with types and the row count, one row per column."""
    layout = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for position, f in enumerate(table.schema.fields)
        ]
    )
    return (
        table.agg(F.count("*").alias("row_count"))
        .select(F.explode(layout).alias("c"), "row_count")
        .select("c.*", "row_count")
    )


def preview(table: DataFrame, rows: int = 10) -> DataFrame:
    return table.limit(rows)


def layer_status(spark: SparkSession, lake: Lake) -> DataFrame:
    """Per layer: path, whether it exists, rows and newest ingestion time.

    A count without columns is answered from the parquet footers; only layers
    with an ingestion time read that one column.
    """
    parts = []
    for layer in LAYER_PATHS:
        path, table = resolve_table(spark, lake, layer)
        if table is None:
            counted = spark.range(1).select(
                F.lit(0).cast("bigint").alias("row_count"),
                F.lit(None).cast("timestamp").alias("latest_ingestion"),
            )
        else:
            stamps = [c for c in ("ingestion_timestamp", "updated_at") if c in table.columns]
            newest = F.max(stamps[0]) if stamps else F.lit(None)
            counted = table.agg(
                F.count("*").alias("row_count"),
                newest.cast("timestamp").alias("latest_ingestion"),
            )
        parts.append(
            counted.select(
                F.lit(layer).alias("layer"),
                F.lit(path).alias("path"),
                F.lit(table is not None).alias("table_exists"),
                "row_count",
                "latest_ingestion",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def lake_summary(spark: SparkSession, lake: Lake) -> DataFrame:
    """One row: the four layer counts, availability and newest ingestion."""
    status = layer_status(spark, lake)
    counts = [
        F.coalesce(F.sum(F.when(F.col("layer") == layer, F.col("row_count"))), F.lit(0)).alias(
            f"{layer}_count"
        )
        for layer in LAYER_PATHS
    ]
    return status.agg(
        *counts,
        F.bool_or("table_exists").alias("available"),
        F.max("latest_ingestion").alias("latest_ingestion"),
    )


def as_json(summary: DataFrame) -> DataFrame:
    """The summary row as one JSON document; a time that is not known is null."""
    return summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def as_text(summary: DataFrame) -> DataFrame:
    """The summary row as lines (position, line) for people to read."""
    counts = [
        F.concat(F.lit(f"{layer.replace('_', ' ')}: "), F.col(f"{layer}_count").cast("string"), F.lit(" rows"))
        for layer in LAYER_PATHS
    ]
    stamp = F.coalesce(F.col("latest_ingestion").cast("string"), F.lit("none yet"))
    found = F.when(F.col("available"), F.lit("tables found")).otherwise(F.lit("no tables found"))
    lines = F.array(found, *counts, F.concat(F.lit("latest ingestion: "), stamp))
    return summary.select(F.posexplode(lines).alias("position", "line"))
