"""Where tables live and which formats they use.

Formats are configuration: a deployment names ``kafka`` and ``delta`` here,
tests use file streams and parquet.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Lake layout and topic names.
LAYER_PATHS = {
    "bronze": ("bronze/transactions_raw", "raw_transactions"),
    "silver": ("silver/transactions_features", "curated_transactions"),
    "gold": ("gold/fraud_risk_summary",),
    "scored_gold": ("gold/scored_fraud_decisions",),
}
RAW_TOPIC = "transactions.raw"
SCORED_TOPIC = "transactions.scored"
ERRORS_TOPIC = "transactions.errors"


@dataclass(frozen=True)
class Channel:
    """A message source or sink: format, options and an optional path."""

    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    path: str | None = None

    @staticmethod
    def kafka_source(servers: str, topic: str) -> Channel:
        return Channel(
            "kafka",
            {
                "kafka.bootstrap.servers": servers,
                "subscribe": topic,
                "startingOffsets": "earliest",
            },
        )

    def with_rate(self, amount: int) -> Channel:
        """The source in micro-batches of ``amount`` offsets (Kafka) or files at most."""
        name = "maxOffsetsPerTrigger" if self.format == "kafka" else "maxFilesPerTrigger"
        return Channel(self.format, {**self.options, name: str(amount)}, self.path)

    def bounded(self, rows: int, size: int) -> Channel:
        """The source in micro-batches of so many offsets (Kafka) or bytes of files at most, unless it has a rate.

        A file larger than that is a micro-batch by itself.
        """
        has = {name.lower() for name in self.options}
        if self.format == "kafka":
            name, amount = "maxOffsetsPerTrigger", rows
        elif self.format in ("parquet", "orc", "json", "csv", "text", "delta"):
            name, amount = "maxBytesPerTrigger", size
        else:
            return self
        if has & {"maxoffsetspertrigger", "maxfilespertrigger", "maxbytespertrigger"}:
            return self
        return Channel(self.format, {**self.options, name: str(amount)}, self.path)

    @staticmethod
    def kafka_sink(servers: str, topic: str) -> Channel:
        return Channel("kafka", {"kafka.bootstrap.servers": servers, "topic": topic})


@dataclass(frozen=True)
class Lake:
    """Root of the table tree, with one checkpoint per streaming query."""

    root: str
    format: str = "parquet"

    def table(self, layer: str) -> str:
        return f"{self.root}/{LAYER_PATHS[layer][0]}"

    def candidates(self, layer: str) -> list[str]:
        return [f"{self.root}/{relative}" for relative in LAYER_PATHS[layer]]

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/_checkpoints/{query}"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    In local mode a folder below the warehouse takes its place.  On a cluster
    that may be the driver's own disk, so the setting is needed there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_txnloom"


def ensure_checkpointing(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: iterative training cuts its lineage there."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh, shared folder for one run of a job.

    Results may still read from it after the job has returned, so nothing here
    deletes it: the deployment empties ``spark.checkpoint.dir`` between runs.
    """
    return f"{shared_dir(spark)}/txnloom/{purpose}-{uuid.uuid4().hex}"
