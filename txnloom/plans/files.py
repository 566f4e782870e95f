"""Queries that write files from the driver tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.config import new_workspace
from txnloom.operators import logs, quality, scoring
from txnloom.operators.explain import explain
from txnloom.plans.catalog import ENTRIES, query
from txnloom.plans.fixtures import request_log, table, transactions
from txnloom.plans.inputs import decided
from txnloom.plans.models import _forest
from txnloom.plans.oracle import over_decisions, over_requests, over_txn
from txnloom.sources import readers, writers

_AMOUNTS = "amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest"


def _paysim_file(spark: SparkSession, sf_dir: str) -> str:
    """Transactions as a CSV file in the PaySim layout; its path."""
    path = f"{new_workspace(spark, 'paysim')}/paysim.csv"
    rows = transactions(spark, sf_dir).withColumnsRenamed({"sender_id": "nameOrig", "receiver_id": "nameDest"})
    writers.export_csv(rows.select(*readers.PAYSIM_FILE.names), path)
    return path


@query(
    "file_paysim",
    over_txn(
        f"SELECT 'paysim' AS source_dataset, step, type, {_AMOUNTS}, sender_id, receiver_id, "
        "isFlaggedFraud, isFraud FROM txn"
    ),
)
def file_paysim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.load_transactions(spark, "paysim", [_paysim_file(spark, sf_dir)])
    return rows.drop("event_id", "event_time")


@query("file_training", over_txn("SELECT isFraud, count(*) AS count, max(step) AS last_step FROM txn GROUP BY isFraud"))
def file_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.require_rows(readers.load_training(spark, _paysim_file(spark, sf_dir)), "training file")
    return rows.groupBy("isFraud").agg(F.count("*").alias("count"), F.max("step").alias("last_step"))


@query(
    "file_ieee",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_totalprice AS amount,
        greatest(1, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)) AS copies
    FROM orders
    """,
)
def file_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction and identity files; an order's lines multiply it."""
    root = new_workspace(spark, "ieee")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    named = orders.selectExpr(
        "o_orderkey AS TransactionID", "o_totalprice AS TransactionAmt", "1.0D AS TransactionDT",
        "'w' AS ProductCD", "o_custkey AS card1", "1 AS addr1", "2 AS addr2", "'x' AS P_emaildomain", "0 AS isFraud",
    )
    writers.export_csv(named, f"{root}/transactions.csv")
    writers.export_csv(lines.selectExpr("l_orderkey AS TransactionID", "l_linenumber AS id_01"), f"{root}/identity.csv")
    rows = readers.load_transactions(spark, "ieee", [f"{root}/transactions.csv", f"{root}/identity.csv"])
    return rows.groupBy("event_id", "amount").agg(F.count("*").alias("copies"))


@query("file_requests", over_requests("SELECT timestamp, method, path, status_code, duration_ms FROM req"))
def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_workspace(spark, 'requests')}/requests.jsonl"
    lines = request_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string"))
    writers.write_report(lines, path)
    return readers.read_request_log(spark, path).select("timestamp", "method", "path", "status_code", "duration_ms")


@query(
    "file_upload",
    over_txn(
        """
        SELECT count(*) AS rows_received, count(*) FILTER (CAST(event_id AS BIGINT) % 7 <> 0) AS rows_kept,
            count(*) FILTER (CAST(event_id AS BIGINT) % 7 = 0) AS rows_removed FROM txn
        """
    ),
)
def file_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict upload in which every seventh amount is no number."""
    path = f"{new_workspace(spark, 'upload')}/upload.csv"
    odd = F.col("event_id").cast("bigint") % 7 == 0
    rows = transactions(spark, sf_dir).withColumn("amount", F.when(odd, "n/a").otherwise(F.col("amount").cast("string")))
    writers.export_csv(rows.select(*quality.SCORING_FIELDS), path)
    return quality.upload_counts(quality.clean_upload(readers.read_csv(spark, path), require_flag=True))


@query(
    "file_batch_log",
    over_decisions("SELECT final_decision, risk_level, 2 * count(*) AS rows FROM dec GROUP BY final_decision, risk_level"),
)
def file_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch result log after two appends."""
    path = f"{new_workspace(spark, 'batch-log')}/log"
    batch = logs.batch_log(scoring.flat_result(decided(spark, sf_dir)))
    for _ in range(2):
        writers.append_log(batch, path)
    rows = readers.read_csv(spark, path)
    return rows.groupBy("final_decision", "risk_level").agg(F.count("*").alias("rows"))


@query("file_report", ENTRIES["threshold_report"].oracle)
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON in two places, read from the second."""
    root = new_workspace(spark, "report")
    report = ENTRIES["threshold_report"].run(spark, sf_dir)
    writers.write_report(report, f"{root}/metadata", f"{root}/history")
    return spark.read.schema(report.schema).json(f"{root}/history")


@query(
    "audit_explained",
    over_decisions("SELECT event_id, rule_risk_score, CAST(5 AS INTEGER) AS explained, TRUE AS sorted FROM dec"),
)
def audit_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with the model's explanation, read from its JSON text."""
    model = _forest(spark, sf_dir)
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    audit = logs.audit_rows(explain(scoring.score(rows, model), model))
    entry = "array<struct<feature: string, feature_value: double, impact_score: double>>"
    impact = F.transform(F.from_json("explanation", entry), lambda e: e["impact_score"])
    return audit.select(
        "event_id",
        "rule_risk_score",
        F.size(impact).alias("explained"),
        (impact == F.sort_array(impact, asc=False)).alias("sorted"),
    )
