"""The driver's tables seen as payment data.

Each mapping is one list of (column, SQL expression) pairs that Spark and the
oracle both read, so the two sides start from the same rows.  Everything after
the mapping is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Expressions that differ between the two SQL dialects.
SPARK = {
    "days": "datediff(o_orderdate, DATE'1995-01-01')",
    "order_time": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "hours": "CAST((unix_seconds(CAST(ts AS TIMESTAMP)) - 1704067200) div 3600 AS INT)",
    "event_time": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "stamp": "TIMESTAMP",
}
ORACLE = {
    "days": "CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER)",
    "order_time": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')",
    "hours": "CAST(floor((epoch(ts) - 1704067200) / 3600) AS INTEGER)",
    "event_time": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    "stamp": "TIMESTAMP",
}

# Two steps, because later columns use earlier ones.
_TXN_BASE = [
    ("k", "o_orderkey"),
    ("event_id", "CAST(o_orderkey AS STRING)"),
    ("event_time", "{order_time}"),
    ("event_timestamp", "CAST(o_orderdate AS {stamp})"),
    ("source_dataset", "'orders'"),
    ("step", "{days}"),
    (
        "type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' "
        "WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END",
    ),
    ("amount", "o_totalprice"),
    ("sender_id", "concat('C', CAST(o_custkey AS STRING))"),
    ("receiver_id", "concat('M', CAST(o_orderkey % 97 AS STRING))"),
    (
        "oldbalanceOrg",
        "CASE o_orderkey % 4 WHEN 0 THEN o_totalprice "
        "WHEN 1 THEN o_totalprice + CAST(1000 * (o_orderkey % 50) AS DOUBLE) "
        "WHEN 2 THEN o_totalprice * CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    ),
    ("oldbalanceDest", "CAST(100 * (o_orderkey % 300) AS DOUBLE)"),
]
_RISKY = "type IN ('TRANSFER', 'CASH_OUT')"
_NEW_ORIG = (
    "greatest(oldbalanceOrg - amount, CAST(0 AS DOUBLE)) "
    "+ CASE WHEN k % 10 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
)
_TXN = [
    (c, c)
    for c in (
        "event_id", "event_time", "event_timestamp", "source_dataset", "step", "type", "amount",
        "sender_id", "receiver_id", "oldbalanceOrg",
    )
] + [
    ("newbalanceOrig", _NEW_ORIG),
    ("oldbalanceDest", "oldbalanceDest"),
    (
        "newbalanceDest",
        f"oldbalanceDest + CASE WHEN {_RISKY} AND k % 6 <> 0 THEN amount "
        "ELSE CAST(0 AS DOUBLE) END",
    ),
    (
        "isFlaggedFraud",
        "CAST(CASE WHEN type = 'TRANSFER' AND amount >= 200000 AND k % 3 = 0 THEN 1 ELSE 0 END "
        "AS INT)",
    ),
    (
        "isFraud",
        f"CAST(CASE WHEN oldbalanceOrg > 0 AND ({_NEW_ORIG}) = 0 AND {_RISKY} AND k % 9 <> 0 "
        "THEN 1 ELSE 0 END AS INT)",
    ),
    ("fraud_probability", "CAST((k * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"),
]

_EVENT = [
    ("event_id", "CAST(event_id AS STRING)"),
    ("event_time", "{event_time}"),
    ("event_timestamp", "CAST(ts AS {stamp})"),
    ("source_dataset", "'events'"),
    ("step", "{hours}"),
    (
        "type",
        "CASE event_type WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'DEBIT' "
        "WHEN 'signup' THEN 'CASH_IN' WHEN 'purchase' THEN 'TRANSFER' ELSE 'CASH_OUT' END",
    ),
    ("amount", "value"),
    ("sender_id", "CAST(user_id AS STRING)"),
    ("receiver_id", "concat('M', CAST(event_id % 97 AS STRING))"),
    (
        "oldbalanceOrg",
        "CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value * CAST(3 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END",
    ),
    (
        "newbalanceOrig",
        "CASE event_id % 3 WHEN 1 THEN value * CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    ),
    ("oldbalanceDest", "CAST(100 * (event_id % 50) AS DOUBLE)"),
    (
        "newbalanceDest",
        "CAST(100 * (event_id % 50) AS DOUBLE) "
        "+ CASE WHEN event_id % 4 <> 0 THEN value ELSE CAST(0 AS DOUBLE) END",
    ),
    ("isFlaggedFraud", "CAST(0 AS INT)"),
    ("isFraud", "CAST(CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS INT)"),
]

_REQUEST = [
    ("event_id", "event_id"),
    ("timestamp", "CAST(ts AS {stamp})"),
    ("method", "'POST'"),
    ("path", "concat('/', event_type)"),
    (
        "status_code",
        "CAST(CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 404 "
        "ELSE 200 END AS INT)",
    ),
    ("duration_ms", "value"),
]


def _select(pairs: list[tuple[str, str]], dialect: dict[str, str]) -> list[str]:
    return [f"{expression.format(**dialect)} AS {name}" for name, expression in pairs]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions from orders, with label and a stand-in score."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(*_select(_TXN_BASE, SPARK)).selectExpr(*_select(_TXN, SPARK))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions from events."""
    return table(spark, sf_dir, "events").selectExpr(*_select(_EVENT, SPARK))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_select(_REQUEST, SPARK))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event JSON with faults by event id: %11 no amount, %13 amount as text,
    %17 truncated text, %19 null step, %23 an empty object, %31 a foreign one."""
    events = event_stream(spark, sf_dir).drop("event_timestamp")
    n = F.col("event_id").cast("bigint")
    text = F.to_json(F.struct("*"))
    # A pattern that matches nothing leaves the text of the other rows alone.
    for divisor, pattern, replacement in (
        (11, '"amount":[^,]*,', ""),
        (13, '"amount":([^,]*),', '"amount":"$1",'),
        (17, ".{30}$", ""),
        (19, '"step":[^,]*,', '"step":null,'),
    ):
        chosen = F.when(n % divisor == 0, F.lit(pattern)).otherwise(F.lit("$^"))
        text = F.regexp_replace(text, chosen, F.lit(replacement))
    text = F.when(n % 23 == 0, "{}").when(n % 31 == 0, '{"foo":1}').otherwise(text)
    return events.select(F.col("event_id").alias("key"), text.alias("value"))


TXN_CTE = (
    "txn_base AS (SELECT " + ", ".join(_select(_TXN_BASE, ORACLE)) + " FROM orders), "
    "txn AS (SELECT " + ", ".join(_select(_TXN, ORACLE)) + " FROM txn_base)"
)
EVENT_CTE = "ev AS (SELECT " + ", ".join(_select(_EVENT, ORACLE)) + " FROM events)"
REQUEST_CTE = "req AS (SELECT " + ", ".join(_select(_REQUEST, ORACLE)) + " FROM events)"
