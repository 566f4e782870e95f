"""Queries over single records: normalising, checking, features, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.functions.casts import safe_double, safe_int
from txnloom.functions.contracts import RAW_CONTRACT, SCORED_CONTRACT
from txnloom.operators import logs, medallion, normalize, quality, reports, scoring, training
from txnloom.plans.catalog import query
from txnloom.plans.fixtures import raw_messages, table, transactions
from txnloom.plans.inputs import decided, scored_events, silver_rows
from txnloom.plans.oracle import (
    REASON,
    over_decisions,
    over_features,
    over_messages,
    over_txn,
)
from txnloom.schemas import SCORED_EVENT

# Input shapes with gaps and unusable text, the same SQL on both sides.
_PAYSIM = """
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('E', CAST(o_orderkey AS STRING)) END
            AS event_id,
        concat('T', CAST(o_orderkey AS STRING)) AS transaction_id,
        concat('at-', CAST(o_orderkey AS STRING)) AS event_time,
        CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 7 = 1 THEN '3.7'
            ELSE CAST(o_orderkey % 744 AS STRING) END AS step,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lower(o_orderpriority) END AS type,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'n/a'
            ELSE CAST(o_totalprice AS STRING) END AS amount,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('C', CAST(o_custkey AS STRING)) END
            AS nameOrig,
        concat('S', CAST(o_custkey AS STRING)) AS sender_id,
        concat('M', CAST(o_orderkey % 97 AS STRING)) AS nameDest,
        o_totalprice AS oldbalanceOrg, CAST(0 AS DOUBLE) AS newbalanceOrig,
        CAST(o_custkey AS DOUBLE) AS oldbalanceDest,
        CAST(o_orderkey % 2 AS INT) AS isFraud, CAST(NULL AS INT) AS isFlaggedFraud
    FROM {orders}
"""
_IEEE = """
    SELECT o_orderkey AS TransactionID, o_totalprice AS TransactionAmt,
        CAST(o_orderkey * 7 AS DOUBLE) AS TransactionDT,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE lower(o_orderstatus) END AS ProductCD,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS card1,
        concat('A', CAST(o_orderkey % 400 AS STRING)) AS addr1,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CAST(o_orderkey % 90 AS STRING) END AS addr2,
        concat('mail', CAST(o_orderkey % 9 AS STRING), '.example') AS P_emaildomain,
        CAST(o_orderkey % 2 AS DOUBLE) AS isFraud
    FROM {orders}
"""
_TEXTS = """
    SELECT CAST(o_orderkey AS STRING) AS event_id, o_totalprice AS number,
        CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS STRING)
            WHEN 1 THEN CAST(o_totalprice AS STRING) WHEN 2 THEN concat('x', o_orderstatus)
            WHEN 3 THEN NULL WHEN 4 THEN concat(' ', CAST(o_custkey AS STRING), ' ')
            ELSE '' END AS text
    FROM {orders}
"""


def _from_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(orders="{orders}"), orders=table(spark, sf_dir, "orders"))


@query(
    "normalize_paysim",
    f"""
    WITH p AS ({_PAYSIM.format(orders="orders")})
    SELECT coalesce(nullif(event_id, ''), transaction_id) AS event_id, event_time,
        'paysim' AS source_dataset,
        CASE WHEN regexp_full_match(step, '[0-9]+') THEN CAST(step AS INTEGER) ELSE 0 END AS step,
        upper(coalesce(type, 'TRANSFER')) AS type,
        coalesce(TRY_CAST(amount AS DOUBLE), 0) AS amount,
        coalesce(nameOrig, sender_id) AS sender_id, nameDest AS receiver_id,
        oldbalanceOrg, newbalanceOrig, oldbalanceDest, CAST(0 AS DOUBLE) AS newbalanceDest,
        CAST(0 AS INTEGER) AS isFlaggedFraud, isFraud
    FROM p
    """,
)
def normalize_paysim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_paysim(_from_orders(spark, sf_dir, _PAYSIM))


_IEEE_ROWS = """
    SELECT CAST(TransactionID AS STRING) AS event_id, 'ieee-cis' AS source_dataset,
        CAST(TransactionDT AS INTEGER) AS step, upper(coalesce(ProductCD, 'IEEE')) AS type,
        TransactionAmt AS amount, coalesce(CAST(card1 AS STRING), addr1) AS sender_id,
        coalesce(nullif(addr2, ''), P_emaildomain) AS receiver_id,
        CAST(0 AS DOUBLE) AS oldbalanceOrg, CAST(0 AS DOUBLE) AS newbalanceOrig,
        CAST(0 AS DOUBLE) AS oldbalanceDest, CAST(0 AS DOUBLE) AS newbalanceDest,
        CAST(0 AS INTEGER) AS isFlaggedFraud, CAST(isFraud AS INTEGER) AS isFraud
"""


@query("normalize_ieee", f"WITH i AS ({_IEEE.format(orders='orders')}) {_IEEE_ROWS} FROM i")
def normalize_ieee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_ieee(_from_orders(spark, sf_dir, _IEEE)).drop("event_time")


@query(
    "ieee_identity_join",
    f"""
    WITH i AS ({_IEEE.format(orders="orders")})
    SELECT TransactionID, TransactionAmt, card1, l_linenumber AS device_id, l_shipdate AS seen_at
    FROM i LEFT JOIN lineitem ON l_orderkey = TransactionID
    """,
)
def ieee_identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("TransactionID"),
        F.col("l_linenumber").alias("device_id"),
        F.col("l_shipdate").alias("seen_at"),
    )
    joined = normalize.join_identity(_from_orders(spark, sf_dir, _IEEE), identity)
    return joined.select("TransactionID", "TransactionAmt", "card1", "device_id", "seen_at")


@query(
    "safe_casts",
    f"""
    WITH t AS ({_TEXTS.format(orders="orders")})
    SELECT event_id, coalesce(TRY_CAST(trim(text) AS DOUBLE), 0) AS text_as_double,
        CASE WHEN regexp_full_match(text, ' *[0-9]+ *') THEN CAST(trim(text) AS INTEGER) ELSE 0
            END AS text_as_int,
        CAST(trunc(number) AS INTEGER) AS number_as_int
    FROM t
    """,
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _from_orders(spark, sf_dir, _TEXTS)
    return rows.select(
        "event_id",
        safe_double(rows, "text").alias("text_as_double"),
        safe_int(rows, "text").alias("text_as_int"),
        safe_int(rows, "number").alias("number_as_int"),
    )


@query(
    "decode_events",
    over_messages(
        """
        SELECT event_id, event_time, source_dataset, step, type, amount, sender_id, receiver_id,
            oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFlaggedFraud, isFraud,
            event_timestamp, FALSE AS is_malformed
        FROM bronze
        UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
            NULL, TRUE
        FROM msg WHERE no_event
        """
    ),
)
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = medallion.decode(raw_messages(spark, sf_dir))
    return decoded.drop("raw_event", "ingestion_timestamp")


@query("contract_raw", over_messages(f"SELECT event_id AS key, {REASON} AS contract_error FROM msg"))
def contract_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.check_contract(raw_messages(spark, sf_dir), RAW_CONTRACT)
    return checked.select("key", "contract_error")


@query(
    "contract_scored",
    over_txn(
        """
        SELECT event_id AS key,
            CASE WHEN CAST(event_id AS BIGINT) % 7 = 0
                    THEN 'event missing required fields: prediction'
                WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN 'event.amount expected number, got list'
                WHEN CAST(event_id AS BIGINT) % 11 = 0
                    THEN 'event.prediction missing required fields: risk_level'
                WHEN CAST(event_id AS BIGINT) % 13 = 0
                    THEN 'event.prediction.triggered_rules expected array, got str'
            END AS contract_error
        FROM txn
        """
    ),
)
def contract_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = logs.messages(scored_events(spark, sf_dir))
    faults = [
        (5, '"amount":([^,]*),', '"amount":[$1],'),
        (7, '"prediction":', '"other":'),
        (11, '"risk_level":"[A-Z]*",', ""),
        (13, r'"triggered_rules":\[[^\]]*\]', '"triggered_rules":"none"'),
    ]
    value = F.col("value")
    for divisor, pattern, text in faults:
        hit = F.col("key").cast("bigint") % divisor == 0
        value = F.regexp_replace(value, F.when(hit, pattern).otherwise("$^"), F.lit(text))
    messages = messages.withColumn("value", value)
    return quality.check_contract(messages, SCORED_CONTRACT, layout=SCORED_EVENT).select("key", "contract_error")


_OUT_OF_RANGE = """
    SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 31 = 0 THEN -1 ELSE step END AS step,
        CASE WHEN CAST(event_id AS BIGINT) % 43 = 0 THEN '' ELSE type END AS type,
        CASE WHEN CAST(event_id AS BIGINT) % 37 = 0 THEN -amount ELSE amount END AS amount,
        oldbalanceOrg, newbalanceOrig, oldbalanceDest,
        CASE WHEN CAST(event_id AS BIGINT) % 53 = 0 THEN NULL ELSE newbalanceDest END
            AS newbalanceDest,
        CASE WHEN CAST(event_id AS BIGINT) % 41 = 0 THEN 2 ELSE isFlaggedFraud END
            AS isFlaggedFraud
    FROM {txn}
"""


@query(
    "range_checks",
    over_txn(
        """
        SELECT event_id, nullif(concat_ws(' | ',
            CASE WHEN newbalanceDest IS NULL THEN 'newbalanceDest is required' END,
            CASE WHEN step < 0 THEN 'step must be >= 0' END,
            CASE WHEN type = '' THEN 'type must not be empty' END,
            CASE WHEN amount < 0 THEN 'amount must be >= 0' END,
            CASE WHEN isFlaggedFraud NOT IN (0, 1) THEN 'isFlaggedFraud must be 0 or 1' END), '')
            AS range_errors
        FROM o
        """,
        f"o AS ({_OUT_OF_RANGE.format(txn='txn')})",
    ),
)
def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _OUT_OF_RANGE.format(txn="{txn}")
    rows = spark.sql(sql, txn=transactions(spark, sf_dir))
    return quality.check_ranges(rows).select("event_id", "range_errors")


@query(
    "known_types",
    over_txn(
        """
        SELECT event_id,
            CASE WHEN CAST(event_id AS BIGINT) % 29 = 0 THEN 'CHEQUE' ELSE type END AS type,
            CASE WHEN CAST(event_id AS BIGINT) % 29 = 0 THEN 'Invalid transaction type: CHEQUE. '
                || 'Allowed types are: CASH_IN, CASH_OUT, DEBIT, PAYMENT, TRANSFER' END
                AS type_error
        FROM txn
        """
    ),
)
def known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = F.col("event_id").cast("bigint") % 29 == 0
    rows = transactions(spark, sf_dir).withColumn(
        "type", F.when(foreign, "Cheque").otherwise(F.lower("type"))
    )
    return quality.check_types(rows).select("event_id", "type", "type_error")


_UPLOAD = """
    SELECT event_id,
        CASE WHEN CAST(event_id AS BIGINT) % 23 = 0 THEN NULL ELSE CAST(step AS STRING) END AS step,
        CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN concat('  ', lower(type), ' ')
            WHEN CAST(event_id AS BIGINT) % 59 = 0 THEN NULL ELSE type END AS type,
        CASE WHEN CAST(event_id AS BIGINT) % 17 = 0 THEN 'n/a' ELSE CAST(amount AS STRING) END
            AS amount,
        oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest
    FROM {txn}
"""


@query(
    "clean_batch",
    over_txn(
        """
        SELECT event_id, CAST(step AS INTEGER) AS step, upper(trim(type)) AS type,
            TRY_CAST(amount AS DOUBLE) AS amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest,
            newbalanceDest, CAST(0 AS INTEGER) AS isFlaggedFraud
        FROM u
        WHERE step IS NOT NULL AND type IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NOT NULL
        """,
        f"u AS ({_UPLOAD.format(txn='txn')})",
    ),
)
def clean_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_UPLOAD.format(txn="{txn}"), txn=transactions(spark, sf_dir))
    return quality.accepted(quality.clean_upload(rows))


@query(
    "upload_counts",
    over_txn(
        """
        SELECT count(*) AS rows_received, count(*) FILTER (step IS NOT NULL AND type IS NOT NULL
                AND TRY_CAST(amount AS DOUBLE) IS NOT NULL) AS rows_kept,
            count(*) FILTER (step IS NULL OR type IS NULL
                OR TRY_CAST(amount AS DOUBLE) IS NULL) AS rows_removed
        FROM u
        """,
        f"u AS ({_UPLOAD.format(txn='txn')})",
    ),
)
def upload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_UPLOAD.format(txn="{txn}"), txn=transactions(spark, sf_dir))
    return quality.upload_counts(quality.clean_upload(rows))


_BALANCES = (
    "balance_diff_orig, balance_diff_dest, amount_to_oldbalance_ratio, is_zero_balance_after_txn"
)


@query("features", over_features(f"SELECT event_id, {_BALANCES} FROM feat"))
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.add_features(transactions(spark, sf_dir))
    return rows.select("event_id", *_BALANCES.split(", "))


@query(
    "silver",
    over_features(
        f"""
        SELECT event_id, event_time, source_dataset, step, type, amount, oldbalanceOrg,
            newbalanceOrig, oldbalanceDest, newbalanceDest, isFlaggedFraud, isFraud, {_BALANCES},
            sender_balance_mismatch, receiver_balance_mismatch, event_timestamp
        FROM feat
        """
    ),
)
def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_rows(spark, sf_dir).drop("ingestion_timestamp")


@query(
    "analyst_view",
    over_features(
        """
        SELECT event_id, amount, balance_diff_orig AS sender_balance_difference,
            balance_diff_dest AS receiver_balance_difference,
            amount_to_oldbalance_ratio AS amount_to_sender_balance_ratio,
            CASE WHEN newbalanceOrig = 0 THEN 'Yes' ELSE 'No' END AS sender_zero_balance
        FROM feat
        """
    ),
)
def analyst_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.analyst_view(silver_rows(spark, sf_dir))


@query(
    "encode_type",
    over_txn(
        """
        SELECT event_id, step, amount,
            CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS type
        FROM txn
        """
    ),
)
def encode_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = training.encode_type(transactions(spark, sf_dir))
    return encoded.select("event_id", "step", "amount", "type")


@query(
    "rules",
    over_decisions(
        "SELECT event_id, rule_risk_score, rule_risk_level, triggered_rules FROM ruled"
    ),
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = scoring.flat_result(scoring.apply_rules(transactions(spark, sf_dir)))
    return ruled.select("event_id", "rule_risk_score", "rule_risk_level", "triggered_rules")


@query(
    "decisions",
    over_decisions(
        """
        SELECT event_id, fraud_probability, risk_level, alert, rule_risk_score, rule_risk_level,
            final_decision
        FROM dec
        """
    ),
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select(
        "event_id",
        "fraud_probability",
        "risk_level",
        "alert",
        "rule_risk_score",
        "rule_risk_level",
        "final_decision",
    )


@query(
    "dead_letters",
    over_messages(
        f"""
        SELECT CASE WHEN NOT no_event THEN event_id END AS event_id,
            CASE WHEN NOT no_event THEN source_dataset END AS source_dataset,
            {REASON} AS error_message
        FROM msg WHERE no_event OR n % 19 = 0 OR n % 11 = 0 OR n % 13 = 0
        """
    ),
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = quality.split_triaged(quality.triage(raw_messages(spark, sf_dir)))
    return logs.dead_letters(bad).drop("failed_at", "raw_event")


@query(
    "error_messages",
    over_messages(
        f"""
        SELECT CASE WHEN NOT no_event THEN event_id ELSE 'unknown' END AS key,
            {REASON} AS error_message
        FROM msg WHERE no_event OR n % 19 = 0 OR n % 11 = 0 OR n % 13 = 0
        """
    ),
)
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = quality.split_triaged(quality.triage(raw_messages(spark, sf_dir)))
    sent = logs.error_messages(bad)
    return sent.select(
        "key", F.get_json_object("value", "$.error_message").alias("error_message")
    )


@query(
    "scored_messages",
    over_decisions(
        """
        SELECT event_id AS key, event_time AS scored_at, final_decision,
            CAST(rule_risk_score AS VARCHAR) AS rule_risk_score
        FROM dec
        """
    ),
)
def scored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = logs.messages(scored_events(spark, sf_dir))
    return sent.select(
        "key",
        F.get_json_object("value", "$.scored_at").alias("scored_at"),
        F.get_json_object("value", "$.prediction.final_decision").alias("final_decision"),
        F.get_json_object("value", "$.prediction.rule_risk_score").alias("rule_risk_score"),
    )


SCORED_LOG_SQL = """
    SELECT event_time AS scored_at, event_id, event_time, source_dataset, type, amount,
        fraud_probability, risk_level, rule_risk_score, rule_risk_level, final_decision,
        triggered_rules
    FROM dec
"""


@query("scored_log", over_decisions(SCORED_LOG_SQL))
def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scored_log(scored_events(spark, sf_dir))


AUDIT_SQL = """
    SELECT event_id, step, type AS transaction_type, amount, oldbalanceOrg AS oldbalance_org,
        newbalanceOrig AS newbalance_orig, oldbalanceDest AS oldbalance_dest,
        newbalanceDest AS newbalance_dest, isFlaggedFraud AS is_flagged_fraud, fraud_probability,
        risk_level, alert, rule_risk_score, rule_risk_level, triggered_rules, final_decision,
        '{}' AS explanation
    FROM dec
"""


@query("audit_rows", over_decisions(AUDIT_SQL))
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.audit_rows(decided(spark, sf_dir)).drop("created_at")


@query(
    "alert_log",
    over_decisions(
        """
        SELECT step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
            isFlaggedFraud, fraud_probability, risk_level, alert
        FROM dec
        """
    ),
)
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alert_log(decided(spark, sf_dir)).drop("timestamp")
