"""Queries behind dashboards: newest rows, distributions, KPI strips, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.operators import logs, reports, telemetry
from txnloom.plans.catalog import query
from txnloom.plans.fixtures import request_log, transactions
from txnloom.plans.inputs import decided, scored_events, silver_rows
from txnloom.plans.oracle import over_decisions, over_features, over_requests, over_txn
from txnloom.plans.records import SCORED_LOG_SQL

_BEST_FIRST = "ORDER BY event_time DESC, event_id DESC"


@query(
    "latest_rows",
    over_features(
        f"SELECT event_id, type, amount, balance_diff_orig, event_time FROM feat "
        f"{_BEST_FIRST} LIMIT 100"
    ),
)
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = reports.latest_rows(silver_rows(spark, sf_dir), 100)
    return newest.select("event_id", "type", "amount", "balance_diff_orig", "event_time")


@query(
    "latest_and_total",
    over_features(
        f"SELECT event_id, amount, event_time, (SELECT count(*) FROM feat) AS total_rows FROM feat {_BEST_FIRST} LIMIT 20"
    ),
)
def latest_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest, total = reports.latest_and_total(silver_rows(spark, sf_dir), 20)
    return newest.select("event_id", "amount", "event_time", F.lit(total).cast("bigint").alias("total_rows"))


@query("recent_scored", over_decisions(f"{SCORED_LOG_SQL} {_BEST_FIRST} LIMIT 20"))
def recent_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_scored(logs.scored_log(scored_events(spark, sf_dir)))


@query(
    "audit_recent",
    over_decisions(
        f"""
        SELECT event_id, step, type AS transaction_type, amount, fraud_probability, risk_level,
            rule_risk_score, rule_risk_level, final_decision, triggered_rules,
            strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
        FROM dec {_BEST_FIRST} LIMIT 50
        """
    ),
)
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = logs.audit_rows(decided(spark, sf_dir), F.col("event_timestamp"))
    recent = reports.recent_audit(audit)
    return logs.json_safe(recent)


def _distribution_sql(column: str, cte: str = "dec") -> str:
    return f"SELECT {column}, count(*) AS count FROM {cte} GROUP BY {column}"


@query("risk_distribution", over_decisions(_distribution_sql("risk_level")))
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(decided(spark, sf_dir), "risk_level")


@query("decision_distribution", over_decisions(_distribution_sql("final_decision")))
def decision_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(decided(spark, sf_dir), "final_decision")


@query("rule_level_distribution", over_decisions(_distribution_sql("rule_risk_level")))
def rule_level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(decided(spark, sf_dir), "rule_risk_level")


@query(
    "avg_probability_by_type",
    over_txn(
        "SELECT type, round(avg(fraud_probability), 6) AS average_probability "
        "FROM txn GROUP BY type"
    ),
)
def avg_probability_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reports.average_by(
        transactions(spark, sf_dir), "type", "fraud_probability", "average_probability"
    )
    return means.withColumn("average_probability", F.round("average_probability", 6))


@query(
    "avg_amount_by_type",
    over_features(
        f"""
        SELECT type, round(avg(amount), 5) AS average_amount
        FROM feat GROUP BY type
        """
    ),
)
def avg_amount_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reports.average_by(silver_rows(spark, sf_dir), "type", "amount", "average_amount")
    return means.withColumn("average_amount", F.round("average_amount", 5))


@query(
    "feature_means",
    over_features(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(avg({f}), 4) AS average_value FROM feat"
            for f in reports.RISK_FEATURES
        )
    ),
)
def feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reports.feature_means(silver_rows(spark, sf_dir))
    return means.withColumn("average_value", F.round("average_value", 4))


@query(
    "type_distribution",
    over_decisions(
        f"""
        SELECT type, count(*) AS count, max(event_time) AS latest_event_time
        FROM dec GROUP BY type
        """
    ),
)
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_distribution(logs.scored_log(scored_events(spark, sf_dir)))


@query(
    "kpi_risk",
    over_decisions(
        """
        SELECT count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high_risk,
            count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk,
            count(*) FILTER (risk_level = 'LOW') AS low_risk
        FROM dec
        """
    ),
)
def kpi_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_risk(decided(spark, sf_dir))


@query(
    "kpi_decisions",
    over_decisions(
        """
        SELECT count(*) AS total, count(*) FILTER (final_decision = 'APPROVE') AS approved,
            count(*) FILTER (final_decision = 'MANUAL REVIEW') AS manual_review,
            count(*) FILTER (final_decision = 'BLOCK / MANUAL REVIEW') AS blocked
        FROM dec
        """
    ),
)
def kpi_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpi_decisions(decided(spark, sf_dir))


@query(
    "kpi_audit",
    over_decisions(
        """
        SELECT count(*) AS total, count(*) FILTER (risk_level = 'HIGH') AS high_risk,
            count(*) FILTER (final_decision ILIKE '%manual review%') AS manual_review,
            round(avg(fraud_probability), 4) AS average_probability
        FROM dec
        """
    ),
)
def kpi_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    strip = reports.kpi_audit(decided(spark, sf_dir))
    return strip.withColumn("average_probability", F.round("average_probability", 4))


_REQUEST_MEASURES = """
    count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
    round(avg(duration_ms), 2) AS avg_latency_ms, round(max(duration_ms), 2) AS max_latency_ms
"""


@query("request_totals", over_requests(f"SELECT {_REQUEST_MEASURES} FROM req"))
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.request_totals(request_log(spark, sf_dir))


@query(
    "request_by_endpoint",
    over_requests(
        f"SELECT method || ' ' || path AS endpoint, {_REQUEST_MEASURES} FROM req "
        "GROUP BY method, path"
    ),
)
def request_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.request_by_endpoint(request_log(spark, sf_dir))


@query(
    "request_counters",
    over_requests(
        """
        SELECT method, path, status_code, count(*) AS requests,
            count(*) FILTER (status_code BETWEEN 400 AND 599) AS errors
        FROM req GROUP BY method, path, status_code
        """
    ),
)
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.request_counters(request_log(spark, sf_dir))


@query(
    "prediction_counters",
    over_decisions(
        "SELECT risk_level, final_decision, count(*) AS predictions FROM dec "
        "GROUP BY risk_level, final_decision"
    ),
)
def prediction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.prediction_counters(decided(spark, sf_dir))


@query(
    "probability_histogram",
    over_txn(
        """
        SELECT le, count(*) FILTER (fraud_probability <= le) AS cumulative_count
        FROM txn, (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.5), (0.7), (0.8), (0.9), (1.0),
            ('inf'::DOUBLE)) AS bounds(le)
        GROUP BY le
        """
    ),
)
def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.probability_histogram(transactions(spark, sf_dir))


# Latency bounds as rows, and p95 from cumulative counts per group and bound: the
# first bound that reaches the rank, linear inside its bucket.
_BOUNDS_CTE = "bounds(i, le) AS (VALUES {})".format(
    ", ".join(f"({i}, {b}::DOUBLE)" for i, b in enumerate(telemetry.LATENCY_BOUNDS))
)
_P95 = """
    {name}_lag AS (
        SELECT *, lag(c, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS lower
        FROM {counts} WINDOW w AS (PARTITION BY {key} ORDER BY i)
    ), {name} AS (
        SELECT {key}, any_value(n) AS n,
            coalesce(min_by(lower + (le - lower) * ((n * 0.95::DOUBLE - below) / (c - below)), i)
                FILTER (c >= n * 0.95::DOUBLE), 10.0::DOUBLE) AS p95
        FROM {name}_lag GROUP BY {key}
    )
"""


@query(
    "latency_p95",
    over_requests(
        """
        SELECT start AS window_start, start + INTERVAL 5 MINUTE AS window_end, n AS requests,
            round(n / 300.0::DOUBLE, 6) AS rate_per_second, round(p95, 6) AS p95_seconds
        FROM q
        """,
        _BOUNDS_CTE,
        "counted AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS start, i, le, "
        "count(*) FILTER (duration_ms / 1000.0::DOUBLE <= le) AS c, count(*) AS n "
        "FROM req, bounds GROUP BY ALL)",
        _P95.format(name="q", key="start", counts="counted"),
    ),
)
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = telemetry.latency_windows(request_log(spark, sf_dir))
    return windows.withColumns(
        {c: F.round(c, 6) for c in ("rate_per_second", "p95_seconds")}
    )


# For the alerts the latency is scaled so that slow phases occur, and
# predictions are half a second apart so that high-risk phases occur.
_ALERT_CTES = (
    _BOUNDS_CTE,
    "ra AS (SELECT status_code, duration_ms * 20 / 1000.0::DOUBLE AS seconds, "
    "CAST(floor(epoch(timestamp) / 60) AS BIGINT) + 1 AS m FROM req)",
    "pa AS (SELECT CAST(floor((1704067200 + o_orderkey // 2) / 60) AS BIGINT) + 1 AS m "
    "FROM orders WHERE CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 1000.0::DOUBLE >= 0.8)",
    # All minutes of the data, so that a frame of rows is a frame of minutes.
    "mins AS (SELECT unnest(generate_series((SELECT min(m) FROM ra), "
    "(SELECT max(m) FROM ra) + 20)) AS e)",
    "pmins AS (SELECT unnest(generate_series((SELECT min(m) FROM pa), "
    "(SELECT max(m) FROM pa) + 20)) AS e)",
    "per_min AS (SELECT e, coalesce(x, 0) AS x FROM mins LEFT JOIN "
    "(SELECT m AS e, count(*) FILTER (status_code >= 500) AS x FROM ra GROUP BY m) USING (e))",
    "per_pmin AS (SELECT e, coalesce(x, 0) AS x FROM pmins LEFT JOIN "
    "(SELECT m AS e, count(*) AS x FROM pa GROUP BY m) USING (e))",
    "per_le AS (SELECT m AS e, i, count(*) FILTER (seconds <= le) AS c, count(*) AS n "
    "FROM ra, bounds GROUP BY ALL)",
    "last_five AS (SELECT * FROM (SELECT e, i, le, sum(coalesce(c, 0)) OVER f AS c, "
    "sum(coalesce(n, 0)) OVER f AS n FROM mins CROSS JOIN bounds LEFT JOIN per_le USING (e, i) "
    "WINDOW f AS (PARTITION BY i ORDER BY e ROWS 4 PRECEDING)) WHERE n > 0)",
    _P95.format(name="slow", key="e", counts="last_five"),
    """
    v AS (
        SELECT 'FraudApiHighErrorRate' AS alert, 'warning' AS severity, 2 AS hold, 0.0 AS bound, e,
            sum(x) OVER (ORDER BY e ROWS 4 PRECEDING) / 300.0::DOUBLE AS value
        FROM per_min
        UNION ALL
        SELECT 'FraudApiHighP95Latency', 'warning', 5, 2.0, e, p95
        FROM mins LEFT JOIN slow USING (e)
        UNION ALL
        SELECT 'FraudHighRiskSpike', 'critical', 5, 0.2, e,
            sum(x) OVER (ORDER BY e ROWS 9 PRECEDING) / 600.0::DOUBLE
        FROM per_pmin
    )
    """,
    """
    held AS (
        SELECT *, CASE WHEN hold = 2
            THEN sum(CASE WHEN value > bound THEN 1 ELSE 0 END)
                OVER (PARTITION BY alert ORDER BY e ROWS 2 PRECEDING)
            ELSE sum(CASE WHEN value > bound THEN 1 ELSE 0 END)
                OVER (PARTITION BY alert ORDER BY e ROWS 5 PRECEDING) END AS seen
        FROM v
    )
    """,
)


@query(
    "alert_windows",
    over_requests(
        """
        SELECT alert, severity, CAST(epoch_ms(e * 60000) AS TIMESTAMP) AS fires_at,
            round(value, 6) AS value
        FROM held WHERE seen = hold + 1
        """,
        *_ALERT_CTES,
    ),
)
def alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = request_log(spark, sf_dir).withColumn("duration_ms", F.col("duration_ms") * 20)
    second = F.lit(1704067200) + F.floor(F.col("event_id").cast("bigint") / 2)
    predictions = decided(spark, sf_dir).select(
        "risk_level", F.timestamp_seconds(second).alias("created_at")
    )
    alerts = telemetry.alert_windows(requests, predictions)
    return alerts.withColumn("value", F.round("value", 6))
