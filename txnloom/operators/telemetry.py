"""Request and prediction metrics from log tables, and alert conditions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnloom.sources.writers import written

UNKNOWN = "UNKNOWN"

# Histogram bounds of the exported metrics.
PROBABILITY_BOUNDS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0)
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)
LATENCY_QUANTILE = 0.95
RATE_MINUTES = 5


def _request_measures() -> list[Column]:
    latency = F.col("duration_ms")
    return [
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.coalesce(F.round(F.avg(latency), 2), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.round(F.max(latency), 2), F.lit(0.0)).alias("max_latency_ms"),
    ]


def request_totals(requests: DataFrame) -> DataFrame:
    return requests.agg(*_request_measures())


def request_by_endpoint(requests: DataFrame) -> DataFrame:
    endpoint = F.concat_ws(" ", "method", "path").alias("endpoint")
    return requests.groupBy(endpoint).agg(*_request_measures())


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests per method, path and status, with an error mark."""
    return requests.groupBy("method", "path", "status_code").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code").cast("string").rlike("^[45]..$")).alias("errors"),
    )


def prediction_counters(predictions: DataFrame) -> DataFrame:
    """Predictions per risk level and decision."""
    labels = [
        F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("risk_level", "final_decision")
    ]
    return predictions.groupBy(*labels).agg(F.count("*").alias("predictions"))


def _cumulative(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Counts at or below each bound."""
    return [F.count_if(value <= bound) for bound in bounds]


def probability_histogram(
    predictions: DataFrame, bounds: Sequence[float] = PROBABILITY_BOUNDS
) -> DataFrame:
    """Cumulative histogram of the probability; the last row is everything.

    One aggregate over the table; the bounds become rows afterwards.
    """
    probability = F.coalesce("fraud_probability", F.lit(0.0))
    counts = [*_cumulative(probability, bounds), F.count("*")]
    labels = [*bounds, float("inf")]
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), c.alias("cumulative_count"))
            for b, c in zip(labels, counts, strict=True)
        ]
    )
    return predictions.agg(rows.alias("h")).select(F.explode("h").alias("h")).select("h.*")


def _bucket_quantile(
    counts: Column, total: Column, bounds: Sequence[float], quantile: float
) -> Column:
    """Quantile from cumulative counts, linear inside its bucket.

    Beyond the last bound the result is that bound.
    """
    rank = total * F.lit(quantile)
    result = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below = counts.getItem(i - 1) if i else F.lit(0)
        lower = bounds[i - 1] if i else 0.0
        inside = F.try_divide(rank - below, counts.getItem(i) - below)
        value = F.lit(lower) + F.lit(bounds[i] - lower) * inside
        result = F.when(counts.getItem(i) >= rank, value).otherwise(result)
    return result


def latency_windows(
    requests: DataFrame,
    minutes: int = RATE_MINUTES,
    bounds: Sequence[float] = LATENCY_BOUNDS,
    quantile: float = LATENCY_QUANTILE,
) -> DataFrame:
    """Request rate per second and bucketed p95 latency per window."""
    seconds = F.col("duration_ms") / F.lit(1000.0)
    counted = requests.groupBy(F.window("timestamp", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("requests"),
        F.array(*_cumulative(seconds, bounds)).alias("counts"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "requests",
        (F.col("requests") / F.lit(minutes * 60.0)).alias("rate_per_second"),
        _bucket_quantile(F.col("counts"), F.col("requests"), bounds, quantile).alias(
            "p95_seconds"
        ),
    )


@dataclass(frozen=True)
class Alert:
    """A condition on the trailing window that must hold for some minutes."""

    name: str
    severity: str
    window_minutes: int
    hold_minutes: int
    bound: float


# The alert rules.
SERVER_ERRORS = Alert("FraudApiHighErrorRate", "warning", 5, 2, 0.0)
SLOW_REQUESTS = Alert("FraudApiHighP95Latency", "warning", 5, 5, 2.0)
HIGH_RISK_SPIKE = Alert("FraudHighRiskSpike", "critical", 10, 5, 0.2)


def _minute(column: str) -> Column:
    """End of the minute a row falls in, as minutes since the epoch."""
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 60) + 1


_DAY = 24 * 60


def _minute_table(rows: DataFrame, time: str, sums: dict[str, Column]) -> DataFrame:
    """One written row per minute with the given sums; what every alert on these rows works from."""
    minutes = rows.filter(F.col(time).isNotNull()).groupBy(_minute(time).alias("minute"))
    return written(minutes.agg(*[c.alias(n) for n, c in sums.items()]), "minutes")


def _measured(minutes: DataFrame, alert: Alert, sums: Sequence[str], value: Column) -> DataFrame:
    """Intervals of minutes over which the trailing sums stay as they are, with ``value`` of them.

    A minute enters the window at its end and leaves it ``window_minutes``
    later, so sums change at two times for each minute that has rows, whatever
    the length of the window: they are running totals of what comes and goes.
    Days are separate tasks; a minute counts for the day before whose end its
    effect lies and for the one after, if it reaches that far.
    """
    reach = alert.window_minutes + alert.hold_minutes
    days = F.array_distinct(
        F.array(F.floor(F.col("minute") / _DAY), F.floor((F.col("minute") + F.lit(reach)) / _DAY))
    )
    changes = F.array(
        F.struct(F.col("minute").alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("minute") + F.lit(alert.window_minutes)).alias("at"), F.lit(-1).alias("sign")),
    )
    changed = (
        minutes.withColumn("day", F.explode(days))
        .withColumn("c", F.explode(changes))
        .groupBy("day", F.col("c.at").alias("at"))
        .agg(*[F.sum(F.col(n) * F.col("c.sign")).alias(n) for n in sums])
    )
    order = Window.partitionBy("day").orderBy("at")
    total = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = changed.select("day", "at", F.lead("at").over(order).alias("until"), *[F.sum(n).over(total).alias(n) for n in sums])
    # Before this minute the day does not know all that the window holds.
    first = F.col("day") * _DAY - F.lit(alert.hold_minutes)
    known = running.filter((F.col("until") > first) & (F.col("at") < (F.col("day") + 1) * _DAY))
    return known.select("day", F.greatest("at", first).alias("at"), "until", value.alias("value"))


def _firing(measured: DataFrame, alert: Alert) -> DataFrame:
    """Minutes at which the condition has held long enough.

    The condition must be true now and at every minute of the hold time, so a
    run of true intervals fires from its start plus the hold time on.
    """
    order = Window.partitionBy("day").orderBy("at")
    holds = F.coalesce(F.col("value") > alert.bound, F.lit(False))
    runs = measured.withColumn("holds", holds).withColumn(
        "run", F.count_if(~F.col("holds")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    true_runs = runs.filter("holds").withColumn("since", F.min("at").over(Window.partitionBy("day", "run")))
    start = F.greatest(F.col("at"), F.col("since") + F.lit(alert.hold_minutes), F.col("day") * _DAY)
    end = F.least(F.col("until"), (F.col("day") + 1) * _DAY) - 1
    fired = true_runs.select("value", start.alias("start"), end.alias("end")).filter("start <= end")
    minutes = fired.select("value", F.explode(F.sequence("start", "end")).alias("fires_at"))
    return minutes.select(
        F.lit(alert.name).alias("alert"),
        F.lit(alert.severity).alias("severity"),
        F.timestamp_seconds(F.col("fires_at") * 60).alias("fires_at"),
        "value",
    )


def _rate(minutes: DataFrame, column: str, alert: Alert) -> DataFrame:
    return _measured(minutes, alert, [column], F.col(column) / F.lit(alert.window_minutes * 60.0))


def alert_windows(
    requests: DataFrame,
    predictions: DataFrame,
    bounds: Sequence[float] = LATENCY_BOUNDS,
    prediction_time: str = "created_at",
) -> DataFrame:
    """Every minute at which one of the alerts fires, with its measure.

    Either table is read once, into one row per minute with all its sums.
    """
    seconds = F.col("duration_ms") / F.lit(1000.0)
    latencies = {f"b{i}": c for i, c in enumerate(_cumulative(seconds, bounds))}
    errors = F.count_if(F.col("status_code").between(500, 599))
    served = _minute_table(requests, "timestamp", {"n": F.count("*"), "errors": errors} | latencies)
    risky = _minute_table(predictions, prediction_time, {"risky": F.count_if(F.col("risk_level") == "HIGH")})
    p95 = _bucket_quantile(F.array(*[F.col(b) for b in latencies]), F.col("n"), bounds, LATENCY_QUANTILE)
    parts = [
        _firing(_rate(served, "errors", SERVER_ERRORS), SERVER_ERRORS),
        _firing(_measured(served, SLOW_REQUESTS, ["n", *latencies], p95), SLOW_REQUESTS),
        _firing(_rate(risky, "risky", HIGH_RISK_SPIKE), HIGH_RISK_SPIKE),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
