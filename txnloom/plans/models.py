"""Queries for splits, training, evaluation, explanation and drift."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.config import Channel, Lake
from txnloom.functions.features import MODEL_COLUMNS
from txnloom.operators import drift, evaluation, scoring, splits, training
from txnloom.operators.explain import explain
from txnloom.plans.catalog import query
from txnloom.plans.fixtures import event_stream, transactions
from txnloom.plans.inputs import decided, raw_channel
from txnloom.plans.oracle import RULE_CTE, over_decisions, over_events, over_txn
from txnloom.sources.writers import written
from txnloom.streaming import pipelines

RULE_SCORE = "rule_score"
MODEL_SCORE = "fraud_probability"
SCORES = (MODEL_SCORE, RULE_SCORE)


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label with two scores: the stand-in one and the rules' (many ties)."""
    rows = decided(spark, sf_dir)
    return rows.withColumn(RULE_SCORE, F.col("rule_risk_score").cast("double") / 100.0)


_SCORES_CTE = (
    "sc AS (SELECT dec.*, CAST(rule_risk_score AS DOUBLE) / 100.0::DOUBLE AS rule_score FROM dec)"
)
_HASH = "CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"


@query(
    "class_balance",
    over_txn(
        """
        SELECT count(*) FILTER (isFraud = 1) AS fraud_count,
            count(*) FILTER (isFraud = 0) AS non_fraud_count,
            count(*) FILTER (isFraud = 0) / count(*) FILTER (isFraud = 1)::DOUBLE
                AS scale_pos_weight
        FROM txn
        """
    ),
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_balance(transactions(spark, sf_dir))


@query(
    "temporal_split",
    over_txn(
        f"""
        SELECT event_id, step,
            CASE WHEN row_number() OVER (ORDER BY step, {_HASH.format(key="event_id")})
                <= CAST(floor((SELECT count(*) FROM txn) * 0.8::DOUBLE) AS BIGINT)
                THEN 'train' ELSE 'test' END AS split,
            'temporal_holdout_by_step' AS strategy
        FROM txn
        """
    ),
)
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split, strategy = splits.validation_split(transactions(spark, sf_dir))
    return split.select("event_id", "step", "split", F.lit(strategy).alias("strategy"))


@query(
    "stratified_split",
    over_txn(
        f"""
        SELECT event_id, isFraud, CASE WHEN row_number() OVER (PARTITION BY isFraud
                    ORDER BY {_HASH.format(key="event_id || ':42'")})
                <= CAST(floor(count(*) OVER (PARTITION BY isFraud) * 0.8::DOUBLE) AS BIGINT)
                THEN 'train' ELSE 'test' END AS split
        FROM txn
        """
    ),
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.stratified_split(transactions(spark, sf_dir))
    return split.select("event_id", "isFraud", "split")


def _ranking_sql(score: str) -> str:
    return f"""
        SELECT '{score}' AS model,
            sum(neg * (tp - pos) + neg * pos * 0.5::DOUBLE)
                / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS roc_auc,
            sum(pos * (tp::DOUBLE / (tp + fp)::DOUBLE)) / sum(pos)::DOUBLE AS average_precision
        FROM (
            SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp,
                sum(neg) OVER (ORDER BY s DESC) AS fp
            FROM (SELECT {score} AS s, count(*) FILTER (isFraud = 1) AS pos,
                count(*) FILTER (isFraud = 0) AS neg FROM sc GROUP BY {score})
        )
    """


_RANKING = " UNION ALL ".join(_ranking_sql(s) for s in SCORES)


@query(
    "eval_ranking",
    over_decisions(
        f"SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) "
        f"AS average_precision FROM ({_RANKING})",
        _SCORES_CTE,
    ),
)
def eval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = evaluation.ranking_quality(_two_scores(spark, sf_dir), SCORES)
    return ranking.withColumns({c: F.round(c, 6) for c in ("roc_auc", "average_precision")})


def _threshold_sql(score: str, threshold: float) -> str:
    return f"""
        SELECT {threshold}::DOUBLE AS threshold, tp AS true_positives, fp AS false_positives,
            fn AS false_negatives, tn AS true_negatives,
            CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
            CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
            CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END
                AS f1_score
        FROM (SELECT count(*) FILTER ({score} >= {threshold} AND isFraud = 1) AS tp,
            count(*) FILTER ({score} >= {threshold} AND isFraud = 0) AS fp,
            count(*) FILTER ({score} < {threshold} AND isFraud = 1) AS fn,
            count(*) FILTER ({score} < {threshold} AND isFraud = 0) AS tn FROM sc)
    """


_METRICS = ("precision", "recall", "f1_score")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in _METRICS})


@query(
    "eval_threshold",
    over_decisions(
        f"SELECT threshold, {_ROUNDED} FROM ({_threshold_sql(RULE_SCORE, 0.5)})", _SCORES_CTE
    ),
)
def eval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    return _round_metrics(evaluation.threshold_quality(rows, RULE_SCORE))


@query(
    "threshold_report",
    over_decisions(
        f"SELECT threshold, true_positives, false_positives, false_negatives, true_negatives, "
        f"{_ROUNDED} FROM ("
        + " UNION ALL ".join(_threshold_sql(RULE_SCORE, t) for t in (0.2, 0.35, 0.5, 0.65, 0.8))
        + ")",
        _SCORES_CTE,
    ),
)
def threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(evaluation.threshold_report(_two_scores(spark, sf_dir), RULE_SCORE))


@query(
    "class_report",
    over_decisions(
        f"""
        SELECT class, {_ROUNDED}, support FROM (
            SELECT * FROM per
            UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score),
                CAST(sum(support) AS BIGINT) FROM per
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support)::DOUBLE,
                sum(recall * support) / sum(support)::DOUBLE,
                sum(f1_score * support) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT)
                FROM per
        )
        """,
        _SCORES_CTE,
        "lab AS (SELECT isFraud AS y, CASE WHEN rule_score >= 0.5 THEN 1 ELSE 0 END AS p FROM sc)",
        """
        per AS (
            SELECT CAST(c AS VARCHAR) AS class,
                count(*) FILTER (y = c AND p = c) / count(*) FILTER (p = c)::DOUBLE AS precision,
                count(*) FILTER (y = c AND p = c) / count(*) FILTER (y = c)::DOUBLE AS recall,
                2 * count(*) FILTER (y = c AND p = c)
                    / (count(*) FILTER (p = c) + count(*) FILTER (y = c))::DOUBLE AS f1_score,
                count(*) FILTER (y = c) AS support
            FROM lab, (VALUES (0), (1)) AS v(c) GROUP BY c
        )
        """,
        "acc AS (SELECT count(*) FILTER (y = p) / count(*)::DOUBLE AS a, count(*) AS n FROM lab)",
    ),
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(evaluation.class_report(_two_scores(spark, sf_dir), RULE_SCORE))


@query(
    "model_selection",
    over_decisions(
        f"""
        SELECT model, round(average_precision, 6) AS average_precision,
            round(recall, 6) AS recall, round(selection_score, 6) AS selection_score
        FROM (
            SELECT model, average_precision, recall,
                0.7::DOUBLE * average_precision + 0.3::DOUBLE * recall AS selection_score
            FROM ({_RANKING}) JOIN (
                SELECT '{MODEL_SCORE}' AS model, recall FROM ({_threshold_sql(MODEL_SCORE, 0.5)})
                UNION ALL
                SELECT '{RULE_SCORE}', recall FROM ({_threshold_sql(RULE_SCORE, 0.5)})
            ) USING (model)
        ) ORDER BY selection_score DESC LIMIT 1
        """,
        _SCORES_CTE,
    ),
)
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    recalls = None
    for position, name in enumerate(SCORES):
        one = evaluation.threshold_quality(rows, name).select(
            F.lit(position).alias("position"), F.lit(name).alias("model"), "recall"
        )
        recalls = one if recalls is None else recalls.unionByName(one)
    candidates = evaluation.ranking_quality(rows, SCORES).join(recalls, "model")
    best = evaluation.select_model(candidates)
    return best.withColumns(
        {c: F.round(c, 6) for c in ("average_precision", "recall", "selection_score")}
    )


# Baseline and current parts of the event stream; the current one is shifted.
_CUT = "2024-01-16"


def _drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = scoring.add_features(event_stream(spark, sf_dir))
    before = F.col("event_timestamp") < F.lit(_CUT).cast("timestamp")
    baseline, current = rows.filter(before), rows.filter(~before)
    shifted = current.withColumn("amount", F.col("amount") * 3)
    return baseline, scoring.add_features(shifted)


_SIDES_CTE = f"""
    drift_base AS (SELECT * FROM evf WHERE event_timestamp < TIMESTAMP '{_CUT}'),
    drift_now AS (
        SELECT * EXCLUDE (amount, amount_to_oldbalance_ratio), amount * 3 AS amount,
            amount * 3 / (oldbalanceOrg + 1.0::DOUBLE) AS amount_to_oldbalance_ratio
        FROM evf WHERE event_timestamp >= TIMESTAMP '{_CUT}')
"""
_DECILES = ", ".join(str(i / 10) for i in range(11))


def _psi_sql(feature: str) -> str:
    return f"""
        SELECT '{feature}' AS feature, CASE WHEN any_value(points) < 2 THEN 0.0::DOUBLE ELSE
            sum((a - e) * ln(a / e)) END AS psi
        FROM (
            SELECT points,
                greatest(e_n / greatest(sum(e_n) OVER (), 1)::DOUBLE, 0.0001::DOUBLE) AS e,
                greatest(a_n / greatest(sum(a_n) OVER (), 1)::DOUBLE, 0.0001::DOUBLE) AS a
            FROM (
                SELECT lo, points,
                    (SELECT count(*) FROM drift_base WHERE {feature} >= lo
                        AND ({feature} < hi OR (last AND {feature} = hi))) AS e_n,
                    (SELECT count(*) FROM drift_now WHERE {feature} >= lo
                        AND ({feature} < hi OR (last AND {feature} = hi))) AS a_n
                FROM (
                    SELECT q AS lo, lead(q) OVER (ORDER BY q) AS hi, count(*) OVER () AS points,
                        row_number() OVER (ORDER BY q DESC) = 2 AS last
                    FROM (SELECT DISTINCT unnest(quantile_cont({feature}, [{_DECILES}])) AS q
                        FROM drift_base)
                ) WHERE hi IS NOT NULL OR points = 1
            )
        )
    """


_PSI = " UNION ALL ".join(f"({_psi_sql(f)})" for f in drift.NUMERIC_FEATURES)
_SEVERITY = (
    "CASE WHEN psi IS NULL THEN 'UNKNOWN' WHEN psi >= 0.25 THEN 'HIGH' "
    "WHEN psi >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END"
)


def _shift_sql(feature: str) -> str:
    return f"""
    SELECT '{feature}' AS feature, category, coalesce(b, 0.0::DOUBLE) AS baseline_pct,
        coalesce(c, 0.0::DOUBLE) AS current_pct,
        abs(coalesce(c, 0.0::DOUBLE) - coalesce(b, 0.0::DOUBLE)) AS absolute_change
    FROM (SELECT {feature} AS category, count(*) / (SELECT count(*) FROM drift_base)::DOUBLE AS b
            FROM drift_base GROUP BY {feature})
        FULL JOIN (SELECT {feature} AS category, count(*) / (SELECT count(*) FROM drift_now)::DOUBLE
            AS c FROM drift_now GROUP BY {feature}) USING (category)
"""


_SHIFT = _shift_sql("type")
_ALL_SHIFTS = " UNION ALL ".join(f"({_shift_sql(f)})" for f in drift.CATEGORICAL_FEATURES)
_SHARES = ("baseline_pct", "current_pct", "absolute_change")
_ROUNDED_SHARES = ", ".join(f"round({c}, 6) AS {c}" for c in _SHARES)


@query(
    "psi",
    over_events(
        f"SELECT feature, round(psi, 6) AS psi, {_SEVERITY} AS severity FROM ({_PSI})", _SIDES_CTE
    ),
)
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = drift.psi_report(*_drift_sides(spark, sf_dir))
    return report.withColumn("psi", F.round("psi", 6))


@query(
    "categorical_shift",
    over_events(
        f"SELECT feature, category, {_ROUNDED_SHARES} FROM ({_SHIFT})", _SIDES_CTE
    ),
)
def categorical_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = drift.categorical_shift(*_drift_sides(spark, sf_dir))
    return shift.withColumns({c: F.round(c, 6) for c in _SHARES})


def _report_sql(shifts: str) -> str:
    return f"""
        SELECT r.*, high_drift_features, high_drift_features <> '' AS requires_review
        FROM (
            SELECT 'numeric' AS kind, feature, NULL AS category, round(psi, 6) AS psi, severity,
                NULL::DOUBLE AS baseline_pct, NULL::DOUBLE AS current_pct,
                NULL::DOUBLE AS absolute_change
            FROM found
            UNION ALL
            SELECT 'categorical', feature, category, NULL, NULL, {_ROUNDED_SHARES} FROM ({shifts})
        ) r, (SELECT coalesce(string_agg(feature, ', ' ORDER BY feature), '')
            AS high_drift_features FROM found WHERE severity = 'HIGH')
    """


_FOUND_CTE = f"found AS (SELECT feature, psi, {_SEVERITY} AS severity FROM ({_PSI}))"


@query("drift_report", over_events(_report_sql(_SHIFT), _SIDES_CTE, _FOUND_CTE))
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = drift.drift_report(*_drift_sides(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ("psi", *_SHARES)})


_DECIDED_CTE = """
    drift_base AS (SELECT * FROM dec WHERE step < 0),
    drift_now AS (SELECT * FROM dec WHERE step >= 0 AND final_decision <> 'APPROVE')
"""


@query("drift_decisions", over_decisions(_report_sql(_ALL_SHIFTS), _DECIDED_CTE, _FOUND_CTE))
def drift_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of features, types, model levels and final decisions between scored
    transactions of the first years and those of later years that were not approved."""
    rows = scoring.add_features(decided(spark, sf_dir))
    later = rows.filter("step >= 0 AND final_decision <> 'APPROVE'")
    report = drift.drift_report(rows.filter("step < 0"), later)
    return report.withColumns({c: F.round(c, 6) for c in ("psi", *_SHARES)})


_MODELS: dict[tuple[str, str], PipelineModel] = {}


def _forest(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The forest for a data folder, trained once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        train, _ = splits.parts(splits.validation_split(transactions(spark, sf_dir))[0])
        _MODELS[key] = training.train_forest(train)
    return _MODELS[key]


def _training_sql(model: str) -> str:
    """What a training run must report, whatever the learner finds."""
    return over_txn(
        f"""
        SELECT '{model}' AS model, '{splits.TEMPORAL}' AS strategy,
            count(*) FILTER (part = 'train') AS train_rows,
            CAST(sum(isFraud) FILTER (part = 'train') AS BIGINT) AS train_positives,
            count(*) FILTER (part = 'test') AS confusion_total,
            CAST(sum(isFraud) FILTER (part = 'test') AS BIGINT) AS confusion_positives,
            TRUE AS metrics_in_range, TRUE AS better_than_chance
        FROM (
            SELECT isFraud, CASE WHEN row_number() OVER (ORDER BY step, {_HASH.format(key="event_id")})
                <= CAST(floor((SELECT count(*) FROM txn) * 0.8::DOUBLE) AS BIGINT)
                THEN 'train' ELSE 'test' END AS part
            FROM txn
        )
        """
    )


def _run(spark: SparkSession, sf_dir: str, name: str, fit, params: dict) -> DataFrame:
    """A training run: its parts, the confusion counts on the held-out rows, its metrics."""
    split, strategy = splits.validation_split(transactions(spark, sf_dir).drop("fraud_probability"))
    train, test = splits.parts(split)
    model = fit(train)
    scored = written(
        scoring.predict_probability(test, model).select(training.LABEL, scoring.PROBABILITY), "held-out"
    )
    candidate = training.Candidate(name, model, params, training.measures(scored))
    metrics = training.run_records(split, [candidate]).select("model", "metrics", "selection_score")
    at_half = evaluation.threshold_report(scored, scoring.PROBABILITY, training.LABEL).filter(
        F.col("threshold") == 0.5
    )
    counts = train.agg(
        F.count("*").alias("train_rows"), F.sum(F.col(training.LABEL).cast("bigint")).alias("train_positives")
    )
    kinds = [f"{side}_{sign}" for side in ("true", "false") for sign in ("positives", "negatives")]
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    values = F.map_values("metrics")
    inside = F.forall(F.concat(values, F.array("selection_score")), lambda v: (v >= 0) & (v <= 1))
    one = F.lit(1).alias("_one")
    joined = metrics.select("*", one).join(at_half.select(*kinds, one), "_one").join(counts.select("*", one), "_one")
    return joined.select(
        "model",
        F.lit(strategy).alias("strategy"),
        "train_rows",
        "train_positives",
        total.cast("bigint").alias("confusion_total"),
        (F.col("true_positives") + F.col("false_negatives")).cast("bigint").alias("confusion_positives"),
        inside.alias("metrics_in_range"),
        (F.col("metrics")["roc_auc"] > 0.5).alias("better_than_chance"),
    )


@query("train_rf", _training_sql("random_forest"))
def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "random_forest", training.train_forest, training.FOREST)


@query("train_gbt", _training_sql("boosted_trees"))
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "boosted_trees", training.train_boosted, training.BOOSTED)


def _follows(probability: str, tolerance: float = 0.0, alert: bool = True) -> Column:
    """Whether level, decision and alert follow from the probability and the rules.

    The SQL side of these queries states only that they do for every row.  With
    a tolerance, a probability that near a limit may fall on either side.
    """
    p, rules = F.col(probability), F.col("rule_risk_score")

    def expected(high: Column, middle: Column) -> Column:
        level = F.when(high, "HIGH").when(middle, "MEDIUM").otherwise("LOW")
        text = (
            F.when(high, "Fraud suspected").when(middle, "Manual review required").otherwise("Transaction looks normal")
        )
        decision = (
            F.when(high | (rules >= 70), "BLOCK / MANUAL REVIEW")
            .when(middle | (rules >= 40), "MANUAL REVIEW")
            .otherwise("APPROVE")
        )
        same = (F.col("risk_level") == level) & (F.col("final_decision") == decision)
        return same & (F.col("alert") == text) if alert else same

    shifts = (0.0, tolerance, -tolerance) if tolerance else (0.0,)
    return reduce(or_, [expected(p >= 0.8 + d, p >= 0.5 + d) for d in shifts])


@query(
    "score_batch",
    over_decisions("SELECT event_id, rule_risk_score, rule_risk_level, triggered_rules, TRUE AS follows FROM dec"),
)
def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    model = _forest(spark, sf_dir)
    scored = scoring.flat_result(scoring.score(rows, model))
    # Levels hold for the unrounded probability; the model gives it again.
    exact = scoring.predict_probability(scored.withColumnRenamed(scoring.PROBABILITY, "_rounded"), model)
    near = F.abs(F.col("_rounded") - F.col(scoring.PROBABILITY)) <= 1e-4
    return exact.select(
        "event_id",
        "rule_risk_score",
        "rule_risk_level",
        "triggered_rules",
        (_follows(scoring.PROBABILITY) & near).alias("follows"),
    )


@query(
    "explain_topk",
    over_txn("SELECT event_id, CAST(rank AS INTEGER) AS rank, TRUE AS is_row_value FROM txn, range(1, 6) AS r(rank)"),
)
def explain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _forest(spark, sf_dir)
    rows = scoring.add_features(transactions(spark, sf_dir))
    explained = explain(rows, model).select(*rows.columns, F.posexplode("explanation").alias("place", "e"))
    types = F.array(*[F.lit(t) for t in scoring.known_types(model)])
    numbers = [
        F.struct(F.lit(n).alias("k"), (F.array_position(types, F.col(n)) - 1 if n == "type" else F.col(n)).cast("double").alias("v"))
        for n in MODEL_COLUMNS
    ]
    own = F.map_from_entries(F.array(*numbers))[F.col("e.feature")]
    return explained.select(
        "event_id", (F.col("place") + 1).alias("rank"), own.eqNullSafe(F.col("e.feature_value")).alias("is_row_value")
    )


@query(
    "score_stream",
    over_events(
        "SELECT event_id, type, rule_risk_score, rule_risk_level, TRUE AS follows FROM ruled WHERE "
        + " AND ".join(f"CAST(event_id AS BIGINT) % {n} <> 0" for n in (11, 13, 17, 19, 23, 31)),
        "feat AS (SELECT evf.*, 0.0::DOUBLE AS fraud_probability FROM evf)",
        RULE_CTE,
    ),
)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw channel to scored channel, logs and dead letters in one stream."""
    channel, root = raw_channel(spark, sf_dir, "score_stream")
    lake = Lake(root)
    pipelines.start_scoring(
        spark,
        channel,
        _forest(spark, sf_dir),
        Channel("parquet", path=f"{root}/scored"),
        Channel("parquet", path=f"{root}/errors"),
        lake,
        once=True,
    ).awaitTermination()
    scored = spark.read.format(lake.format).load(f"{root}/logs/scored")
    return scored.select(
        "event_id", "type", "rule_risk_score", "rule_risk_level", _follows(scoring.PROBABILITY, 1e-4, alert=False).alias("follows")
    )
