"""Risk rules, model probability and decision for whole tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.functions.casts import utc_now_text
from txnloom.functions.decisions import alert_text, final_decision, joined_rules, model_level
from txnloom.functions.features import balance_features
from txnloom.functions.rules import risk_columns
from txnloom.operators.quality import check_types
from txnloom.schemas import CANONICAL_EVENT, PREDICTION

PROBABILITY = "fraud_probability"
PROBABILITY_DIGITS = 4


def add_features(df: DataFrame) -> DataFrame:
    return df.withColumns(balance_features())


def apply_rules(df: DataFrame) -> DataFrame:
    """Add rule score, rule level and the array of triggered messages."""
    return df.withColumns(risk_columns(df.columns))


def decide(df: DataFrame) -> DataFrame:
    """Add level, alert and final decision from probability and rules.

    The tests use the full probability; it is rounded afterwards for display,
    so rounding never changes a decision.
    """
    probability = F.col(PROBABILITY)
    level = model_level(probability)
    return df.withColumns(
        {
            "risk_level": level,
            "alert": alert_text(level),
            "final_decision": final_decision(
                level, F.col("rule_risk_level"), probability, F.col("rule_risk_score")
            ),
            PROBABILITY: F.round(probability, PROBABILITY_DIGITS),
        }
    )


def known_types(model: PipelineModel) -> tuple[str, ...]:
    """The transaction types a model was fitted on."""
    return tuple(model.stages[0].labels)


def predict_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the model's probability of the positive class, in the JVM."""
    kept = [c for c in df.columns if c != PROBABILITY]
    with_features = add_features(df) if "balance_diff_orig" not in kept else df
    scored = model.transform(with_features)
    positive = vector_to_array(F.col("probability")).getItem(1)
    return scored.select(*kept, positive.alias(PROBABILITY))


def score(
    df: DataFrame,
    model: PipelineModel,
    allowed_types: tuple[str, ...] | None = None,
    mode: str = "reject",
) -> DataFrame:
    """Input columns plus the seven prediction columns.

    Rows of a type the model was not fitted on (or not in ``allowed_types``)
    cannot be scored: ``reject`` leaves them out (take them from
    ``quality.check_types``), ``fail`` stops the job.
    """
    known = known_types(model)
    if allowed_types is not None:
        known = tuple(t for t in known if t in allowed_types)
    checked = check_types(df, known, mode)
    if mode == "reject":
        checked = checked.filter(F.col("type_error").isNull()).drop("type_error")
    return decide(apply_rules(predict_probability(checked, model)))


def flat_result(scored: DataFrame) -> DataFrame:
    """Scored rows with the rule messages joined to one text."""
    return scored.withColumn("triggered_rules", joined_rules(F.col("triggered_rules")))


def as_prediction() -> Column:
    return F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION.fields])


def scored_event(scored: DataFrame, scored_at: Column | None = None) -> DataFrame:
    """Nested scored event: the raw event, its prediction and the time."""
    kept = [n for n in CANONICAL_EVENT.names if n in scored.columns]
    extra = [n for n in ("explanation", "prediction_log_id") if n in scored.columns]
    if "prediction_log_id" not in extra:
        extra.append(F.lit(None).cast("int").alias("prediction_log_id"))
    return scored.select(
        *kept,
        as_prediction().alias("prediction"),
        *extra,
        (scored_at if scored_at is not None else utc_now_text()).alias("scored_at"),
    )
