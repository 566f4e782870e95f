"""Retraining job: check the dataset, train, evaluate, select, report."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.functions.features import MODEL_COLUMNS
from txnloom.operators import evaluation, splits, training
from txnloom.operators.scoring import PROBABILITY, predict_probability
from txnloom.sources.readers import load_training, require_rows
from txnloom.sources.writers import append, write_report

# What a reader of a model report should know about this library's training.
GOVERNANCE_NOTES = (
    "The held-out rows are the latest ones where both parts have two classes, else a stratified part.",
    "Metrics are computed on all held-out rows; max_rows bounds the fitted rows only.",
    "The threshold table lists five cutoffs; which one to use is not decided here.",
    "Types absent from the fitted rows are rejected when scoring.",
)


@dataclass(frozen=True)
class Outcome:
    best: training.Candidate
    candidates: list[training.Candidate]
    report: DataFrame
    runs: DataFrame


def candidates(train: DataFrame, test: DataFrame, **sizes) -> list[training.Candidate]:
    """Both learners fitted on the training part and measured on the test part.

    ``sizes`` may override the number of trees: ``forest`` and ``boosted``.
    """
    found = []
    learners = (
        ("random_forest", training.train_forest, training.FOREST, sizes.get("forest", {})),
        ("boosted_trees", training.train_boosted, training.BOOSTED, sizes.get("boosted", {})),
    )
    for name, fit, params, overrides in learners:
        model = fit(train, **overrides)
        metrics = training.evaluate(model, test)
        found.append(training.Candidate(name, model, params | overrides, metrics))
    return found


def model_report(
    counts: Mapping[str, int],
    test: DataFrame,
    best: training.Candidate,
    strategy: str,
    dataset: str,
    model_path: str,
) -> DataFrame:
    """The one-row report document of a retraining run.

    ``counts`` has the rows of the whole dataset (training_rows), of those the
    fitted_rows and the held_out_rows; with ``max_rows`` some are neither.
    """
    scored = predict_probability(test, best.model).select(training.LABEL, PROBABILITY)
    line = F.struct(
        "threshold",
        "precision",
        "recall",
        "f1_score",
        "true_positives",
        "false_positives",
        "false_negatives",
        "true_negatives",
    )
    thresholds = evaluation.threshold_report(scored, PROBABILITY, training.LABEL).agg(
        F.array_sort(F.collect_list(line)).alias("threshold_report")
    )
    metrics = F.struct(*[F.lit(float(v)).alias(k) for k, v in best.metrics.items()])
    return thresholds.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("retrained_at"),
        F.lit(dataset).alias("dataset_path"),
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("training_rows", "fitted_rows", "held_out_rows")],
        F.lit(strategy).alias("validation_strategy"),
        F.array(*[F.lit(c) for c in MODEL_COLUMNS]).alias("features"),
        F.lit(training.LABEL).alias("target"),
        F.lit(best.name).alias("best_model_name"),
        metrics.alias("best_metrics"),
        "threshold_report",
        F.lit(float(best.score)).alias("best_selection_score"),
        F.array(*[F.lit(n) for n in GOVERNANCE_NOTES]).alias("model_governance_notes"),
        F.lit(model_path).alias("model_path"),
    )


def retrain(
    rows: DataFrame,
    output: str,
    dataset: str = "",
    max_rows: int | None = None,
    **sizes,
) -> Outcome:
    """Train both learners on canonical events and keep the better one.

    All rows of the training part are fitted by default; ``max_rows`` fits a
    repeatable sample of it.  The held-out part is always whole.  Writes the
    model, the report (twice: metadata and history) and the run records below
    ``output``.
    """
    require_rows(rows, dataset or "training rows")
    training.require_two_classes(rows)
    split, strategy = splits.validation_split(rows)
    train, test = splits.parts(split)
    sizes_of = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    fitted = sizes_of.get(splits.TRAIN, 0)
    if max_rows is not None:
        train = splits.sample_rows(train, max_rows)
        fitted = train.count()
    counts = {
        "training_rows": sum(sizes_of.values()),
        "fitted_rows": fitted,
        "held_out_rows": sizes_of.get(splits.TEST, 0),
    }
    found = candidates(train, test, **sizes)
    best = max(found, key=lambda c: c.score)  # max keeps the first of equals
    model_path = f"{output}/model"
    best.model.write().overwrite().save(model_path)
    report = model_report(counts, test, best, strategy, dataset, model_path)
    runs = training.run_records(rows, found)
    write_report(report, f"{output}/model_metadata", f"{output}/retraining_report")
    append(runs, f"{output}/model_runs")
    require_artifacts(rows.sparkSession, output)
    return Outcome(best, found, report, runs)


def require_artifacts(spark: SparkSession, output: str) -> PipelineModel:
    """Read back what the run must leave; fails when something is missing."""
    require_rows(spark.read.json(f"{output}/model_metadata"), "model metadata")
    return PipelineModel.load(f"{output}/model")


def retrain_file(spark: SparkSession, path: str, output: str, **options) -> Outcome:
    """Retrain from a PaySim file."""
    return retrain(load_training(spark, path), output, dataset=path, **options)


def report_json(outcome: Outcome) -> dict:
    """The report document as a mapping."""
    return json.loads(outcome.report.toJSON().first())
