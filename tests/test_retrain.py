import pytest

from txnloom.operators import training
from txnloom.operators.explain import explain, importances
from txnloom.operators.scoring import score
from txnloom.plans import retrain
from txnloom.plans.fixtures import transactions

SMALL = {"forest": {"numTrees": 8, "maxDepth": 5}, "boosted": {"maxIter": 4, "maxDepth": 3}}


@pytest.fixture(scope="module")
def outcome(spark, sf_dir, tmp_path_factory):
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    output = str(tmp_path_factory.mktemp("retrain"))
    return retrain.retrain(rows, output, dataset="orders", **SMALL), output


def test_report_and_artifacts(spark, outcome):
    result, output = outcome
    report = retrain.report_json(result)
    assert report["training_rows"] == 1500 and report["target"] == "isFraud"
    assert (report["fitted_rows"], report["held_out_rows"]) == (1200, 300)
    assert report["validation_strategy"] == "temporal_holdout_by_step"
    assert report["best_model_name"] == result.best.name
    assert [t["threshold"] for t in report["threshold_report"]] == [0.2, 0.35, 0.5, 0.65, 0.8]
    assert len(report["features"]) == 12
    assert spark.read.parquet(f"{output}/model_runs").count() == 2
    assert spark.read.json(f"{output}/retraining_report").first()["dataset_path"] == "orders"
    assert result.best.score == max(c.score for c in result.candidates)
    assert result.best.metrics["roc_auc"] > 0.9


def test_saved_model_scores_and_explains(spark, sf_dir, outcome):
    _, output = outcome
    model = retrain.require_artifacts(spark, output)
    rows = transactions(spark, sf_dir).drop("fraud_probability")
    scored = score(rows, model)
    assert scored.count() == 1500
    assert scored.columns == [*rows.columns, "fraud_probability", "rule_risk_score",
                              "rule_risk_level", "triggered_rules", "risk_level", "alert",
                              "final_decision"]
    odd = rows.limit(3).selectExpr("* EXCEPT (type)", "'CHEQUE' AS type")
    assert score(odd, model).count() == 0
    with pytest.raises(Exception, match="CHEQUE"):
        score(odd, model, mode="fail").collect()

    row = explain(rows, model).first()
    assert len(row["explanation"]) == 5
    impacts = [e["impact_score"] for e in row["explanation"]]
    assert impacts == sorted(impacts, reverse=True)
    assert [e["feature"] for e in row["explanation"]] == [n for n, _ in importances(model)[:5]]


def test_sampled_training_and_guards(spark, sf_dir, tmp_path):
    rows = transactions(spark, sf_dir)
    with pytest.raises(ValueError, match="empty"):
        retrain.retrain(rows.limit(0), str(tmp_path))
    with pytest.raises(ValueError, match="one class"):
        retrain.retrain(rows.filter("isFraud = 0"), str(tmp_path))


def test_encode_type(spark):
    rows = spark.createDataFrame([("B", "x"), ("A", "y"), ("C", "z")], "type string, nameOrig string")
    got = training.encode_type(rows)
    assert [r["type"] for r in got.collect()] == [1, 0, 2] and got.columns == ["type"]
