import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import HIGH, LOW, expected_score, frame

from txnloom.functions.rules import RULES
from txnloom.operators import scoring


def ruled(spark, rows):
    return {r["event_id"]: r for r in scoring.apply_rules(frame(spark, rows)).collect()}


def test_known_vectors(spark):
    found = ruled(spark, [HIGH, LOW])
    assert found["h"]["rule_risk_score"] == 95
    assert found["h"]["rule_risk_level"] == "HIGH"
    assert found["h"]["triggered_rules"] == [RULES[i].message for i in (0, 1, 2, 3)]
    assert (found["l"]["rule_risk_score"], found["l"]["rule_risk_level"]) == (0, "LOW")
    assert found["l"]["triggered_rules"] == []


def test_all_rules_are_capped_at_100(spark):
    every = HIGH | {"amount": 200000.0, "oldbalanceOrg": 300000.0, "newbalanceDest": 0.0}
    row = ruled(spark, [every])["h"]
    assert len(row["triggered_rules"]) == 6
    assert row["rule_risk_score"] == 100


def test_absent_values_count_as_zero(spark):
    empty = {k: None for k in HIGH} | {"event_id": "e"}
    row = ruled(spark, [empty])["e"]
    assert (row["rule_risk_score"], row["triggered_rules"]) == (0, [])
    only_type = spark.createDataFrame([("transfer",)], "type string")
    assert scoring.apply_rules(only_type).first()["rule_risk_score"] == 15


money = st.sampled_from([0.0, 1.0, 500.0, 199999.99, 200000.0, 250000.0, 300000.0])
txn = st.fixed_dictionaries(
    {
        "type": st.sampled_from(["TRANSFER", "cash_out", "PAYMENT", "CASH_IN", "Debit"]),
        "amount": money, "oldbalanceOrg": money, "newbalanceOrig": money,
        "oldbalanceDest": money, "newbalanceDest": money,
        "isFlaggedFraud": st.sampled_from([0, 1]),
    }
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(txn, min_size=40, max_size=60))
def test_rules_match_the_row_oracle(spark, rows):
    full = [HIGH | r | {"event_id": str(i)} for i, r in enumerate(rows)]
    found = ruled(spark, full)
    for row in full:
        score, fired = expected_score(row)
        got = found[row["event_id"]]
        assert got["rule_risk_score"] == score
        assert 0 <= score <= 100
        assert got["triggered_rules"] == [
            rule.message for rule, hit in zip(RULES, fired, strict=True) if hit
        ]


@pytest.mark.parametrize(
    ("probability", "score", "level", "rule_level", "decision"),
    [
        (0.80, 0, "HIGH", "LOW", "BLOCK / MANUAL REVIEW"),
        (0.79996, 0, "MEDIUM", "LOW", "MANUAL REVIEW"),
        (0.50, 0, "MEDIUM", "LOW", "MANUAL REVIEW"),
        (0.49996, 0, "LOW", "LOW", "APPROVE"),
        (0.0, 70, "LOW", "HIGH", "BLOCK / MANUAL REVIEW"),
        (0.0, 40, "LOW", "MEDIUM", "MANUAL REVIEW"),
        (0.0, 39, "LOW", "LOW", "APPROVE"),
    ],
)
def test_decisions_use_the_unrounded_probability(
    spark, probability, score, level, rule_level, decision
):
    row = spark.range(1).select(
        F.lit(probability).alias("fraud_probability"),
        F.lit(score).alias("rule_risk_score"),
        F.lit(rule_level).alias("rule_risk_level"),
    )
    got = scoring.decide(row).first()
    assert (got["risk_level"], got["final_decision"]) == (level, decision)
    assert got["fraud_probability"] == round(probability, 4)


def test_features(spark):
    row = HIGH | {
        "amount": 1000.0, "oldbalanceOrg": 5000.0, "newbalanceOrig": 4000.0,
        "oldbalanceDest": 1000.0, "newbalanceDest": 2000.0,
    }
    got = scoring.add_features(frame(spark, [row])).first()
    assert (got["balance_diff_orig"], got["balance_diff_dest"]) == (1000.0, 1000.0)
    assert got["is_zero_balance_after_txn"] == 0
    assert got["amount_to_oldbalance_ratio"] == pytest.approx(1000 / 5001)


def test_features_tolerate_a_zero_divisor(spark):
    got = scoring.add_features(frame(spark, [HIGH | {"oldbalanceOrg": -1.0}])).first()
    assert got["amount_to_oldbalance_ratio"] is None
