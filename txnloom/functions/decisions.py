"""Model risk level and the final decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnloom.functions.rules import MEDIUM_SCORE, risk_level

# Probability bounds and the texts shown for each outcome.
HIGH_PROBABILITY = 0.80
REVIEW_PROBABILITY = 0.50
ALERTS = {
    "HIGH": "Fraud suspected",
    "MEDIUM": "Manual review required",
    "LOW": "Transaction looks normal",
}
BLOCK = "BLOCK / MANUAL REVIEW"
REVIEW = "MANUAL REVIEW"
APPROVE = "APPROVE"
RULE_SEPARATOR = " | "


def model_level(probability: Column) -> Column:
    return risk_level(probability, HIGH_PROBABILITY, REVIEW_PROBABILITY)


def alert_text(level: Column) -> Column:
    text = F.when(level == "HIGH", ALERTS["HIGH"]).when(level == "MEDIUM", ALERTS["MEDIUM"])
    return text.otherwise(ALERTS["LOW"])


def final_decision(
    level: Column, rule_level: Column, probability: Column, rule_score: Column
) -> Column:
    blocked = (level == "HIGH") | (rule_level == "HIGH")
    reviewed = (probability >= REVIEW_PROBABILITY) | (rule_score >= MEDIUM_SCORE)
    return F.when(blocked, BLOCK).when(reviewed, REVIEW).otherwise(APPROVE)


def joined_rules(rules: Column) -> Column:
    return F.array_join(rules, RULE_SEPARATOR)
