"""The risk rules as data: points, message and a condition per rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnloom.functions.features import movement_gap

# Thresholds, points and texts of the rule book.
HIGH_VALUE_AMOUNT = 200000
RISKY_TYPES = ("TRANSFER", "CASH_OUT")
BALANCE_TOLERANCE = 1
SCORE_CAP = 100
HIGH_SCORE = 70
MEDIUM_SCORE = 40


@dataclass(frozen=True)
class Facts:
    """Transaction fields as the rules see them: no nulls, type in capitals."""

    kind: Column
    amount: Column
    sender_before: Column
    sender_after: Column
    receiver_before: Column
    receiver_after: Column
    flagged: Column

    @property
    def risky(self) -> Column:
        return self.kind.isin(*RISKY_TYPES)


@dataclass(frozen=True)
class Rule:
    points: int
    message: str
    fires: Callable[[Facts], Column]


RULES = (
    Rule(
        25,
        "High value transaction amount >= 200000",
        lambda t: t.amount >= HIGH_VALUE_AMOUNT,
    ),
    Rule(
        25,
        "Sender balance became zero after transaction",
        lambda t: t.risky & (t.sender_after == 0) & (t.sender_before > 0),
    ),
    Rule(
        15,
        "Risky transaction type: TRANSFER/CASH_OUT",
        lambda t: t.risky,
    ),
    Rule(
        30,
        "Transaction already flagged by system rule",
        lambda t: t.flagged == 1,
    ),
    Rule(
        15,
        "Sender balance movement mismatch",
        lambda t: (t.kind != "CASH_IN")
        & (t.sender_before >= t.amount)
        & (movement_gap(t.sender_before, -t.amount, t.sender_after) > BALANCE_TOLERANCE),
    ),
    Rule(
        15,
        "Receiver balance movement mismatch",
        lambda t: t.risky
        & (movement_gap(t.receiver_before, t.amount, t.receiver_after) > BALANCE_TOLERANCE),
    ),
)


def facts(columns: list[str]) -> Facts:
    """Read the rule inputs, taking 0 or '' for an absent field or value."""

    def pick(name: str, default: object) -> Column:
        if name not in columns:
            return F.lit(default)
        return F.coalesce(F.col(name), F.lit(default))

    return Facts(
        kind=F.upper(pick("type", "")),
        amount=pick("amount", 0.0),
        sender_before=pick("oldbalanceOrg", 0.0),
        sender_after=pick("newbalanceOrig", 0.0),
        receiver_before=pick("oldbalanceDest", 0.0),
        receiver_after=pick("newbalanceDest", 0.0),
        flagged=pick("isFlaggedFraud", 0),
    )


def risk_columns(columns: list[str]) -> dict[str, Column]:
    """Capped score, its level and the messages of the rules that fired."""
    seen = facts(columns)
    hits = [(rule, rule.fires(seen)) for rule in RULES]
    score = F.lit(0)
    for rule, hit in hits:
        score = score + F.when(hit, rule.points).otherwise(0)
    capped = F.least(score, F.lit(SCORE_CAP))
    return {
        "rule_risk_score": capped,
        "rule_risk_level": risk_level(capped, HIGH_SCORE, MEDIUM_SCORE),
        "triggered_rules": F.array_compact(
            F.array(*[F.when(hit, F.lit(rule.message)) for rule, hit in hits])
        ),
    }


def risk_level(measure: Column, high: float, medium: float) -> Column:
    return (
        F.when(measure >= high, "HIGH").when(measure >= medium, "MEDIUM").otherwise("LOW")
    )
