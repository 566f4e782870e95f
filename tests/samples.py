"""Small inputs and plain-Python oracles for the tests."""

from __future__ import annotations

import json

# An emptied sender, a flagged transfer over the limit: 25 + 25 + 15 + 30 = 95 points.
HIGH = {
    "event_id": "h", "event_time": "2031-03-05T09:30:00Z", "source_dataset": "feed-a",
    "step": 7, "type": "TRANSFER", "amount": 310000.0, "sender_id": "S77", "receiver_id": "R12",
    "oldbalanceOrg": 310000.0, "newbalanceOrig": 0.0, "oldbalanceDest": 40.0,
    "newbalanceDest": 310040.0, "isFlaggedFraud": 1, "isFraud": 1,
}
# A small payment whose balances agree: no rule, 0 points.
LOW = HIGH | {
    "event_id": "l", "type": "PAYMENT", "amount": 62.5, "oldbalanceOrg": 810.0,
    "newbalanceOrig": 747.5, "newbalanceDest": 40.0, "isFlaggedFraud": 0, "isFraud": 0,
}


def frame(spark, rows):
    from txnloom.schemas import CANONICAL_EVENT

    return spark.createDataFrame(
        [tuple(r.get(n) for n in CANONICAL_EVENT.names) for r in rows], CANONICAL_EVENT
    )


def message(**changes) -> str:
    event = HIGH | changes
    return json.dumps({k: v for k, v in event.items() if v != "DROP"})


def expected_score(t: dict) -> tuple[int, list[bool]]:
    """The rule book again, one row at a time."""
    moved = {"TRANSFER", "CASH_OUT"}
    kind = t["type"].upper()
    fired = [
        t["amount"] >= 200000,
        kind in moved and t["oldbalanceOrg"] > 0 and t["newbalanceOrig"] == 0,
        kind in moved,
        t["isFlaggedFraud"] == 1,
        kind != "CASH_IN" and t["oldbalanceOrg"] >= t["amount"]
        and abs(t["oldbalanceOrg"] - t["amount"] - t["newbalanceOrig"]) > 1,
        kind in moved and abs(t["oldbalanceDest"] + t["amount"] - t["newbalanceDest"]) > 1,
    ]
    points = (25, 25, 15, 30, 15, 15)
    return min(100, sum(p for p, f in zip(points, fired, strict=True) if f)), fired
