"""SQL building blocks of the oracle side, written apart from the operators."""

from __future__ import annotations

from txnloom.plans.fixtures import EVENT_CTE, REQUEST_CTE, TXN_CTE

_FEATURES = """
    oldbalanceOrg - newbalanceOrig AS balance_diff_orig,
    newbalanceDest - oldbalanceDest AS balance_diff_dest,
    amount / (oldbalanceOrg + CAST(1 AS DOUBLE)) AS amount_to_oldbalance_ratio,
    CAST(CASE WHEN newbalanceOrig = 0 THEN 1 ELSE 0 END AS INTEGER)
        AS is_zero_balance_after_txn,
    CAST(CASE WHEN abs((oldbalanceOrg - amount) - newbalanceOrig) > 1 THEN 1 ELSE 0 END
        AS INTEGER) AS sender_balance_mismatch,
    CAST(CASE WHEN abs((oldbalanceDest + amount) - newbalanceDest) > 1 THEN 1 ELSE 0 END
        AS INTEGER) AS receiver_balance_mismatch
"""

FEAT_CTE = f"feat AS (SELECT txn.*, {_FEATURES} FROM txn)"
EVENT_FEAT_CTE = f"evf AS (SELECT ev.*, {_FEATURES} FROM ev)"

RULE_CTE = """
hits AS (
    SELECT feat.*,
        amount >= 200000 AS r1,
        type IN ('TRANSFER','CASH_OUT') AND oldbalanceOrg > 0 AND newbalanceOrig = 0 AS r2,
        type IN ('TRANSFER','CASH_OUT') AS r3,
        isFlaggedFraud = 1 AS r4,
        type <> 'CASH_IN' AND oldbalanceOrg >= amount
            AND abs((oldbalanceOrg - amount) - newbalanceOrig) > 1 AS r5,
        type IN ('TRANSFER','CASH_OUT')
            AND abs((oldbalanceDest + amount) - newbalanceDest) > 1 AS r6
    FROM feat
), points AS (
    SELECT hits.*,
        CAST(least(100, CASE WHEN r1 THEN 25 ELSE 0 END + CASE WHEN r2 THEN 25 ELSE 0 END
            + CASE WHEN r3 THEN 15 ELSE 0 END + CASE WHEN r4 THEN 30 ELSE 0 END
            + CASE WHEN r5 THEN 15 ELSE 0 END + CASE WHEN r6 THEN 15 ELSE 0 END) AS INTEGER)
            AS rule_risk_score,
        concat_ws(' | ',
            CASE WHEN r1 THEN 'High value transaction amount >= 200000' END,
            CASE WHEN r2 THEN 'Sender balance became zero after transaction' END,
            CASE WHEN r3 THEN 'Risky transaction type: TRANSFER/CASH_OUT' END,
            CASE WHEN r4 THEN 'Transaction already flagged by system rule' END,
            CASE WHEN r5 THEN 'Sender balance movement mismatch' END,
            CASE WHEN r6 THEN 'Receiver balance movement mismatch' END) AS triggered_rules
    FROM hits
), ruled AS (
    SELECT points.*,
        CASE WHEN rule_risk_score >= 70 THEN 'HIGH' WHEN rule_risk_score >= 40 THEN 'MEDIUM'
            ELSE 'LOW' END AS rule_risk_level
    FROM points
), dec AS (
    SELECT ruled.*,
        CASE WHEN fraud_probability >= 0.8 THEN 'HIGH' WHEN fraud_probability >= 0.5 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_level,
        CASE WHEN fraud_probability >= 0.8 THEN 'Fraud suspected'
            WHEN fraud_probability >= 0.5 THEN 'Manual review required'
            ELSE 'Transaction looks normal' END AS alert,
        CASE WHEN fraud_probability >= 0.8 OR rule_risk_score >= 70 THEN 'BLOCK / MANUAL REVIEW'
            WHEN fraud_probability >= 0.5 OR rule_risk_score >= 40 THEN 'MANUAL REVIEW'
            ELSE 'APPROVE' END AS final_decision
    FROM ruled
)
"""

# What the raw channel holds after the seeded faults, by event number.
MESSAGE_CTE = """
msg AS (
    SELECT ev.*, CAST(event_id AS BIGINT) AS n,
        CAST(event_id AS BIGINT) % 17 = 0 OR CAST(event_id AS BIGINT) % 23 = 0
            OR CAST(event_id AS BIGINT) % 31 = 0 AS no_event,
        CASE WHEN CAST(event_id AS BIGINT) % 11 = 0 OR CAST(event_id AS BIGINT) % 13 = 0
            THEN NULL ELSE amount END AS read_amount,
        CASE WHEN CAST(event_id AS BIGINT) % 19 = 0 THEN NULL ELSE step END AS read_step
    FROM ev
), bronze AS (
    SELECT event_id, event_time, source_dataset, read_step AS step, type, read_amount AS amount,
        sender_id, receiver_id, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
        isFlaggedFraud, isFraud, event_timestamp
    FROM msg WHERE NOT no_event
)
"""

REASON = """
    CASE WHEN n % 23 = 0 OR n % 31 = 0 THEN 'event missing required fields: event_id, '
            || 'event_time, source_dataset, step, type, amount, oldbalanceOrg, newbalanceOrig, '
            || 'oldbalanceDest, newbalanceDest, isFlaggedFraud'
        WHEN n % 17 = 0 THEN 'event is not valid JSON'
        WHEN n % 19 = 0 AND n % 11 = 0 THEN 'event missing required fields: step, amount'
        WHEN n % 19 = 0 THEN 'event missing required fields: step'
        WHEN n % 11 = 0 THEN 'event missing required fields: amount'
        WHEN n % 13 = 0 THEN 'event.amount expected number, got str'
    END
"""


def over_txn(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([TXN_CTE, *ctes]) + " " + body


def over_features(body: str, *ctes: str) -> str:
    return over_txn(body, FEAT_CTE, *ctes)


def over_decisions(body: str, *ctes: str) -> str:
    return over_features(body, RULE_CTE, *ctes)


def over_events(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EVENT_CTE, EVENT_FEAT_CTE, *ctes]) + " " + body


def over_messages(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EVENT_CTE, MESSAGE_CTE, *ctes]) + " " + body


def over_requests(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([REQUEST_CTE, *ctes]) + " " + body
