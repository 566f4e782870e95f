"""Record layouts shared by the batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Field names, order and types of the exchanged records.
CANONICAL_EVENT = _record(
    event_id=_TEXT,
    event_time=_TEXT,
    source_dataset=_TEXT,
    step=_INT,
    type=_TEXT,
    amount=_DOUBLE,
    sender_id=_TEXT,
    receiver_id=_TEXT,
    oldbalanceOrg=_DOUBLE,
    newbalanceOrig=_DOUBLE,
    oldbalanceDest=_DOUBLE,
    newbalanceDest=_DOUBLE,
    isFlaggedFraud=_INT,
    isFraud=_INT,
)

PREDICTION = _record(
    fraud_probability=_DOUBLE,
    risk_level=_TEXT,
    alert=_TEXT,
    rule_risk_score=_INT,
    rule_risk_level=_TEXT,
    triggered_rules=T.ArrayType(_TEXT),
    final_decision=_TEXT,
)

# A scored event carries the canonical event without the account ids.
SCORED_EVENT = T.StructType(
    [f for f in CANONICAL_EVENT if f.name not in ("sender_id", "receiver_id")]
    + [
        T.StructField("prediction_log_id", T.IntegerType()),
        T.StructField("scored_at", T.StringType()),
        T.StructField("prediction", PREDICTION),
    ]
)

PAYSIM_FILE = _record(
    step=_DOUBLE,
    type=_TEXT,
    amount=_DOUBLE,
    nameOrig=_TEXT,
    oldbalanceOrg=_DOUBLE,
    newbalanceOrig=_DOUBLE,
    nameDest=_TEXT,
    oldbalanceDest=_DOUBLE,
    newbalanceDest=_DOUBLE,
    isFraud=_DOUBLE,
    isFlaggedFraud=_DOUBLE,
)

IEEE_FILE = _record(
    TransactionID=_TEXT,
    TransactionAmt=_DOUBLE,
    TransactionDT=_DOUBLE,
    ProductCD=_TEXT,
    card1=_TEXT,
    addr1=_TEXT,
    addr2=_TEXT,
    P_emaildomain=_TEXT,
    isFraud=_DOUBLE,
)

REQUEST_LOG = _record(
    timestamp=_TEXT,
    level=_TEXT,
    logger=_TEXT,
    message=_TEXT,
    request_id=_TEXT,
    method=_TEXT,
    path=_TEXT,
    status_code=_INT,
    duration_ms=_DOUBLE,
    client_host=_TEXT,
    error=_TEXT,
    exception=_TEXT,
)

# Fields the scoring model reads besides the engineered ones.
SCORING_FIELDS = (
    "step",
    "type",
    "amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
    "isFlaggedFraud",
)

# Money columns, which must never be negative.
AMOUNT_FIELDS = (
    "amount",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
)

TRANSACTION_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
