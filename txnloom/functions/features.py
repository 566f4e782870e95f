"""Balance features of a transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnloom.schemas import SCORING_FIELDS


def movement_gap(opening: Column, moved: Column, closing: Column) -> Column:
    """How far a closing balance is from opening balance plus movement."""
    return F.abs((opening + moved) - closing)


def as_flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def balance_features() -> dict[str, Column]:
    """The four columns the model adds to a transaction."""
    opening, closing = F.col("oldbalanceOrg"), F.col("newbalanceOrig")
    return {
        "balance_diff_orig": opening - closing,
        "balance_diff_dest": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        "amount_to_oldbalance_ratio": F.try_divide(F.col("amount"), opening + F.lit(1.0)),
        "is_zero_balance_after_txn": as_flag(closing == 0),
    }


def mismatch_flags() -> dict[str, Column]:
    """Balance checks of the silver table, for every transaction type."""
    amount = F.col("amount")
    sender = movement_gap(F.col("oldbalanceOrg"), -amount, F.col("newbalanceOrig"))
    receiver = movement_gap(F.col("oldbalanceDest"), amount, F.col("newbalanceDest"))
    return {
        "sender_balance_mismatch": as_flag(sender > 1),
        "receiver_balance_mismatch": as_flag(receiver > 1),
    }


MODEL_COLUMNS = SCORING_FIELDS + tuple(
    # Engineered columns in model order.
    (
        "balance_diff_orig",
        "balance_diff_dest",
        "amount_to_oldbalance_ratio",
        "is_zero_balance_after_txn",
    )
)
