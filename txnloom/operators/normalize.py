"""Source datasets to the canonical transaction event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnloom.functions.casts import first_text, safe_double, safe_int, utc_now_text
from txnloom.schemas import CANONICAL_EVENT
from txnloom.sources.writers import written


def _fallback_id(df: DataFrame, stable_ids: bool) -> Column:
    """Id for a record without one: its content hash, or a random uuid.

    The hash gives a replayed record the same id again.
    """
    if stable_ids:
        return F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    return F.uuid()


def _canonical(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL_EVENT.fields]
    )


def normalize_paysim(df: DataFrame, *, stable_ids: bool = True) -> DataFrame:
    """PaySim-style rows as canonical events; unusable numbers become 0."""
    columns = {
        "event_id": F.coalesce(
            first_text(df, "event_id", "transaction_id"), _fallback_id(df, stable_ids)
        ),
        "event_time": F.coalesce(first_text(df, "event_time"), utc_now_text()),
        "source_dataset": F.lit("paysim"),
        "type": F.upper(F.coalesce(first_text(df, "type"), F.lit("TRANSFER"))),
        "sender_id": F.coalesce(first_text(df, "nameOrig", "sender_id"), F.lit("")),
        "receiver_id": F.coalesce(first_text(df, "nameDest", "receiver_id"), F.lit("")),
    }
    for name in ("step", "isFlaggedFraud", "isFraud"):
        columns[name] = safe_int(df, name)
    for name in (
        "amount",
        "oldbalanceOrg",
        "newbalanceOrig",
        "oldbalanceDest",
        "newbalanceDest",
    ):
        columns[name] = safe_double(df, name)
    return _canonical(df, columns)


def normalize_ieee(df: DataFrame, *, stable_ids: bool = True) -> DataFrame:
    """IEEE-CIS rows as canonical events.

    The dataset has no balances and no system flag: they are 0, so the balance
    rules say nothing about these events.
    """
    zero = {
        name: F.lit(0)
        for name in (
            "oldbalanceOrg",
            "newbalanceOrig",
            "oldbalanceDest",
            "newbalanceDest",
            "isFlaggedFraud",
        )
    }
    return _canonical(
        df,
        zero
        | {
            "event_id": F.coalesce(
                first_text(df, "TransactionID"), _fallback_id(df, stable_ids)
            ),
            "event_time": utc_now_text(),
            "source_dataset": F.lit("ieee-cis"),
            "step": safe_int(df, "TransactionDT"),
            "type": F.upper(F.coalesce(first_text(df, "ProductCD"), F.lit("IEEE"))),
            "amount": safe_double(df, "TransactionAmt"),
            "sender_id": F.coalesce(first_text(df, "card1", "addr1"), F.lit("")),
            "receiver_id": F.coalesce(first_text(df, "addr2", "P_emaildomain"), F.lit("")),
            "isFraud": safe_int(df, "isFraud"),
        },
    )


# Rows of one id that a task of the identity join takes on either side.
HEAVY_ROWS = 100_000
# Tasks that rows without an id, which meet nothing, are spread over.
NULL_PARTS = 1024


def join_identity(transactions: DataFrame, identity: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Left join on TransactionID; several identities repeat the transaction.

    Both inputs are read once and written as columns, from which the rows of
    every id are counted.  Only ids with more than ``heavy_rows`` on a side are
    salted: their rows are dealt to parts of that size, and every part meets a
    copy of the other side's, so a task never holds more than a part of each.
    """
    key = "TransactionID"
    left, right = written(transactions, "transactions"), written(identity, "identity")

    def parts(side: DataFrame, name: str) -> DataFrame:
        heavy = side.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > heavy_rows)
        return heavy.select(key, F.ceil(F.col("n") / heavy_rows).cast("int").alias(name))

    # At most rows / heavy_rows ids; adaptive execution broadcasts them while they are few.
    heavy = written(parts(left, "_lefts").join(parts(right, "_rights"), key, "full"), "heavy")
    counts = {c: F.coalesce(c, F.lit(1)) for c in ("_lefts", "_rights")}
    dealt = {}
    for side, mine, others in ((left, "_lefts", "_rights"), (right, "_rights", "_lefts")):
        # The place in a written file repeats when a task does.
        place = F.monotonically_increasing_id()
        split = F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(F.col(mine))
        salted = side.withColumn("_place", place).join(heavy, key, "left").withColumns(counts)
        salted = salted.withColumn(mine[:-1], F.pmod("_place", split).cast("int"))
        dealt[mine] = salted.withColumn(others[:-1], F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_place")
    one = dealt["_lefts"].drop("_lefts")
    two = dealt["_rights"].drop("_lefts", "_rights").withColumn("_found", F.lit(True))
    joined = one.join(two, [key, "_left", "_right"], "left")
    # A copy that meets no row of its part says nothing where other parts have rows.
    kept = joined.filter(F.col("_found").isNotNull() | (F.col("_rights") == 1))
    names = [*transactions.columns, *[c for c in identity.columns if c != key]]
    return kept.select(key, *[c for c in names if c != key])
