"""Casts that fall back to a default instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark also accepts a Java suffix ("1d"); the patterns keep to plain numbers.
_NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def field(df: DataFrame, name: str) -> Column:
    """The named column, or NULL when the input does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _is_text(df: DataFrame, name: str) -> bool:
    return name not in df.columns or isinstance(df.schema[name].dataType, T.StringType)


def number(df: DataFrame, name: str) -> Column:
    """Double value of a column; NULL for missing, NaN or unparseable input."""
    value = field(df, name)
    if _is_text(df, name):
        return F.when(value.rlike(_NUMBER_TEXT), value.try_cast("double"))
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def safe_double(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(number(df, name), F.lit(float(default)))


def safe_int(df: DataFrame, name: str, default: int = 0) -> Column:
    """Integer value; numbers are truncated, text must be a whole number."""
    value = field(df, name)
    if _is_text(df, name):
        whole = F.when(value.rlike(_INTEGER_TEXT), value.try_cast("int"))
    else:
        whole = value.try_cast("int")
    return F.coalesce(whole, F.lit(int(default)))


def first_text(df: DataFrame, *names: str) -> Column:
    """First column whose text is present and not empty, else NULL."""
    candidates = [F.col(n).cast("string") for n in names if n in df.columns]
    if not candidates:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def utc_now_text() -> Column:
    """Current instant as ISO-8601 text in UTC."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
