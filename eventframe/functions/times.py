"""Epoch-millisecond columns. Nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def div(a: Column, b: int | Column) -> Column:
    """Integer division of two whole-number columns."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def ntz_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC, rounded down."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return div(F.timestamp_diff("MICROSECOND", epoch, ts), 1000)


def column_ms(df: DataFrame, name: str) -> Column:
    """Milliseconds of a timestamp column of either kind."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_millis(F.col(name))
    return div(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(name)), 1000)


def utc_day(ms: Column) -> Column:
    """``yyyy-MM-dd`` of an epoch-millisecond column."""
    return F.date_from_unix_date(div(ms, DAY_MS).cast("int")).cast("string")


def two_digits(n: Column) -> Column:
    return F.right(F.concat(F.lit("0"), n.cast("string")), F.lit(2))


def parse_ms(text: Column) -> Column:
    """Milliseconds of a date string or of digits; zone-less dates count as UTC."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]\d{2}:")
    return (
        F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
        .when(zoned, F.unix_millis(text.try_cast("timestamp")))
        .otherwise(ntz_ms(text.try_cast("timestamp_ntz")))
    )
