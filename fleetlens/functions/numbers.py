"""Integer and time arithmetic with the truncation the reports expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates towards zero; NULL for a zero divisor."""
    a_sql = a.cast("bigint")
    b_sql = F.nullif((F.lit(b) if isinstance(b, int) else b).cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", a_sql, b_sql)


def int_avg(x: Column) -> Column:
    """Integer average: sum over count, truncated."""
    return int_div(F.sum(x), F.count(x))


def round_to_minute(ts: Column) -> Column:
    """Nearest minute; half a minute rounds up."""
    return F.date_trunc("minute", ts + F.expr("INTERVAL 30 SECONDS")).cast("timestamp_ntz")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed, not elapsed minutes."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end))
