"""Months: keys, ranges, and the minutes of a period that fall into them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(text: Column) -> Column:
    """``YYYY-MM`` of an ISO date or timestamp; null for anything else."""
    s = F.trim(text.cast("string"))
    day = F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.date_format(day, "yyyy-MM"))


def month_start(key: Column) -> Column:
    return F.to_date(F.concat(key, F.lit("-01")))


def month_range(first: Column, last: Column) -> Column:
    """All month keys from ``first`` to ``last``."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def minutes_in_month(key: Column, start: Column, end: Column) -> Column:
    """Whole minutes, both ends counted, of a period clipped to the month (to 23:59:59)."""
    a = F.greatest(start, month_start(key).cast("timestamp"))
    b = F.least(end, (F.add_months(month_start(key), 1).cast("timestamp") - F.expr("interval 1 second")))
    return F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 60).cast("bigint") + F.lit(1).cast("bigint"))
