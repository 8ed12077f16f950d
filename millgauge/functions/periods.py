"""Day, week and month buckets and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(moment: Column) -> Column:
    return F.date_trunc("DAY", moment)


def week_of(moment: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.date_trunc("WEEK", moment)


def month_of(moment: Column) -> Column:
    return F.date_trunc("MONTH", moment)


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def week_label(moment: Column) -> Column:
    """ISO week such as 2025-W01; the year is the year of the ISO week."""
    week = F.lpad(F.weekofyear(moment).cast("string"), 2, "0")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), moment).cast("string"), F.lit("-W"), week)
