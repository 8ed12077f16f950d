"""Casts that turn bad text into NULL instead of failing the job.

Feeds arrive either as text (CSV landing files) or already typed (Parquet). A
column that has the wanted type is passed through, so typed feeds pay nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def lenient(df: DataFrame, name: str, target: str) -> Column:
    column = F.col(name)
    if _type_of(df, name) == target:
        return column
    if target == "int":
        # A whole number may be written with decimals ("12.0"); they are cut off.
        return F.coalesce(column.try_cast("int"), column.try_cast("double").try_cast("int"))
    return column.try_cast(target)


_DAY = "yyyy-MM-dd"


def _day(column: Column) -> Column:
    """The moment at which a day written as yyyy-MM-dd begins, as parsed by the pattern.

    A cast is several times faster, and takes more than the pattern does; so it is
    given only what has the digits and hyphens in place, which both read alike.
    """
    in_place = (
        (F.length(column) == 10)
        & (F.substring(column, 5, 1) == "-")
        & (F.substring(column, 8, 1) == "-")
        & F.substring(column, 10, 1).between("0", "9")
        & (column >= "0001")
    )
    return F.when(in_place, column.try_cast("date").cast("timestamp")).otherwise(F.try_to_timestamp(column, F.lit(_DAY)))


def _parsed(column: Column, pattern: str) -> Column:
    return _day(column) if pattern == _DAY else F.try_to_timestamp(column, F.lit(pattern))


def lenient_date(df: DataFrame, name: str, pattern: str = _DAY) -> Column:
    column, kind = F.col(name), _type_of(df, name)
    if kind == "date":
        return column
    if kind in ("timestamp", "timestamp_ntz"):
        return column.cast("date")
    return _parsed(column, pattern).cast("date")


def lenient_timestamp(df: DataFrame, name: str, pattern: str) -> Column:
    column, kind = F.col(name), _type_of(df, name)
    if kind == "timestamp":
        return column
    if kind in ("date", "timestamp_ntz"):
        return column.cast("timestamp")
    return _parsed(column, pattern)
