"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], ties: bool = False
) -> DataFrame:
    """Rows ranked first per key; with ``ties`` every row sharing first place.

    The filter on the rank lets Spark cut each partition to its own first rows
    before shuffling, so a key that holds most of the table still sends only a
    handful of rows to its task.
    """
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    place = F.rank() if ties else F.row_number()
    return df.withColumn("_place", place.over(window)).filter(F.col("_place") == 1).drop("_place")


def newest_rows(df: DataFrame, period: str) -> DataFrame:
    """All rows of the newest period, from one pass over the frame.

    Each partition is cut to its own newest period before the partitions meet, so
    the last step sees a period's rows per task at most, not the table.
    """
    place = F.rank().over(Window.orderBy(F.col(period).desc_nulls_last()))
    ranked = df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
    return ranked.filter(F.col(period).isNotNull())


def current_machines(machines: DataFrame) -> DataFrame:
    """One row per machine from a master that may have been delivered repeatedly.

    The newest file wins, then the latest arrival and the file's name. Rows of one
    file are told apart by a hash of their columns, so the choice is the same in
    every run.
    """
    when = [F.col(name).desc_nulls_last() for name in ("_file_ts", "_ingested_at", "_source_file") if name in machines.columns]
    order = [*when, F.xxhash64(*sorted(machines.columns))]
    return latest_per_key(machines, ["machine_id"], order)
