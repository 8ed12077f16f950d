"""Tables laid out on several keys at once, and lookups that read few of their files.

Every key is cut into ranges. A zone is a combination of ranges, numbered by interleaving
the bits of their numbers, so neighbouring zones are near in all keys. Zones are partition
folders: a condition on any one of the keys is turned into one on the zone, and Spark then
lists only the folders that can hold such rows.

Deliveries are laid out on their own: what has been written stays as it is. A delivery
counts once its row is in the log, which Spark commits as a whole; a refresh that stopped
before has left nothing that a reader sees, and runs again. A large delivery is laid out in
groups by its first key, one after the other, so that not all of its rows lie in a shuffle at once.

The bounds of the ranges come from ``SAMPLE_ROWS`` rows of the first delivery, those with
the lowest hashes. They decide sizes of files, never results. Rows without a key lie in its
first range; a lookup by that key does not return them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millgauge import session
from millgauge.operators.layout import CODEC

SAMPLE_ROWS = 4096
# Ranges per key: 2 ** RANGE_BITS.
RANGE_BITS = 4
# A delivery of more rows is laid out in several groups of ranges of the first key. Each
# group reads the delivery again, so there are few.
ROWS_AT_ONCE = 10_000_000
MOST_GROUPS = 4
LOG = "path string, through bigint"
BOUNDS = "key string, type string, bounds array<string>"


def key_bounds(df: DataFrame, keys: Sequence[str], bits: int = RANGE_BITS) -> list[tuple[str, str, list[str]]]:
    """(key, type, bounds as text): quantiles of every key in a bounded sample."""
    hashed = [field.name for field in df.schema if not isinstance(field.dataType, T.MapType)]
    sample = df.select(*keys, F.xxhash64(*hashed).alias("_h")).orderBy("_h").limit(SAMPLE_ROWS)
    # Sorted in the key's own order, by Spark.
    ordered = sample.agg(*(F.transform(F.sort_array(F.collect_list(key)), lambda v: v.cast("string")).alias(key) for key in keys)).first()
    found = []
    for key in keys:
        values, ranges = ordered[key], 1 << bits
        cuts = dict.fromkeys(values[len(values) * i // ranges] for i in range(1, ranges)) if values else {}
        found.append((key, df.schema[key].dataType.simpleString(), list(cuts)))
    return found


def range_number(value: Column, kind: str, bounds: Sequence[str]) -> Column:
    """How many bounds the value reaches."""
    reached = (F.coalesce(value >= F.lit(bound).cast(kind), F.lit(False)).cast("int") for bound in bounds)
    return reduce(lambda a, b: a + b, reached, F.lit(0))


def interleaved(numbers: Sequence[Column], bits: int = RANGE_BITS) -> Column:
    """One number from the bits of several, taken in turn."""
    n = len(numbers)
    parts = [F.shiftleft(F.shiftright(number, i).bitwiseAND(F.lit(1)), i * n + j) for j, number in enumerate(numbers) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def number_in(zone: Column, position: int, keys: int, bits: int = RANGE_BITS) -> Column:
    """The range number of the key at a position, from the zone."""
    parts = [F.shiftleft(F.shiftright(zone, i * keys + position).bitwiseAND(F.lit(1)), i) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_bounds(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]] | None:
    """The bounds that the first delivery has fixed, keys in their order."""
    rows = _read(spark, f"position int, {BOUNDS}", f"{path}/_bounds")
    return [(r["key"], r["type"], r["bounds"]) for r in rows.sort("position").collect()] if rows is not None else None


def deliveries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(folder, last batch) of every delivery that has been laid out whole."""
    log = _read(spark, LOG, f"{path}/_deliveries")
    return [(r["path"], r["through"]) for r in log.sort("through").collect()] if log is not None else []


def groups_for(count: int) -> int:
    """In how many groups a delivery of so many rows is laid out, at most."""
    return min(MOST_GROUPS, 1 << (count // ROWS_AT_ONCE).bit_length())


def lay_out(rows: DataFrame, path: str, keys: Sequence[str], through: int, groups: int = 1) -> None:
    """Add a delivery, up to a batch, to the layout."""
    spark = rows.sparkSession
    bounds = stored_bounds(spark, path)
    if bounds is None:
        bounds = key_bounds(rows, keys)
        entries = [(position, *entry) for position, entry in enumerate(bounds)]
        spark.createDataFrame(entries, f"position int, {BOUNDS}").coalesce(1).write.mode("overwrite").parquet(f"{path}/_bounds")
    zone = interleaved([range_number(F.col(key), kind, cuts) for key, kind, cuts in bounds])
    hashed = [field.name for field in rows.schema if not isinstance(field.dataType, T.MapType)]
    # The hash lets a zone that a hot key fills take several tasks.
    first, kind, cuts = bounds[0]
    # Some of the bounds, so that no zone is in two groups; every row reaches some number of them.
    dividers = list(dict.fromkeys(cuts[len(cuts) * i // groups] for i in range(1, groups))) if cuts else []
    folder = f"{path}/rows/delivery=d{uuid.uuid4().hex}"
    for group in range(len(dividers) + 1):
        chosen = rows.where(range_number(F.col(first), kind, dividers) == group) if dividers else rows
        placed = chosen.withColumn("zone", zone).repartitionByRange("zone", F.xxhash64(*hashed)).sortWithinPartitions("zone", *keys)
        with session.short_shuffles(spark):
            placed.write.mode("append").option("compression", CODEC).partitionBy("zone").parquet(folder)
    spark.createDataFrame([(folder, through)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/_deliveries")


def refresh(spark: SparkSession, source: str, path: str, keys: Sequence[str]) -> None:
    """Lay out the batches of an appended table that have arrived since the last refresh."""
    done = max((through for _, through in deliveries(spark, path)), default=-1)
    arrived = spark.read.parquet(source).where(F.col("batch_id") > done)
    last, count = arrived.agg(F.max("batch_id"), F.count(F.lit(1))).first()
    if last is not None:
        lay_out(arrived.where(F.col("batch_id") <= last), path, keys, last, groups_for(count))


def lookup(spark: SparkSession, path: str, between: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Rows whose keys lie between two values, both included, for one or more of the keys."""
    bounds, folders = stored_bounds(spark, path), [folder for folder, _ in deliveries(spark, path)]
    if bounds is None or not folders:
        raise ValueError(f"nothing is laid out in {path}")
    unknown = set(between) - {key for key, _, _ in bounds}
    if unknown:
        raise ValueError(f"not laid out by {sorted(unknown)}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders)
    for position, (key, kind, cuts) in enumerate(bounds):
        if key not in between:
            continue
        low, high = (F.lit(value).cast(kind) for value in between[key])
        number = number_in(F.col("zone"), position, len(bounds))
        rows = rows.where((number >= range_number(low, kind, cuts)) & (number <= range_number(high, kind, cuts)))
        rows = rows.where(F.col(key).between(low, high))
    return rows.drop("zone", "delivery")
