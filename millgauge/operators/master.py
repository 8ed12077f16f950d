"""A master table kept current: the newest delivery of every key, in buckets by hash.

A refresh merges the batches that have arrived since the last one into the buckets that
they touch, and leaves the files of the others alone. The merged buckets go to a new folder
and count once their rows are in the log, which Spark commits as a whole: a refresh that
stopped before has changed nothing. Reading takes the newest folder of every bucket and the
batches that no refresh has merged yet, so it is right at any time and ranks only those.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millgauge.operators.latest import current_machines

BUCKETS = 64
LOG = "bucket int, path string, through bigint, written_at bigint"


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/_log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def state(spark: SparkSession, path: str) -> tuple[dict[int, str], int]:
    """The newest folder of every bucket, and the last batch merged."""
    log = _log(spark, path)
    if log is None:
        return {}, -1
    rows = log.groupBy("bucket").agg(F.max_by("path", "written_at").alias("path"), F.max("through").alias("through")).collect()
    return {r["bucket"]: r["path"] for r in rows if r["bucket"] is not None}, max(r["through"] for r in rows)


def _with_later(stored: DataFrame | None, later: DataFrame) -> DataFrame:
    return later if stored is None else stored.unionByName(later)


def _folders(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    return spark.read.parquet(*sorted(paths)) if paths else None


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The current row of every machine; equal to ranking all deliveries."""
    folders, through = state(spark, path)
    later = spark.read.parquet(source).where(F.col("batch_id") > through).drop("batch_id")
    return current_machines(_with_later(_folders(spark, list(folders.values())), later))


def refresh(spark: SparkSession, source: str, path: str, buckets: int = BUCKETS) -> None:
    """Merge what has arrived into the buckets that it touches."""
    folders, through = state(spark, path)
    arrived = spark.read.parquet(source).where(F.col("batch_id") > through)
    last = arrived.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    arrived = arrived.where(F.col("batch_id") <= last).drop("batch_id")
    bucket = F.pmod(F.xxhash64("machine_id"), F.lit(buckets)).cast("int")
    touched = [r[0] for r in arrived.select(bucket).distinct().collect()]  # at most one row per bucket
    known = _folders(spark, [folders[b] for b in touched if b in folders])
    folder = f"{path}/{uuid.uuid4().hex}"
    merged = current_machines(_with_later(known, arrived)).withColumn("bucket", bucket)
    merged.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    now = time.time_ns()
    entries = [(b, f"{folder}/bucket={b}", last, now) for b in touched] or [(None, None, last, now)]
    spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").parquet(f"{path}/_log")
