"""Sensor readings on a stream with state: deduplicated, rolled up by day, newest per machine.

State is bounded by event time. The watermark follows the newest reading seen, a given
delay behind it. A reading older than that is late: it is dropped and counted. A sensor
id is remembered for the delay, so a reading delivered again within it is dropped and
counted, too. A day is closed once the watermark has passed its end; it is then written
once, and its state goes.

Each micro-batch replaces the folder of its number, so a batch that runs again after a
lost executor or driver leaves the same rows; what a stream has read and remembers is in
its checkpoint, from which a restart goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millgauge.operators import gold
from millgauge.operators.latest import latest_per_key
from millgauge.sources.landing import MAX_FILE_AGE
from millgauge.streaming.ingest import Folders

DELAY = "2 days"
# A machine without a reading for so long is silent.
SILENT_DAYS = 30
LOG = "stream string, run_id string, batch_id bigint, rows_in bigint, late bigint, duplicates bigint"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def silver_readings(spark: SparkSession, folders: Folders, files_per_batch: int | None = None) -> DataFrame:
    """New rows of the silver sensor table."""
    schema = spark.read.parquet(folders.table("silver_sensor_data")).drop("batch_id").schema
    reader = spark.readStream.schema(schema).options(maxFileAge=MAX_FILE_AGE, recursiveFileLookup=True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folders.table("silver_sensor_data"))


def deduplicated(readings: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first reading of each sensor id; repeats within the delay and late rows are dropped.

    Readings without a time cannot be placed and are left out.
    """
    timed = readings.where(F.col("reading_timestamp").isNotNull())
    return timed.withWatermark("reading_timestamp", delay).dropDuplicatesWithinWatermark(["sensor_id"])


def closed_days(readings: DataFrame) -> DataFrame:
    """Sensor condition per machine and closed day, of readings with a watermark."""
    day = F.window("reading_timestamp", "1 day")
    return readings.groupBy("machine_id", day).agg(*gold.sensor_measures()).select(
        "machine_id", F.col("window.start").alias("reading_date"), *gold.SENSOR_MEASURES
    )


class _Newest(StatefulProcessor):
    """The newest reading of one machine, and whether it has fallen silent.

    Rows come in any order and in pieces; a piece is reduced to its own newest row first.
    A timer is kept at the newest time plus the silent period; the watermark sets it off.
    """

    def __init__(self, silent_ms: int, columns: tuple[str, ...], schema: str):
        self.silent_ms, self.columns, self.schema = silent_ms, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _row(self, key, values, silent: bool) -> pd.DataFrame:
        return pd.DataFrame({"machine_id": [key[0]], **{name: [value] for name, value in zip(self.columns, values)}, "silent": [silent]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.newest.get()) if self.newest.exists() else None
        best = known
        for piece in rows:
            piece = piece.sort_values(["reading_timestamp", "sensor_id"])
            last = tuple(piece[name].iloc[-1] for name in self.columns)
            last = tuple(None if pd.isna(value) else value.item() if hasattr(value, "item") else value for value in last)
            # The time and then the id come first among the columns.
            if best is None or (pd.Timestamp(last[0]), last[1]) > (pd.Timestamp(best[0]), best[1]):
                best = last
        if best is None or best == known:
            return
        self.newest.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = int(pd.Timestamp(best[0]).timestamp() * 1000) + self.silent_ms
        self.handle.registerTimer(due)
        yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            yield self._row(key, tuple(self.newest.get()), True)

    def close(self) -> None:
        pass


NEWEST = ("reading_timestamp", "sensor_id", "health_score", "machine_status")
_NEWEST_SCHEMA = "reading_timestamp timestamp, sensor_id string, health_score int, machine_status string"


def newest_readings(readings: DataFrame, delay: str = DELAY, silent_days: int = SILENT_DAYS) -> DataFrame:
    """Changes of the newest reading per machine: a row when a newer one comes, and one when a machine falls silent."""
    timed = readings.where(F.col("reading_timestamp").isNotNull()).withWatermark("reading_timestamp", delay)
    # The state's columns are cut here so that only they reach the workers.
    narrow = timed.select("machine_id", "reading_timestamp", "sensor_id", F.col("health_score").cast("int").alias("health_score"), "machine_status")
    return narrow.groupBy("machine_id").transformWithStateInPandas(
        statefulProcessor=_Newest(silent_days * 86_400_000, NEWEST, _NEWEST_SCHEMA),
        outputStructType=f"machine_id string, {_NEWEST_SCHEMA}, silent boolean",
        outputMode="Update",
        timeMode="EventTime",
    )


def run(rows: DataFrame, table: str, folders: Folders, mode: str) -> None:
    """Take in everything that is available now, write each batch to a folder of its number and log what was dropped."""
    spark = rows.sparkSession
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        query = (
            rows.writeStream.queryName(table)
            .outputMode(mode)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folders.table(table)}/batch_id={number}"))
            .option("checkpointLocation", folders.checkpoint(table))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_STATE_STORE, before)
    _log(spark, folders, table, query.recentProgress)


def _log(spark: SparkSession, folders: Folders, table: str, progress: list) -> None:
    """One row per batch with what its state operators have dropped; later ones see what the first lets through."""
    rows = []
    for batch in progress:
        states = batch["stateOperators"]
        late = sum(state["numRowsDroppedByWatermark"] for state in states)
        doubles = sum(state["customMetrics"].get("numDroppedDuplicateRows", 0) for state in states)
        rows.append((table, batch["runId"], batch["batchId"], batch["numInputRows"], late, doubles))
    if rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folders.root}/stream_log")


def dropped(spark: SparkSession, folders: Folders) -> DataFrame:
    """Rows in, late and repeated per stream so far."""
    log = spark.read.schema(LOG).parquet(f"{folders.root}/stream_log").where("rows_in > 0")
    return log.groupBy("stream").agg(F.sum("rows_in").alias("rows_in"), F.sum("late").alias("late"), F.sum("duplicates").alias("duplicates"))


def refresh_daily_health(readings: DataFrame, folders: Folders, delay: str = DELAY) -> None:
    """Bring the daily rollup up to date with the stream of readings."""
    run(closed_days(deduplicated(readings, delay)), "daily_health", folders, "append")


def refresh_readings(readings: DataFrame, folders: Folders, delay: str = DELAY) -> None:
    """Bring the table of deduplicated readings up to date with the stream."""
    run(deduplicated(readings, delay), "unique_readings", folders, "append")


def refresh_newest(readings: DataFrame, folders: Folders, delay: str = DELAY, silent_days: int = SILENT_DAYS) -> None:
    """Bring the newest reading per machine up to date with the stream."""
    run(newest_readings(readings, delay, silent_days), "newest_readings", folders, "update")


def daily_health(spark: SparkSession, folders: Folders, machines: DataFrame) -> DataFrame:
    """Closed days in the form of the maintenance rollup."""
    return gold.with_maintenance(spark.read.parquet(folders.table("daily_health")).drop("batch_id"), machines)


def newest(spark: SparkSession, folders: Folders) -> DataFrame:
    """The newest reading per machine: the last change that was written."""
    changes = spark.read.parquet(folders.table("newest_readings"))
    order = [F.col("batch_id").desc(), F.col("reading_timestamp").desc(), F.col("sensor_id").desc(), F.col("silent").desc()]
    return latest_per_key(changes, ["machine_id"], order).drop("batch_id")


