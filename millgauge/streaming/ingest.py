"""Landing folder to bronze to silver, incrementally.

Each micro-batch is gated once: its rows go to a folder of its own below the table,
named after the batch, and its rule counts, observed in the same pass, to the quality
log under the same number. The rows come first and the entry second, and the stream
commits the batch only after both. So a driver or executor lost anywhere leads to the
batch being run again, which replaces what it had left; a batch that has its entry is
complete and is not written again. A rule that FAILs keeps its batch out.

Bronze is brought up to date before silver reads it, so silver never sees a batch that
is still to be replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession

from millgauge.operators.layout import CODEC
from millgauge.operators.quality import RULES, event_rows, gate
from millgauge.operators.silver import TYPERS
from millgauge.sources.landing import MAX_FILE_AGE, read_files, stream_landing
from millgauge.sources.schemas import FEEDS, bronze_schema

LOG_SCHEMA = "table_name string, rule string, action string, passed bigint, failed bigint"
# Splits of a batch's files for each task slot, at least. With about one, some slots would
# get a second split when all others are done, and a stage would last twice as long.
SPLITS_PER_SLOT = 4
_MIN_SPLITS = "spark.sql.files.minPartitionNum"

@dataclass(frozen=True)
class Folders:
    """Where landing files arrive and where tables, checkpoints and logs live."""

    landing: str
    root: str

    def feed(self, name: str) -> str:
        return f"{self.landing}/{name}"

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"

    @property
    def quality_log(self) -> str:
        return f"{self.root}/quality_log"


    def log_entry(self, table: str, batch: int) -> str:
        return f"{self.quality_log}/log_table={table}/batch_id={batch}"


def bronze_stream(spark: SparkSession, feed: str, folders: Folders, files_per_batch: int | None = None) -> DataFrame:
    """New files of the landing folder, by path."""
    return stream_landing(spark, folders.feed(feed), files_per_batch)


def silver_stream(spark: SparkSession, feed: str, folders: Folders, files_per_batch: int | None = None) -> DataFrame:
    """New bronze rows, typed."""
    reader = spark.readStream.schema(bronze_schema(feed)).options(maxFileAge=MAX_FILE_AGE, recursiveFileLookup=True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return TYPERS[feed](reader.parquet(folders.table(f"bronze_{feed}")))


def _logged(spark: SparkSession, folders: Folders, table: str, batch: int) -> bool:
    try:
        return not spark.read.parquet(folders.log_entry(table, batch)).isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def log_batch(spark: SparkSession, folders: Folders, table: str, batch: int, counts: dict) -> None:
    """One entry per rule, replacing those of an earlier attempt."""
    rows = event_rows(table, RULES[table], counts)
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(folders.log_entry(table, batch))


def write_batch(rows: DataFrame, batch: int, table: str, folders: Folders) -> None:
    """Gate one batch into the table and log its counts."""
    spark = rows.sparkSession
    if RULES[table] and _logged(spark, folders, table, batch):
        return
    counts = Observation(f"{table}-{batch}")
    gate(rows, RULES[table], counts).write.mode("overwrite").option("compression", CODEC).parquet(f"{folders.table(table)}/batch_id={batch}")
    log_batch(spark, folders, table, batch, counts.get)


def append(
    arriving: DataFrame, table: str, folders: Folders, rows_of: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> None:
    """Append everything that is available now to the table; ``rows_of`` gives the rows of a batch of what arrives."""
    spark = arriving.sparkSession
    before = spark.conf.get(_MIN_SPLITS, None)
    spark.conf.set(_MIN_SPLITS, SPLITS_PER_SLOT * spark.sparkContext.defaultParallelism)
    try:
        # A stream keeps the settings that it has been started with.
        query = (
            arriving.writeStream.queryName(table)
            .foreachBatch(lambda batch, number: write_batch(rows_of(batch), number, table, folders))
            .option("checkpointLocation", folders.checkpoint(table))
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_MIN_SPLITS)
        else:
            spark.conf.set(_MIN_SPLITS, before)
    query.awaitTermination()


def refresh_bronze(spark: SparkSession, feed: str, folders: Folders, files_per_batch: int | None = None) -> None:
    def rows_of(files: DataFrame) -> DataFrame:
        return read_files(files.sparkSession, feed, [row.path for row in files.sort("path").toLocalIterator()])

    append(bronze_stream(spark, feed, folders, files_per_batch), f"bronze_{feed}", folders, rows_of)


def refresh_silver(spark: SparkSession, feed: str, folders: Folders, files_per_batch: int | None = None) -> None:
    append(silver_stream(spark, feed, folders, files_per_batch), f"silver_{feed}", folders)


def refresh(spark: SparkSession, folders: Folders, feeds: tuple[str, ...] = FEEDS) -> None:
    """Bring bronze and silver of every feed up to date with its landing folder."""
    for feed in feeds:
        refresh_bronze(spark, feed, folders)
        refresh_silver(spark, feed, folders)


def quality_log(spark: SparkSession, folders: Folders) -> DataFrame:
    """Rule counts of every batch so far."""
    return spark.read.parquet(folders.quality_log).drop("log_table")
