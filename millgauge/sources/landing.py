"""Landing folders: one folder of headed CSV files per feed.

Columns are found by the name in each file's own header, so files may carry them in any
order. Names are compared without surrounding blanks and case. A feed column that a file
lacks is null. What has no column of its own is kept in the map ``_rescued_data``: values
of unknown columns below their name (repeated names numbered, empty ones below their
place), and below ``_line`` the whole line where it has more or fewer values than the
header. The map is null where nothing was rescued. An empty file has no rows; a file whose
header names none of the feed's columns stops the batch.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millgauge import session
from millgauge.sources.schemas import FEED_COLUMNS, RESCUED, bronze_schema

LINE = "_line"

# The file source ignores a new file this much older than the newest it has read.
# Deliveries may keep any original time, so no file is ever too old.
MAX_FILE_AGE = "40000d"

# Text of every value; lines are checked whole, whatever columns a query asks for.
_CSV = {"header": True, "columnPruning": False, "columnNameOfCorruptRecord": LINE}

_FILES = "path string, modificationTime timestamp, length bigint, content binary"

# Rows in a compressed file, which only one task can read.
ROWS_PER_FILE = 500_000

_DATE = "yyyy-MM-dd"
_MOMENT = "yyyy-MM-dd HH:mm:ss"


def header_names(line: str) -> list[str]:
    """The distinct column names of a header line, in place."""
    used, names = {LINE}, []
    for place, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]))):
        plain = name.strip().lower() or f"_c{place}"
        unique, number = plain, 1
        while unique in used:
            number += 1
            unique = f"{plain}#{number}"
        used.add(unique)
        names.append(unique)
    return names


def _literal(path: str) -> str:
    """The path of one file, safe from being read as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def files_by_header(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line to the files that start with it; files without a line are left out.

    The lines are found by the executors. The first block of a file is one task's, in
    order, so the first line that the task meets is the header.
    """
    lines = spark.read.text([_literal(path) for path in paths]).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    first = lines.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.first("value").alias("header"))
    groups: dict[str, list[str]] = defaultdict(list)
    for row in first.sort("file").toLocalIterator():
        groups[row.header].append(unquote(row.file))
    return groups


def _rescued(unknown: list[str]) -> Column:
    # Next to all rows have nothing to rescue; for them the map is not even begun.
    names = [*unknown, LINE]
    found = F.coalesce(*(F.col(f"`{name}`") for name in names)).isNotNull()
    if not unknown:
        return F.when(found, F.create_map(F.lit(LINE), F.col(LINE)))
    entries = F.array(*(F.struct(F.lit(name).alias("key"), F.col(f"`{name}`").alias("value")) for name in names))
    return F.when(found, F.map_from_entries(F.filter(entries, lambda entry: entry["value"].isNotNull())))


def _read_group(spark: SparkSession, feed: str, header: str, paths: list[str]) -> DataFrame:
    names = header_names(header)
    wanted = FEED_COLUMNS[feed]
    if not set(wanted) & set(names):
        raise ValueError(f"no column of feed {feed} in the header of {paths[0]} and {len(paths) - 1} more files: {header[:200]}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, LINE]])
    columns = [
        *(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted),
        F.current_timestamp().alias("_ingested_at"),
        # The same text as in the metadata, which would have every row copied once more.
        F.input_file_name().alias("_source_file"),
        _rescued([name for name in names if name not in wanted]).alias(RESCUED),
    ]
    if feed == "machines":
        columns.append(F.col("_metadata.file_modification_time").alias("_file_ts"))
    return spark.read.schema(schema).options(**_CSV).csv([_literal(path) for path in paths]).select(*columns)


def read_files(spark: SparkSession, feed: str, paths: list[str]) -> DataFrame:
    """Headed CSV files as one bronze-shaped batch, columns by name; one scan per distinct header.

    Only file names and distinct headers pass through the driver, which lists the files anyway.
    """
    groups = files_by_header(spark, paths) if paths else {}
    if not groups:
        return spark.createDataFrame([], bronze_schema(feed))
    return reduce(DataFrame.unionByName, (_read_group(spark, feed, header, files) for header, files in groups.items()))


def read_landing(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """All files of a landing folder as one bronze-shaped batch."""
    files = spark.read.format("binaryFile").load(path).select("path").sort("path")
    return read_files(spark, feed, [row.path for row in files.toLocalIterator()])


def stream_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a landing folder as a stream of their paths; their content is not read."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("maxFileAge", MAX_FILE_AGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path")


def write_landing(
    df: DataFrame,
    feed: str,
    path: str,
    files: int | None = None,
    mode: str = "overwrite",
    columns: Sequence[str] | None = None,
    codec: str | None = None,
) -> None:
    """Write a feed as headed CSV, replacing what is there or, in mode ``append``, as one more delivery.

    ``files`` fixes the number of files; by default each task writes its own, so
    a large feed is never squeezed through one writer. ``columns`` are the feed's own in
    their order unless given. ``codec`` compresses the files, such as ``gzip``; a task then
    begins another file after ``ROWS_PER_FILE`` rows, since such a file can't be split.
    """
    out = df.select(*(columns or FEED_COLUMNS[feed]))
    if files:
        out = out.repartition(files)
    writer = out.write.mode(mode).option("header", True).option("dateFormat", _DATE).option("timestampFormat", _MOMENT)
    if codec:
        writer = writer.option("compression", codec).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", ROWS_PER_FILE)
    with session.short_shuffles(df.sparkSession):
        writer.csv(path)
