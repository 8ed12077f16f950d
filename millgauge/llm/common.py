"""Helpers shared by the operators: words as columns, stored intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge import session

# A word is a run of anything but these characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    This cuts the lineage on disk that every executor reaches, so that work is
    done once and survives lost executors, and gives the optimizer the real size.
    """
    path = session.fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that has been freed back to the system.

    Python workers are kept for later tasks, and would keep it with them.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's C library only
    if trim is not None:
        trim(0)


def words(text: Column) -> Column:
    """The white-space separated words of a text; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often it is named."""
    return F.transform(F.array(value), body)[0]


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
