"""Vectors compressed to codes of their parts, nearest entries found by Orchard search.

A vector is cut into equal consecutive parts, each coded by the nearest entry of its
position's codebook. Codebooks are learnt in rounds: Spark assigns every part of every
vector, sums parts by entry in each task and then over tasks, and only the sums of the
entries, as many as the codebooks have numbers, reach the driver.

Orchard search: for every entry of a codebook the others are listed by distance from it.
A query starts at some entry and walks its list; an entry not yet visited is compared
and marked, and a nearer one becomes the current entry, whose list is walked from its
start. By the triangle inequality nothing beyond twice the query's distance from the
current entry can be nearer, so the walk stops there. Everything is in whole numbers
(squared distances, 4 times instead of twice), so the result is exactly the nearest
entry, ties to the lower number: an entry at just twice the distance may tie and is
still compared. Searches start at the first entry of the part's sort order by mean, and
all vectors of a batch walk at once.

Defined results. Vectors that are null or hold a null, NaN or infinite component are
dropped, as are those of another length than the first kept one. Null ids
count as one id after all others; of rows that repeat an id the least vector seeds.
Fewer ids than entries give smaller codebooks; an empty table gives no rows. Components reach
``LARGEST`` in size at most, beyond which 64-bit sums would not be exact; a larger one
stops the job. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Scaled components of this size have squared distances and sums well within 64 bits.
LARGEST = 1 << 24
# Vectors that walk at once; bounds the table of visited marks.
BATCH = 4096


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept, v being the scaled whole components; stored."""
    value = vectors[vector]
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(value.isNotNull() & (F.size(value) > 0) & (F.size(value) % parts == 0) & finite)
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * scale))
    whole = stored(kept.select(vectors[key].alias("vec_id"), vectors[label].alias("label"), scaled.alias("v")), "whole-vectors")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if first is None:
        return whole
    bounded = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(bounded, True).otherwise(F.raise_error(F.lit(f"a scaled component exceeds {LARGEST}")).cast("boolean"))
    return whole.where((F.size("v") == first[0]) & checked)


def seeds(whole: DataFrame, entries: int, parts: int) -> np.ndarray:
    """First codebooks (part, entry, position): the vectors of the smallest ids."""
    smallest = whole.select(F.col("vec_id").alias("seed_id")).distinct().orderBy(F.col("seed_id").asc_nulls_last()).limit(entries)
    rows = whole.join(smallest, F.col("vec_id").eqNullSafe(F.col("seed_id")), "left_semi")
    chosen = rows.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    table = np.array([row.v for row in chosen], np.int64)
    return np.ascontiguousarray(table.reshape(len(chosen), parts, -1).transpose(1, 0, 2))


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: all others by squared distance from it, and those distances; ties by number."""
    distances = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(distances, axis=1, kind="stable")
    others = order[order != np.arange(len(book))[:, None]].reshape(len(book), -1)
    return others, np.take_along_axis(distances, others, axis=1)


def nearest(queries: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each query by Orchard search from its ``start``."""
    others, reach = lists
    best = start.copy()
    least = ((queries - book[best]) ** 2).sum(axis=1)
    # The entry whose list is walked, and how far. An equal entry with a lower number
    # becomes the best one, but the list of the current entry serves as well.
    current, place = best.copy(), np.zeros(len(queries), np.int64)
    visited = np.zeros((len(queries), len(book)), bool)
    visited[np.arange(len(queries)), best] = True
    active = np.arange(len(queries))
    while True:
        active = active[place[active] < others.shape[1]]
        if len(active):
            active = active[reach[current[active], place[active]] <= 4 * least[active]]
        if not len(active):
            return best, least
        entry = others[current[active], place[active]]
        place[active] += 1
        fresh = ~visited[active, entry]
        row, entry = active[fresh], entry[fresh]
        visited[row, entry] = True
        found = ((queries[row] - book[entry]) ** 2).sum(axis=1)
        nearer = found < least[row]
        lower = (found == least[row]) & (entry < best[row])
        best[row[nearer | lower]] = entry[nearer | lower]
        least[row[nearer]] = found[nearer]
        current[row[nearer]], place[row[nearer]] = entry[nearer], 0


def starts(queries: np.ndarray, book: np.ndarray) -> np.ndarray:
    """A start for each query: the entry whose sum of components is next above its own, the last one beyond all."""
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    return order[np.minimum(np.searchsorted(sums[order], queries.sum(axis=1)), len(book) - 1)]


def assigned(batch: pa.RecordBatch, books: np.ndarray, lists: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, parts, entries, squared distances) of the vectors of a batch, ``BATCH`` at a time."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(batch.num_rows, len(books), -1)
    for at in range(0, batch.num_rows, BATCH):
        block = vectors[at : at + BATCH]
        chosen = np.empty(block.shape[:2], np.int64)
        error = np.empty(block.shape[:2], np.int64)
        for part, book in enumerate(books):
            queries = block[:, part]
            chosen[:, part], error[:, part] = nearest(queries, book, lists[part], starts(queries, book))
        yield at, block, chosen, error


def entry_sums(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total) summed over the vectors assigned to each entry; tasks sum their own rows first."""
    parts, entries, width = books.shape
    lists = [neighbour_lists(book) for book in books]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, block, chosen, _ in assigned(batch, books, lists):
                for part in range(parts):
                    np.add.at(n[part], chosen[:, part], 1)
                    np.add.at(total[part], chosen[:, part], block[:, part])
        part, entry = np.nonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), sums], ["part", "entry", "n", "total"])

    sums = whole.select("v").mapInArrow(partial, "part long, entry long, n long, total array<long>")
    each = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).select("part", "entry", "n", F.array(*(f"t{k}" for k in range(width))).alias("total"))


def learn(whole: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) after the rounds; unused entries stay as they are."""
    books = seeds(whole, entries, parts)
    for _ in range(rounds):
        books = books.copy()
        for part, entry, n, total in entry_sums(whole, books).collect():
            books[part, entry] = np.array(total, np.int64) // n
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes, error) of every vector: its entries by part, and their summed squared distance."""
    lists = [neighbour_lists(book) for book in books]
    parts = len(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block, chosen, error in assigned(batch, books, lists):
                codes = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(block) + 1) * parts, pa.int32()), pa.array(chosen.reshape(-1).astype(np.int32))
                )
                keys = [batch.column(name).slice(at, len(block)) for name in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*keys, codes, pa.array(error.sum(axis=1))], ["vec_id", "label", "codes", "error"])

    kinds = {field.name: field.dataType.simpleString() for field in whole.schema}
    return whole.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def digest(books: np.ndarray) -> str:
    """Of all numbers of the codebooks by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def hex_code(codes: Column) -> Column:
    """Two hex digits per part."""
    return F.array_join(F.transform(codes, lambda code: F.lpad(F.lower(F.hex(code)), 2, "0")), "")


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    entries: int = ENTRIES,
    parts: int = PARTS,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, codes, error, label_error), codebooks); label_error sums a label's errors, null being one label."""
    whole = whole_vectors(vectors, key, vector, label, parts)
    books = None if whole.isEmpty() else learn(whole, entries, parts, rounds)
    if books is None:
        empty = whole.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.withColumn("label_error", F.col("error")), None
    coded = stored(encode(whole, books), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), books
