"""Repeated passages through a sparse suffix array over words.

Only suffixes at content-selected places are kept: the least hash of ``GRAM_WORDS``-word
grams in every ``WINDOW`` consecutive ones (a minimiser). Wherever a passage of
``MIN_WORDS`` words stands, its first ``WINDOW`` grams select the same place, so two
occurrences share an anchor with at least ``CONTEXT`` = MIN_WORDS - WINDOW + 1 words of
the passage after it. The suffixes are sorted over the cluster by (``context``, a hash of
those words; ``wide``, one of the WINDOW - 1 words before and MIN_WORDS words after the
anchor; document), so suffixes that may belong to one passage lie side by side. Each run of equal
context is read off the sorted rows, neighbours are compared, and the documents of
neighbours are compared on the texts: a match is extended word by word to the left and
right. What a hash brings together by chance fails that comparison. The matches of a
document are united, and runs of at least ``MIN_WORDS`` words are its repeated passages.

A passage holds its anchor among its first ``WINDOW`` words, so it is one of WINDOW
stretches of MIN_WORDS words around the anchor. Partners of a suffix are found exactly:

* A neighbour from another document with the same ``wide`` shares all of those stretches
  and is the partner.
* In a run of two suffixes, the other one is.
* Everywhere else the stretches themselves are hashed, and each is met with one other
  document that has it. Suffixes with a partner of the first kind are there for the
  others' sake and are represented by two of them, from two documents.

Sorted rows are read in batches that know nothing of each other, so no run is ever held
whole, however long. A run that touches an end of its batch may go on in another one:
it never counts as a run of two, and all that it holds are represented in the last kind.

Every comparison of two documents is one row, and texts move compressed. Every reported word
lies in a match of MIN_WORDS words or more that was verified on the texts, and every word
of such a match is reported (but for equal 64-bit hashes of different words).

Defined results. Words are split at white space and compared exactly. Null, empty and
short texts have no passages. Rows that repeat a doc_id and text are one document. A
null doc_id is kept. Repeats inside one document only are not reported. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millgauge.llm.common import stored

MIN_WORDS = 50
GRAM_WORDS = 12
WINDOW = 16
CONTEXT = MIN_WORDS - WINDOW + 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _grams(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of ``size`` words from every place, or from the places ``at``."""
    places = np.arange(len(hashes) - size + 1) if at is None else at
    out = np.zeros(len(places), np.uint64)
    for step in range(size):
        out = out * _FACTOR + hashes[places + step]
        out ^= out >> np.uint64(29)
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept suffixes, the hashes of their first CONTEXT words and of the words around.

    The last takes the WINDOW - 1 words before and the first MIN_WORDS words; it is 0
    where the text has fewer.
    """
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _hashes(words)
    grams = _grams(hashes, GRAM_WORDS)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    places = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    places = places[places + CONTEXT <= len(words)]
    wide = np.zeros(len(places), np.int64)
    inside = (places >= WINDOW - 1) & (places + MIN_WORDS <= len(words))
    wide[inside] = _grams(hashes, WINDOW - 1 + MIN_WORDS, places[inside] - (WINDOW - 1)).view(np.int64)
    return places, _grams(hashes, CONTEXT, places).view(np.int64), wide


def stretches(words: list[bytes], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all stretches of MIN_WORDS words that hold one of the places among their first WINDOW words."""
    starts = np.unique(np.asarray(places, np.int64)[:, None] - np.arange(WINDOW))
    starts = starts[(starts >= 0) & (starts + MIN_WORDS <= len(words))]
    return starts, _grams(_hashes(words), MIN_WORDS, starts).view(np.int64)


def suffixes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, place, context, wide) of all kept suffixes, in the shared folder; ``doc`` is a hash of id and text."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, one in zip(batch["doc"].to_pylist(), batch["text"]):
                places, contexts, wide = anchors(_split(one.as_py()))
                if len(places):
                    columns = (np.full(len(places), number), places.astype(np.int32), contexts, wide)
                    yield pa.record_batch([pa.array(column) for column in columns], ["doc", "place", "context", "wide"])

    keyed = docs.select(F.xxhash64(doc, text).alias("doc"), F.col(text).alias("text"))
    return stored(keyed.mapInArrow(select, "doc long, place int, context long, wide long"), "suffixes")


NEIGHBOURS = "doc long, place int, other long, other_place int, open boolean"


def compared(doc: np.ndarray, context: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: the row that each one's partner is in (-1: none), and whether its stretches have to be met.

    Runs that touch either end may go on elsewhere.
    """
    rows = np.arange(len(doc))
    new_run = np.r_[True, context[1:] != context[:-1]]
    new_class = new_run | np.r_[True, wide[1:] != wide[:-1]]
    starts, first = np.flatnonzero(new_run), np.flatnonzero(new_class)
    run, same = np.cumsum(new_run) - 1, np.cumsum(new_class) - 1
    # The first and last row of each one's class; they are its least and greatest documents.
    low, high = first[same], np.r_[first[1:], len(doc)][same] - 1
    settled = (wide != 0) & (doc[low] != doc[high])
    ends = np.r_[starts[1:], len(doc)] - 1
    cut = (starts == 0) | (ends == len(doc) - 1)
    two = (ends - starts == 1) & ~cut
    shared = cut | (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
    done = two | (np.logical_and.reduceat(settled, starts) & ~cut)

    partner = np.where(settled, np.where(doc[low] != doc, low, high), -1)
    pair = two[run] & shared[run] & ~settled
    partner[pair] = (starts[run] + ends[run] - rows)[pair]
    return partner, (shared & ~done)[run] & (~settled | (rows == low) | (rows == high))


def sorted_neighbours(kept: DataFrame) -> DataFrame:
    """(doc, place, other, other_place, open): suffixes with a partner, and those whose stretches have to be met."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, place, context, wide = (batch[name].to_numpy() for name in ("doc", "place", "context", "wide"))
            partner, unmet = compared(doc, context, wide)
            chosen = np.flatnonzero((partner >= 0) | unmet)
            other, without = partner[chosen], partner[chosen] < 0
            yield pa.record_batch(
                [doc[chosen], place[chosen], pa.array(doc[other], mask=without), pa.array(place[other], mask=without), unmet[chosen]],
                ["doc", "place", "other", "other_place", "open"],
            )

    order = ["context", "wide", "doc"]
    rows = kept.repartitionByRange(*order).sortWithinPartitions(*order, "place")
    return stored(rows.mapInArrow(compare, NEIGHBOURS), "sorted-neighbours")


def _met(stretched: DataFrame) -> DataFrame:
    """(doc, place, other, other_place) of stretches that another document has too."""
    here = F.struct("doc", F.col("start").alias("place"))
    ends = stretched.groupBy("stretch").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    found = stretched.join(ends.where(F.col("low")["doc"] != F.col("high")["doc"]), "stretch")
    other = F.when(F.col("low")["doc"] != F.col("doc"), F.col("low")).otherwise(F.col("high"))
    return found.select("doc", F.col("start").alias("place"), other["doc"].alias("other"), other["place"].alias("other_place"))


def _refined(docs: DataFrame, hot: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, start, stretch): the hashed stretches around the places of ``hot`` (doc, place)."""
    asked = stored(hot.groupBy("doc").agg(F.collect_set("place").alias("places")), "places-to-refine")
    keyed = docs.select(F.xxhash64(doc, text).alias("doc"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, one, places in zip(batch["doc"].to_pylist(), batch["text"], batch["places"]):
                starts, hashes = stretches(_split(one.as_py()), places.as_py())
                if len(starts):
                    columns = (np.full(len(starts), number), starts.astype(np.int32), hashes)
                    yield pa.record_batch([pa.array(column) for column in columns], ["doc", "start", "stretch"])

    rows = keyed.join(asked, "doc").select("doc", "text", "places")
    return stored(rows.mapInArrow(cut, "doc long, start int, stretch long"), "stretches")


def neighbours(kept: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, other, at): the places (shift, place) of a document to compare with ``other``, ``shift`` words further on."""
    lined = sorted_neighbours(kept)
    exact = _met(_refined(docs, lined.where("open"), doc, text))
    pairs = lined.where(F.col("other").isNotNull()).select("doc", "place", "other", "other_place").unionByName(exact)
    at = F.struct((F.col("other_place") - F.col("place")).alias("shift"), "place")
    return pairs.groupBy("doc", "other").agg(F.array_sort(F.collect_set(at)).alias("at"))


def extended(mine: list[bytes], theirs: list[bytes], at: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Stretches [start, end) of ``mine`` equal to ``theirs`` shifted, around the places ``at`` (shift, place), in order."""
    out: list[tuple[int, int, int]] = []
    for shift, place in at:
        if out and shift == out[-1][2] and place < out[-1][1]:
            continue
        if mine[place : place + CONTEXT] != theirs[place + shift : place + shift + CONTEXT]:
            continue
        start, end = place, place + CONTEXT
        while start > 0 and start + shift > 0 and mine[start - 1] == theirs[start + shift - 1]:
            start -= 1
        while end < len(mine) and end + shift < len(theirs) and mine[end] == theirs[end + shift]:
            end += 1
        out.append((start, end, shift))
    return out


MATCHES = "doc long, doc_id {kind}, other_id {kind}, start int, end int, other_start int"


def matches(docs: DataFrame, pairs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Extended matches (doc, doc_id, other_id, start, end, other_start) of the compared documents."""
    kind = docs.schema[doc].dataType.simpleString()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([small.compress((one.as_py() or "").encode()) for one in batch["text"]], pa.binary())
            yield pa.record_batch([batch["doc"], batch["doc_id"], texts], ["doc", "doc_id", "packed"])

    keyed = docs.select(F.xxhash64(doc, text).alias("doc"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    texts = keyed.mapInArrow(compress, f"doc long, doc_id {kind}, packed binary").dropDuplicates(["doc"])
    # Both joins read the same shuffled texts.
    mine = pairs.join(texts, "doc").withColumnsRenamed({"doc": "me", "doc_id": "my_id", "packed": "my_packed"})
    rows = mine.join(texts, mine["other"] == texts["doc"]).select("me", "my_id", "doc_id", "at", "my_packed", "packed")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc", "doc_id", "other_id", "start", "end", "other_start")}
            for row in range(batch.num_rows):
                one = {name: batch[name][row].as_py() for name in batch.schema.names}
                words, theirs = (large.decompress(one[name]).split() for name in ("my_packed", "packed"))
                for start, end, shift in extended(words, theirs, [(x["shift"], x["place"]) for x in one["at"]]):
                    if end - start >= min_words:
                        for name, value in zip(out, (one["me"], one["my_id"], one["doc_id"], start, end, start + shift)):
                            out[name].append(value)
            types = [pa.int64(), batch.schema.field("my_id").type, batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(values, type_) for values, type_ in zip(out.values(), types)], list(out))

    return rows.mapInArrow(extend, MATCHES.format(kind=kind))


def repeated_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, other_id, other_start): words of a document that other documents hold too.

    Overlapping matches are one passage; ``other_id`` and ``other_start`` belong to its
    longest match, ``other_start`` to where that begins.
    """
    pairs = stored(neighbours(suffixes(docs, doc, text), docs, doc, text), "suffix-neighbours")
    found = stored(matches(docs, pairs, doc, text, min_words), "matches")
    by_start = Window.partitionBy("doc").orderBy("start", "end", "other_id", "other_start")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    opened = found.withColumn("opens", (F.coalesce(F.max("end").over(before), F.lit(-1)) < F.col("start")).cast("int"))
    run = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("length"), "other_id", "other_start"))
    united = opened.withColumn("run", F.sum("opens").over(run)).groupBy("doc", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best")
    )
    return united.select(
        "doc_id", "start", "end", F.col("best")["other_id"].alias("other_id"), F.col("best")["other_start"].alias("other_start")
    )
