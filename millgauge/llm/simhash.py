"""SimHash near-duplicates found through Golay-code fuzzy keys.

A fingerprint has 64 bits. It is cut into segments of 22, 21 and 21 bits, each read as
a word of the perfect (23, 12) Golay code. Two fingerprints that differ in at most two
bits agree on one segment and differ in at most one bit on the segment after it
(cyclically): with two errors over three segments, one of the three such pairs always
has none on its first and at most one on its second segment.

A key is the whole first segment with the number of a codeword near the second one. A
word at distance d from another decodes to a codeword (at most 3 away) that is at most
3 + d away from the other. So each fingerprint is filed once under its decoded codeword
and looks under every codeword at most 4 away, 1 or 6 of them; whatever differs in one
bit is found. Pairs that share a key are verified by counting their differing bits.

Copies share a fingerprint and are one row here. A key with more than ``KEY_ROWS``
members on a side forms no pairs: its members go, each once, through all 65 variants of
the fingerprint with at most one bit changed. Fingerprints with a variant in common differ in two bits at
most, and any that do have one, so linking a variant's members to the smallest of them
is exact and makes 65 rows a fingerprint, however large the group.

Defined results. A null or empty text has no words and the fingerprint 0, which links
like any other. A null doc_id keeps its row; a component's id is the smallest doc_id
that is not null. Repeated rows are copies. Extra columns are not read; an empty table
gives an empty result. Long texts are hashed in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millgauge.llm.common import stored
from millgauge.llm.components import connected

SHINGLE_WORDS = 3
MAX_BITS = 2
# Members of a key up to which its pairs are formed, on either side.
KEY_ROWS = 64
BLOCK = 1 << 15

# Low bit and width of the segments; generator of the Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR, CODE_BITS, CHECK_BITS = 0xC75, 23, 11


def fingerprint(text: str | None) -> int:
    """Majority of the shingle hashes in each bit, as a signed 64-bit number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < SHINGLE_WORDS:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE_WORDS))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(text) for text in batch], dtype="int64")


def _patterns() -> tuple[np.ndarray, list[list[int]]]:
    """Per syndrome: the lightest error, and all errors of weight four."""
    from itertools import combinations

    light = np.zeros(1 << CHECK_BITS, np.int64)
    four: list[list[int]] = [[] for _ in light]
    for weight in range(1, 5):
        errors = np.array([sum(1 << bit for bit in bits) for bits in combinations(range(CODE_BITS), weight)], np.int64)
        for error, syndrome in zip(errors.tolist(), _syndrome(errors).tolist()):
            if weight < 4:
                light[syndrome] = error
            else:
                four[syndrome].append(error)
    return light, four


def _syndrome(values: np.ndarray) -> np.ndarray:
    """Remainder of the words as polynomials by the generator."""
    rest = values.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


LIGHT, FOUR = _patterns()


def codewords_near(word: int) -> list[int]:
    """Numbers of the codewords at most 4 away, the decoded one first."""
    syndrome = int(_syndrome(np.array([word], np.int64))[0])
    return [(word ^ error) >> CHECK_BITS for error in (int(LIGHT[syndrome]), *FOUR[syndrome])]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("home", T.BooleanType())])))
def _keys(fingerprints: pd.Series) -> pd.Series:
    """All keys of a fingerprint; ``home`` marks the decoded one of each pair of segments."""
    values = fingerprints.to_numpy(np.int64)
    parts = [(values >> low) & ((1 << width) - 1) for low, width in SEGMENTS]
    syndromes = [_syndrome(part) for part in parts]
    rows: list[list[dict]] = [[] for _ in values]
    for pair in range(3):
        exact, fuzzy, syndrome = parts[pair], parts[(pair + 1) % 3], syndromes[(pair + 1) % 3]
        for row, (whole, word, check) in enumerate(zip(exact.tolist(), fuzzy.tolist(), syndrome.tolist())):
            base = (pair << 40) | (whole << 12)
            rows[row].append({"key": base | ((word ^ int(LIGHT[check])) >> CHECK_BITS), "home": True})
            rows[row].extend({"key": base | ((word ^ error) >> CHECK_BITS), "home": False} for error in FOUR[check])
    return pd.Series(rows)


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(doc_id, fp, more columns) of every row, written to the shared folder."""
    return stored(docs.select(F.col(doc).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"), *more), "fingerprints")


def links(distinct: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints ``fp`` that connect all within two bits."""
    keyed = stored(distinct.select("fp", F.explode(_keys("fp")).alias("at")).select("fp", "at.*"), "golay-keys")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if("home").alias("homes"))
    shared = counts.where("`all` > 1 AND homes > 0")
    many = F.col("all") > key_rows
    cold = keyed.join(shared.where(~many).select("key"), "key", "left_semi")
    hot = keyed.join(shared.where(many).select("key"), "key", "left_semi").select("fp").distinct()
    filed = cold.where("home").select("key", F.col("fp").alias("a"))
    looking = cold.select("key", F.col("fp").alias("b"))
    pairs = filed.join(looking, "key").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, MAX_BITS)).select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long") for bit in range(64)))
    variants = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    centre = variants.groupBy("variant").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = variants.join(centre, "variant").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, doc: str = "doc_id", text: str = "text", key_rows: int = KEY_ROWS, more: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, more columns) of every row."""
    each = fingerprints(docs, doc, text, *more)
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    edges = stored(links(distinct, key_rows), "fingerprint-links")
    roots = connected(edges)
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id", *each.columns[2:])


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the smallest id of each component, with their own columns.

    Each row is judged by the component of its own text, so rows that repeat a doc_id
    with other texts may part, and every component keeps its smallest id. Rows without
    a doc_id stay, since nothing tells which of them comes first.
    """
    members = components(docs, doc, text, more=(F.xxhash64(text).alias("version"),))
    gone = members.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"))
    gone = stored(gone.distinct(), "near-copies")
    return docs.join(gone, (docs[doc] == gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_version"]), "left_anti")
