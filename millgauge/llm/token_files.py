"""Token ids in binary files: one compressed frame per document, a shared dictionary.

Documents are sorted by doc_id over range partitions, so a file holds a stretch of ids
and files follow one another. A file is a table of blocks. A block keeps the frames of a
few documents in one binary value, with the byte offset, the id count and the running
start of each, and the hash of the dictionary that its frames need. A reader finds a
document by the block's id range, cuts its frame out by the offset and expands it alone.
The dictionary is trained once on a bounded sample of serialized documents
(``SAMPLE_DOCS``) and stored beside the files; it changes sizes only, never ids.

Starts are kept relative to the file, so files are written independently; a file's own
start is the sum over the files before it, a few numbers per file.

Encoding gives the tokenizer library's own ids. For byte-level models with the usual
pre-tokenizer a text is cut before single spaces, where the pre-tokenizer always cuts
too, and each distinct unit is encoded by the library once per worker (the memory for
this is bounded by ``CACHE_UNITS``). A unit of Latin letters, digits, punctuation and
line ends is made of its parts, which many units share. Texts that hold a special token's string, and other
models, are encoded whole.

Defined results. A null text is empty and holds the end id only. Rows that repeat are
documents of their own, ordered by their text's hash; a null doc_id comes first. Extra
columns are not read. An empty table gives no files and an empty result. A document is
compressed in memory, one at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millgauge import session

END_ID = 0
SAMPLE_DOCS = 512
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 1 << 16
BLOCK_DOCS = 128
BLOCK_BYTES = 1 << 20
CACHE_UNITS = 1_200_000
# Units that one call of the library encodes.
CALL_UNITS = 4096
# Fixed value: how a byte-level vocabulary writes a space.
SPACE = "Ġ"
LEVEL = 3
# Parts of a unit as the usual pre-tokenizer cuts it, for units that hold nothing else: no
# apostrophe, which may begin a contraction, and line ends between two other characters only.
_KINDS = ("A-Za-zÀ-ÖØ-öø-ÿ", "0-9", r"!-&(-/:-@\[-`{-~")
_PARTS = re.compile("|".join(["\n", *(f"[{kind}]+" for kind in _KINDS)]))
_PLAIN = re.compile("[{0}]+(?:\n[{0}]+)*".format("".join(_KINDS)))


class Encoder:
    """Ids of texts as the library gives them, packed as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        cut = model.get("pre_tokenizer") or {}
        self.by_unit = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("normalizer")
        )
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[number for token, number in vocabulary.items() if token.startswith(SPACE)]] = True

    def _pack(self, units: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def _learn_first(self, units: set[str]) -> None:
        missing = [unit for unit in units if unit not in self.first]
        if missing:
            self.first.update(zip(missing, self._pack(missing)))

    def _learn_spaced(self, units: set[str]) -> None:
        """Units after a space; those of several parts from the ids of their parts."""
        parts = {unit: _PARTS.findall(unit) for unit in units if not unit.isalpha() and _PLAIN.fullmatch(unit)}
        parts = {unit: found for unit, found in parts.items() if len(found) > 1}
        self._learn_whole({unit for unit in units if unit not in parts}.union(found[0] for found in parts.values()))
        self._learn_first({part for found in parts.values() for part in found[1:]})
        for unit, (head, *rest) in parts.items():
            self.spaced[unit] = self.spaced[head] + b"".join(map(self.first.__getitem__, rest))

    def _learn_whole(self, units: set[str]) -> None:
        """Units after a space, many in one call: a token that begins with a space begins the next unit."""
        missing = [unit for unit in units if unit not in self.spaced]
        for at in range(0, len(missing), CALL_UNITS):
            some = missing[at : at + CALL_UNITS]
            joined = " ".join(["", *some])
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            starts = np.nonzero(self.opens[ids])[0]
            if len(starts) != len(some) or "" in some:
                self.spaced.update(zip(some, self._pack([" " + unit for unit in some])))
                continue
            data, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            self.spaced.update((unit, data[a:b]) for unit, a, b in zip(some, (4 * starts).tolist(), ends))

    def encode(self, text: str) -> bytes:
        if not self.by_unit or any(token in text for token in self.special):
            return self._pack([text])[0]
        for cache in (self.first, self.spaced):
            if len(cache) > CACHE_UNITS:
                cache.clear()
        if re.search(r" \s", text):
            # A run of white space: its last space begins the next unit.
            units = re.split(r"(?= \S)", text)
            self._learn_first(set(units))
            return b"".join(map(self.first.__getitem__, units))
        head, *rest = text.split(" ")
        self._learn_first({head})
        found = [*map(self.spaced.get, rest)]
        missing = {unit for unit, ids in zip(rest, found) if ids is None}
        if missing:
            self._learn_spaced(missing)
            found = map(self.spaced.__getitem__, rest)
        return self.first[head] + b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def _document(text: str | None, tokenizer: str) -> bytes:
    return encoder(tokenizer).encode(text or "") + END_ID.to_bytes(4, "little")


@dataclass(frozen=True)
class Dictionary:
    """Shared bytes of all frames; empty if there was nothing to train on."""

    data: bytes

    @property
    def name(self) -> str:
        return hashlib.sha256(self.data).hexdigest()

    def _shared(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.data) if self.data else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._shared())

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._shared())


def train_dictionary(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Dictionary:
    """A dictionary of the ``sample`` documents with the lowest hashes, among those of up to SAMPLE_CHARS characters."""
    few = (
        docs.select(F.col(text).alias("text"), F.xxhash64(doc, text).alias("at"))
        .where(F.char_length("text").between(1, SAMPLE_CHARS))
        .orderBy("at")
        .limit(sample)
        .select("text")
    )

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_document(one, tokenizer) for one in batch["text"].to_pylist()], pa.binary())], ["data"])

    arrays = [bytes(row.data) for row in few.mapInArrow(serialize, "data binary").collect()]
    try:
        return Dictionary(zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes())
    except (zstandard.ZstdError, ValueError):
        # Too little to train on: the documents themselves serve as shared content.
        return Dictionary(b"".join(arrays)[:DICTIONARY_BYTES])


BLOCKS = (
    "part int, block int, first_doc long, last_doc long, dictionary string, doc_ids array<long>, "
    "starts array<long>, counts array<int>, offsets array<int>, payload binary, n_tokens long"
)
_BLOCK_TYPES = pa.schema(
    [("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())),
     ("starts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("n_tokens", pa.int64())]
)


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, dictionary: Dictionary) -> Iterator[pa.RecordBatch]:
    """Blocks of one file, from its documents in order."""
    compressor, name = dictionary.compressor(), dictionary.name
    number, total = 0, 0
    ids: list = []
    starts: list[int] = []
    counts: list[int] = []
    frames: list[bytes] = []

    def block() -> pa.RecordBatch:
        known = [one for one in ids if one is not None]
        offsets = np.cumsum([0, *map(len, frames)])[:-1].tolist()
        row = [number, min(known, default=None), max(known, default=None), name, ids, starts, counts, offsets, b"".join(frames), sum(counts)]
        return pa.record_batch([pa.array([value], field.type) for value, field in zip(row, _BLOCK_TYPES)], schema=_BLOCK_TYPES)

    size = 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            data = _document(text.as_py(), tokenizer)
            frame = compressor.compress(data)
            ids.append(doc)
            starts.append(total)
            counts.append(len(data) // 4)
            frames.append(frame)
            total += counts[-1]
            size += len(frame)
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield block()
                number, size, ids, starts, counts, frames = number + 1, 0, [], [], [], []
    if ids:
        yield block()


def write(docs: DataFrame, root: str, tokenizer: str, doc: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the dictionary and the blocks below ``root``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, doc, text)
    spark.createDataFrame([(dictionary.name, bytearray(dictionary.data))], "name string, data binary").coalesce(1).write.parquet(f"{root}/dictionary")
    ordered = (
        docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    types = BLOCKS.removeprefix("part int, ")
    blocks = ordered.mapInArrow(lambda batches: _packed(batches, tokenizer, dictionary), types)
    blocks.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "uncompressed").parquet(f"{root}/blocks")


def _dictionary(spark: SparkSession, root: str) -> Dictionary:
    row = spark.read.schema("name string, data binary").parquet(f"{root}/dictionary").first()
    found = Dictionary(bytes(row.data))
    if found.name != row.name:
        raise ValueError(f"the dictionary below {root} is not the one it was")
    return found


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{root}/blocks")


def _cut(batch: pa.RecordBatch, row: int, decompressor: zstandard.ZstdDecompressor, name: str) -> Iterator[tuple]:
    """(doc_id, start, ids as bytes) of the documents of one block."""
    values = {field: batch[field][row].as_py() for field in ("dictionary", "doc_ids", "starts", "counts", "offsets", "payload")}
    if values["dictionary"] != name:
        raise ValueError(f"a block needs the dictionary {values['dictionary']}")
    ends = [*values["offsets"][1:], len(values["payload"])]
    for doc, start, count, begin, end in zip(values["doc_ids"], values["starts"], values["counts"], values["offsets"], ends):
        data = decompressor.decompress(values["payload"][begin:end])
        if len(data) != 4 * count:
            raise ValueError(f"document {doc} has {len(data) // 4} ids, not {count}")
        yield doc, start, data


def _part_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each file: a sum over the files, of which there are few."""
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, ids) of every document, expanded from its frame."""
    dictionary = _dictionary(spark, root)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = dictionary.decompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                docs, starts, ids = zip(*_cut(batch, row, decompressor, dictionary.name))
                lists = [np.frombuffer(data, "<u4").astype(np.int64) for data in ids]
                yield pa.record_batch(
                    [pa.array([batch["part"][row].as_py()] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["part", "doc_id", "start", "ids"],
                )

    blocks = _blocks(spark, root)
    rows = blocks.mapInArrow(expand, "part int, doc_id long, start long, ids array<long>")
    return rows.join(_part_starts(blocks), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def read_one(spark: SparkSession, root: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: only blocks that may hold it are read, and only their frames of it expanded."""
    dictionary = _dictionary(spark, root)
    rows = _blocks(spark, root).where(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc"))).select("doc_ids", "offsets", "payload")
    found = rows.where(F.array_contains("doc_ids", doc_id)).collect()
    decompressor = dictionary.decompressor()
    out = []
    for row in found:
        ends = [*row.offsets[1:], len(row.payload)]
        for doc, begin, end in zip(row.doc_ids, row.offsets, ends):
            if doc == doc_id:
                out.append(np.frombuffer(decompressor.decompress(bytes(row.payload[begin:end])), "<u4").tolist())
    return out


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its expanded frame."""
    dictionary = _dictionary(spark, root)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = dictionary.decompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                docs, starts, ids = zip(*_cut(batch, row, decompressor, dictionary.name))
                yield pa.record_batch(
                    [pa.array([batch["part"][row].as_py()] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array([len(data) // 4 for data in ids], pa.int64()), pa.array([zlib.crc32(data) for data in ids], pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = _blocks(spark, root)
    rows = blocks.mapInArrow(expand, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(_part_starts(blocks), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to a new shared folder and read the digests back."""
    root = session.fresh_folder(docs.sparkSession, "token-files")
    write(docs, root, tokenizer, doc, text)
    return digests(docs.sparkSession, root)
