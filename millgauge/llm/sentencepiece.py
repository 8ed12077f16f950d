"""SentencePiece encoding over a relational lattice, and decoding.

A text becomes SentencePiece's normal form (a leading space, spaces as the mark U+2581)
and is cut where a mark follows another character. No piece of the table spans such a
place, which is checked, so the best segmentation of a text is that of its units. Each
distinct unit is segmented once:

* its substrings of up to the longest piece's length are exploded, with their places;
* an equi-join to the piece table keeps those that are pieces: the edges of its lattice;
* the edges are grouped by unit, in order of their ends;
* a higher-order aggregate folds them into the best score and last piece of every place.

The piece table is the model's vocabulary, of a checked size (``MAX_PIECES``), and is the
only thing broadcast. Documents are dealt into chunks of about ``CHUNK_BYTES`` by a hash;
a chunk names its distinct units once to the lattice, gets their ids back in the same
order, and writes the ids of its documents. So a text is moved once, a frequent word is
one row per chunk, and no vocabulary is held beyond one chunk's.

The segmentation is that of the unigram method: the highest sum of piece scores, the
earliest start winning ties, a character without a piece as an unknown one below the
lowest score, written as byte pieces where the table has them.

Defined results. A null or empty text has no pieces and decodes to an empty text. Rows
that repeat are encoded each. A null doc_id is kept. Extra columns are not read. An
empty table gives an empty result. Long units fold in blocks, in linear time.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millgauge.llm.common import let, release

MARK = "▁"
CHUNK_BYTES = 8 << 20
# Bytes of text per bucket of distinct units: a bucket's edges fit in a task's memory.
BUCKET_BYTES = 1 << 20
MAX_PIECES = 500_000
UNKNOWN_PENALTY = 10.0
FOLD_BLOCK = 256
UNKNOWN = -1
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary: pieces that segment texts, the ids of byte pieces, the unknown id."""

    texts: tuple[str, ...]
    usable: tuple[tuple[str, int, float], ...]
    bytes_at: tuple[int, ...]
    unknown: int
    skipped: frozenset[int]

    @property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.usable)

    @property
    def unknown_score(self) -> float:
        return min(score for _, _, score in self.usable) - UNKNOWN_PENALTY


def read_pieces(path: str) -> Pieces:
    """The piece table of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    number = range(model.get_piece_size())
    texts = tuple(model.id_to_piece(i) for i in number)
    special = {i for i in number if model.is_control(i) or model.is_unknown(i)}
    of_byte = {int(texts[i][3:5], 16): i for i in number if model.is_byte(i)}
    usable = tuple((texts[i], i, float(model.get_score(i))) for i in number if i not in special and not model.is_byte(i) and not model.is_unused(i))
    return pieces_of(texts, usable, tuple(of_byte[b] for b in range(256)) if len(of_byte) == 256 else (), model.unk_id(), frozenset(i for i in number if model.is_control(i)))


def pieces_of(texts, usable, bytes_at, unknown, skipped=frozenset()) -> Pieces:
    """A checked piece table."""
    if len(texts) > MAX_PIECES:
        raise ValueError(f"{len(texts)} pieces are more than the {MAX_PIECES} that may be broadcast")
    if any(MARK in piece.lstrip(MARK) for piece, _, _ in usable):
        raise ValueError("a piece holds a space after another character")
    return Pieces(tuple(texts), tuple(usable), tuple(bytes_at), unknown, frozenset(skipped))


def units(text: str | None) -> list[str]:
    """The units of a text, each without its first mark."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [unit[1:] for unit in _UNITS.findall(MARK + text.replace(" ", MARK))]


def _bucket(unit: str, buckets: int) -> int:
    return zlib.crc32(unit.encode()) % buckets


def _by_bucket(texts: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """Distinct units of the texts in buckets, sorted."""
    found: set[str] = set()
    for text in texts:
        found.update(units(text))
    out: dict[int, list[str]] = defaultdict(list)
    for unit in sorted(found):
        out[_bucket(unit, buckets)].append(unit)
    return out


def lattice(distinct: DataFrame, pieces: Pieces, keys: list[str], unit: str = "unit") -> DataFrame:
    """Per row of ``keys`` and ``unit``: the edges (end, start, id, score) of its lattice.

    Starts and ends count characters of the unit with its mark put back.
    """
    spark = distinct.sparkSession
    table = pa.table({"piece": [p for p, _, _ in pieces.usable], "id": pa.array([i for _, i, _ in pieces.usable], pa.int32()), "score": [s for _, _, s in pieces.usable]})
    known = spark.createDataFrame(table)
    whole = distinct.select(*keys, unit, F.concat(F.lit(MARK), unit).alias("whole"))
    size = F.char_length("whole")
    starts = whole.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("start")))).alias("length"))
    substrings = spans.select(*keys, unit, "start", "length", F.substring("whole", F.col("start") + 1, F.col("length")).alias("piece"))
    # A single character is kept without a piece too: it is then unknown.
    single = F.col("length") == 1
    edges = substrings.join(F.broadcast(known), "piece", "left").where(F.col("id").isNotNull() | single)
    edge = F.struct(
        (F.col("start") + F.col("length")).alias("end"),
        "start",
        F.coalesce("id", F.lit(UNKNOWN)).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )
    return edges.groupBy(*keys, unit).agg(F.collect_list(edge).alias("edges"))


def best_paths(edges: Column) -> Column:
    """Viterbi as a fold: for every place, from the first, the last piece's start and id on the best way there.

    Edges are folded by end and start, so of equal ways the one whose last piece begins
    first is taken. The best way to an end is settled when the first edge of the next
    end comes. Settled places go to ``recent`` and from there, in blocks, to ``old``: an
    edge starts at most the longest piece before its end, so it only looks into ``recent``.
    """
    place = "struct<score: double, start: int, id: int>"
    none = F.lit(None).cast(place)
    origin = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(UNKNOWN).alias("id"))
    begin = F.struct(
        F.array().cast(f"array<array<{place}>>").alias("old"),
        F.array(origin).cast(f"array<{place}>").alias("recent"),
        F.lit(0).alias("base"),
        F.lit(1).alias("end"),
        none.alias("best"),
    )

    def settled(state: Column) -> Column:
        """The state with the best way to its end put among the settled places."""
        recent = F.concat(state["recent"], F.array(state["best"]))
        full = F.size(state["recent"]) >= 2 * FOLD_BLOCK
        return F.when(
            full,
            F.struct(
                F.concat(state["old"], F.array(F.slice(state["recent"], 1, FOLD_BLOCK))).alias("old"),
                F.slice(recent, FOLD_BLOCK + 1, 2 * FOLD_BLOCK + 1).alias("recent"),
                (state["base"] + FOLD_BLOCK).alias("base"),
                (state["end"] + 1).alias("end"),
                none.alias("best"),
            ),
        ).otherwise(
            F.struct(state["old"].alias("old"), recent.alias("recent"), state["base"].alias("base"), (state["end"] + 1).alias("end"), none.alias("best"))
        )

    def improve(state: Column, edge: Column) -> Column:
        score = F.get(state["recent"], edge["start"] - state["base"])["score"] + edge["score"]
        better = state["best"].isNull() | (score > state["best"]["score"])
        best = F.when(better, F.struct(score.alias("score"), edge["start"].alias("start"), edge["id"].alias("id"))).otherwise(state["best"])
        return state.withField("best", best)

    def step(state: Column, edge: Column) -> Column:
        return F.when(edge["end"] == state["end"], improve(state, edge)).otherwise(let(settled(state), lambda s: improve(s, edge)))

    def places(state: Column) -> Column:
        every = F.concat(F.flatten(state["old"]), state["recent"], F.array(state["best"]))
        return F.struct(F.transform(every, lambda p: p["start"]).alias("starts"), F.transform(every, lambda p: p["id"]).alias("ids"))

    return F.aggregate(F.sort_array(edges), begin, step, places)


def path_ids(unit: str, starts: list[int], ids: list[int], pieces: Pieces) -> list[int]:
    """Ids on the best path, walked back from the end; unknown characters as byte pieces if there are any."""
    out: list[int] = []
    at = len(starts) - 1
    while at > 0:
        if ids[at] != UNKNOWN:
            out.append(ids[at])
        elif pieces.bytes_at:
            character = (MARK + unit)[at - 1]
            out.extend(pieces.bytes_at[b] for b in reversed(character.encode("utf-8", "surrogatepass")))
        elif not (out and out[-1] == pieces.unknown):
            out.append(pieces.unknown)  # a run of unknown characters is one piece
        at = starts[at]
    return out[::-1]


def _lists(column: pa.ChunkedArray) -> Iterator[list[int]]:
    """The lists of whole numbers of a column."""
    for chunk in column.chunks:
        at, values = chunk.offsets.to_pylist(), chunk.values.to_numpy(zero_copy_only=False).tolist()
        yield from (values[a:b] for a, b in zip(at, at[1:]))


def _pack(lists: list[list[int]]) -> bytes:
    flat = [i for x in lists for i in x]
    width = "<u2" if max(flat, default=0) < 1 << 16 else "<u4"
    head = np.array([len(lists), int(width[2]), *map(len, lists)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + np.array(flat, width).tobytes())


def _unpack(data: bytes) -> list[bytes]:
    """The lists of ids, each as little-endian 32-bit numbers."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    count, width = np.frombuffer(raw, "<u4", 2).tolist()
    ends = (4 * np.cumsum(np.frombuffer(raw, "<u4", count, 8), dtype=np.int64)).tolist()
    ids = np.frombuffer(raw, f"<u{width}", -1, 8 + 4 * count).astype("<u4").tobytes()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def encode(
    docs: DataFrame, pieces: Pieces, doc: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, decode_too: bool = False
) -> DataFrame:
    """(doc_id, ids, text_crc32) of every row; ``ids`` are packed little-endian 32-bit numbers.

    With ``decode_too`` also decoded_crc32, of the text that the ids decode to. The worker
    that writes the ids decodes them, so that a task needs no second one beside it.
    """
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    chunks = 1 + total // chunk_bytes
    buckets = 1 + total // BUCKET_BYTES
    kind = docs.schema[doc].dataType.simpleString()
    dealt = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc, text), F.lit(chunks)).cast("int").alias("chunk"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            texts = pa.array([small.compress((one.as_py() or "").encode()) for one in batch["text"]], pa.binary())
            yield pa.record_batch([batch["doc_id"], batch["chunk"], texts], ["doc_id", "chunk", "text"])

    # Compressed before they move: the texts are the larger part of all that is shuffled.
    keyed = dealt.mapInArrow(compress, f"doc_id {kind}, chunk int, text binary")

    def plain(group: pa.Table) -> Iterator[str]:
        """The texts of a chunk, one at a time."""
        large = zstandard.ZstdDecompressor()
        for one in group["text"]:
            yield large.decompress(one.as_py()).decode()

    def name_units(group: pa.Table) -> pa.Table:
        chunk = group["chunk"][0].as_py()
        found = _by_bucket(plain(group), buckets)
        release()
        return pa.table(
            {"bucket": pa.array(list(found), pa.int32()), "chunk": pa.array([chunk] * len(found), pa.int32()), "units": pa.array(map(" ".join, found.values()), pa.string())}
        )

    # A unit holds no space, so a space parts the units of a bucket.
    asked = keyed.groupBy("chunk").applyInArrow(name_units, "bucket int, chunk int, units string").repartition(buckets, "bucket")
    # Both uses of ``asked`` read all its columns and rows (an inner explode would filter
    # them first), so that they share one shuffle.
    distinct = asked.select("bucket", "chunk", F.explode_outer(F.split("units", " ")).alias("unit")).groupBy("bucket", "unit").agg(F.min("chunk").alias("asker"))
    solved = lattice(distinct, pieces, ["bucket", "asker"]).select("bucket", "asker", "unit", best_paths(F.col("edges")).alias("best"))
    solved = solved.select(F.col("bucket").alias("of_bucket"), "asker", "unit", "best.*")

    def answer(questions: pa.Table, answers: pa.Table) -> pa.Table:
        starts, last = _lists(answers["starts"]), _lists(answers["ids"])
        ids = {unit: path_ids(unit, one, its, pieces) for unit, one, its in zip(answers["unit"].to_pylist(), starts, last)}
        packed = [_pack([ids[unit] for unit in row]) for row in (one.as_py().split(" ") for one in questions["units"])]
        release()
        return pa.table({"chunk": questions["chunk"], "bucket": questions["bucket"], "packed": pa.array(packed, pa.binary())})

    answers = asked.groupBy("bucket").cogroup(solved.groupBy("of_bucket")).applyInArrow(answer, "chunk int, bucket int, packed binary")

    def write_ids(group: pa.Table, coded: pa.Table) -> pa.Table:
        named = _by_bucket(plain(group), buckets)
        ids: dict[str, bytes] = {}
        for bucket, packed in zip(coded["bucket"].to_pylist(), coded["packed"]):
            ids.update(zip(named.pop(bucket), _unpack(packed.as_py())))
        columns = {
            "doc_id": group["doc_id"],
            "ids": pa.array((b"".join(map(ids.__getitem__, units(one))) for one in plain(group)), pa.binary()),
            "text_crc32": pa.array((zlib.crc32(one.encode()) for one in plain(group)), pa.int64()),
        }
        if decode_too:
            known = piece_bytes(pieces)
            columns["decoded_crc32"] = pa.array((zlib.crc32(decoded(one.as_py(), pieces, known).encode()) for one in columns["ids"]), pa.int64())
        release()
        return pa.table(columns)

    schema = f"doc_id {kind}, ids binary, text_crc32 long" + (", decoded_crc32 long" if decode_too else "")
    return keyed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(write_ids, schema)


def piece_bytes(pieces: Pieces) -> list[bytes]:
    """What each id decodes to: byte pieces the bytes they are, control pieces nothing."""
    found = [b"" if i in pieces.skipped else piece.encode() for i, piece in enumerate(pieces.texts)]
    for b, number in enumerate(pieces.bytes_at):
        found[number] = bytes([b])
    return found


def decoded(ids: bytes, pieces: Pieces, known: list[bytes] | None = None) -> str:
    """The text of packed ids: what each decodes to (``known``, if made before), marks as spaces, the first one dropped."""
    known = known or piece_bytes(pieces)
    joined = b"".join(map(known.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
    return joined.replace(MARK, " ").removeprefix(" ")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text of their packed ids."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_bytes(pieces)
        for batch in batches:
            column = pa.array([decoded(one.as_py() or b"", pieces, known) for one in batch[ids]], pa.string())
            yield pa.record_batch([*batch.columns, column], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(texts, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(encoded: DataFrame, pieces: Pieces, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, text_crc32, round_trip) of encoded rows, and their packed ids.

    Rows that were encoded without ``decode_too`` are decoded here.
    """
    if "decoded_crc32" not in encoded.columns:
        encoded = decode(encoded, pieces).withColumn("decoded_crc32", F.crc32(F.encode("decoded", "UTF-8")))
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        "decoded_crc32",
        "text_crc32",
        *(["ids"] if keep_ids else []),
        (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"),
    )
