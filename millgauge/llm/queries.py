"""Registered queries of the operators and their SQL. Each digest comes from its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millgauge import session
from millgauge.llm import chat, decontaminate, filter_audit, minhash, orchard, quality_rules, resharding, secrets, sentencepiece, simhash, suffixes, token_files, warc
from millgauge.llm.common import table, tokenizer_path
from millgauge.llm.sql import DECONTAMINATION_SQL, FILTER_AUDIT_SQL, MINHASH_SQL, QUALITY_SQL, VECTOR_CODES_SQL


SHARDS, OLD_SHARDS = 40, 32


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, and whether decoding them gives the text back."""
    pieces = sentencepiece.read_pieces(tokenizer_path("piece_bpe_32k.model"))
    encoded = sentencepiece.encode(table(spark, folder, "documents"), pieces, decode_too=True)
    return sentencepiece.digests(encoded, pieces)


def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every capture derived from the pages, revisits resolved."""
    found = warc.resolve(warc.captures(table(spark, folder, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda h: F.concat_ws(": ", h["key"], h["value"])))
    return found.select("record_id", "canonical_url", "ts", "kind", "outcome", "response_id", "digest", F.array_join(entries, "\n").alias("headers"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    return token_files.round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.components(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics and verdict of every document."""
    return quality_rules.judged(table(spark, folder, "documents")).select(
        "doc_id",
        *(F.col("quality")[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")),
    )


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that documents share."""
    return suffixes.repeated_passages(table(spark, folder, "documents"))


def op7_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lie in shards by source, moved into 40 even shards; the files of changed shards are rewritten."""
    docs = table(spark, folder, "documents")
    by_source = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    placed, affected = resharding.reshard(docs, by_source, SHARDS)
    path = session.fresh_folder(spark, "resharded")
    resharding.rewrite_affected(placed, affected, path)
    rewritten = resharding.read_shards(spark, path, placed)
    untouched = placed.where(~F.col("shard").isin(affected)) if len(affected) < SHARDS else placed.limit(0)
    return rewritten.unionByName(untouched).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.findings(table(spark, folder, "documents"))
    base = [kind for kind, *_ in secrets.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = (F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in base)
    return found.select("doc_id", *counts, F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op10_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation repaired and rendered."""
    return chat.conversations(table(spark, folder, "conversations"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from the documents in each of their orders."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return minhash.components(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every embedding, and a digest of the codebooks."""
    coded, books = orchard.compress(table(spark, folder, "embeddings"))
    digest = F.lit(None if books is None else orchard.digest(books)).cast("string")
    return coded.select("vec_id", orchard.hex_code(F.col("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_resharding": op7_resharding,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_chat_repair": op10_chat_repair,
    "op11_filter_audit": op11_filter_audit,
    "op12_minhash": op12_minhash,
    "op13_vector_codes": op13_vector_codes,
}

STATEMENTS = {
    "op5_quality_rules": QUALITY_SQL,
    "op9_decontamination": DECONTAMINATION_SQL,
    "op11_filter_audit": FILTER_AUDIT_SQL,
    "op12_minhash": MINHASH_SQL,
    "op13_vector_codes": VECTOR_CODES_SQL,
}
