"""Documents to token ids, in five stages: each reads what the one before has written.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the
last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millgauge.llm import decontaminate, quality_rules, secrets, sentencepiece, simhash
from millgauge.llm.common import stored, table, tokenizer_path

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark passages to count as contaminated."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and the length that this gives."""
    clean = secrets.redacted(docs)
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", changed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that decoding gives the text back."""
    pieces = sentencepiece.read_pieces(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece.digests(sentencepiece.encode(docs, pieces, decode_too=True), pieces, keep_ids=True)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode),
]

# No SQL expresses fingerprint components or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
