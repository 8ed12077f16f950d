"""Benchmark decontamination with a positional inverted index.

The index holds a posting (term, document, position) for every occurrence of a
benchmark term in the documents; a term is stored as a small number. A window of
consecutive item words is looked up from its rarest term: the postings of that term,
shifted by its place in the window, are the candidate starts. The shifted lists of
the second and third rarest terms are intersected with them one after the other, and
what is left is checked against the postings of all other terms at once. Frequent
words are read only for candidates that three rare terms have confirmed.

``phrase_matches`` gives exact phrases, ``proximity_matches`` windows whose terms all
lie near their rarest term in any order.

Nothing grows with the square of a group: every list is joined by (document,
position), which at most one posting has. Tables that are joined to the index are
written first, so Spark broadcasts one only if its real size is within the session's
limit and shuffles otherwise.

Defined results. A null or empty text has no words, hits nothing and is not
contaminated; an item without words has no window. A null doc_id or item_id is a
value like any other (a null item_id is left out of the id list). Documents are told
apart by doc_id and a hash of the text, so rows that repeat a doc_id are matched each
on its own, and rows that repeat both, a null doc_id too, get the same result. Repeated items give the same ids once. Extra columns are not read. Empty
tables on either side give no matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millgauge.llm.common import stored

# Word characters before upper-case letters are lowered.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW_WORDS = 13
# Lists intersected one by one before the rest is checked at once.
RARE_TERMS = 3
DOC = ["doc", "version"]


def terms(text: Column) -> Column:
    """Words of a text, letters in the case they have."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM_PATTERN), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII words take the fast way."""
    plain = F.char_length(word) == F.octet_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _doc(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart, never null: the id and a hash of id and text."""
    return [F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("version")]


@dataclass(frozen=True)
class Benchmark:
    """``terms`` (term_id, term) and ``windows`` (item_id, window, n_terms, offset, term_id)."""

    terms: DataFrame
    windows: DataFrame


def read_benchmark(items: DataFrame, window_words: int = WINDOW_WORDS, item: str = "item_id", text: str = "text") -> Benchmark:
    """All windows of the items and the terms in them, written to the shared folder."""
    found = (
        items.select(F.col(item).alias("item_id"), F.transform(terms(F.col(text)), lowered).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window_words, F.lit(0)))
    windows = (
        found.select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start") + 1, window_words).alias("words"))
        .distinct()
        .select("item_id", F.xxhash64("item_id", "words").alias("window"), "words")
    )
    spread = stored(
        windows.select("item_id", "window", F.size("words").alias("n_terms"), F.posexplode("words").alias("offset", "term")),
        "benchmark-windows",
    )
    # A number per term: terms are spread over partitions by hash and numbered by row.
    named = spread.select("term").distinct()
    vocabulary = stored(named.select(F.monotonically_increasing_id().alias("term_id"), "term"), "benchmark-terms")
    numbered = spread.join(vocabulary, "term").select("item_id", "window", "n_terms", "offset", "term_id")
    return Benchmark(vocabulary, stored(numbered, "benchmark-numbered"))


def build_index(docs: DataFrame, benchmark: Benchmark, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of all benchmark terms in the documents, written to the shared folder."""
    occurrences = docs.select(*_doc(F.col(doc), F.col(text)), F.posexplode(terms(F.col(text))).alias("pos", "word"))
    postings = occurrences.withColumn("term", lowered(F.col("word"))).join(benchmark.terms, "term")
    return stored(postings.select("term_id", *DOC, "pos"), "postings")


def _ranked(benchmark: Benchmark, index: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with their terms ranked from the rarest."""
    frequency = stored(index.groupBy("term_id").agg(F.count(F.lit(1)).alias("postings")), "term-frequency")
    by_rarity = Window.partitionBy("window").orderBy("postings", "term_id", "offset")
    ranked = (
        benchmark.windows.join(frequency, "term_id")
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("window")))
    )
    return stored(ranked.where(F.col("known") == F.col("n_terms")).drop("known", "postings"), "ranked-windows")


def _of_rank(ranked: DataFrame, rank: int) -> DataFrame:
    part = ranked.where(F.col("rank") == rank).select("window", "n_terms", "offset", "term_id")
    return stored(part, f"rank-{rank}")


def phrase_matches(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Exact occurrences of windows: (window, n_terms, doc_id, version, start)."""
    first = _of_rank(ranked, 1)
    candidates = index.join(first, "term_id").select(
        "window", "n_terms", *DOC, (F.col("pos") - F.col("offset")).alias("start")
    ).where("start >= 0")
    for rank in range(2, RARE_TERMS + 1):
        entry = _of_rank(ranked, rank)
        # The shifted list of this term: where the window would have to start.
        shifted = index.join(entry, "term_id").select("window", *DOC, (F.col("pos") - F.col("offset")).alias("start"))
        short = candidates.where(F.col("n_terms") < rank)
        tall = candidates.where(F.col("n_terms") >= rank)
        tall = tall.join(shifted, ["window", *DOC, "start"], "left_semi")
        candidates = stored(short.unionByName(tall), f"candidates-{rank}")

    # Rows that repeat a document repeat its postings, and so its candidates.
    candidates = stored(candidates.distinct(), "distinct-candidates")
    rest = ranked.where(F.col("rank") > RARE_TERMS).select("window", "offset", "term_id")
    expected = candidates.join(rest, "window").select(
        "window", "n_terms", *DOC, "start", "term_id", (F.col("start") + F.col("offset")).alias("pos")
    )
    where = stored(candidates.select(*DOC).distinct(), "candidate-documents")
    near = index.join(where, DOC, "left_semi")
    confirmed = (
        expected.join(near, ["term_id", *DOC, "pos"], "left_semi")
        .groupBy("window", "n_terms", *DOC, "start")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("n_terms") - RARE_TERMS)
        .drop("found")
    )
    return candidates.where(F.col("n_terms") <= RARE_TERMS).unionByName(confirmed)


def proximity_matches(ranked: DataFrame, index: DataFrame, slack: int = WINDOW_WORDS) -> DataFrame:
    """Windows whose distinct terms all lie within ``slack`` words of their rarest term.

    Returns (window, doc, version, seed), ``seed`` being the place of the rarest
    term. Lists are intersected from the rarest term as for phrases, but by stretches
    of ``slack`` words, each with its two neighbours, and then by distance.
    """
    wanted = stored(ranked.groupBy("window", "term_id").agg(F.min("rank").alias("rank")), "near-terms")
    seeds = index.join(wanted.where("rank = 1").select("window", "term_id"), "term_id").select(
        "window", *DOC, F.col("pos").alias("seed")
    )
    for rank in range(2, RARE_TERMS + 2):
        asked = wanted.where(F.col("rank") > RARE_TERMS if rank > RARE_TERMS else F.col("rank") == rank).select("window", "term_id")
        needed = asked.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
        stretches = F.array(*(F.floor(F.col("seed") / slack) + k for k in (-1, 0, 1)))
        places = index.join(asked.select("term_id").distinct(), "term_id", "left_semi").select(
            "term_id", *DOC, "pos", F.floor(F.col("pos") / slack).alias("stretch")
        )
        found = (
            seeds.join(asked, "window")
            .withColumn("stretch", F.explode(stretches))
            .join(places, ["term_id", *DOC, "stretch"])
            .where(F.abs(F.col("seed") - F.col("pos")) <= slack)
            .groupBy("window", *DOC, "seed")
            .agg(F.count_distinct("term_id").alias("found"))
        )
        counted = seeds.join(needed, "window", "left").join(found, ["window", *DOC, "seed"], "left")
        kept = counted.where(F.coalesce("needed", F.lit(0)) == F.coalesce("found", F.lit(0)))
        seeds = stored(kept.select("window", *DOC, "seed").distinct(), f"near-{rank}")
    return seeds


def _hits(matches: DataFrame) -> DataFrame:
    """Document words inside any match, counted once each."""
    inside = matches.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_terms") - 1)).alias("pos"))
    return inside.distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))


def contamination(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", window_words: int = WINDOW_WORDS
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids, comma-joined), contaminated."""
    benchmark = read_benchmark(items, window_words)
    index = build_index(docs, benchmark, doc, text)
    ranked = _ranked(benchmark, index)
    matches = stored(phrase_matches(ranked, index), "matches")
    which = ranked.select("window", "item_id").distinct()
    found = matches.select("window", *DOC).distinct().join(which, "window")
    listed = found.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hits = _hits(matches)
    marked = stored(hits.join(listed, DOC), "contaminated")
    sizes = docs.select(F.col(doc).alias("doc_id"), *_doc(F.col(doc), F.col(text)), F.size(terms(F.col(text))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sizes.join(marked, DOC, "left").select(
        "doc_id",
        *DOC,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    bad = contamination(docs, items, doc, text).where("contaminated").select(*(F.col(name).alias(f"bad_{name}") for name in DOC))
    bad = stored(bad.distinct(), "contaminated-ids")
    number, version = _doc(docs[doc], docs[text])
    return docs.join(bad, (number == bad["bad_doc"]) & (version == bad["bad_version"]), "left_anti")
