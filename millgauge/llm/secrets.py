"""Secret scans over a ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. The ledger holds, for each pair of
blob and rule version, the spans found. A run scans one version of each blob that the
ledger doesn't have under the current rules, appends the result, and joins the spans
back to every path that holds the blob. Copies are scanned once, and a later run scans
new texts only. An append is committed by Spark as a whole; a blob that two runs wrote
has the same spans in both, and one of them is read.

Defined results. A null text is the empty blob. Rows that repeat are paths of one blob.
Null paths and extra columns pass through. A long text is scanned whole. An empty table
leaves the ledger as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from millgauge import session
from millgauge.llm.common import stored

# Raised whenever a rule changes: findings of older rules are then scanned anew.
RULES_VERSION = 2

# Kinds in order, patterns, and the least length of a match (for
# assign, of its second group).
BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
# A private key reaches from its heading to its END line, whatever stands between them
# (armor headers, escaped line ends, indentation). Without an END line before the next
# mark it reaches over the base64 runs that follow: 16 characters or more after any line
# end or space, then up to two shorter lines. No part is read twice, so a search is linear.
_LABEL = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_LINE_END = r"[ \t\"',]*+(?:\r?\n|\\r\\n|\\n)"
_HEADERS = rf"(?:{_LINE_END}[ \t]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+)*"
_RUNS = r"(?:(?:[\s\"',>|]|\\[rnt])++[A-Za-z0-9+/=]{16,}+)*"
_SHORT = rf"(?:{_LINE_END}[ \t\"'>|]*+[A-Za-z0-9+/=]{{1,15}}+(?=[ \t\"',]*+(?:[\r\n\\]|\Z))){{0,2}}"
PRIVATE_KEY = rf"-----BEGIN {_LABEL}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {_LABEL}|{_HEADERS}{_RUNS}{_SHORT})"
# Further kinds; each pattern is anchored by a literal that the text must hold.
MORE_RULES = (
    ("private_key", re.compile(PRIVATE_KEY), 0, 1),
    ("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    # The user may be empty; the scheme's bound only moves the start of a match.
    ("url_password", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*+:[^\s/@]{3,}+@"), 0, 1),
)
# What a text must hold for a pattern to match, to skip texts quickly.
LITERALS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "private_key": ("PRIVATE KEY",),
    "web_token": ("eyJ",),
    "url_password": ("://",),
}
# Found in every text that any rule finds a span in. Spark looks for it where a text lies.
MAY_HOLD = r"(?i:passw|secret|token|api_?key)|AKIA|PRIVATE KEY|eyJ|://|[0-9a-f]{16}"
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start, then in the order of the kinds."""
    small = text.lower()
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE_RULES + MORE_RULES):
        literals = LITERALS.get(kind)
        hay = small if kind == "assign" else text
        if literals and not any(literal in hay for literal in literals):
            continue
        for match in pattern.finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), order, kind, match.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@F.pandas_udf(SPANS)
def _scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan(text)] for text in batch])


def blob(text: Column) -> Column:
    """The address of a content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _entries(spark: SparkSession, ledger: str, rules: int) -> DataFrame | None:
    """Blobs scanned under these rules, with their spans; None for a new ledger."""
    try:
        known = spark.read.schema(f"blob binary, rules int, spans {SPANS.simpleString()}").parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return known.where(F.col("rules") == rules).dropDuplicates(["blob"])


def update_ledger(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: int = RULES_VERSION) -> DataFrame:
    """Scan what the ledger lacks and append it; the entries of these rules.

    Only addresses and paths are grouped. One version of each unseen blob is then
    read: the rows are met by path and address, and a text is moved once at most.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(path).alias("path"), blob(F.col(text)).alias("blob"))
    unseen = held.groupBy("blob").agg(F.min("path").alias("path"))
    known = _entries(spark, ledger, rules)
    if known is not None:
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    unseen = stored(unseen, "unseen-blobs")
    texts = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"), blob(F.col(text)).alias("blob"))
    unseen_at = unseen.select(F.col("path").alias("at"), F.col("blob").alias("content")).hint("shuffle_hash")
    chosen = texts.join(unseen_at, texts["path"].eqNullSafe(unseen_at["at"]) & (texts["blob"] == unseen_at["content"]), "left_semi")
    fresh = chosen.select("blob", F.lit(rules).alias("rules"), _scanned("text").alias("spans"))
    fresh.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return _entries(spark, ledger, rules)


def findings(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, spans) of every row; without a ledger a new one is begun."""
    ledger = ledger or session.fresh_folder(docs.sparkSession, "secret-ledger")
    entries = update_ledger(docs, ledger, path, text).select("blob", "spans")
    paths = docs.select(F.col(path), blob(F.col(text)).alias("blob"))
    return paths.join(entries, "blob", "left")


def _cut(text: str, spans, mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = span["end"]
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span in the text replaced by the mark; other columns as they were.

    Texts that cannot hold a span are passed on where they lie; the others meet the blobs with one.
    """

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([one if found is None else _cut(one, found, mark) for one, found in zip(texts, spans)])

    spark = docs.sparkSession
    ledger = ledger or session.fresh_folder(spark, "secret-ledger")
    entries = update_ledger(docs, ledger, path, text)
    dirty = stored(entries.where(F.size("spans") > 0).select(F.col("blob").alias("dirty_blob"), F.col("spans").alias("dirty_spans")), "dirty-blobs")
    possible = F.coalesce(F.col(text).rlike(MAY_HOLD), F.lit(False))
    suspect = docs.where(possible)
    joined = suspect.join(dirty, blob(suspect[text]) == dirty["dirty_blob"], "left")
    clean = F.when(dirty["dirty_spans"].isNull(), suspect[text]).otherwise(cut(suspect[text], dirty["dirty_spans"]))
    redone = joined.select(*(clean.alias(name) if name == text else suspect[name] for name in docs.columns))
    return docs.where(~possible).unionByName(redone)
