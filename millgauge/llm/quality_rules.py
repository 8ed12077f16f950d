"""Quality rules: a table of thresholds compiled into one projection.

Every metric is an expression over one row, so a text is read once, nothing is
shuffled and nothing is joined. Ratios are compared as integers (100 * part against
percent * whole), so no rounding decides a verdict.

Defined results. A null or empty text has no words, all metrics zero, and fails the
base rules. Other columns may be null and are not read. Rows that repeat are judged
each on its own. Extra columns pass through ``keep_good`` untouched, whatever their
names. An empty table gives an empty table. The length of a text is bounded only by
what fits in one row; the work is n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millgauge.llm.common import WORD_PATTERN, let, words

# Characters counted as symbols.
SYMBOL_PATTERN = r"[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on be with as by at from this are or an not "
    "le la les de des et en un une du que qui dans pour par est sur ne pas au avec il "
    "der die und das den von zu mit ist im nicht ein eine auf für sich dem "
    "el los las y del se con no su para al lo como es una"
).split()

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Threshold:
    """``low <= 100 * part / whole <= high``; a bound of None is open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


# Length, symbol, stop-word and line ratios, in percent.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", low=300, high=1000),
    Threshold("symbols", "n_symbols", "n_words", high=20),
    Threshold("stop_words", "n_stop_words", "n_words", low=5),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", high=50),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def _repeated_words(found: Column) -> Column:
    """Words covered by a window of three words that occurs twice or more.

    The windows are sorted with their places; equal neighbours are repeats. Their
    places, in order, each cover three words less what the next one covers too.
    """
    windows = F.when(
        F.size(found) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(found) - 3),
            lambda i: F.concat_ws(" ", F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def places(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda gram, i: F.struct(gram.alias("gram"), i.alias("i"))))
        return let(
            placed,
            lambda rows: F.sort_array(
                F.transform(
                    F.filter(
                        rows,
                        lambda row, k: (row["gram"] == F.get(rows, k - 1)["gram"]) | (row["gram"] == F.get(rows, k + 1)["gram"]),
                    ),
                    lambda row: row["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda here, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - here, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    # Most texts repeat nothing, which a set of the windows tells without sorting them.
    return let(
        windows,
        lambda grams: F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            let(places(grams), covered)
        ),
    )


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))


def metrics(text: Column) -> Column:
    """All metrics of a text as one struct of longs."""
    whole = F.coalesce(text, F.lit(""))

    def of(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.char_length(F.array_join(found, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOL_PATTERN)).cast("long").alias("n_symbols"),
            let(
                _lines(whole),
                lambda lines: F.struct(F.size(lines).alias("all"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")),
            ).alias("lines"),
            F.size(F.filter(found, lambda word: F.lower(word).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeated_words(found).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), of)


def base_failed(values: dict[str, Column]) -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (values["n_words"] < MIN_WORDS) | (100 * values["n_repeat_words"] > MAX_REPEATED_PERCENT * values["n_words"])


def compiled(thresholds: tuple[Threshold, ...], values: dict[str, Column]) -> Column:
    """The threshold table as one condition: true if every rule holds."""
    verdict = F.lit(True)
    for rule in thresholds:
        part, whole = 100 * values[rule.part], values[rule.whole]
        if rule.low is not None:
            verdict = verdict & (part >= rule.low * whole)
        if rule.high is not None:
            verdict = verdict & (part <= rule.high * whole)
    return verdict


def judged(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS, into: str = "quality") -> DataFrame:
    """The rows with a struct column of metrics, ``base_failed`` and ``kept``."""
    raw = docs.withColumn(into, metrics(F.col(text)))
    found = F.col(into)
    values = {name: found[name] for name in METRICS if name not in ("n_lines", "n_dup_lines")}
    values["n_lines"] = found["lines"]["all"].cast("long")
    values["n_dup_lines"] = found["lines"]["dup"].cast("long")
    failed = base_failed(values)
    return raw.withColumn(
        into,
        F.struct(
            *(values[name].alias(name) for name in METRICS),
            failed.alias("base_failed"),
            (~failed & compiled(thresholds, values)).alias("kept"),
        ),
    )


def keep_good(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows that pass, with their own columns only."""
    into = "quality"
    while into.lower() in (name.lower() for name in docs.columns):
        into += "_"
    good = judged(docs, text, thresholds, into).where(F.col(into)["kept"])
    return good.drop(into)
