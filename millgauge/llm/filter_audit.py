"""What filters remove, alone and after each other, for every order of applying them.

Each filter leaves one stored table of failing ids. What a filter removes after a prefix
of others are its failing ids that no filter of the prefix has failed: a left-anti join
of its table with each of theirs. A prefix leaves the same rows in whatever order its
filters come, so the 120 orders of five filters need 80 pairs of a filter and a prefix;
all of them pass through one chain of five left-anti joins, in which a row asks once to
skip a filter and once to have it before. Labelled losses are the same chain over the
failing ids that a left-semi join with the labelled ids leaves. Rows that pass every
filter are counted, never joined; the chain is keyed by row number throughout, so it is
dealt once and no part, text or id is a hot key in it.

Survivors follow by subtraction along an order, redundant rows as the rest of the
filter's table, and the sum over all orders from how often each prefix occurs in them.

Defined results. A null text counts as empty, a null part as the empty string; all rows
count, also those that repeat an id. A row repeats an earlier one if the same text has a
smaller id; a null id is neither smaller nor later. Labels are met by id: one label row
that says so is enough, null ids have none. Extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millgauge.llm.common import let, stored, words

# Failure conditions over the measures of a text, by filter.
CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "A": lambda m: m["n_words"] < 50,
    "B": lambda m: 100 * m["n_distinct"] < 65 * m["n_words"],
    "C": lambda m: 100 * m["n_upper"] > 5 * m["n_chars"],
    "D": lambda m: m["has_symbol"],
}
# The filter that fails rows whose text a smaller id has.
REPEATS = "E"


def measures(text: Column) -> Column:
    """What the conditions read, of a text that is not null."""
    counts = let(words(text), lambda found: F.struct(F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("distinct")))
    return let(
        counts,
        lambda count: F.struct(
            count["n"].cast("long").alias("n_words"),
            count["distinct"].cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.char_length(text).cast("long").alias("n_chars"),
            text.rlike(r"[#$%&*|]").alias("has_symbol"),
        ),
    )


def judged(docs: DataFrame, conditions: dict[str, Callable[[Column], Column]], doc: str, text: str, part: str) -> DataFrame:
    """(rid, doc_id, part, digest, one flag per condition) of every row, in one pass over the texts, stored."""
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    flags = let(measures(value), lambda m: F.struct(*(F.coalesce(fails(m), F.lit(False)).alias(name) for name, fails in conditions.items())))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        docs[doc].alias("doc_id"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(value, 256)).alias("digest"),
        flags.alias("fails"),
    )
    return stored(rows, "judged")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose digest a smaller id has: all but those with the smallest id of their digest.

    Joined by id and digest together, so that a text with many copies is no hot key.
    """
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    return rows.where("doc_id IS NOT NULL").join(firsts, ["doc_id", "digest"], "left_anti")


def failing_ids(rows: DataFrame, conditions: dict, repeats: str | None = REPEATS) -> dict[str, DataFrame]:
    """One stored table (rid, doc_id, part) per filter, in the filters' alphabetical order."""
    failing = {name: rows.where(F.col("fails")[name]) for name in conditions}
    if repeats:
        failing[repeats] = later_copies(rows)
    return {name: stored(failing[name].select("rid", "doc_id", "part"), f"failing-{name}") for name in sorted(failing)}


def removals(failing: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``failing`` (rid, filter, …), once per ``prefix`` of other filters that none of them fails.

    A prefix is the sorted string of its filters. A row is asked about each filter but
    its own twice, left out of the prefix and in it; the anti-join removes it from the
    prefixes with a filter that it fails.
    """
    level = failing.withColumn("prefix", F.lit(""))
    for name, ids in tables.items():
        choices = F.when(F.col("filter") == name, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        gone = ids.select(F.col("rid").alias("gone_rid"))
        asked = level.withColumn("taken", F.explode(choices))
        left = asked.join(gone, (F.col("rid") == F.col("gone_rid")) & F.col("taken"), "left_anti")
        level = left.withColumn("prefix", F.concat("prefix", F.when(F.col("taken"), name).otherwise(""))).drop("taken")
    return level


def prefix_counts(tables: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, prefix, removed, one count per label) from the failing ids and the labelled ids."""
    each = [ids.select("rid", "doc_id", "part", F.lit(name).alias("filter")) for name, ids in tables.items()]
    failing = reduce(DataFrame.unionByName, each)
    counted = [failing.withColumn("measure", F.lit("removed"))]
    counted += [failing.join(ids.select("doc_id"), "doc_id", "left_semi").withColumn("measure", F.lit(name)) for name, ids in labelled.items()]
    every = reduce(DataFrame.unionByName, counted).drop("doc_id")
    counts = (F.count_if(F.col("measure") == name).alias(name) for name in ("removed", *labelled))
    return removals(every, tables).groupBy("part", "filter", "prefix").agg(*counts)


def audit(
    docs: DataFrame,
    labels: DataFrame,
    conditions: dict[str, Callable[[Column], Column]] = CONDITIONS,
    repeats: str | None = REPEATS,
    doc: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    Filters are named by single letters. ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost`` and ``toxic_lost`` count rows of the part;
    ``shapley`` is the sum of the filter's ``removed`` over all orders.
    """
    rows = judged(docs, conditions, doc, text, part)
    tables = failing_ids(rows, conditions, repeats)
    labelled = {"good_lost": labels.where("quality = 1"), "toxic_lost": labels.where("toxic = 1")}
    counts = stored(prefix_counts(tables, labelled), "prefix-counts")

    n = len(tables)
    occurs = reduce(
        lambda rest, size: F.when(F.length("prefix") == size, factorial(size) * factorial(n - 1 - size)).otherwise(rest), range(n), F.lit(0)
    )
    totals = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == "", F.col("removed"))).alias("failing"),
        F.sum(F.when(F.length("prefix") == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * occurs).alias("shapley"),
    )
    orders = F.array(*(F.lit("".join(order)) for order in permutations(tables)))
    steps = (
        rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows_in"))
        .select("part", "rows_in", F.explode(orders).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("prefix", F.expr("array_join(array_sort(split(substring(filter_order, 1, step - 1), '')), '')"))
    )
    joined = steps.join(counts, ["part", "filter", "prefix"], "left").join(totals, ["part", "filter"], "left")
    count_of = {name: F.coalesce(F.col(name), F.lit(0).cast("long")) for name in ("removed", "failing", "unique_fails", "shapley", *labelled)}
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        (F.col("rows_in") - F.sum(count_of["removed"]).over(so_far)).alias("kept"),
        count_of["removed"].alias("removed"),
        (count_of["failing"] - count_of["removed"]).alias("redundant"),
        *(count_of[name].alias(name) for name in ("unique_fails", "good_lost", "toxic_lost", "shapley")),
    )
