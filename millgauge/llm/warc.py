"""Not-modified revisits of web captures resolved to the response they confirm.

A revisit record says that a page was still what an earlier capture holds. It is joined
as of its time to the latest earlier full response of the same canonical URL. The
response is accepted if the validators that the revisit carries agree with it (entity
tag, modification date, payload digest). The resolved record has the response's headers
with those that a not-modified answer may change replaced by the revisit's.

The as-of join runs on two levels, so a URL captured very often is not one task: a
window within (URL, stretch of time) finds the latest response inside the stretch, and
one row per stretch carries the last response over to later stretches. Payloads are
not moved; a resolved record names the response that holds its payload.

Defined results. A record without a URL or time, and a revisit with no earlier response,
is ``unresolved``. Equal times are ordered by record id, then kind. Rows that repeat are
resolved each on its own. Null validators are not checked; a revisit without any is
``unchecked``. Null headers are none. Extra columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millgauge.llm.common import stored

RESPONSE, REVISIT = "response", "revisit"
STRETCH_SECONDS = 86_400

# Headers that a not-modified answer may change, in lower case.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't change the page.
IGNORED_PARAMETERS = r"(utm_[a-z]+|gclid|fbclid|ref|sessionid)"

RECORD = ("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    """One form of a URL: lower-case host without www and default port, no fragment, sorted parameters without ignored ones."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?)://(?:[^/@?]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^(www|m)\.", "")
    path = F.regexp_extract(bare, r"^(?i:https?)://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"(?<=.)/+$", ""))
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(rf"^(?i){IGNORED_PARAMETERS}(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(bare.rlike(r"^(?i:https?)://[^/?]"), F.concat(host, path, tail)).otherwise(bare)


def _strong(tag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(tag, r"^W/", "")


def _latest_earlier(records: DataFrame) -> DataFrame:
    """The records with ``found``: the latest response before them on their URL."""
    order = ["ts", "record_id", "kind"]
    response = F.when(
        F.col("kind") == RESPONSE, F.struct("ts", "record_id", "kind", "etag", "last_modified", "digest", "headers")
    )
    staged = records.withColumn("stretch", F.floor(F.col("ts") / STRETCH_SECONDS)).withColumn("response", response)
    inside = Window.partitionBy("canonical_url", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = staged.withColumn("near", F.last("response", ignorenulls=True).over(inside))
    # The last response of each stretch: the newest key is kept by the aggregate, the row by a join.
    key = F.struct("ts", "record_id", "etag", "last_modified", "digest")
    heads = staged.where(F.col("kind") == RESPONSE).groupBy("canonical_url", "stretch").agg(F.max(key).alias("head"))
    stretches = staged.select("canonical_url", "stretch").distinct().join(heads, ["canonical_url", "stretch"], "left")
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("far", F.last("head", ignorenulls=True).over(before)).select(
        "canonical_url", "stretch", F.col("far")["ts"].alias("far_ts"), F.col("far")["record_id"].alias("far_id")
    ).where("far_ts IS NOT NULL")
    answers = staged.where(F.col("kind") == RESPONSE).select(
        "canonical_url", F.col("ts").alias("far_ts"), F.col("record_id").alias("far_id"), F.col("response").alias("carried")
    ).dropDuplicates(["canonical_url", "far_ts", "far_id"])
    carried = carried.join(answers, ["canonical_url", "far_ts", "far_id"]).select("canonical_url", "stretch", "carried")
    joined = near.join(carried, ["canonical_url", "stretch"], "left")
    return joined.withColumn("found", F.coalesce("near", "carried")).drop("near", "carried", "response", "stretch")


def _lowered(headers: Column) -> Column:
    """Header names in lower case, the last of equal names kept."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(pairs, lambda p: F.lower(p["key"])))

    def last(name: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: F.lower(p["key"]) == name), -1)["value"]

    return F.map_from_arrays(names, F.transform(names, last))


def resolve(records: DataFrame) -> DataFrame:
    """Per record: canonical_url, kind, outcome, response_id, digest and headers after resolution.

    ``outcome`` is full (a response), resolved, unchecked (no validators to check),
    mismatch (a validator disagrees), or unresolved. Only resolved and unchecked
    revisits take over the response.
    """
    # The records are read from several sides below, and without payloads they are small.
    named = stored(records.select(*RECORD).withColumn("canonical_url", canonical_url(F.col("url"))), "captures")
    placed = _latest_earlier(named.where("canonical_url IS NOT NULL AND ts IS NOT NULL"))
    lost = named.where("canonical_url IS NULL OR ts IS NULL").withColumn("found", F.lit(None).cast(placed.schema["found"].dataType))
    rows = placed.unionByName(lost)
    found = F.col("found")
    pairs = (
        (_strong(F.col("etag")), _strong(found["etag"])),
        (F.col("last_modified"), found["last_modified"]),
        (F.col("digest"), found["digest"]),
    )
    given = [mine.isNotNull() for mine, _ in pairs]
    differs = [mine.isNotNull() & ~mine.eqNullSafe(theirs) for mine, theirs in pairs]
    outcome = (
        F.when(F.col("kind") == RESPONSE, "full")
        .when(found.isNull(), "unresolved")
        .when(differs[0] | differs[1] | differs[2], "mismatch")
        .when(given[0] | given[1] | given[2], "resolved")
        .otherwise("unchecked")
    )
    taken = F.col("outcome").isin("resolved", "unchecked")
    own = _lowered(F.col("headers"))
    allowed = F.map_filter(own, lambda name, _: name.isin(*PERMITTED_HEADERS))
    theirs = F.map_filter(_lowered(found["headers"]), lambda name, _: ~F.array_contains(F.map_keys(allowed), name))
    return rows.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "ts",
        "kind",
        "outcome",
        F.when(F.col("kind") == RESPONSE, F.col("record_id")).when(taken, found["record_id"]).alias("response_id"),
        F.when(taken, found["digest"]).otherwise(F.col("digest")).alias("digest"),
        F.when(taken, F.map_concat(theirs, allowed)).otherwise(own).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records derived from the pages, so that every page takes part four times.

    A page is a full response on its own URL at its number in minutes, and a revisit
    of it ten days on, with or without agreeing validators by a hash of its content.
    The front page of its site and language is captured at the same minute, by the
    hash as a response or a revisit, so a common site is a URL with very many
    captures. A last revisit lies before any response of its URL.
    """
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")))
    chance = F.pmod(F.xxhash64("html"), F.lit(8))
    minute = F.col("page_id") * 60
    front = F.regexp_extract("url", r"^(https?://[^/?#]+/[a-z]{2})/", 1)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    stale = F.concat(F.lit('"'), F.reverse(F.substring(digest, 1, 12)), F.lit('"'))
    front_tag = F.concat(F.lit('"v'), F.floor(F.col("page_id") / 50).cast("string"), F.lit('"'))
    none = F.lit(None).cast("string")

    def record(number: int, url: Column, ts: Column, kind: Column, etag: Column, digest: Column) -> Column:
        headers = F.create_map(
            F.lit("Content-Type"), F.when(kind == RESPONSE, "text/html").otherwise("text/plain"),
            F.lit("Date"), ts.cast("string"),
            F.lit("ETag"), F.coalesce(etag, F.lit("")),
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.lit(60 * (number + 1)).cast("string")),
        )
        return F.struct(
            (F.col("page_id") * 4 + number).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"),
            etag.alias("etag"), none.alias("last_modified"), digest.alias("digest"), headers.alias("headers"),
        )

    rows = F.array(
        record(0, F.col("url"), minute, F.lit(RESPONSE), tag, digest),
        record(1, F.col("url"), minute + 10 * STRETCH_SECONDS, F.lit(REVISIT), F.when(chance < 5, F.concat(F.lit("W/"), tag)).when(chance < 7, stale), none),
        record(2, front, minute, F.when(chance < 2, RESPONSE).otherwise(REVISIT), front_tag, F.when(chance < 2, digest)),
        record(3, F.col("url"), minute - STRETCH_SECONDS, F.lit(REVISIT), tag, none),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")
