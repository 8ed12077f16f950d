"""MinHash near-duplicates: keys by tensored banding, every candidate verified.

A text's set is its distinct shingles. Plain banding with tables of six minhashes needs
six new ones per table. Here two collections of ``COLLECTION`` triples of minhashes make
all keys: table (i, j) joins triple i of the first collection with triple j of the
second, so 144 tables take 72 minhashes instead of 864. Two sets of similarity 0.85 miss
every table with a probability of about 2 in 100,000, and of 3 in 10 million at 0.9.
Equal sets are one row from the start and cannot be missed. A set that shares no triple
of one of the collections with any other has no key in common with one, so only shared
triples are combined.

A key with few members gives its pairs, each verified on the full sets. The members of a
key with more than ``GROUP`` form no pairs. Keys that share members make one hot group,
and in a group the links are found exactly, however many members there are, from how each
member differs from the group's majority set, the shingles of more than half of it
(``_split``): a difference of d shingles from it and the size n give the slack
3 n - 37 d, and members whose slacks sum to at least 0 are similar enough by the triangle
inequality. The member with the most slack is linked to all those at once. Any other
link needs members that share elements of their differences; each needs so many in
common (``_needed``: of d elements at least d - 3 n / 17, however the other differs) that
one of them is among its first, rarest ones, so those are the new keys. The
step is repeated where a new key has many members; each time the shared element moves to
the majority and the differences get smaller. No step pairs up a group.

Only sizes, minhashes and digests are kept of all texts; the sets themselves are made
again for those texts alone that are in a candidate pair or group.

Defined results. Null, empty and blank texts have no shingles and stay alone, each its
own component. A null id keeps its row and is ignored as the smallest of a component; a
component without any id has a null one, and its rows are kept. Rows that repeat an id are
members by their own text. Extra columns are not read; an empty table gives no rows. Long
texts are hashed in blocks. Shingles are told apart by 64-bit hashes of their words, sets
by 128 bits, texts by MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millgauge.llm.common import stored
from millgauge.llm.components import connected

SHINGLE_WORDS = 3
# Sets are linked when 100 * intersection >= 85 * union; in sizes n and the number of
# differing shingles, 37 * differing <= 3 * (n + n').
SLACK_SIZE, SLACK_DIFFERENCE = 3, 37
SIMILAR, OF_UNION = 100, 85
# Minhashes that are taken together, and how many such in each of the two collections.
TOGETHER, COLLECTION = 3, 12
# Members of a key up to which its pairs are formed.
GROUP = 8
# Members of a group that meet one copy of what is joined to the group.
SPREAD = 512
BLOCK = 1 << 14
MEMO = 1 << 17
# Texts, and shingles of texts, in a batch that leaves Python.
ROWS, VALUES = 256, 1 << 18

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_RANDOM = np.random.default_rng(20240229)
_WORD_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, (SHINGLE_WORDS, SHINGLE_WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RANDOM.integers(0, 1 << 63, 2 * TOGETHER * COLLECTION, np.uint64)
_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, 2 * TOGETHER * COLLECTION, np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[1]
    values = (values ^ (values >> np.uint64(27))) * _MIX[2]
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str | None, memo: _WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the text's words, with A-Z as a-z."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(len(found), SHINGLE_WORDS)
    count = len(found) - width + 1
    combined = sum(hashes[k : k + count] * factor for k, factor in enumerate(_WORD_FACTORS[width - 1][:width]))
    return np.unique(_mixed(combined))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One number per ``TOGETHER`` minhashes: those of the first collection, then of the second."""
    least = np.full(len(_FLIPS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        values = (shingles[at : at + BLOCK, None] ^ _FLIPS) * _FACTORS
        values ^= values >> np.uint64(32)
        np.minimum(least, (values * _MIX[1]).min(axis=0), out=least)
    made = np.zeros(len(least) // TOGETHER, np.uint64)
    for k in range(TOGETHER):
        made = _mixed(made * _MIX[0] + least[k::TOGETHER])
    return made


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    memo = _WordHashes()
    for batch in batches:
        column = batch.column("text")
        for row in range(batch.num_rows):
            yield batch, row, shingle_set(column[row].as_py(), memo)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "version", "n", "set_id", "signature"]
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    for batch, row, shingles in _texts(batches):
        key = xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None
        rows.append(
            (
                batch.column("doc_id")[row].as_py(),
                batch.column("version")[row].as_py(),
                len(shingles),
                key,
                _signed(signature(shingles)) if len(shingles) else None,
            )
        )
        if len(rows) == ROWS:
            yield made()
            rows = []
    if rows:
        yield made()


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[int] = []
    sets: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, sets)])
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), values], ["sid", "shingles"])

    held = 0
    for batch, row, shingles in _texts(batches):
        keys.append(batch.column("sid")[row].as_py())
        sets.append(shingles)
        held += len(shingles)
        if len(sets) == ROWS or held >= VALUES:
            yield made()
            keys, sets, held = [], [], 0
    if sets:
        yield made()


def _version(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version of the text, n shingles, set_id, signature) of every row, stored."""
    rows = docs.select(docs[doc].cast("long").alias("doc_id"), _version(docs[text]).alias("version"), docs[text].alias("text"))
    made = rows.mapInArrow(_signatures, "doc_id long, version binary, n long, set_id binary, signature array<long>")
    return stored(made, "minhash-signatures")


def distinct_sets(each: DataFrame) -> DataFrame:
    """(sid, set_id, n, signature, first doc_id, a row that has the set), stored; empty sets have none."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "version")).alias("of")
    grouped = each.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), first)
    return stored(
        grouped.select(F.monotonically_increasing_id().alias("sid"), "set_id", "n", "signature", F.col("of.doc_id").alias("first"), F.col("of.version").alias("version")),
        "distinct-sets",
    )


def table_keys(sets: DataFrame) -> DataFrame:
    """(key, sid, n, members): one key per table and set, of those keys that sets share; stored."""
    halves = sets.select("sid", "n", F.posexplode("signature").alias("k", "value")).withColumn("half", F.xxhash64("k", "value"))
    met = halves.groupBy("half").agg(F.count(F.lit(1)).alias("sharing")).where("sharing > 1")
    shared = halves.join(met, "half", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.collect_list(F.struct("k", "half")).alias("halves"))
    first = F.filter("halves", lambda h: h["k"] < COLLECTION)["half"]
    second = F.filter("halves", lambda h: h["k"] >= COLLECTION)["half"]
    one = shared.select("sid", "n", second.alias("second"), F.explode(first).alias("u"))
    keyed = one.select("sid", "n", "u", F.explode("second").alias("v")).select(F.xxhash64("u", "v").alias("key"), "sid", "n")
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return stored(keyed.join(members, "key"), "shared-keys")


def _close(a: Column, b: Column) -> Column:
    """Sizes that a similar pair can have."""
    return F.lit(OF_UNION) * F.greatest(a, b) <= F.lit(SIMILAR) * F.least(a, b)


def cold_pairs(keyed: DataFrame, group: int) -> DataFrame:
    """Distinct pairs (a, b) of the members of small keys that can be similar by size."""
    small = keyed.where(F.col("members") <= group)
    a = small.select("key", F.col("sid").alias("a"), F.col("n").alias("n_a"))
    b = small.select("key", F.col("sid").alias("b"), F.col("n").alias("n_b"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & _close(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct()


def hot_groups(keyed: DataFrame, group: int) -> DataFrame:
    """(g, sid, members): members of larger keys, in one group with all that they share such a key with; stored."""
    large = keyed.where(F.col("members") > group)
    centre = large.groupBy("key").agg(F.min("sid").alias("a"))
    roots = connected(large.join(centre, "key").select("a", F.col("sid").alias("b")))
    return stored(sized(roots.select(F.col("root").alias("g"), F.col("node").alias("sid"))), "hot-groups")


def sized(groups: DataFrame, salts: int = 64) -> DataFrame:
    """(g, sid) with the number of ``members`` of the group, joined in ``salts`` parts of it."""
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return groups.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(salts)).cast("int")).join(spread, ["g", "salt"]).drop("salt")


def per_group(members: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Members (g, sid, members) with the row of their group (g, of how many ``members``), which large groups meet in copies."""
    parts = F.ceil(F.col("members") / SPREAD).cast("int")
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members")
    return members.withColumn("salt", F.pmod(F.xxhash64("sid"), parts).cast("int")).join(spread, ["g", "salt"], how).drop("salt")


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(sid, shingles) of the wanted sets, made from one text of each; stored."""
    chosen = sets.join(wanted.distinct(), "sid", "left_semi").select("sid", F.col("first").alias("of_doc"), F.col("version").alias("of_version"))
    rows = docs.select(docs[doc].cast("long").alias("doc_id"), _version(docs[text]).alias("version"), docs[text].alias("text"))
    # By id and version together: copies of a text are no hot key.
    met = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")))
    one = met.groupBy("sid").agg(F.first("text").alias("text"))
    return stored(one.mapInArrow(_full_sets, "sid long, shingles array<long>"), "full-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return pairs.join(a, "a").join(b, "b").where(SIMILAR * common.cast("long") >= OF_UNION * union.cast("long")).select("a", "b")


def _centred(members: DataFrame) -> DataFrame:
    """(g, sid, n, members, delta, slack, best, top): each member's difference from its group's majority set.

    ``top`` is the member with the most slack, ``best`` its slack.
    """
    elements = members.select("g", "members", F.explode("delta").alias("e"))
    counted = elements.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n_e"), F.first("members").alias("members"))
    common = counted.where("2 * n_e > members").groupBy("g").agg(F.first("members").alias("members"), F.collect_list("e").alias("majority"))
    centred = per_group(members, common, "left").withColumn("majority", F.coalesce("majority", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("delta", "majority"), F.array_except("majority", "delta"))
    made = stored(
        centred.select("g", "sid", "n", "members", apart.alias("delta")).withColumn("slack", SLACK_SIZE * F.col("n") - SLACK_DIFFERENCE * F.size("delta").cast("long")),
        "centred",
    )
    tops = made.groupBy("g").agg(F.first("members").alias("members"), F.max(F.struct("slack", "sid")).alias("top"))
    return per_group(made, tops.select("g", "members", F.col("top.slack").alias("best"), F.col("top.sid").alias("top")))


def _needed(partner: Column) -> Column:
    """Elements of its difference that a member has in common with any similar one of at most the slack ``partner``.

    Two differences of d and d' elements, c of them in common, are d + d' - 2 c apart. That
    is at most 3 (n + n') / 37, so c is at least -(slack + other's slack) / 74. And c is at
    most d', so d - c is within the same bound, where n' is at most 100 n / 85.
    """
    d = F.size("delta").cast("long")
    apart, sizes = OF_UNION * SLACK_DIFFERENCE, SLACK_SIZE * (SIMILAR + OF_UNION)
    return F.greatest(
        F.lit(1).cast("long"), F.ceil(-(F.col("slack") + partner) / (2.0 * SLACK_DIFFERENCE)), F.ceil((apart * d - sizes * F.col("n")) / F.lit(float(apart)))
    )


def _prefixes(rest: DataFrame) -> DataFrame:
    """(g, e, sid, n, open): the elements by which a member has to be met, of members that may have further links.

    Whoever has ``needed`` elements in common with another has one of them among its
    first ones, of all but one less than needed. Elements are in order of how rare they are in the group; one that no other
    member has counts for its place only.
    """
    elements = rest.select("g", "sid", "n", "open", "needed", F.explode("delta").alias("e"))
    counts = elements.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n_e"), F.max("open").alias("any_open")).where("n_e > 1")
    ranked = elements.join(counts, ["g", "e"], "left").withColumn("n_e", F.coalesce("n_e", F.lit(1).cast("long")))
    place = F.row_number().over(Window.partitionBy("g", "sid").orderBy("n_e", "e"))
    size = F.count(F.lit(1)).over(Window.partitionBy("g", "sid"))
    first = ranked.withColumn("place", place).withColumn("size", size).where("place <= size - needed + 1 AND n_e > 1 AND any_open")
    return first.select("g", "e", "sid", "n", "open")


def _split(members: DataFrame, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, pairs to verify, members of the next groups) of groups (g, sid, n, members, delta).

    Links are those of each group's top member by slack. Pairs come from small new
    groups, which are the members with a rare element of their differences in common,
    and hold at least one member that the top is not linked to.
    """
    centred = _centred(members)
    rest = centred.withColumn("open", (F.col("slack") + F.col("best") < 0) & (F.col("sid") != F.col("top")))
    links = rest.where(~F.col("open") & (F.col("sid") != F.col("top"))).select(F.col("top").alias("a"), F.col("sid").alias("b"))

    # A member that is linked to the top needs to meet open ones only; their slack bounds what is needed.
    still = rest.where("open").groupBy("g").agg(F.first("members").alias("members"), F.max("slack").alias("open_best"))
    partner = F.when(F.col("open"), F.col("best")).otherwise(F.col("open_best"))
    meeting = per_group(rest, still).withColumn("needed", _needed(partner)).where(F.col("needed") <= F.size("delta"))
    met = stored(_prefixes(meeting), "prefixes")

    # Elements with the same members, such as all shingles around one changed word, make one new group.
    same = (F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"same_{k}") for k in range(2))
    counts = met.groupBy("g", "e").agg(F.count(F.lit(1)).alias("members"), F.count_if("open").alias("n_open"), *same)
    counts = counts.where("members > 1 AND n_open > 0").groupBy("g", "members", "same_0", "same_1").agg(F.min("e").alias("e")).select("g", "e", "members")
    shared = stored(met.join(counts, ["g", "e"]).select(F.xxhash64("g", "e").alias("key"), "g", "sid", "n", "open", "members"), "shared-elements")
    small = shared.where(F.col("members") <= group)
    a = small.select("key", "g", F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("open").alias("open_a"))
    b = small.select("key", "g", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("open").alias("open_b"))
    pairs = a.join(b, ["key", "g"]).where((F.col("a") < F.col("b")) & (F.col("open_a") | F.col("open_b")) & _close(F.col("n_a"), F.col("n_b")))
    large = shared.where(F.col("members") > group).select("g", "sid", F.col("key").alias("next_g"), F.col("members").alias("next_members"))
    following = large.join(centred.select("g", "sid", "n", "delta"), ["g", "sid"])
    return links, pairs.select("a", "b").distinct(), following.select(F.col("next_g").alias("g"), "sid", "n", F.col("next_members").alias("members"), "delta")


def hot_links(groups: DataFrame, sets: DataFrame, group: int) -> DataFrame:
    """Links (a, b) that connect all similar members of the groups (g, sid, members)."""
    members = groups.join(sets, "sid").select("g", "sid", F.size("shingles").cast("long").alias("n"), "members", F.col("shingles").alias("delta"))
    found = None
    while not members.isEmpty():
        links, pairs, following = _split(stored(members, "members"), group)
        step = stored(links.unionByName(verified(pairs, sets)), "hot-links")
        found = step if found is None else found.unionByName(step)
        members = stored(following, "next-members")
    return groups.select(F.col("g").alias("a"), F.col("sid").alias("b")).limit(0) if found is None else found


def components(docs: DataFrame, doc: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    each = measured(docs, doc, text)
    sets = distinct_sets(each)
    keyed = table_keys(sets)
    pairs, groups = stored(cold_pairs(keyed, group), "pairs"), hot_groups(keyed, group)
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(groups.select("sid"))
    full = full_sets(docs, sets, wanted, doc, text)
    edges = verified(pairs, full).unionByName(hot_links(groups, full, group))
    roots = connected(edges)

    grouped = sets.select("sid", "set_id", "first").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("set_id", "component_id")
    met = each.where("n > 0").join(named, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = met.unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
