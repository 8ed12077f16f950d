"""Filter audit, MinHash near-duplicates and vector codes against brute-force versions, on awkward rows."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millgauge.llm import filter_audit, minhash, orchard
from tests.llm.fixtures import collected, documents, prose, texts
from tests.llm.test_documents import lower, words

ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    documents(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# filter audit


def failures(rows):
    """The filters that each (doc_id, text) fails."""
    out = []
    for doc, text in rows:
        text = text or ""
        found = words(text)
        out.append(
            {
                name
                for name, bad in {
                    "A": len(found) < 50,
                    "B": 100 * len(set(found)) < 65 * len(found),
                    "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
                    "D": any(c in "#$%&*|" for c in text),
                    "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t in rows),
                }.items()
                if bad
            }
        )
    return out


def expected_audit(rows, parts, good, toxic):
    fails, out = failures(rows), {}
    for part in set(parts):
        mine = [k for k, p in enumerate(parts) if p == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [k for k in left if name in fails[k]]
                left = [k for k in left if name not in fails[k]]
                total[name] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(name in fails[k] for k in mine) - len(gone),
                    sum(fails[k] == {name} for k in mine),
                    sum(rows[k][0] in good for k in gone),
                    sum(rows[k][0] in toxic for k in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {key: tuple(values) for key, values in out.items()}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_every_order(spark, docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (4, 1, 1), (5, None, 1), (6, 0, 1), (16, 1, None), (18, 1, 1), (None, 1, 1), (20, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    ).withColumn("part", F.lit("clash")).withColumn("rid", F.lit(0))
    parts = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("web")))
    parts = parts.withColumn("rid", F.lit(7)).withColumn("prefix", F.lit("x"))
    rows = [(r.doc_id, r.text, r.source or "") for r in parts.select("doc_id", "text", "source").collect()]
    expected = expected_audit([r[:2] for r in rows], [r[2] for r in rows], {1, 4, 16, 18, 20, 99}, {1, 4, 5, 6, 18, 99})
    got = filter_audit.audit(parts, labels).collect()
    assert len(got) == 2 * 600 == len(expected)
    for row in got:
        assert tuple(row[name] for name in MEASURES) == expected[row.part, row.filter_order, row.step]


def test_audit_of_other_filters(spark):
    rows = documents(spark, [(k, "w " * k) for k in range(10)])
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(rows, labels, {"X": lambda m: m["n_words"] < 5, "Y": lambda m: m["n_words"] % 2 == 1}, repeats=None)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in found.collect()}
    assert got == {
        ("XY", 1): (5, 5, 0, 3, 1, 8),
        ("XY", 2): (2, 3, 2, 3, 0, 8),
        ("YX", 1): (5, 5, 0, 3, 1, 8),
        ("YX", 2): (2, 3, 2, 3, 0, 8),
    }


def test_audit_of_nothing(spark, empty, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit.audit(docs, labels).collect())


# MinHash


def shingles(text):
    found = words(lower(text))
    return {tuple(found[i : i + 3]) for i in range(max(len(found) - 2, 1))} if found else set()


def expected_components(rows):
    """(size of the set, smallest id reachable) of each (doc_id, text)."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            root[find(b)] = find(a)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    lowest = {k: min((d for d in ids if d is not None), default=None) for k, ids in members.items()}
    return [(len(sets[k]), lowest[find(k)]) for k in range(len(rows))]


def check_components(found, rows):
    expected = collections.Counter()
    for (doc, _), (n, component) in zip(rows, expected_components(rows)):
        expected[doc, n, component, component is None or doc == component] += 1
    assert collections.Counter(tuple(r) for r in found.collect()) == expected


def changed(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def families(seed):
    """Copies with a few words changed: around the threshold, in chains, about a base that is there or is not."""
    rng, made = random.Random(seed), []
    for family in range(6):
        base = prose(100 * seed + family, 150).split()
        if family % 2:
            made.append(" ".join(base))
        made += [changed(rng, base, rng.randint(1, 6)) for _ in range(20)]
        chain = base
        for _ in range(12):
            chain = changed(rng, chain, 3).split()
            made.append(" ".join(chain))
        second = changed(rng, base, 8).split()
        made += [changed(rng, second, rng.randint(1, 5)) for _ in range(10)]
    passage = prose(7, 60)
    made += [f"{passage} {prose(1000 + k, 15)} {k}" for k in range(30)]
    rng.shuffle(made)
    return list(enumerate(made))


def test_components_on_awkward_rows(docs, empty):
    check_components(minhash.components(docs), ROWS)
    assert minhash.components(empty).count() == 0


@pytest.mark.parametrize("group", [2, 8, 1000])
def test_components_of_families(spark, group):
    """Groups of 2 send every bucket of three or more through the exact splitting, 1000 none."""
    rows = families(3)
    check_components(minhash.components(documents(spark, rows), group=group), rows)


def test_links_of_one_hot_group_are_exact(spark):
    """All sets in one group, whatever their keys: the splitting alone finds every component."""
    rows = [(d, t) for d, t in families(5) if t]
    sets = {d: minhash.shingle_set(t, minhash._WordHashes()) for d, t in rows}
    assert all(len(sets[d]) == len(shingles(t)) for d, t in rows)
    full = spark.createDataFrame([(d, s.view(np.int64).tolist()) for d, s in sets.items()], "sid long, shingles array<long>")
    groups = spark.createDataFrame([(0, d) for d in sets], "g long, sid long")
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in minhash.hot_links(minhash.sized(groups), full, 4).collect():
        assert 100 * len(shingles(rows[a][1]) & shingles(rows[b][1])) >= 85 * len(shingles(rows[a][1]) | shingles(rows[b][1]))
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert [find(d) for d, _ in rows] == [component for _, component in expected_components(rows)]


def test_members_too_far_from_any_other_make_no_new_groups(spark):
    """Members that lack shared elements, but have more of their own than a link allows, are settled in one step."""
    rng, base = random.Random(2), range(398)
    sets = [list(base)] + [[e for e in base if e not in lost] + [1000 * k + e for e in range(90)] for k in range(1, 21) for lost in [set(rng.sample(base, 90))]]
    rows = [(0, sid, len(one), len(sets), one) for sid, one in enumerate(sets)]
    members = spark.createDataFrame(rows, "g long, sid long, n long, members long, delta array<long>")
    assert [found.count() for found in minhash._split(members, 4)] == [0, 0, 0]


def test_tables_rarely_miss(spark):
    """Pairs at the threshold share a key; counted over many pairs."""
    rng, missed, pairs = random.Random(1), 0, 0
    while pairs < 300:
        base = [f"w{rng.random()}" for _ in range(200)]
        a, b = (minhash.shingle_set(t, minhash._WordHashes()) for t in (" ".join(base), changed(rng, base, 5)))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        pairs += 1
        same = minhash.signature(a) == minhash.signature(b)
        missed += not (same[: minhash.COLLECTION].any() and same[minhash.COLLECTION :].any())
    assert missed <= 1


# vector codes


def coded(rows, entries, rounds, parts=16):
    """Plain search over whole numbers: (code, error) of each row and the codebooks."""
    width = len(rows[0][1]) // parts
    vectors = [[int(np.floor(np.float64(x) * 256)) for x in v] for _, v in rows]
    cut = [[v[p * width : p * width + width] for p in range(parts)] for v in vectors]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def search(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for row in cut:
                members[search(p, row[p])[1]].append(row[p])
            for e, found in members.items():
                books[p][e] = [sum(column) // len(found) for column in zip(*found)]
    best = [[search(p, row[p]) for p in range(parts)] for row in cut]
    return [([e for _, e in row], sum(d for d, _ in row)) for row in best], books


def vectors(n, width, seed, spread):
    """Many ties: components from few values."""
    rng = np.random.default_rng(seed)
    return [(int(k), [float(x) for x in rng.integers(-spread, spread + 1, width) / 64]) for k in rng.permutation(n) * 3]


@pytest.mark.parametrize("n, width, entries, spread", [(200, 32, 64, 2), (150, 64, 20, 40), (30, 16, 64, 1), (1, 16, 64, 3)])
def test_codes_match_plain_search(spark, n, width, entries, spread):
    rows = vectors(n, width, n, spread)
    expected, books = coded(rows, entries, 2)
    label = {k: None if k % 4 == 0 else k % 3 for k, _ in rows}
    frame = spark.createDataFrame([(k, v, label[k], "x") for k, v in rows], "vec_id long, embedding array<float>, label int, codes string").repartition(3)
    found, learnt = orchard.compress(frame, entries=entries)
    assert learnt.tolist() == books
    got = {r.vec_id: r for r in found.collect()}
    errors = collections.Counter()
    for (k, _), (_, error) in zip(rows, expected):
        errors[label[k]] += error
    for (k, _), (code, error) in zip(rows, expected):
        assert (got[k].codes, got[k].error, got[k].label_error) == (code, error, errors[label[k]])


def test_orchard_visits_few_entries():
    """The walk stops early, and is exact, on entries in clusters."""
    rng = np.random.default_rng(2)
    book = (rng.integers(-9, 9, (64, 4)) * 1000 + rng.integers(-20, 20, (64, 4))).astype(np.int64)
    queries = book[rng.integers(0, 64, 500)] + rng.integers(-50, 50, (500, 4))
    plain = ((queries[:, None] - book[None]) ** 2).sum(axis=2)
    best, least = orchard.nearest(queries, book, orchard.neighbour_lists(book), orchard.starts(queries, book))
    assert (best == plain.argmin(axis=1)).all() and (least == plain.min(axis=1)).all()


def test_vectors_that_are_dropped(spark):
    good = [0.5] * 16
    nan, inf = float("nan"), float("inf")
    rows = [(1, good, 1), (2, None, 1), (3, good[:-1] + [nan], 1), (4, good[:-1] + [-inf], 1), (5, good[:-1] + [None], 1), (6, [1.0] * 32, 1)]
    rows += [(7, [], 1), (8, [1.0] * 15, 1), (None, [-0.5] * 16, None), (None, [-0.5] * 16, None), (1, [0.25] * 16, 1)]
    found, books = orchard.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = collected(found, "vec_id")
    assert {k: len(v) for k, v in got.items()} == {1: 2, None: 2}
    assert books.shape == (16, 2, 1) and books[:, 1].tolist() == [[-128]] * 16
    nothing, books = orchard.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert nothing.count() == 0 and books is None
    huge = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="exceeds"):
        orchard.compress(huge)[0].collect()
