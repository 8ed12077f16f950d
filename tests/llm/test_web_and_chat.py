"""Revisits and chat repair against brute-force versions, on awkward rows."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from millgauge.llm import chat, warc

# revisits

RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def resolved(rows):
    """Outcome and response of each record, by search."""
    out = []
    for number, url, ts, kind, etag, modified, digest, _ in rows:
        if kind == "response":
            out.append((number, "full", number))
            continue
        earlier = [r for r in rows if r[3] == "response" and None not in (url, ts, r[1], r[2]) and r[1] == url and (r[2], r[0], r[3]) < (ts, number, kind)]
        if not earlier:
            out.append((number, "unresolved", None))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        strong = lambda tag: tag and tag.removeprefix("W/")
        checks = [(strong(etag), strong(best[4])), (modified, best[5]), (digest, best[6])]
        given = [(a, b) for a, b in checks if a is not None]
        outcome = "mismatch" if any(a != b for a, b in given) else "resolved" if given else "unchecked"
        out.append((number, outcome, None if outcome == "mismatch" else best[0]))
    return collections.Counter(out)


def test_revisits_against_search(spark):
    rng = random.Random(4)
    rows = []
    for number in range(400):
        # One URL has a third of all records, over many stretches of time.
        url = rng.choice(["a.org/hot"] * 5 + [f"a.org/{k}" for k in range(10)])
        kind = rng.choice(["response", "revisit", "revisit"])
        tags = [None, '"x"', 'W/"x"', '"y"']
        rows.append((number, url, rng.randrange(0, 12) * 40_000, kind, rng.choice(tags), rng.choice([None, None, "d1"]), rng.choice([None, None, "s1"]), None))
    rows += [(400, None, 5, "revisit", None, None, None, None), (401, "a.org/hot", None, "response", None, None, None, None), (402, "a.org/never", 9, "revisit", '"x"', None, None, None)]
    got = warc.resolve(spark.createDataFrame(rows, RECORDS)).collect()
    assert collections.Counter((r.record_id, r.outcome, r.response_id) for r in got) == resolved(rows)
    twice = spark.createDataFrame(rows + rows, RECORDS)
    assert warc.resolve(twice).count() == 2 * len(rows)
    assert warc.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_headers_are_merged(spark):
    rows = [
        (1, "http://a.org/", 10, "response", '"x"', None, "d", {"ETag": '"x"', "Content-Type": "text/html", "Date": "one"}),
        (2, "http://www.a.org:80/#top", 20, "revisit", '"x"', None, None, {"date": "two", "Content-Type": "text/plain", "X-Own": "1"}),
    ]
    extra = spark.createDataFrame(rows, RECORDS).withColumns({"found": F.lit(1), "stretch": F.lit(2), "outcome": F.lit(3)})
    row = warc.resolve(extra).where("record_id = 2").first()
    assert row.outcome == "resolved" and row.response_id == 1 and row.digest == "d"
    assert row.headers == {"etag": '"x"', "content-type": "text/html", "date": "two"}


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://WWW.A.org:80/b/?utm_source=x&z=1&a=2#f", "a.org/b?a=2&z=1"), ("https://a.org", "a.org/"), ("https://a.org:443/", "a.org/"),
        ("https://u:p@a.org:8080/x//", "a.org:8080/x"), ("https://m.a.org/x?", "a.org/x"), ("mailto:me", "mailto:me"), (None, None), ("", ""),
    ],
)
def test_canonical_urls(spark, url, expected):
    assert spark.range(1).select(warc.canonical_url(F.lit(url).cast("string"))).first()[0] == expected


# chat


def cheapest(roles):
    """Least cost by trying every way through the automaton."""
    best = {0: 0}
    for role in roles:
        known = role if role in chat.ROLES else None
        new = {}
        for state, cost in best.items():
            for target, name in enumerate(chat.ROLES):
                label = chat.COSTS["unknown"] if known is None else chat.COSTS["relabel"] * (name != role)
                ways = []
                if target in chat.NEXT[state]:
                    ways.append(label)
                if state == 1 + target:
                    ways.append(label + chat.COSTS["merge"])
                if target not in chat.NEXT[state] and any(target in chat.NEXT[1 + b] for b in chat.NEXT[state]):
                    ways.append(label + chat.COSTS["insert"])
                for price in ways:
                    new[1 + target] = min(new.get(1 + target, 1 << 30), cost + price)
        best = new
    return min(best.values())


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return all(role == ("user", "assistant")[i % 2] for i, role in enumerate(rest))


def test_every_short_conversation_is_repaired_at_least_cost():
    for n in range(1, 5):
        for roles in itertools.product(["system", "user", "assistant", "tool", None], repeat=n):
            cost, actions = chat.repair(list(roles))
            assert cost == cheapest(roles)
            out = []
            for what, target, between in actions:
                if what == "insert":
                    out.append(chat.ROLES[between])
                if what != "merge":
                    out.append(chat.ROLES[target])
            assert legal(out), roles


TURNS = "conv_id long, turn long, role string, text string, stretch int, place int, extra string"


def whole(rows):
    """Rendering of one conversation repaired in one piece."""
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
    cost, actions = chat.repair([r[2] for r in ordered])
    turns = []
    for row, (what, target, between) in zip(ordered, actions):
        if what == "insert":
            turns.append([chat.ROLES[between], ""])
        if what == "merge":
            turns[-1][1] += "\n" + (row[3] or "")
        else:
            turns.append([chat.ROLES[target], row[3] or ""])
    return cost, [r for r, _ in turns], "\n<|end|>\n".join(f"<|{role}|>\n{text}" for role, text in turns)


def test_conversations(spark, monkeypatch):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", None]
    rows = [(c, t, rng.choice(roles), rng.choice(["hello", "", None, "a longer text " * 300]), None, None, None) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(roles), f"t{t}", None, None, None) for t in range(1500)]  # a long one, over six stretches
    rows += [(50, 1, "user", "same", None, None, None)] * 3 + [(50, None, "system", "no number", None, None, None), (None, 0, "user", "no conversation", None, None, None)]
    turns = spark.createDataFrame(rows, TURNS)
    by = collections.defaultdict(list)
    for row in rows:
        by[row[0]].append(row)
    pieces = collections.defaultdict(list)
    for r in chat.rendered_pieces(turns).collect():
        pieces[r.conv_id].append(r)
    assert set(pieces) == set(by) and len(pieces[99]) == 6
    for conv, own in by.items():
        cost, kept, text = whole(own)
        mine = sorted(pieces[conv], key=lambda r: r.stretch)
        assert sum(r.cost for r in mine) == cost
        shown = "".join(r.rendered for r in mine)
        if conv != 99:
            assert shown == text
        heads = [part.split("|>")[0] for part in shown.split("<|") if part.split("|>")[0] in chat.ROLES]
        assert legal(heads)
    digests = {r.conv_id: r for r in chat.conversations(turns).collect()}
    for conv, mine in pieces.items():
        hashes = [hashlib.sha256(r.rendered.encode()).hexdigest() for r in sorted(mine, key=lambda r: r.stretch)]
        assert digests[conv].rendered_sha256 == hashlib.sha256(",".join(hashes).encode()).hexdigest()
    assert chat.conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("stretch, fan", [(256, 256), (4, 3)])
def test_stretches_are_bounded_whatever_the_turn_numbers(spark, monkeypatch, stretch, fan):
    """Null, equal, restarting and sparse turn numbers, a null conversation, repeated rows."""
    monkeypatch.setattr(chat, "STRETCH", stretch)
    monkeypatch.setattr(chat, "FAN", fan)
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", None]
    numbers = {1: lambda k: None, 2: lambda k: 5, 3: lambda k: k % 50, 4: lambda k: 1000 * k, None: lambda k: k % 100}
    rows = [(c, number(k), rng.choice(roles), f"text {k}", None, None, None) for c, number in numbers.items() for k in range(600)]
    rows += [(5, 1, "user", "the same", None, None, None)] * 600 + [(0, 1, "user", "zero", None, None, None)]
    pieces = collections.defaultdict(list)
    for r in chat.rendered_pieces(spark.createDataFrame(rows, TURNS)).collect():
        pieces[r.conv_id].append(r)
    assert set(pieces) == {0, 1, 2, 3, 4, 5, None}
    for conv, mine in pieces.items():
        own = [r for r in rows if r[0] == conv]
        assert sorted(r.stretch for r in mine) == list(range(-(-len(own) // stretch)))
        cost, _, text = whole(own)
        shown = "".join(r.rendered for r in sorted(mine, key=lambda r: r.stretch))
        assert sum(r.cost for r in mine) == cost
        heads = [part.split("|>")[0] for part in shown.split("<|") if part.split("|>")[0] in chat.ROLES]
        assert legal(heads)
        # The texts stand in the order of the turns.
        said = lambda shown: [line for line in shown.split("\n") if line.startswith(("text", "the same", "zero"))]
        assert said(shown) == said(text)
