"""Registration, statements and the pipeline on the smallest supplied tables."""

import collections

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import connect, difference
from millgauge.llm import common, quality_rules, queries, sentencepiece
from tests.llm.test_documents import fingerprint, ids_of, quality, reachable, terms, viterbi


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", queries.STATEMENTS)
def test_matches_statement(spark, data, name):
    assert difference(queries.QUERIES[name](spark, data), connect(data), queries.STATEMENTS[name]) is None


def kept_by_rules(text):
    n, chars, symbols, dup, repeated = quality(text)
    found = (text or "").split()
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in found)
    lines = sum(bool(line.strip(" \t\r\v\f")) for line in (text or "").split("\n"))
    return n >= 50 and 2 * repeated <= n and 3 * n <= chars <= 10 * n and 5 * symbols <= n and 20 * stops >= n and 2 * dup <= lines


def test_pipeline(spark, data):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    items = [terms(r["text"]) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()]
    good = sorted(d for d, t in docs.items() if kept_by_rules(t))
    roots = reachable([fingerprint(docs[d]) for d in good])
    one = [d for k, d in enumerate(good) if roots[k] == k]
    windows = collections.defaultdict(set)
    for words in items:
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[n].add(tuple(words[k : k + n]))
    clean = []
    for d in one:
        words = terms(docs[d])
        hit = {i + k for n, known in windows.items() for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in known for k in range(n)}
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append(d)
    assert len(docs) > len(good) > len(one) >= len(clean) > 0

    rows = corpus_pipeline.run(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == clean
    assert all(r.round_trip and r.n_pieces == len(ids_of(r["ids"])) for r in rows)
    pieces = sentencepiece.read_pieces(common.tokenizer_path("piece_bpe_32k.model"))
    short = [r for r in rows if len(docs[r.doc_id]) < 1500][:10]
    for r in short:
        text = sentencepiece.decoded(bytes(r["ids"]), pieces)
        assert ids_of(r["ids"]) == viterbi(text, pieces)
        assert text == docs[r.doc_id] or "[SECRET]" in text
