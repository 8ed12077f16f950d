"""DuckDB statements of the operators that SQL can express over whole tables."""

from __future__ import annotations

from millgauge.llm.decontaminate import LOWER, UPPER
from millgauge.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)

QUALITY_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), grams AS (
    SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3
), counted AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM grams
), steps AS (
    SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS step FROM counted WHERE n > 1
), repeated AS (
    SELECT rid, sum(step) AS n_repeat_words FROM steps GROUP BY rid
), lines AS (
    SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line_counts AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid
), measured AS (
    SELECT s.doc_id,
           CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS BIGINT) AS n_stop_words,
           CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
    FROM split s LEFT JOIN repeated USING (rid) LEFT JOIN line_counts USING (rid)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND 100 * word_chars BETWEEN 300 * n_words AND 1000 * n_words
       AND 100 * n_symbols <= 20 * n_words
       AND 100 * n_stop_words >= 5 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM measured
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{_TERM}'), lambda w: translate(w, '{UPPER}', '{LOWER}'))"

DECONTAMINATION_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS words FROM documents
), items AS (
    SELECT DISTINCT item_id, {_TERMS} AS words FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, words[s : s + 12] AS words
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s FROM items WHERE len(words) > 0)
), sizes AS (
    SELECT DISTINCT len(words) AS n FROM windows
), grams AS (
    SELECT rid, s, n, words[s : s + n - 1] AS words
    FROM (SELECT rid, n, words, unnest(range(1, len(words) - n + 2)) AS s FROM docs, sizes WHERE len(words) >= n)
), matches AS (
    SELECT g.rid, g.s, g.n, w.item_id FROM grams g JOIN windows w ON w.words = g.words
), hits AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM matches) GROUP BY rid
), found AS (
    SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM matches WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id,
       CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)
"""

FILTER_AUDIT_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), failed AS (
    SELECT part,
           concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                  CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails,
           coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
           coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS bad
    FROM split
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS x, filter_order[1 : step - 1] AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), classes AS (
    SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM failed GROUP BY part, fails
), counted AS (
    SELECT part, filter_order, step, x,
           sum(n) FILTER (WHERE translate(fails, before || x, '') = fails) AS kept,
           sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS removed,
           sum(n) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') <> fails) AS redundant,
           sum(n) FILTER (WHERE fails = x) AS unique_fails,
           sum(good) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS good_lost,
           sum(bad) FILTER (WHERE contains(fails, x) AND translate(fails, before, '') = fails) AS toxic_lost
    FROM classes, steps GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""

MINHASH_SQL = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT rid, array_to_string(words[i : i + 2], ' ') AS s
    FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
    SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), common AS (
    SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid
), links AS MATERIALIZED (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.rid = c.a JOIN sizes y ON y.rid = c.b
    WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reached AS (
    SELECT rid, rid AS other FROM docs
    UNION SELECT r.rid, l.b FROM reached r JOIN links l ON l.a = r.other
), smallest AS (
    SELECT r.rid, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.rid = r.other GROUP BY r.rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM docs JOIN smallest USING (rid) LEFT JOIN sizes USING (rid)
"""

# Squared distance of two lists of equal length, and division that goes down.
_DISTANCE = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOWN = "(s - (((s % n) + n) % n)) // n"


def _assigned(book: str) -> str:
    return f"""
    SELECT vec_id, label, x, part, unnest(arg_min_list) AS found FROM (
        SELECT p.vec_id, p.label, p.x, p.part,
               list(struct_pack(d := {_DISTANCE}, entry := b.entry) ORDER BY {_DISTANCE}, b.entry)[1:1] AS arg_min_list
        FROM parts p JOIN {book} b USING (part) GROUP BY p.vec_id, p.label, p.x, p.part)"""


def _refined(book: str, assigned: str) -> str:
    return f"""
    SELECT b.part, b.entry, coalesce(new.x, b.x) AS x FROM {book} b LEFT JOIN (
        SELECT part, entry, list({_DOWN} ORDER BY i) AS x FROM (
            SELECT part, found.entry AS entry, i, sum(x[i]) AS s, count(*) AS n
            FROM {assigned}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY part, found.entry, i)
        GROUP BY part, entry) new ON new.part = b.part AND new.entry = b.entry"""


VECTOR_CODES_SQL = f"""
WITH whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, part, v[part * w + 1 : part * w + w] AS x
    FROM (SELECT *, len(v) // 16 AS w, unnest(range(0, 16)) AS part FROM whole)
), book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x
    FROM parts WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 64)
), round1 AS MATERIALIZED ({_assigned("book0")}
), book1 AS MATERIALIZED ({_refined("book0", "round1")}
), round2 AS MATERIALIZED ({_assigned("book1")}
), book2 AS MATERIALIZED ({_refined("book1", "round2")}
), final AS MATERIALIZED ({_assigned("book2")}
), books AS (
    SELECT sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(x) AS n, unnest(range(1, len(x) + 1)) AS i FROM book2)
), coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', found.entry), '' ORDER BY part) AS code, CAST(sum(found.d) AS BIGINT) AS error
    FROM final GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books
"""
