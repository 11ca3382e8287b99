"""DuckDB SQL for the rows of the queries."""

from garimpo.llm.lines import LINES
from garimpo.llm.mixing import BUCKETS, MOST, SEED, SHARE, WEIGHTS
from garimpo.llm.repetition import BASE_LIMIT, BASE_WORDS, LINE_LIMIT, NGRAM_LIMITS
from garimpo.llm.substring import WINDOW

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _rules() -> str:
    """Each text's words in a list; the words inside repeated windows are found by the windows' places."""
    lengths = sorted({3, *NGRAM_LIMITS})
    grams = ", ".join(f"CASE WHEN k + {n - 1} <= nw THEN hash(list_slice(ws, k, k + {n - 1})) END AS g{n}" for n in lengths)
    seen = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 AS d{n}" for n in lengths)
    inside = ", ".join(f"max(d{n}::INT) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    totals = "sum(c3) AS n_repeat_words, sum(length(w)) AS word_chars, " + ", ".join(f"sum(c{n} * length(w)) AS dup{n}" for n in NGRAM_LIMITS)
    good = " AND ".join(f"100 * coalesce(dup{n}, 0) <= {most} * coalesce(word_chars, 0)" for n, most in NGRAM_LIMITS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT rid, ws, len(ws) AS nw, unnest(range(1, len(ws) + 1)) AS k FROM d),
g AS (SELECT rid, k, ws[k] AS w, {grams} FROM w),
s AS (SELECT rid, k, w, {seen} FROM g),
c AS (SELECT rid, k, w, {inside} FROM s),
t AS (SELECT rid, {totals} FROM c GROUP BY rid),
l0 AS (SELECT rid, unnest(range(1, len(ls) + 1)) AS k, ls FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)),
l1 AS (SELECT rid, length(ls[k]) AS n, row_number() OVER (PARTITION BY rid, ls[k] ORDER BY k) > 1 AS again FROM l0 WHERE regexp_matches(ls[k], '[^\\x20\\x09-\\x0D]')),
l AS (SELECT rid, sum(n) AS line_chars, sum(CASE WHEN again THEN n ELSE 0 END) AS dup_chars, count(*) FILTER (again) AS n_dup FROM l1 GROUP BY rid),
o AS (SELECT doc_id, len(ws) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  ({good}) AND 100 * coalesce(dup_chars, 0) <= {LINE_LIMIT} * coalesce(line_chars, 0) AS good
  FROM d LEFT JOIN t USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed,
  NOT (n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words) AND good AS kept FROM o
"""


def _substrings() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
w AS (SELECT rid, doc_id, k, CASE WHEN k + {WINDOW - 1} <= len(ws) THEN md5(array_to_string(list_slice(ws, k, k + {WINDOW - 1}), ' ')) END AS h, ws[k] AS word FROM k),
f AS (SELECT h, min(doc_id) AS first_doc FROM w WHERE h IS NOT NULL GROUP BY h),
m AS (SELECT rid, k, word, coalesce(doc_id > first_doc, false)::INT AS late FROM w LEFT JOIN f USING (h)),
c AS (SELECT rid, k, word, max(late) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""


def _near_duplicates(width: int = 4) -> str:
    """Sets of shingles, pairs that share a shingle, links, and the smallest doc_id that they reach."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {width - 2}), lambda k: array_to_string(list_slice(ws, k, k + {width - 1}), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _mixing() -> str:
    names = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 4))::BIGINT % {BUCKETS} AS b FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} {names} END AS weight, {MOST} * source_size AS most FROM s0),
s2 AS (SELECT *, row_number() OVER w AS k, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
  - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s1 WINDOW w AS (ORDER BY most / weight::DOUBLE, source ASC NULLS LAST)),
s3 AS (SELECT *, min(CASE WHEN level * weight <= most THEN k END) OVER () AS open FROM s2),
s4 AS (SELECT *, max(CASE WHEN k = open THEN level END) OVER () AS final FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN open IS NULL OR k < open THEN most::DOUBLE ELSE final * weight END AS target,
  ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(1) || 'null')), 1, 5))::BIGINT::DOUBLE / 1048576 AS u FROM s4),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  (row_number() OVER (PARTITION BY d.source ORDER BY size, b, doc_id NULLS FIRST))::DOUBLE AS k
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u)) * size)::BIGINT AS taken FROM r
"""


def _lines() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d),
w0 AS (SELECT rid, doc_id, k, ls[k] AS line, CASE WHEN k + {LINES - 1} <= len(ls) THEN array_to_string(list_slice(ls, k, k + {LINES - 1}), chr(10)) END AS g FROM k),
w AS (SELECT rid, doc_id, k, line, CASE WHEN regexp_matches(g, '[^\\x20\\x09-\\x0D]') THEN md5(g) END AS h FROM w0),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_doc, row_number() OVER (PARTITION BY h, rid ORDER BY k) AS nth FROM w),
m AS (SELECT rid, k, line, (h IS NOT NULL AND (nth > 1 OR doc_id > first_doc))::INT AS late FROM f),
c AS (SELECT rid, k, line, max(late) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN {LINES - 1} PRECEDING AND CURRENT ROW) AS gone FROM m),
r AS (SELECT rid, sum(gone)::BIGINT AS n_removed, string_agg(line, chr(10) ORDER BY k) FILTER (gone = 0) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(ls) AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN r USING (rid)
"""


def _tool_calls() -> str:
    return """
WITH c AS (SELECT conv_id, turn, text, turn::VARCHAR AS call_id FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, (turn - 1)::VARCHAR AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
g AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM 2 AS fresh FROM c),
b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM g),
l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, chain ORDER BY turn) - 1)::INT AS level FROM b),
j AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.call_id, r.call_id) AS call_id, level, turn, text, content,
  CASE WHEN l.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.call_id = r.call_id)
SELECT conv_id, call_id, level, row_number() OVER (PARTITION BY conv_id ORDER BY status = 'orphan', level NULLS LAST, turn NULLS FIRST, call_id)::INT AS place, status,
  CASE WHEN status <> 'orphan' THEN length(text) > 0 AND turn >= 0 END AS valid,
  '{"arguments":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '}' END
  || ',"id":"' || call_id || '","name":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '"reply"' END || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END || '}' AS json
FROM j
"""


ORACLES = {"op3_tool_call_linking": _tool_calls(), "op5_mixing": _mixing(), "op6_line_dedup": _lines(), "op2_minhash_near_dedup": _near_duplicates(), "op9_substring_dedup": _substrings(), "op10_quality_rules": _rules()}
