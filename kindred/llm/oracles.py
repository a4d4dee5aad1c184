"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The words of column ``text`` of a subquery.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: The rules of op1 as RE2 has them, written out once more.
_boiler = r"(?i)\b(licensed under|all rights reserved|copyright (\(c\)|©)|privacy policy|cookie policy|terms of (use|service)|enable javascript|click here|sign up|log ?in to|subscribe (now|to)|read more|share (this|on)|powered by|lorem ipsum)\b"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS} AS w FROM d),
g AS (SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) x(i)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM r, (VALUES (0), (1), (2)) v(k)) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT rid, l, list_filter(l, lambda x: NOT (
  NOT regexp_matches(x, '[.,;:!?…。！？]')
  OR (len(regexp_extract_all(x, '[#*$%&|<>~^={{}}\\\x{{BB}}›•\x{{B7}}]')) >= 3 AND len(regexp_extract_all(x, '[#*$%&|<>~^={{}}\\\x{{BB}}›•\x{{B7}}]')) * 25 > length(x))
  OR (len(regexp_extract_all(x, '[!?]{{2,}}|\.{{4,}}')) >= 3 AND len(regexp_extract_all(x, '[!?]{{2,}}|\.{{4,}}')) * 30 > length(x))
  OR (regexp_matches(x, '{_boiler}') AND len(regexp_extract_all(x, '{_boiler}')) * 400 >= length(x)))) AS kept FROM l),
s AS (SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, len(k.l) - len(list_distinct(k.l)) AS n_dup_lines,
 coalesce(c.n, 0) AS n_repeat_words, len(k.l) AS n_lines, len(k.l) - len(k.kept) AS n_bad_lines, length(array_to_string(k.l, '')) AS chars, length(array_to_string(k.l, '')) - length(array_to_string(k.kept, '')) AS lost_chars
 FROM d JOIN w USING (rid) JOIN k USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * chars AS kept,
 CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(lost_chars AS BIGINT) AS lost_chars FROM s"""

OP2 = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM d),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) END AS top FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM m"""

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM d, unnest(range(1, len(w) - 11)) x(i)),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM g) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM f, unnest(range(0, 13)) x(k) GROUP BY doc_id),
p AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM p"""

_reply = "json_object('text', text, 'turn', t.turn)"
OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS before FROM conversations),
u AS (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user'),
lev AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM u)),
a AS (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'assistant'),
c AS (SELECT t.conv_id, t.turn, 'call' AS kind, id AS call_id, level, a.turn IS NOT NULL AS linked, coalesce(length(text), 0) > 0 AS valid, CASE WHEN text = '' THEN '/text: minLength' ELSE '' END AS error,
 json_object('arguments', {_reply}, 'call_id', id, 'conv_id', t.conv_id, 'kind', 'call', 'level', level, 'name', 'reply', 'turn', t.turn)::VARCHAR AS line FROM t JOIN lev ON lev.conv_id = t.conv_id AND lev.turn = t.turn LEFT JOIN a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1 WHERE role = 'user'),
r AS (SELECT t.conv_id, t.turn, 'result' AS kind, before AS call_id, level, level IS NOT NULL AS linked, NULL::BOOLEAN AS valid, '' AS error,
 json_object('call_id', before, 'content', text, 'conv_id', t.conv_id, 'kind', 'result', 'level', level, 'name', CASE WHEN level IS NOT NULL THEN 'reply' END, 'turn', t.turn)::VARCHAR AS line FROM t LEFT JOIN lev ON lev.conv_id = t.conv_id AND lev.turn = t.turn - 1 WHERE role = 'assistant'),
o AS (SELECT conv_id, turn, 'text' AS kind, NULL AS call_id, NULL::BIGINT AS level, FALSE AS linked, NULL::BOOLEAN AS valid, '' AS error, json_object('content', text, 'conv_id', conv_id, 'kind', 'text', 'role', role, 'turn', turn)::VARCHAR AS line FROM t WHERE role NOT IN ('user', 'assistant'))
SELECT * FROM c UNION ALL SELECT * FROM r UNION ALL SELECT * FROM o"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len({WORDS}) AS size FROM documents),
k AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size, -ln((('0x' || substr(md5(doc_id || '|7'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / (len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))) / (1.0::DOUBLE + 10.0::DOUBLE * (len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(size, 1))) * CASE WHEN length(text) / greatest(size, 1)::DOUBLE BETWEEN 4 AND 9 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM k GROUP BY source),
c AS (SELECT *, 3 * n AS cap, sum(n) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, n, least(cap, w * (SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, level LIMIT 1)) AS target FROM l),
e AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS epochs, target - CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END * n AS budget FROM t),
r AS (SELECT source, key, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY key, doc_id) AS upto FROM (SELECT source, key, doc_id, sum(size) AS n FROM k WHERE size > 0 GROUP BY source, key, doc_id)),
g AS (SELECT r.*, e.budget, e.budget - coalesce(max(upto) FILTER (upto <= budget) OVER (PARTITION BY r.source), 0) AS gap FROM r JOIN e ON e.source IS NOT DISTINCT FROM r.source WHERE budget > 0),
x AS (SELECT source, key, doc_id FROM g WHERE upto <= budget UNION ALL SELECT source, key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(n - gap), key, doc_id) AS rk FROM g WHERE upto > budget AND abs(n - gap) < gap) WHERE rk = 1)
SELECT k.doc_id, k.size, CAST(e.n AS BIGINT) AS source_size, e.target, CAST(k.size * (e.epochs + CASE WHEN x.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM k JOIN e ON e.source IS NOT DISTINCT FROM k.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM k.source AND x.key = k.key AND x.doc_id = k.doc_id"""

ORACLES = {"op1_quality_rules": OP1, "op2_warc": OP2, "op3_substring_dedup": OP3, "op9_chat": OP9, "op10_mixing": OP10}
