"""DuckDB SQL for the queries that SQL can state on whole tables."""

from __future__ import annotations

import re

from .chat_events import CONTROL, MARKS
from .line_rules import BOILERPLATE, MAX_REPEATED, MIN_LEFT, MIN_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(0, 35) AS t(j)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)
SELECT w.doc_id, any_value(len(ws)) AS n_words, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN x ON w.doc_id = x.doc_id LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY w.doc_id"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS key FROM s GROUP BY doc_id),
classes AS (SELECT key, min(doc_id) AS d, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY key),
r AS (SELECT s.k, c.d, c.n FROM s JOIN classes c ON s.doc_id = c.d),
links AS (SELECT a.d AS x, b.d AS y FROM r a JOIN r b ON a.k = b.k AND a.d < b.d GROUP BY a.d, b.d, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS n, x AS m FROM both_ways UNION SELECT reach.n, e.y FROM reach JOIN both_ways e ON e.x = reach.m),
roots AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
degree AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT w.doc_id, coalesce(root, d, w.doc_id) AS class_id, coalesce(d, w.doc_id) AS copy_of, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (key) LEFT JOIN roots ON roots.n = d LEFT JOIN degree ON degree.x = d"""

_control = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL)
_around = " ".join(f"WHEN {literal(role)} THEN {len(before) + len(after)}" for role, (before, after) in MARKS.items())
CHAT_FORMATTING = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(text) + len(regexp_extract_all(text, {literal(_control)})) + CASE role {_around} END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""

_phrases = "|".join(BOILERPLATE)
QUALITY_RULES = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
l AS (SELECT doc_id, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines),
m AS (
  SELECT *, len(ws) AS n, len(regexp_extract_all(line, '[#*$%&|<>]')) AS signs, len(regexp_extract_all(line, '[|>»·›•]')) AS marks,
    len(regexp_extract_all(line, '[A-Z]')) AS big, len(regexp_extract_all(line, '[a-z]')) AS small, len(list_distinct(ws)) AS kinds FROM l),
f AS (SELECT *, n > 0 AND (
    (signs >= 3 AND signs > 0.3 * n) OR (marks >= 3 AND marks > 0.2 * n) OR (big + small >= 20 AND big > 0.7 * (big + small) AND n >= 5)
    OR (n >= 12 AND NOT regexp_matches(line, '[.,;:!?\x{{2000}}-\x{{3FFF}}\x{{F000}}-\x{{FFFF}}]'))
    OR (n < 8 AND NOT regexp_matches(ws[n], '[].,;:!?"'')}}\x{{2000}}-\x{{FFFF}}]$'))
    OR (n <= 25 AND regexp_matches(lower(line), {literal(_phrases)})) OR (n >= 10 AND kinds < 0.2 * n) OR (nth > 1 AND n >= 3)) AS fails FROM m),
d AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, sum(signs)::BIGINT AS n_symbols, count(*) FILTER (n > 0 AND nth > 1) AS n_dup_lines,
    coalesce(sum(n) FILTER (NOT fails), 0)::BIGINT AS n_left FROM f GROUP BY doc_id),
w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri, range(0, 3) AS t(j) WHERE times > 1 GROUP BY doc_id),
base AS (
  SELECT d.*, length(array_to_string(w.ws, ''))::BIGINT AS word_chars, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= {MIN_LEFT} * n_words AS kept, n_left FROM judged"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
t AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM t"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS l, len(t) - len(replace(t, chr(10), '')) + CASE WHEN t = '' OR suffix(t, chr(10)) THEN 0 ELSE 1 END AS n FROM d),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b FROM u),
c AS (SELECT *,
  CASE WHEN least(a, b) = n THEN t WHEN least(a, b) = 0 THEN '' ELSE array_to_string(l[:least(a, b)], chr(10)) || chr(10) END AS p,
  CASE WHEN greatest(a, b) = n THEN t WHEN greatest(a, b) = 0 THEN '' ELSE array_to_string(l[:greatest(a, b)], chr(10)) || chr(10) END AS pm FROM k),
s AS (SELECT doc_id, n, t, p, substr(pm, len(p) + 1) AS m, substr(t, len(pm) + 1) AS x,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""
