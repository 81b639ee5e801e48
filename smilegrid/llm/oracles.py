"""DuckDB SQL for the numbered queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Components of links (a, b), both ways, by everything that a vertex reaches.
_REACH = "reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"

OP1 = rf"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WHITE}'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
owned AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS owner FROM windows),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM owned, range(13) AS t(k) WHERE owner < doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

OP2 = f"""
WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM x WHERE len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE list_dot_product(p.v, q.v) / (p.norm * q.norm) >= 0.9),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, b FROM least) USING (vec_id)"""


def _escaped(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


OP5 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(replace({_escaped("role")}, ':', '\:')) + length(': ') + length({_escaped("text")}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

OP6 = rf"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_PLAIN}'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, w[i : i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS s FROM wins),
spots AS (SELECT doc_id, i, s, w[i : i + s - 1] AS win FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM docs, sizes)),
hits AS (SELECT doc_id, i, s, item_id FROM spots JOIN wins USING (win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(m.n, 0) AS n_hit, coalesce(h.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(m.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked m USING (doc_id) LEFT JOIN named h USING (doc_id)"""

OP9 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WHITE}'), []) AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM sets p JOIN sets q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_.n >= 80 * (x.n + y.n - both_.n)),
{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, b FROM least) USING (doc_id)"""

#: kind, rank, pattern, group whose length counts, least length
_SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(m[i]) AS "end" FROM (
  SELECT *, CAST(list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g FROM documents WHERE text IS NOT NULL)))
  WHERE length(g[i]) >= {least}"""


_SPANS = "string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank, \"end\")"
OP10 = f"""
WITH found AS ({" UNION ALL ".join(_found(i, *r) for i, r in enumerate(_SECRETS))}),
sums AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  {_SPANS} FILTER (WHERE rank < 3) AS base, {_SPANS} AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sums USING (doc_id)"""

def _plus(x: str, cost: str, letters: str) -> str:
    """A path (nine digits of cost, then letters; NULL: none) with more of both."""
    return f"lpad(CAST(CAST(left({x}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substring({x}, 10) || '{letters}'"


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"
_WHITES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11 = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
dealt AS (SELECT *, {_CRC} % 20 AS what FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM dealt, range(2) AS t(k) WHERE what <> 0 AND (k = 0 OR what = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, right(rtrim(text, {_WHITES}), 1) AS ending FROM damaged),
turns AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM turns GROUP BY conv_id),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {_plus("s0", "2", "D")}, CASE WHEN keeps AND initial = 's' THEN least({_plus("s1", "2", "D")}, {_plus("s0", "extra", "K")}) ELSE {_plus("s1", "2", "D")} END,
    least({_plus("u", "2", "D")}, CASE WHEN keeps AND initial = 'u' THEN {_plus("f", "extra", "K")} END, CASE WHEN keeps THEN {_plus("f", "extra + 1", "R")} END),
    least({_plus("a", "2", "D")}, CASE WHEN keeps AND initial = 'a' THEN {_plus("u", "extra", "K")} END, CASE WHEN keeps THEN {_plus("u", "extra + 1", "R")} END)
  FROM (SELECT *, least(s0, s1, a) AS f FROM (SELECT *, least(s3, {_plus("u", "5", "I")}) AS a FROM (
    SELECT t.conv_id, t.i, s0, s1, s3, initial, fault NOT IN ('blank', 'duplicate') AS keeps, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, least(s2, {_plus("s0", "5", "I")}, {_plus("s1", "5", "I")}, {_plus("s3", "5", "I")}) AS u
    FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1)))),
ended AS (SELECT p.conv_id, least(s0, s3, {_plus("s2", "5", "I")}, {_plus("s1", "10", "II")}) AS path FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i),
letters AS (SELECT conv_id, k, path[9 + k] AS letter, CAST(length(replace(path[10 : 9 + k], 'I', '')) AS BIGINT) AS i FROM (SELECT conv_id, path, unnest(range(1, length(path) - 8)) AS k FROM ended)),
staying AS (SELECT l.conv_id, k, letter, t.role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text, count(*) FILTER (WHERE NOT (letter = 'K' AND initial = 's')) OVER (PARTITION BY l.conv_id ORDER BY k) AS place
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM staying GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(path, 9) AS BIGINT), 0) AS cost, coalesce(substring(path, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""

_METRICS = {"word_length": ("word_chars", "n_words", 300), "symbols": ("n_symbols", "n_words", 100), "dup_lines": ("n_dup_lines", "n_lines", 500), "repeats": ("n_repeat_words", "n_words", 300)}


def _fence(keys: str, name: str) -> str:
    cells = f"SELECT {keys}, metric, cell, count(*) AS n, sum(count(*)) OVER (PARTITION BY {keys}, metric ORDER BY cell) AS upto, sum(count(*)) OVER (PARTITION BY {keys}, metric) AS total FROM cells GROUP BY {keys}, metric, cell"
    quarter = f"SELECT {keys}, metric, max(total) AS total, min(cell) FILTER (WHERE upto * 4 >= total) AS q1, min(cell) FILTER (WHERE upto * 4 >= 3 * total) AS q3 FROM ({cells}) GROUP BY {keys}, metric"
    return f"{name} AS (SELECT {keys}, metric, total, q1 - 3 * (q3 - q1) - slack AS least, q3 + 3 * (q3 - q1) + slack AS most FROM ({quarter}) JOIN slacks USING (metric))"


OP12 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WHITE}'), []) AS w FROM documents),
lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WHITE}')) AS lines FROM docs),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs))),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM windows, range(8) AS t(k) WHERE n > 1 GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words FROM lined LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
slacks AS (SELECT unnest({list(_METRICS)}) AS metric, unnest({[x[2] for x in _METRICS.values()]}) AS slack),
shares AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, 1000 * {x} // greatest({n}, 1) AS v FROM judged WHERE NOT base_failed" for m, (x, n, _) in _METRICS.items())}),
cells AS (SELECT lang, source, 1 AS one, metric, (v >> CAST(low AS BIGINT)) << CAST(low AS BIGINT) AS cell FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS low FROM shares)),
{_fence("lang, source", "own")}, {_fence("lang", "spoken")}, {_fence("one", "whole")},
past AS (SELECT doc_id, string_agg(metric, ',' ORDER BY metric) AS failed FROM (
  SELECT s.*, CASE WHEN o.total >= 100 THEN o.least WHEN l.total >= 100 THEN l.least ELSE a.least END AS least, CASE WHEN o.total >= 100 THEN o.most WHEN l.total >= 100 THEN l.most ELSE a.most END AS most
  FROM shares s JOIN own o USING (lang, source, metric) JOIN spoken l USING (lang, metric) JOIN whole a USING (metric)) WHERE v > most OR (v < least AND metric = 'word_length') GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM judged LEFT JOIN past USING (doc_id)"""

OP13 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM runs GROUP BY lang),
starts AS (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM runs, range(1, 6) AS t(d)),
counts AS (SELECT lang, array_to_string(w[i : i + d - 1], ' ') AS phrase, d, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, d)) AS k FROM counts WHERE d > 1),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : len(w)], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inner_ AS (SELECT lang, f, d, e, string_split(phrase, ' ') AS w, unnest(range(1, d - e + 2)) AS i FROM counts, range(2, 5) AS t(e) WHERE e < d),
longer AS (SELECT lang, array_to_string(w[i : i + e - 1], ' ') AS phrase, max(f) AS f FROM inner_ GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR g.f < a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

ORACLES = {
    "op1_substring_automata": OP1,
    "op2_embedding_pstable": OP2,
    "op5_chat_fingerprints": OP5,
    "op6_prefix_decontaminate": OP6,
    "op9_minhash_bayes": OP9,
    "op10_secret_ledger": OP10,
    "op11_repair_arcs": OP11,
    "op12_adaptive_rules": OP12,
    "op13_phrase_suffixes": OP13,
}
