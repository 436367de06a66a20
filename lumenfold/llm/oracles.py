"""DuckDB SQL for the training-data queries whose whole results SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w FROM {table}"


_REACH = """reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)"""

OP1 = f"""
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (SELECT row, vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM usable),
both_ways AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.row <> y.row AND len(x.v) = len(y.v)
  WHERE list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.95
), {_REACH},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(l.b, e.vec_id), e.vec_id)::BIGINT AS component_id, coalesce(least(l.b, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

# every start of a 200-byte string, by its digest; covered bytes are runs of starts that lie at most 200 apart
OP4 = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, t, unnest(range(1, n - 198)) AS pos FROM raw WHERE n >= 200),
strings AS (SELECT doc_id, pos, hash(array_slice(t, pos, pos + 199)) AS h, md5(array_slice(t, pos, pos + 199)) AS h2 FROM starts),
twice AS (SELECT h, h2 FROM strings GROUP BY h, h2 HAVING count(*) > 1),
hits AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM strings JOIN twice USING (h, h2) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hits),
runs AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(array_slice(r.t, g.a, coalesce(g.b, r.n + 1) - 1)), '' ORDER BY g.a) AS k FROM gaps g JOIN raw r ON r.doc_id = g.doc_id GROUP BY g.doc_id),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT r.doc_id, r.n::BIGINT AS n_bytes, coalesce(d.n_removed, 0)::BIGINT AS n_removed, coalesce(d.n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN d.doc_id IS NULL THEN r.t ELSE unhex(k.k) END) AS kept_sha256
FROM raw r LEFT JOIN removed d ON d.doc_id = r.doc_id LEFT JOIN kept k ON k.doc_id = r.doc_id
"""

_OP5_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP5 = f"""
WITH items AS (SELECT item_id, w, least(len(w), 13) AS size FROM ({_words(_OP5_WORD, "benchmark", "item_id")}) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, list_reduce(w[s : s + size - 1], lambda x, y: x || ' ' || y) AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM items)),
docs AS ({_words(_OP5_WORD, "documents", "doc_id")}),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size),
grams AS (SELECT doc_id, size, s, list_reduce(w[s : s + size - 1], lambda x, y: x || ' ' || y) AS g FROM places),
found AS (SELECT doc_id, grams.size, s, item_id FROM grams JOIN windows ON windows.g = grams.g AND windows.size = grams.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS of FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(named.of, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""

_WORD = r"[^\x20\x09-\x0D]+"
OP10 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, w, least(len(w), 3) AS size FROM ({_words(_WORD, "documents", "doc_id")})),
sets AS (SELECT DISTINCT doc_id, size, list_reduce(w[s : s + size - 1], lambda x, y: x || ' ' || y) AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.g = y.g AND x.size = y.size AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH},
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(l.b, d.doc_id), d.doc_id)::BIGINT AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
"""


def _crc(text: str) -> str:
    """crc32 of a text of ASCII characters, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


LANGUAGE_MODEL_BASE = f"""
WITH docs AS (SELECT doc_id, w, {_crc('doc_id::VARCHAR')} % 7 = 2 AS held_out FROM ({_words(_WORD, "documents", "doc_id")})),
tokens AS (SELECT doc_id, held_out, unnest(list_append(list_transform(w, lambda x: 'w' || x), '')) AS t FROM docs),
counts AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
whole AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(whole.n)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (whole.n + whole.v + 1))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (t), whole GROUP BY doc_id
"""


def _fields(text: str) -> str:
    part = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_STEPS = """string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.lv)::BIGINT) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.lv)::BIGINT) AS r"""
_RUN = "t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.lv + 1))::BIGINT"
# all levels of each source's tree and of the tree over the sources; then each leaf's runs on its way to the root
OP11 = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, source, {_fields("text")} AS leaf, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_fields("replace(text, chr(10), '')")} END AS found FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
tree AS (
  SELECT source, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL SELECT source, any_value(lv) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, pos // 3
), subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lv, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT any_value(lv) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM upper_tree WHERE n > 1 GROUP BY pos // 3
), steps AS (
  SELECT l.source, l.pos, t.lv, {_STEPS} FROM leaves l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND {_RUN} GROUP BY l.source, l.pos, t.lv
  UNION ALL
  SELECT x.source, x.pos, 1000 + u.lv, u.l, u.r FROM leaves x JOIN (SELECT l.source, t.lv, {_STEPS} FROM subroots l JOIN upper_tree t ON {_RUN} GROUP BY l.source, t.lv) u ON u.source IS NOT DISTINCT FROM x.source
), ordered AS (SELECT source, pos, coalesce(l, '') AS l, coalesce(r, '') AS r, row_number() OVER (PARTITION BY source, pos ORDER BY lv) AS k FROM steps),
folds AS (
  SELECT source, pos, 0::BIGINT AS k, coalesce(found, leaf) AS h FROM leaves
  UNION ALL SELECT f.source, f.pos, o.k, sha256(o.l || f.h || o.r) FROM folds f JOIN ordered o ON o.source IS NOT DISTINCT FROM f.source AND o.pos = f.pos AND o.k = f.k + 1
), ends AS (SELECT source, pos, arg_max(h, k) AS h FROM folds GROUP BY source, pos),
proofs AS (SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM ordered GROUP BY source, pos),
roots AS (SELECT h AS root FROM upper_tree WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, roots.root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = roots.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos, roots
"""

_RULES = {
    "few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines", "short_words": "word_chars < 2 * n_words",
}
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: translate(x, {_SPACES}, '') <> '') AS l FROM docs),
windows AS (SELECT row, s, array_to_string(w[s : s + 7], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS s FROM docs WHERE len(w) >= 8)),
twice AS (SELECT row, g FROM windows GROUP BY row, g HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(s, s + 8)) AS p FROM windows JOIN twice USING (row, g)) GROUP BY row),
m AS (
  SELECT row, doc_id, source, len(w)::BIGINT AS n_words, length(translate(t, {_SPACES}, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs JOIN lines USING (row) LEFT JOIN covered USING (row)
), sums AS ({" UNION ALL ".join(f"SELECT source, '{r}' AS rule, count(*) AS n, count(*) FILTER ({c}) AS f FROM m GROUP BY source" for r, c in _RULES.items())}),
moments AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS square, count(*) / sum(n) AS noise FROM sums GROUP BY rule),
spreads AS (SELECT rule, mean, square - mean * mean - mean * (1 - mean) * noise AS spread FROM moments),
prior AS (SELECT rule, mean, CASE WHEN spread > 0 THEN greatest(2.0, least(1e6, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS weight FROM spreads),
bad AS (SELECT DISTINCT source, true AS bad FROM sums JOIN prior USING (rule) WHERE (f + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["few_words"]} OR {_RULES["repeats"]}) AS base_failed,
  NOT ({_RULES["few_words"]} OR {_RULES["repeats"]}) AND NOT coalesce(bad, false) AS kept
FROM m LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM m.source
"""

# the composed machine row by row: the least (cost, labels) of each conversation and state of the grammar
OP13 = f"""
WITH RECURSIVE arcs(q, label, reads, gives, q2, cost) AS (VALUES
  (0, 'D', NULL, NULL, 0, 4), (1, 'D', NULL, NULL, 1, 4), (2, 'D', NULL, NULL, 2, 4), (3, 'D', NULL, NULL, 3, 4),
  (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0), (2, 'K', 'a', NULL, 3, 0), (3, 'K', 'u', NULL, 2, 0),
  (0, 'R', NULL, 'user', 2, 3), (1, 'R', NULL, 'user', 2, 3), (2, 'R', NULL, 'assistant', 3, 3), (3, 'R', NULL, 'user', 2, 3)),
inserted(q, q2, labels, texts, cost) AS (VALUES (0, 0, '', [], 0), (1, 1, '', [], 0), (2, 2, '', [], 0), (3, 3, '', [], 0),
  (0, 2, 'I', ['user:'], 3), (1, 2, 'I', ['user:'], 3), (3, 2, 'I', ['user:'], 3), (2, 3, 'I', ['assistant:'], 3), (0, 3, 'II', ['user:', 'assistant:'], 6), (1, 3, 'II', ['user:', 'assistant:'], 6)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
), rows_of AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS r, rtrim(text, {_SPACES}) AS words, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS r_before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (SELECT *, words = '' AS blank, words <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated, words <> '' AND right(words, 1) NOT IN ('.', '!', '?') AS cut FROM rows_of),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate, count(*) FILTER (cut AND NOT repeated) AS truncated,
    count(*) FILTER (r_before IS NOT NULL AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), walk AS (
  SELECT c.conv_id, 0::BIGINT AS i, s.q2 AS q, {{'cost': s.cost, 'labels': s.labels, 'texts': s.texts::VARCHAR[]}} AS w FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN inserted s ON s.q = 0
  UNION ALL
  SELECT walk.conv_id, walk.i + 1, s.q2, min({{'cost': w.cost + arcs.cost + s.cost + CASE WHEN cut AND label <> 'D' THEN 3 ELSE 0 END, 'labels': w.labels || label || s.labels,
    'texts': w.texts || CASE WHEN label = 'D' THEN [] ELSE [coalesce(gives, role) || ':' || text] END || s.texts::VARCHAR[]}})
  FROM walk JOIN judged d ON d.conv_id IS NOT DISTINCT FROM walk.conv_id AND d.i = walk.i + 1
  JOIN arcs ON arcs.q = walk.q AND (label = 'D' OR NOT (blank OR repeated)) AND coalesce(reads = r, true) JOIN inserted s ON s.q = arcs.q2
  GROUP BY walk.conv_id, walk.i + 1, s.q2
), ends AS (SELECT conv_id, arg_max(w, i) AS w FROM (SELECT conv_id, i, min(w) AS w FROM walk WHERE q IN (0, 3) GROUP BY conv_id, i) GROUP BY conv_id)
SELECT e.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal,
  e.w.cost::BIGINT AS cost, e.w.labels AS audit, sha256(array_to_string(e.w.texts, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
