"""DuckDB SQL that gives the same rows as the queries."""

OP1 = r"""
WITH word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS span, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM item, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(i) WHERE len(w) > 0),
doc_win AS (
  SELECT doc_id, i, span, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM word, (SELECT DISTINCT span FROM win), unnest(range(1, len(w) - span + 2)) AS r(i)),
hit AS (SELECT doc_id, i, span, item_id FROM doc_win JOIN win USING (span, win)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, span)) AS r(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM word LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP9 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("live", r"[sr]k_live_[A-Za-z0-9]{20,}", 0, 1),
)

OP10 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), piece AS ("
    + " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, {least} AS least,
  unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}', 0)) AS hit,
  unnest(regexp_extract_all(t, '{p}', {group})) AS part, generate_subscripts(string_split_regex(t, '{p}'), 1) AS i FROM d"""
        for k, (kind, p, group, least) in enumerate(_RULES)
    )
    + """), span AS (
  SELECT doc_id, k, kind, part, least, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e, length(hit) AS n
  FROM piece WHERE hit IS NOT NULL),
kept AS (SELECT doc_id, k, kind, CAST(e - n AS BIGINT) AS s, kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS said
  FROM span WHERE length(part) >= least)
SELECT doc_id, count(k) FILTER (k = 0) AS n_assign, count(k) FILTER (k = 1) AS n_access, count(k) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""
)
