"""DuckDB SQL that gives the same rows as the engine's queries."""

_PAGES = """doc_pages AS (
  SELECT volume AS doc_id, CAST(row_number() OVER (PARTITION BY volume ORDER BY doc_id) AS INTEGER) AS page, coalesce(text, '') AS text,
    CASE WHEN length(trim(coalesce(text, ''))) >= 32 THEN 'text_layer' ELSE 'empty' END AS basis
  FROM (SELECT *, concat_ws('-', source, CAST(doc_id // 1000 AS VARCHAR)) AS volume FROM documents))"""
_LINES = _PAGES + """, doc_lines AS (
  SELECT doc_id, page, CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS text FROM (SELECT doc_id, page, string_split(text, chr(10)) AS l FROM doc_pages))"""
_CONV = """conv AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page, coalesce(text, '') AS text FROM conversations)"""


def _ranges(rows: str, keys: str = "doc_id", page: str = "page", name: str = "pages") -> str:
    """Pages of a relation as ranges: gaps and islands."""
    return f"""SELECT {keys}, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS {name}
  FROM (SELECT {keys}, min(p) AS lo, max(p) AS hi FROM (
    SELECT {keys}, p, p - row_number() OVER (PARTITION BY {keys} ORDER BY p) AS island FROM (SELECT DISTINCT {keys}, {page} AS p FROM {rows})) GROUP BY {keys}, island) GROUP BY {keys}"""


T03_FIND_LITERAL = f"""
WITH {_PAGES}, hit AS (
  SELECT doc_id, page, basis, CASE WHEN basis = 'empty' THEN 0 ELSE len(string_split(lower(text), 'tion')) - 1 END AS n FROM doc_pages),
r AS ({_ranges("(SELECT * FROM hit WHERE n > 0)")})
SELECT h.doc_id, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (basis <> 'empty') AS pages_searched,
  count(*) FILTER (basis = 'empty') AS pages_skipped_no_text, coalesce(any_value(r.pages), '') AS pages
FROM hit h LEFT JOIN r ON h.doc_id = r.doc_id GROUP BY h.doc_id
"""

A16_HITS_BY_DOC = """
SELECT doc_id, CAST(len(string_split(lower(text), 'ent')) - 1 AS BIGINT) AS hits, CAST(strpos(lower(text), 'ent') - 1 AS BIGINT) AS first_at
FROM documents WHERE contains(lower(coalesce(text, '')), 'ent')
"""

F07_SNIPPETS = f"""
WITH {_PAGES}, piece AS (
  SELECT doc_id, page, text, unnest(p) AS gap, generate_subscripts(p, 1) AS i, len(p) AS n
  FROM (SELECT doc_id, page, text, string_split(lower(text), 'license') AS p FROM doc_pages WHERE basis <> 'empty') WHERE len(p) > 1),
places AS (SELECT doc_id, page, text, i, n, sum(length(gap) + 7) OVER (PARTITION BY doc_id, page ORDER BY i) - 7 AS s FROM piece),
m AS (SELECT doc_id, page, text, CAST(s AS INTEGER) AS s, CAST(s + 7 AS INTEGER) AS e, count(*) OVER (PARTITION BY doc_id) AS total,
    row_number() OVER (PARTITION BY doc_id ORDER BY page, s) AS place FROM places WHERE i < n)
SELECT doc_id, page, CAST(length(text[1:s]) - length(replace(text[1:s], chr(10), '')) + 1 AS INTEGER) AS line, s AS "start", e AS "end",
  CASE WHEN s > 60 THEN '…' ELSE '' END || trim(replace(text[greatest(s - 60, 0) + 1:least(e + 60, length(text))], chr(10), ' ')) ||
  CASE WHEN e + 60 < length(text) THEN '…' ELSE '' END AS snippet, total, total > 3 AS truncated
FROM m WHERE place <= 3
"""

T03_FIND_REGEX_GROUPS = """
SELECT event_type AS doc_id, regexp_extract(props, '"([a-z]+)": ([0-9]+)', 1) AS key, count(*) AS matches,
  CAST(sum(CAST(regexp_extract(props, '"([a-z]+)": ([0-9]+)', 2) AS BIGINT)) AS BIGINT) AS total,
  CAST(max(length(regexp_extract(props, '^.*"[a-z]+": [0-9]+'))) AS INTEGER) AS last_end
FROM events WHERE regexp_matches(props, '"[a-z]+": [0-9]+') GROUP BY 1, 2
"""

X01_FIND_PASSAGES = "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"

P01_PAGE_SELECTION = f"WITH {_CONV} SELECT doc_id, page, length(text) AS characters FROM conv WHERE page IN (1, 2, 4)"

P02_ORDERED_SELECTION = f"""
WITH {_CONV}, c AS (SELECT doc_id, max(page) AS n FROM conv GROUP BY doc_id HAVING max(page) >= 3),
s AS (SELECT doc_id, list_concat([3, 1, 1, 2], range(3, n + 1)) AS l FROM c)
SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS position, CAST(unnest(l) AS INTEGER) AS page FROM s
"""

A09_PAGE_RANGES = f"WITH {_CONV}, asked AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page FROM conversations WHERE role = 'user') " + _ranges("asked")

U02_ASSEMBLE = f"""
WITH {_CONV}, w(position, doc_id, page, rotation) AS (VALUES (1, '1', 2, 0), (2, '1', 1, 90), (3, '0', 1, 0), (4, '0', 2, 0))
SELECT position, doc_id, page, rotation, length(text) AS characters FROM w JOIN conv USING (doc_id, page)
"""

U03_REMOVE_PAGES = f"WITH {_CONV} SELECT doc_id, page, 'native' AS basis FROM conv WHERE page NOT IN (2, 3)"

J12_UPSERT = f"WITH {_PAGES} SELECT doc_id, page, CASE WHEN length(text) < 400 THEN length('ocr of ' || length(text)) ELSE length(text) END AS characters FROM doc_pages"

A03_TOKEN_BUDGET = f"WITH {_PAGES} SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM doc_pages GROUP BY doc_id"

M05_PAGES_THAT_FIT = f"""
WITH {_PAGES}, s AS (SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM doc_pages GROUP BY doc_id)
SELECT doc_id, CASE WHEN chars <= 0 THEN pages ELSE least(greatest(32000 // greatest(1, chars // pages), 1), pages) END AS fit,
  CASE WHEN chars <= 0 THEN pages ELSE least(greatest(8000 // greatest(1, chars // pages), 1), pages) END AS fit_constrained FROM s
"""

M02_RENDER = """
WITH s AS (SELECT p_partkey, CAST(p_size * 20 + 100 AS DOUBLE) AS w, CAST(p_size * 30 + 100 AS DOUBLE) AS h, p_size % 9 + 1 AS pages FROM part),
b AS (SELECT *, CAST(floor(w / 72 * 150.0::DOUBLE * (h / 72 * 150.0::DOUBLE) * 4) AS BIGINT) AS bytes FROM s)
SELECT p_partkey, bytes, CAST(least(greatest(floor(sqrt(268435456::DOUBLE / pages / (w / 72 * h / 72 * 4))), 36), 600) AS BIGINT) AS dpi,
  greatest(1, 268435456 // bytes) AS fit FROM b
"""

L05_EVEN_SAMPLE = f"""
WITH {_PAGES}, c AS (SELECT doc_id, max(page) AS n FROM doc_pages GROUP BY doc_id)
SELECT DISTINCT doc_id, CAST(CASE WHEN n <= 20 THEN i + 1 ELSE 1 + round_even(i * ((n - 1) / 19.0::DOUBLE), 0) END AS INTEGER) AS page
FROM c, range(0, 20) AS r(i) WHERE i < n
"""

_STRIDE = """stride AS (
  SELECT doc_id, length(text) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_pages),
estimate AS (
  SELECT doc_id, max(n) AS n_pages, count(*) AS sampled, CAST(floor(CAST(sum(chars) AS DOUBLE) / count(*) * max(n) / 4) AS BIGINT) AS estimate
  FROM stride WHERE i % greatest(n // 8, 1) = 0 AND i < greatest(n // 8, 1) * 8 GROUP BY doc_id)"""

L06_STRIDE = f"WITH {_PAGES}, {_STRIDE} SELECT * FROM estimate"

B01_ADMISSION = f"""
WITH {_PAGES}, {_STRIDE},
upto AS (SELECT doc_id, page, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM doc_pages),
fit AS (SELECT doc_id, min(page) AS lo, max(page) FILTER (upto // 4 <= 8000) AS hi FROM upto GROUP BY doc_id)
SELECT doc_id, n_pages, estimate, estimate <= 8000 AS admitted, CASE WHEN estimate <= 8000 THEN '' ELSE lo || '-' || coalesce(hi, lo) END AS suggested_pages
FROM estimate JOIN fit USING (doc_id)
"""

W06_PAGINATE = """
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS s FROM documents),
f AS (
  SELECT doc_id, s, list_reduce(list_transform(s, lambda x: {'pages': []::BIGINT[], 'page': 1::BIGINT, 'used': 0::BIGINT, 'n': x::BIGINT}),
    lambda a, x: CASE WHEN a.used > 0 AND a.used + x.n > 2800
      THEN {'pages': list_append(a.pages, a.page + 1), 'page': a.page + 1, 'used': x.n, 'n': 0::BIGINT}
      ELSE {'pages': list_append(a.pages, a.page), 'page': a.page, 'used': a.used + x.n, 'n': 0::BIGINT} END,
    {'pages': []::BIGINT[], 'page': 1::BIGINT, 'used': 0::BIGINT, 'n': 0::BIGINT}) AS r FROM l)
SELECT doc_id, CAST(p AS INTEGER) AS page, count(*) AS lines, CAST(sum(n) AS BIGINT) AS characters
FROM (SELECT doc_id, unnest(r.pages) AS p, unnest(s) AS n FROM f) GROUP BY 1, 2
"""

A02_PROBE_KINDS = f"""
WITH {_PAGES} SELECT doc_id, CASE WHEN basis <> 'empty' THEN 'born_digital' WHEN page % 2 = 0 THEN 'scanned' ELSE 'empty' END AS kind, count(*) AS pages
FROM doc_pages GROUP BY 1, 2
"""

A04_MODE = f"""
WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, l_orderkey * 8 + l_linenumber AS page, l_quantity % 5 + 595 AS width, l_quantity % 3 + 842 AS height
  FROM lineitem WHERE l_linenumber <= 7),
s AS (SELECT doc_id, width, height, count(*) AS n_pages, min(page) AS seen FROM p GROUP BY ALL),
m AS (SELECT doc_id, width, height, n_pages FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_pages DESC, seen) = 1),
o AS ({_ranges("(SELECT p.doc_id, p.page FROM p JOIN m USING (doc_id) WHERE p.width <> m.width OR p.height <> m.height)", name="other_pages")})
SELECT doc_id, width, height, n_pages, coalesce(other_pages, '') AS other_pages FROM m LEFT JOIN o USING (doc_id)
"""

T01_PROBE = f"""
WITH {_PAGES}, k AS (SELECT *, CASE WHEN basis <> 'empty' THEN 'born_digital' WHEN page % 2 = 0 THEN 'scanned' ELSE 'empty' END AS kind FROM doc_pages),
s AS (SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (kind = 'born_digital') AS born_digital,
  count(*) FILTER (kind = 'scanned') AS scanned, count(*) FILTER (kind = 'empty') AS empty, CASE WHEN count(DISTINCT basis) = 1 THEN max(basis) ELSE 'text_layer' END AS agreed
  FROM k GROUP BY doc_id),
a AS ({_ranges("(SELECT * FROM k WHERE kind <> 'born_digital')", name="scanned_pages")}),
b AS ({_ranges("(SELECT * FROM k WHERE kind = 'born_digital')", name="digital_pages")})
SELECT doc_id, pages, characters, born_digital, scanned, empty,
  CASE WHEN born_digital = pages THEN 'full' WHEN born_digital = 0 THEN 'none' ELSE 'partial' END AS extractable,
  CASE WHEN born_digital + scanned = 0 THEN 'empty' ELSE agreed END AS basis, characters // 4 AS token_estimate_full,
  CASE WHEN characters <= 0 THEN pages ELSE least(greatest(32000 // greatest(1, characters // pages), 1), pages) END AS pages_that_fit_one_response,
  coalesce(scanned_pages, '') AS scanned_pages, coalesce(digital_pages, '') AS digital_pages
FROM s LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""

_HEADS = """edge AS (
  SELECT doc_id, page, line, text, line IN (min(line) OVER w, max(line) OVER w) AS is_edge, regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '[0-9]+', '#', 'g') AS shape
  FROM all_lines WINDOW w AS (PARTITION BY doc_id, page)),
total AS (SELECT doc_id, count(DISTINCT page) AS total_pages FROM doc_pages GROUP BY doc_id),
head AS (
  SELECT doc_id, shape, count(DISTINCT page) AS n_pages, any_value(total_pages) AS total_pages,
    any_value(total_pages) >= 4 AND count(DISTINCT page) >= 0.6 * any_value(total_pages) AS is_head
  FROM edge JOIN total USING (doc_id) WHERE is_edge AND shape <> '' GROUP BY doc_id, shape)"""

A01_RUNNING_HEADS = f"WITH {_LINES}, all_lines AS (SELECT * FROM doc_lines), {_HEADS} SELECT * FROM head"

W04_STRIP_HEADS = f"""
WITH {_LINES}, all_lines AS (
  SELECT * FROM doc_lines UNION ALL SELECT doc_id, page, -1, 'Report of ' || doc_id FROM doc_pages
  UNION ALL SELECT doc_id, page, 1000000, ' page ' || page FROM doc_pages), {_HEADS}
SELECT doc_id, page, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS characters FROM edge e
WHERE NOT (is_edge AND EXISTS (SELECT 1 FROM head h WHERE h.doc_id = e.doc_id AND h.shape = e.shape AND is_head)) GROUP BY doc_id, page
"""

W05_COLLAPSE = r"""
WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '.  ' || chr(9)), chr(10), chr(10) || chr(10) || ' ' || chr(10)) AS t FROM documents),
s AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)) AS t FROM t),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM s)
SELECT doc_id, length(t) AS characters, md5(t) AS digest FROM c
"""

F01_NORMALISE = """
WITH o AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'fi', chr(64257)), 'é', 'e' || chr(769)), 'th ', 'th' || chr(160)) AS o FROM documents),
r AS (SELECT doc_id, o, replace(replace(replace(replace(replace(replace(replace(replace(replace(o, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'),
  chr(64259), 'ffi'), chr(64260), 'ffl'), chr(64261), 'st'), chr(64262), 'st'), chr(173), ''), chr(160), ' ') AS r FROM o)
SELECT doc_id, CAST(length(o) - length(translate(o, chr(64256) || chr(64257) || chr(64258) || chr(64259) || chr(64260) || chr(64261) || chr(64262) || chr(173) || chr(160), '')) AS BIGINT) AS replaced,
  md5(nfc_normalize(r)) AS digest FROM r
"""

F02_SHAPE = f"""
WITH {_LINES} SELECT regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '[0-9]+', '#', 'g') AS shape, count(*) AS n FROM doc_lines WHERE regexp_matches(text, '[0-9]') GROUP BY 1
"""

_BOXES = """box AS (
  SELECT 'two_column' AS doc_id, 1 AS page, CAST(id AS INTEGER) AS ord, (id // 96) AS side, (id % 96) // 4 AS r, id % 4 AS k,
    CASE WHEN id // 96 = 0 THEN 330.0 ELSE 60.0 END::DOUBLE + id % 4 * 55.0::DOUBLE AS x0, 110.0::DOUBLE + ((id % 96) // 4) * 18.0::DOUBLE AS y0
  FROM range(0, 192) AS t(id)),
word AS (SELECT *, x0 + 50.0::DOUBLE AS x1, y0 + 10.0::DOUBLE AS y1, CASE WHEN side = 0 THEN 'R' ELSE 'L' END || r || 'w' || k AS text FROM box),
rw AS (
  SELECT *, CAST(sum(CASE WHEN step > 2.0 THEN 1 ELSE 0 END) OVER (ORDER BY y0, x0, ord) + 1 AS BIGINT) AS row
  FROM (SELECT *, abs(y0 - lag(y0) OVER (ORDER BY y0, x0, ord)) AS step FROM word)),
seg AS (
  SELECT doc_id, page, row, segment, min(x0) AS x0, max(x1) AS x1 FROM (
    SELECT *, CAST(sum(CASE WHEN x0 - reach >= greatest(2, CAST(floor((540.0 + 5.0 - 60.0) * 0.013) AS INTEGER)) THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY x0, ord) + 1 AS BIGINT) AS segment
    FROM (SELECT *, max(x1) OVER (PARTITION BY row ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rw)) GROUP BY ALL)"""

W09_ROWS = f"WITH {_BOXES} SELECT doc_id, page, row, count(*) AS words, min(y0) AS y0 FROM rw GROUP BY doc_id, page, row"
W10_SEGMENTS = f"WITH {_BOXES} SELECT * FROM seg"
G01_GUTTERS = f"""
WITH {_BOXES}, x AS (SELECT x, (SELECT count(*) FROM seg WHERE x BETWEEN floor(x0) AND floor(x1)) AS n FROM range(60, 546) AS t(x)),
free AS (SELECT x, n <= 24 * 0.12 AS free, sum(CASE WHEN n <= 24 * 0.12 THEN 0 ELSE 1 END) OVER (ORDER BY x) AS run FROM x),
runs AS (SELECT min(x) AS lo, max(x) AS hi FROM free WHERE free GROUP BY run HAVING max(x) < 545 AND count(*) >= 6)
SELECT 'two_column' AS doc_id, 1 AS page, CAST(lo AS INTEGER) AS low, CAST(hi AS INTEGER) AS high, (lo + hi + 1) / 2.0::DOUBLE AS middle FROM runs
WHERE (SELECT count(DISTINCT row) FROM seg WHERE x1 <= lo + 1) >= 6 AND (SELECT count(DISTINCT row) FROM seg WHERE x0 >= hi) >= 6
"""
L02_READING_ORDER = f"""
WITH {_BOXES}, c AS (SELECT *, CASE WHEN (x0 + x1) / 2 >= 302 THEN 2 ELSE 1 END AS col FROM word)
SELECT doc_id, page, CAST(row_number() OVER (ORDER BY col, y0, x0) AS INTEGER) AS position, col AS "column", text FROM c
"""
G05_LINES = f"""
WITH {_BOXES} SELECT 'two_column' AS doc_id, 1 AS page, CAST(row_number() OVER (ORDER BY side DESC, r) AS BIGINT) AS line, string_agg(text, ' ' ORDER BY k) AS text FROM word GROUP BY side, r
"""
_CELLS = """, cell AS (
  SELECT CAST(id // 2 AS INTEGER) AS row, CAST(id % 2 AS INTEGER) AS col, 55.0 + (id % 2) * 110.0 AS cx0, 108.0 + (id // 2) * 36.0 AS cy0 FROM range(0, 12) AS t(id)),
held AS (SELECT cell.row, cell.col, w.text, w.y0, w.x0 FROM word w JOIN cell ON (w.x0 + w.x1) / 2 BETWEEN cx0 AND cx0 + 110 AND (w.y0 + w.y1) / 2 BETWEEN cy0 AND cy0 + 36)"""
J04_WORD_IN_CELL = f"WITH {_BOXES}{_CELLS} SELECT row, col, text FROM held"
W12_CELL_ORDER = f"""
WITH {_BOXES}{_CELLS}, t AS (SELECT row, col, string_agg(text, ' ' ORDER BY y0, x0) AS text FROM held GROUP BY row, col)
SELECT row, string_agg(coalesce(text, ''), ' | ' ORDER BY col) AS cells FROM cell LEFT JOIN t USING (row, col) GROUP BY row
"""

_TABLES = """t AS (
  SELECT CAST(o_custkey % 50 AS VARCHAR) AS doc_id, o_orderkey AS table_no, CASE o_orderstatus WHEN 'F' THEN 'ruled' WHEN 'O' THEN 'whitespace' ELSE 'native' END AS basis,
    CASE o_orderstatus WHEN 'F' THEN 0.95::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM orders)"""
T05_MIN_CONFIDENCE = f"WITH {_TABLES} SELECT * FROM t WHERE confidence >= 0.9"
A07_BY_BASIS = f"WITH {_TABLES} SELECT doc_id, basis, count(*) AS tables FROM t GROUP BY ALL"
A06_WEAKEST = f"""
WITH {_TABLES} SELECT doc_id, arg_max(basis, CASE basis WHEN 'native' THEN 0 WHEN 'ruled' THEN 3 ELSE 6 END) AS weakest,
  CASE WHEN count(DISTINCT basis) = 1 THEN max(basis) ELSE 'text_layer' END AS agreed FROM t GROUP BY doc_id
"""
F10_PIPE_TABLE = r"""
WITH r AS (
  SELECT conv_id, turn, list_transform(CASE WHEN turn % 2 = 0 THEN [role, coalesce(text, '')] ELSE [role] END,
    lambda c: trim(regexp_replace(replace(c, '|', '\|'), '[\r\n]+', ' ', 'g'))) AS c FROM conversations),
w AS (SELECT conv_id, max(len(c)) AS n FROM r GROUP BY conv_id),
l AS (SELECT conv_id, turn, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, '| ' || array_to_string(list_resize(c, n, ''), ' | ') || ' |' AS line FROM r JOIN w USING (conv_id))
SELECT conv_id, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| ' || array_to_string(list_resize(['---'], n, '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY i) AS md
FROM l GROUP BY conv_id
"""
A08_UPPER_MEDIAN = "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey"

_FACTS = """f AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_partkey AS VARCHAR) AS context_ref, CASE WHEN l_linestatus = 'F' THEN l_suppkey END AS unit_ref, CAST(l_quantity AS BIGINT) AS value FROM lineitem),
c AS (SELECT CAST(p_partkey AS VARCHAR) AS context_ref, CASE WHEN p_size % 2 = 0 THEN 'at ' || strftime(DATE '2020-01-01' + p_size, '%Y-%m-%d')
    ELSE '2020-01-01 to ' || strftime(DATE '2020-01-01' + p_size, '%Y-%m-%d') END AS period FROM part WHERE p_size > 10),
star AS (SELECT f.*, coalesce(period, context_ref) AS context, coalesce(s_name, '') AS unit FROM f LEFT JOIN c USING (context_ref) LEFT JOIN supplier ON unit_ref = s_suppkey)"""
J01_FACTS = f"WITH {_FACTS} SELECT context, count(*) AS facts FROM star GROUP BY context"
J02_FACTS = f"WITH {_FACTS} SELECT unit, count(*) AS facts, CAST(sum(value) AS BIGINT) AS total FROM star GROUP BY unit"
A14_FACTS = f"""
WITH {_FACTS} SELECT doc_id, count(*) AS facts, count(*) FILTER (unit <> '') AS numeric_facts, coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit) FILTER (unit <> ''), '') AS units FROM star GROUP BY doc_id
"""

T13_REDACT = f"""
WITH {_LINES} SELECT doc_id, count(*) FILTER (regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9.]+')) AS redacted,
  count(DISTINCT page) FILTER (regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9.]+')) AS pages FROM doc_lines GROUP BY doc_id
"""
T13_RESIDUAL = f"""
WITH {_LINES}, k AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM doc_lines WHERE NOT regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9.]+') GROUP BY ALL)
SELECT count(*) AS pages, CAST(sum(len(regexp_extract_all(text, '(?i)[a-z0-9.]+@[a-z0-9.]+'))) AS BIGINT) AS residual_matches FROM k
"""

F12_ESCAPE = """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS digest FROM pages
"""
T04_EXTRACT = f"WITH {_LINES}, all_lines AS (SELECT * FROM doc_lines), {_HEADS}" + r""",
kept AS (
  SELECT doc_id, page, line, text FROM edge e
  WHERE NOT (is_edge AND EXISTS (SELECT 1 FROM head h WHERE h.doc_id = e.doc_id AND h.shape = e.shape AND is_head))),
l AS (
  SELECT doc_id, text AS x, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS i
  FROM (SELECT * FROM kept UNION ALL SELECT doc_id, page, 2147483647, '' FROM doc_pages)),
said AS (
  SELECT doc_id, i, x, row_number() OVER d AS k, i - lag(i) OVER d AS gap,
    coalesce(i - lag(i) OVER d <= 2 AND regexp_matches(lag(x) OVER d, '[\p{L}\p{N}_]-\s*$') AND regexp_matches(x, '^\p{Ll}'), false) AS fits
  FROM l WHERE regexp_matches(x, '\S') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
marked AS (SELECT *, (k - max(CASE WHEN NOT fits THEN k END) OVER (PARTITION BY doc_id ORDER BY k)) % 2 = 1 AS taken FROM said),
joined AS (
  SELECT doc_id, i, taken, gap, CASE WHEN lead(taken) OVER d THEN regexp_replace(rtrim(x), '-$', '') || ltrim(lead(x) OVER d) ELSE x END AS x
  FROM marked WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
gone AS (SELECT doc_id, i FROM joined WHERE taken UNION SELECT doc_id, i - 1 FROM joined WHERE taken AND gap = 2),
lines AS (
  SELECT l.doc_id, l.i, trim(regexp_replace(coalesce(j.x, l.x), '[ \t]+', ' ', 'g')) AS x
  FROM l LEFT JOIN joined j ON l.doc_id = j.doc_id AND l.i = j.i
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = l.i)),
raw AS (SELECT doc_id, regexp_replace(regexp_replace(string_agg(x, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS r FROM lines GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_pages FROM doc_pages GROUP BY doc_id)
SELECT r.doc_id, nfc_normalize(replace(replace(replace(replace(replace(replace(replace(replace(replace(r, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'),
  chr(64259), 'ffi'), chr(64260), 'ffl'), chr(64261), 'st'), chr(64262), 'st'), chr(173), ''), chr(160), ' ')) AS text,
  n_pages >= 4 AS running_heads_checked,
  (SELECT count(*) FROM doc_lines d WHERE d.doc_id = r.doc_id) - (SELECT count(*) FROM kept k WHERE k.doc_id = r.doc_id) AS running_heads_removed,
  (SELECT count(*) FROM joined j WHERE taken AND j.doc_id = r.doc_id) AS hyphens_joined,
  CAST(length(r) - length(translate(r, chr(64256) || chr(64257) || chr(64258) || chr(64259) || chr(64260) || chr(64261) || chr(64262) || chr(173) || chr(160), '')) AS BIGINT) AS unicode_fixed
FROM raw r JOIN counts c ON r.doc_id = c.doc_id
"""

W03_HYPHEN_JOIN = r"""
WITH l AS (
  SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([a-z]{4})(tion[ .,])', '\1-' || chr(10) || '\2', 'g'), chr(10)) AS x FROM documents)),
said AS (
  SELECT doc_id, i, row_number() OVER d AS k, i - lag(i) OVER d AS gap,
    coalesce(i - lag(i) OVER d <= 2 AND regexp_matches(lag(x) OVER d, '[\p{L}\p{N}_]-\s*$') AND regexp_matches(x, '^\p{Ll}'), false) AS fits
  FROM l WHERE regexp_matches(x, '\S') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
taken AS (
  SELECT doc_id, gap FROM (SELECT *, k - max(CASE WHEN NOT fits THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS place FROM said)
  WHERE place % 2 = 1)
SELECT l.doc_id, CAST(count(*) - coalesce(any_value(t.gone), 0) AS BIGINT) AS lines, CAST(coalesce(any_value(t.n), 0) AS BIGINT) AS joined
FROM l LEFT JOIN (SELECT doc_id, sum(gap) AS gone, count(*) AS n FROM taken GROUP BY doc_id) t ON l.doc_id = t.doc_id GROUP BY l.doc_id
"""

F17_SAFE_NAME = "SELECT page_id, left(regexp_replace(regexp_replace(replace(url, '/', ' ') || ' é.html', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 120) AS name FROM pages"
F04_COLLAPSE = r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS digest FROM documents"
S19_LINKS = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://raw.githubusercontent.com/o/r/main/' || page_id WHEN 1 THEN 'https://www.dropbox.com/s/' || page_id || '/f.pdf?rlkey=k' || page_id || '&dl=1' ELSE url END AS direct FROM pages
"""
S20_DATA_URI = "SELECT page_id, 'text/html' AS media_type, 'p.html' AS name, sha256(html) AS sha256 FROM pages"

S06_HTML_META = r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href=')) AS links FROM pages
"""
T02_OUTLINE_HTML = r"""
SELECT page_id, CAST(1 AS INTEGER) AS level, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title, 'native' AS basis
FROM pages WHERE contains(html, '<h1>')
"""
S07_PARAGRAPHS = r"""
WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), 'the' || chr(10), 'the' || chr(10) || chr(10)), '.' || chr(10), '.' || chr(10) || ' ' || chr(10)) AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split_regex(t, '\n\s*\n')) AS p FROM t)
SELECT doc_id || '.txt' AS doc_id, CAST(sum(length(replace(p, chr(10), ''))) AS BIGINT) AS characters FROM p WHERE trim(p, chr(10) || ' ') <> '' GROUP BY 1
"""
S09_CSV = """
SELECT c_mktsegment AS segment, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, min(c_name || ', Ltd') AS first_name FROM customer GROUP BY 1
"""
