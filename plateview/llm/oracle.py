"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _near(percent: int, more: str = "") -> str:
    """Components of documents by the similarity of their 5-word shingles."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON least.a = d.doc_id
"""


OP4 = _near(75, ", d.doc_id = component_id AS kept")
OP12 = _near(80)

_TERM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

OP6 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_TERM}) AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), {_TERM}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows w ON w.s = p.s AND w.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""

OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_bytes, payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN last USING (payload_bytes, payload_digest)
"""

OP8 = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
lines AS (SELECT doc_id, line, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos FROM raw WHERE regexp_matches(line, '\\S')),
ahead AS (SELECT doc_id, pos, line AS x, lead(line) OVER w AS y, lead(line, 2) OVER w AS z, lead(pos, 2) OVER w IS NOT NULL AS three,
    lead(pos) OVER w IS NOT NULL AS two, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT *, lead(words) OVER (PARTITION BY doc_id ORDER BY pos) AS next_words FROM ahead),
runs AS (
  SELECT doc_id, pos, 1 AS n, [x] AS run FROM counted WHERE words >= 50
  UNION ALL SELECT doc_id, pos, 2, [x, y] FROM counted WHERE two AND words + next_words >= 50
  UNION ALL SELECT doc_id, pos, 3, [x, y, z] FROM counted WHERE three),
placed AS (SELECT doc_id, pos, n, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM runs WINDOW w AS (PARTITION BY n, run ORDER BY doc_id, pos)),
later AS (SELECT doc_id, pos, n FROM placed WHERE first_doc <> doc_id OR pos >= first_pos + n),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM later),
gone AS (SELECT l.doc_id, l.line_no FROM lines l JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos),
kept AS (SELECT r.doc_id, string_agg(line, chr(10) ORDER BY r.line_no) AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.line_no = r.line_no WHERE g.doc_id IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = d.doc_id
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s),
c AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS p FROM w JOIN f ON f.s = w.s WHERE first_doc < w.doc_id),
n AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 50 ELSE least(50, i - p) END) AS n_removed,
             count(*) FILTER (p IS NULL OR i > p + 50) AS n_spans FROM c GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM c),
bytes AS (SELECT d.doc_id, h, unnest(range(0, len(h) // 2)) AS k FROM d SEMI JOIN n ON n.doc_id = d.doc_id),
kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * b.k + 1, 2), '' ORDER BY b.k) AS h FROM bytes b
         LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.k = b.k WHERE g.k IS NULL GROUP BY b.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n.doc_id IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# crc32 without a table: each byte enters before its first of eight shifts.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
  for c in string_split(CAST(conv_id AS VARCHAR), '')])), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"""

OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, r, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND r <= h
  UNION ALL SELECT t.conv_id, r, role, text FROM t JOIN c ON c.conv_id = t.conv_id WHERE r > h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS d, md5(length(role) || ':' || role || text) AS m,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM rebuilt),
begins AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS words FROM c
  UNION ALL SELECT conv_id, d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), words FROM turns),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM begins GROUP BY d, k),
children AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
sums AS (
  SELECT a.k, count(*) FILTER (x.k IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM nodes a JOIN nodes b ON starts_with(b.k, a.k) LEFT JOIN children x ON x.k = b.k GROUP BY a.k),
lasts AS (SELECT conv_id, max_by(k, d) AS k FROM begins GROUP BY conv_id),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN children x ON x.k = n.k LEFT JOIN ends e ON e.k = n.k
LEFT JOIN nodes p ON n.d > 0 AND p.k = substr(n.k, 1, 32 * (n.d - 1))
"""

CHECKS = {"op4_minhash_dedup": OP4, "op6_decontamination": OP6, "op7_warc_packages": OP7, "op8_line_dedup": OP8,
          "op9_substring_dedup": OP9, "op11_prefix_trie": OP11, "op12_parity_join": OP12}
