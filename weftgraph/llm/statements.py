"""DuckDB statements for the registered text operators that SQL can say."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

VECTOR_SEARCH = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank
  FROM s)
WHERE rank <= 20
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    parts = " || ".join(
        f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields)
    return f"sha256({parts})"


def _climb(name: str, leaves: str) -> str:
    """Nodes of all levels over ``leaves`` (grp, pos, n, h)."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, n, pos // 3),
{name}_runs AS (
  SELECT grp, lvl, pos // 3 AS p, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1
  GROUP BY grp, lvl, pos // 3)"""


def _fold(name: str, start: str, nodes: str) -> str:
    """Rows of ``start`` (r, grp, pos, h, proof) folded with the siblings of all levels."""
    left = "array_to_string(hs[:pos % 3], '')"
    right = "array_to_string(hs[pos % 3 + 2:], '')"
    return f"""{name} AS (
  SELECT r, grp, 0 AS lvl, pos, h, proof FROM {start}
  UNION ALL
  SELECT f.r, f.grp, f.lvl + 1, pos // 3, sha256({left} || h || {right}),
    proof || {left} || {right}
  FROM {name} f JOIN {nodes}_runs u ON u.grp = f.grp AND u.lvl = f.lvl AND u.p = f.pos // 3),
{name}_end AS (SELECT r, grp, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof
  FROM {name} GROUP BY r, grp)"""


MERKLE = f"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM bits WHERE k < 8),
crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c FROM documents
  WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s[2:], xor(crc.c >> 8, bits.c) FROM crc
  JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c & 255, ord(s[1])) WHERE s <> ''),
even AS (SELECT doc_id AS id FROM crc WHERE s = '' AND xor(c, 4294967295) % 2 = 0),
hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS grp,
    {_leaf("text")} AS h,
    {_leaf("CASE WHEN id IS NULL THEN text ELSE replace(text, chr(10), '') END")} AS tampered
  FROM documents LEFT JOIN even ON id = doc_id),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n FROM hashed),
{_climb("nodes", "leaves")},
names AS (
  SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos,
    count(*) OVER () AS n FROM nodes WHERE n = 1),
{_climb("tops", "names")},
start AS (SELECT r, grp, pos, tampered AS h, '' AS proof FROM leaves),
{_fold("own", "start", "nodes")},
onward AS (
  SELECT o.r, '' AS grp, names.pos, o.h, o.proof FROM own_end o JOIN names ON names.name = o.grp),
{_fold("over", "onward", "tops")},
root AS (SELECT h FROM tops WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, names.h AS subroot, root.h AS root, sha256(e.proof) AS proof_sha256,
  e.h AS folded_root, e.h = root.h AS verified
FROM leaves l JOIN over_end e ON e.r = l.r JOIN names ON names.name = l.grp, root
"""

LEXICAL = f"""
WITH t AS (
  SELECT r, doc_id, unnest({TERMS}) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
size AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * n * docs) // l AS m FROM size, total),
score AS (
  SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT
    AS rank
  FROM score JOIN m USING (r) WHERE score > 0)
WHERE rank <= 50
"""
