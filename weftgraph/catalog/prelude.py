"""SQL text of the star-schema graph, used as the CTE prelude of the oracles."""

from __future__ import annotations

import re

_FULL_TAGS = "SELECT 'full' AS snapshot_id, * FROM orders"
_PAIR_TAGS = """SELECT 'base' AS snapshot_id, * FROM orders
    WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'cur', * FROM orders
    WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')"""


def prelude(pair: bool = False) -> str:
    scopes = "VALUES ('base'), ('cur')" if pair else "VALUES ('full')"
    return f"""
scopes(snapshot_id) AS ({scopes}),
dirs AS (SELECT n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey AS dir FROM nation),
files0 AS (
  SELECT 'file:c' || c_custkey AS id, 'c' || c_custkey || '.py' AS name,
         dir || '/c' || c_custkey || '.py' AS file_path, 'folder:n' || c_nationkey AS parent_id,
         'python' AS language
  FROM customer JOIN dirs ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'file:s' || s_suppkey, 's' || s_suppkey || '.ts', dir || '/s' || s_suppkey || '.ts',
         'folder:n' || s_nationkey, 'typescript'
  FROM supplier JOIN dirs ON s_nationkey = n_nationkey),
tagged AS ({_PAIR_TAGS if pair else _FULL_TAGS}),
tlines AS (SELECT t.snapshot_id, l.*, o_custkey, o_orderstatus
           FROM lineitem l JOIN tagged t ON l_orderkey = o_orderkey),
nodes AS (
  SELECT snapshot_id, 'folder:.' AS id, 'folder' AS kind, '.' AS name,
         CAST(NULL AS VARCHAR) AS qualified_name, CAST(NULL AS VARCHAR) AS file_path,
         CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS language,
         CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS BIGINT) AS start_line,
         CAST(NULL AS BIGINT) AS end_line, CAST(NULL AS BOOLEAN) AS exported FROM scopes
  UNION ALL SELECT snapshot_id, 'folder:r' || r_regionkey, 'folder', 'r' || r_regionkey, NULL,
         'r' || r_regionkey, 'folder:.', NULL, NULL, NULL, NULL, NULL FROM region, scopes
  UNION ALL SELECT snapshot_id, 'folder:n' || d.n_nationkey, 'folder', 'n' || d.n_nationkey,
         NULL, dir, 'folder:r' || n_regionkey, NULL, NULL, NULL, NULL, NULL
         FROM dirs d JOIN nation n ON d.n_nationkey = n.n_nationkey, scopes
  UNION ALL SELECT snapshot_id, id, 'file', name, NULL, file_path, parent_id, language, NULL,
         NULL, NULL, NULL FROM files0, scopes
  UNION ALL SELECT snapshot_id, 'function:o' || o_orderkey, 'function', o_orderpriority,
         'o' || o_orderkey, file_path, 'file:c' || o_custkey, 'python',
         '(' || o_orderstatus || ')', day(o_orderdate), day(o_orderdate) + 10,
         o_orderstatus = 'F' FROM tagged JOIN files0 ON id = 'file:c' || o_custkey
  UNION ALL SELECT snapshot_id, 'function:s' || l_suppkey || 'p' || l_partkey, 'function',
         p_name, 's' || l_suppkey || 'p' || l_partkey, file_path, 'file:s' || l_suppkey,
         'typescript', '(' || p_brand || ')', p_size, p_size + 10, p_size > 25
         FROM (SELECT DISTINCT snapshot_id, l_suppkey, l_partkey FROM tlines)
         JOIN part ON l_partkey = p_partkey JOIN files0 ON id = 'file:s' || l_suppkey
  UNION ALL SELECT snapshot_id, 'external:p' || p_partkey, 'external', 'pkg:' || p_partkey,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part, scopes),
lines0 AS (SELECT *, concat_ws('|', CAST(round(l_quantity * 100) AS BIGINT),
         CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
         CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus,
         strftime(l_shipdate, '%Y%m%d')) AS detail FROM tlines),
calls AS (
  SELECT snapshot_id, concat_ws(':', 'call', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           substring(md5(detail), 1, 10), row_number() OVER (
             PARTITION BY snapshot_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, detail)
           ) AS id,
         'calls' AS type, 'function:o' || l_orderkey AS source_id,
         CASE l_returnflag WHEN 'N' THEN 'function:s' || l_suppkey || 'p' || l_partkey
              WHEN 'R' THEN 'external:p' || l_partkey END AS target_id,
         CASE l_returnflag WHEN 'N' THEN 'resolved' WHEN 'R' THEN 'external'
              ELSE 'unresolved' END AS resolution,
         file_path AS evidence_path, CAST(l_linenumber AS BIGINT) AS evidence_line,
         l_linestatus AS evidence_text
  FROM lines0 JOIN files0 ON files0.id = 'file:c' || o_custkey),
imports AS (
  SELECT snapshot_id, 'import:' || source_id || '>' || target_id AS id, 'imports' AS type,
         source_id, target_id, 'resolved' AS resolution, file_path AS evidence_path,
         CAST(1 AS BIGINT) AS evidence_line, 'import' AS evidence_text
  FROM (SELECT DISTINCT snapshot_id,
          CASE o_orderstatus WHEN 'F' THEN 'file:c' || o_custkey ELSE 'file:s' || l_suppkey END
            AS source_id,
          CASE o_orderstatus WHEN 'F' THEN 'file:s' || l_suppkey ELSE 'file:c' || o_custkey END
            AS target_id
        FROM tlines WHERE o_orderstatus IN ('F', 'O')) i
  JOIN files0 ON files0.id = i.source_id),
contain AS (
  SELECT snapshot_id, 'contains:' || id AS id, 'contains' AS type, parent_id AS source_id,
         id AS target_id, 'resolved' AS resolution, coalesce(file_path, name) AS evidence_path,
         coalesce(start_line, 1) AS evidence_line, 'contains' AS evidence_text
  FROM nodes WHERE parent_id IS NOT NULL),
relations AS (SELECT * FROM calls UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM contain)
"""


def with_graph(body: str, pair: bool = False, once: bool = False) -> str:
    """``body`` is either a SELECT or further CTEs (``name AS (...), ... SELECT``).

    ``once`` materialises the tables of the graph, for statements that read them many times.
    """
    text = body.strip()
    sep = "\n" if text[:6].upper() == "SELECT" else ",\n"
    graph = prelude(pair)
    if once:
        graph = re.sub(r"(?m)^(files0|nodes|calls|imports|contain) AS \(", r"\1 AS MATERIALIZED (",
                       graph)
    return "WITH " + graph + sep + text
