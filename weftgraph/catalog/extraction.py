"""Extraction, linking, configuration and scanning over sources derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..extract import configs as C
from ..extract import linking as K
from ..extract import python_facts as E
from ..operators.condense import scc_condense
from ..sources import scan as S
from ..sources.plan_log import _once
from ..sources.star_graph import graph_nodes, star_graph
from ..staging import stage, stage_root, table
from .prelude import with_graph
from .registry import query

# ---- Python sources: one module per order, customer and nation ---------------------------------------
_ORDER_SOURCE = """from pkg.customers.c{c} import run as helper
from ..customers import c{c} as mod
import os

class Order:
    def go(self, cb):
        cb()
        return self.stop(helper(os.getcwd()))
    def stop(self, x):
        return mod.run(len(x))
def main(helper):
    helper()
    return Order().go(main)
Order.stop(None, 1)
unknown()
"""


def _fill(template: str, **cols):
    text = F.lit(template)
    for name, value in cols.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def source_files(spark, sf):
    """(project_id, path, content): orders call their customer's module, which defines ``run``,
    re-exports it from its nation's module, or imports a missing module."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("pkg/orders/o"), F.col("o_orderkey").cast("string"), F.lit(".py"))
        .alias("path"), F.col("o_custkey").alias("c"))
    # Parsing costs far more than the rows that name the files: spread those, not the texts.
    tasks = max(4 * spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Orders of a customer, whose texts are equal, follow one another; a range may end inside them.
    orders = orders.repartitionByRange(tasks, "c", "path").sortWithinPartitions("c", "path").select(
        "path", _fill(_ORDER_SOURCE, c=F.col("c")).alias("text"))
    local = F.lit("def run(x):\n    return x\n")
    forward = _fill("from pkg.base.n{n} import work as run\n", n=F.col("c_nationkey"))
    missing = F.lit("from pkg.base.missing import work as run\n")
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("pkg/customers/c"), F.col("c_custkey").cast("string"), F.lit(".py"))
        .alias("path"),
        F.when(F.col("c_mktsegment") == "FURNITURE", missing)
        .when(F.col("c_acctbal") < 0, local).otherwise(forward).alias("text"))
    nations = table(spark, sf, "nation").select(
        F.concat(F.lit("pkg/base/n"), F.col("n_nationkey").cast("string"), F.lit(".py"))
        .alias("path"), F.lit("def work(x):\n    return x\n").alias("text"))
    packages = table(spark, sf, "region").select(F.explode(F.array(*[
        F.lit(p) for p in ("pkg/__init__.py", "pkg/orders/__init__.py",
                           "pkg/customers/__init__.py", "pkg/base/__init__.py")])).alias("path"),
        F.lit("").alias("text")).distinct()
    rows = orders.unionByName(customers).unionByName(nations).unionByName(packages)
    return rows.select(F.lit("shop").alias("project_id"), "path",
                       F.encode("text", "UTF-8").alias("content"))


def _facts(spark, sf, kind):
    """Facts of one kind; files are parsed once, and what takes joins is written once."""
    raw = _once(spark, sf, "python-raw", lambda: E.raw_rows(source_files(spark, sf)))
    part = E.fact_parts(raw)[kind]
    return _once(spark, sf, f"python-{kind}", lambda: part) if kind in ("call", "binding") else part


_SRC = """
WITH o AS (SELECT 'pkg/orders/o' || o_orderkey || '.py' AS path, o_custkey AS c,
    c_mktsegment = 'FURNITURE' AS missing, c_acctbal < 0 AS local, c_nationkey AS n
  FROM orders JOIN customer ON c_custkey = o_custkey),
cu AS (SELECT 'pkg/customers/c' || c_custkey || '.py' AS path, c_mktsegment = 'FURNITURE'
    AS missing, c_acctbal < 0 AS local, c_nationkey AS n FROM customer),
na AS (SELECT 'pkg/base/n' || n_nationkey || '.py' AS path FROM nation)"""


@query("extract_python_decls", _SRC + """
SELECT path, q AS qualified, k AS kind, dk AS declaration_kind, p AS parent, s AS start_line,
  e AS end_line, g AS signature FROM o, (VALUES
  ('Order', 'class', 'class', '', 5, 10, 'class Order'),
  ('Order.go', 'function', 'method', 'Order', 6, 8, 'def go(self, cb)'),
  ('Order.stop', 'function', 'method', 'Order', 9, 10, 'def stop(self, x)'),
  ('main', 'function', 'function', '', 11, 13, 'def main(helper)')) t(q, k, dk, p, s, e, g)
UNION ALL SELECT path, 'run', 'function', 'function', '', 1, 2, 'def run(x)' FROM cu
  WHERE local AND NOT missing
UNION ALL SELECT path, 'work', 'function', 'function', '', 1, 2, 'def work(x)' FROM na""")
def extract_python_decls(spark, sf):
    return _facts(spark, sf, "decl").select(
        "path", "qualified", "kind", "declaration_kind", "parent",
        F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), "signature")


@query("extract_python_imports", _SRC + """
SELECT path, 'pkg.customers.c' || c AS module, 'run' AS member, false AS relative, 1 AS start_line
  FROM o UNION ALL SELECT path, 'pkg.customers', 'c' || c, true, 2 FROM o
UNION ALL SELECT path, 'os', NULL, false, 3 FROM o
UNION ALL SELECT path, CASE WHEN missing THEN 'pkg.base.missing' ELSE 'pkg.base.n' || n END, 'work',
  false, 1 FROM cu WHERE missing OR NOT local""")
def extract_python_imports(spark, sf):
    return _facts(spark, sf, "import").select(
        "path", "module", "member", "relative",
        F.col("start_line").cast("bigint").alias("start_line"))


_CALLS = """
calls AS (SELECT path, c, missing, local, n, src, line, target FROM o, (VALUES
  ('Order.go', 7, 'none'), ('Order.go', 8, 'Order.stop'), ('Order.go', 8, 'helper'),
  ('Order.go', 8, 'os'), ('Order.stop', 10, 'helper'), ('Order.stop', 10, 'len'),
  ('main', 12, 'none'), ('main', 13, 'none'), ('main', 13, 'Order'), ('', 14, 'Order.stop'),
  ('', 15, 'none')) t(src, line, target))"""


@query("extract_python_calls", _SRC + "," + _CALLS + """
SELECT path, src AS parent, line AS start_line, count(*) AS calls FROM calls GROUP BY 1, 2, 3""")
def extract_python_calls(spark, sf):
    return _facts(spark, sf, "call").groupBy(
        "path", "parent", F.col("start_line").cast("bigint").alias("start_line")).agg(
        F.count(F.lit(1)).alias("calls"))


@query("python_scope_lookup", _SRC + "," + _CALLS + """
SELECT path, src AS parent, line AS start_line, CASE target WHEN 'none' THEN 'none'
  WHEN 'helper' THEN 'import' WHEN 'os' THEN 'import' WHEN 'len' THEN 'external' ELSE 'node' END
  AS kind, CASE WHEN target IN ('Order', 'Order.stop') THEN target END AS qualified,
  CASE WHEN target = 'helper' AND line = 8 THEN 'pkg.customers.c' || c WHEN target = 'helper'
  THEN 'pkg.customers' WHEN target = 'os' THEN 'os' END AS module FROM calls""")
def python_scope_lookup(spark, sf):
    return _facts(spark, sf, "call").select(
        "path", "parent", F.col("start_line").cast("bigint").alias("start_line"), "kind",
        "qualified", "module")


def _modules(spark, sf):
    return K.module_table(source_files(spark, sf))


@query("module_table", _SRC + """
SELECT replace(replace(path, '.py', ''), '/', '.') AS module, path FROM (SELECT path FROM o
  UNION ALL SELECT path FROM cu UNION ALL SELECT path FROM na)
UNION ALL VALUES ('pkg', 'pkg/__init__.py'), ('pkg.orders', 'pkg/orders/__init__.py'),
  ('pkg.customers', 'pkg/customers/__init__.py'), ('pkg.base', 'pkg/base/__init__.py')""")
def module_table(spark, sf):
    return _modules(spark, sf).select("module", "path")


@query("relative_import_resolve", _SRC + """
SELECT path, l AS level, CASE l WHEN 0 THEN 'lib' WHEN 1 THEN 'pkg.orders.lib' WHEN 2 THEN 'pkg.lib'
  WHEN 3 THEN 'lib' ELSE '<invalid-relative>' END AS module FROM o,
  (VALUES (0), (1), (2), (3), (4)) t(l)""")
def relative_import_resolve(spark, sf):
    files = source_files(spark, sf).filter(F.col("path").startswith("pkg/orders/o"))
    rows = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    return rows.select("path", F.col("level").cast("bigint").alias("level"), K.relative_module(
        F.col("path"), F.lit("lib"), F.col("level")).alias("module"))


@query("link_imports", _SRC + """
SELECT path, 'pkg.customers.c' || c AS module, 'run' AS member,
  'pkg/customers/c' || c || '.py' AS target_path, 'resolved' AS resolution FROM o
UNION ALL SELECT path, 'pkg.customers', 'c' || c, 'pkg/customers/__init__.py', 'resolved' FROM o
UNION ALL SELECT path, 'os', NULL, NULL, 'external' FROM o
UNION ALL SELECT path, 'pkg.base.missing', 'work', NULL, 'external' FROM cu WHERE missing
UNION ALL SELECT path, 'pkg.base.n' || n, 'work', 'pkg/base/n' || n || '.py', 'resolved' FROM cu
  WHERE NOT missing AND NOT local""")
def link_imports(spark, sf):
    return K.link_imports(_facts(spark, sf, "import"), _modules(spark, sf)).select(
        "path", "module", "member", "target_path", "resolution")


def _linked(spark, sf):
    calls = _facts(spark, sf, "call").withColumn(
        "call_id", F.concat_ws(":", "path", F.col("ordinal").cast("string")))
    return calls, K.link_calls(calls, _modules(spark, sf), _facts(spark, sf, "binding"))


@query("link_calls", _SRC + "," + _CALLS + """
SELECT path, src AS parent, line AS start_line, CASE target WHEN 'none' THEN 'unresolved'
    WHEN 'os' THEN 'external' WHEN 'len' THEN 'external' WHEN 'helper' THEN
    CASE WHEN missing THEN 'external' ELSE 'resolved' END ELSE 'resolved' END AS resolution,
  CASE WHEN target IN ('Order', 'Order.stop') THEN path WHEN target = 'helper' AND NOT missing THEN
    CASE WHEN local THEN 'pkg/customers/c' || c || '.py' ELSE 'pkg/base/n' || n || '.py' END END
    AS target_path,
  CASE WHEN target IN ('Order', 'Order.stop') THEN target WHEN target = 'helper' AND NOT missing
    THEN CASE WHEN local THEN 'run' ELSE 'work' END END AS target_name,
  CASE WHEN target = 'os' THEN 'os.getcwd' WHEN target = 'len' THEN 'builtins.len'
    WHEN target = 'helper' AND missing THEN 'pkg.base.missing.work' END AS external FROM calls""")
def link_calls(spark, sf):
    calls, linked = _linked(spark, sf)
    return K.resolve_calls(calls.select(
        "project_id", "call_id", "path", "parent", "start_line"), linked).select(
        "path", "parent", F.col("start_line").cast("bigint").alias("start_line"), "resolution",
        "target_path", "target_name", "external")


def _made(kind: str, *parts: str) -> str:
    """SQL twin of ``make_id`` for project shop; parts are SQL expressions."""
    return (f"'{kind}:' || substring(sha256(CAST(to_json(['{kind}', 'shop', {', '.join(parts)}]) "
            "AS VARCHAR)), 1, 32)")


_UP = "CASE p WHEN 'pkg' THEN '.' ELSE 'pkg' END"
_HOME = "regexp_replace(path, '/[^/]*$', '')"
_NODES = _SRC + f""",
tree AS (SELECT path FROM o UNION ALL SELECT path FROM cu UNION ALL SELECT path FROM na UNION ALL
  SELECT unnest(['pkg/__init__.py', 'pkg/orders/__init__.py', 'pkg/customers/__init__.py',
    'pkg/base/__init__.py'])),
folder AS (SELECT unnest(['.', 'pkg', 'pkg/orders', 'pkg/customers', 'pkg/base']) AS p),
decl AS (SELECT path, name, q, k, up, uk FROM o, (VALUES ('Order', 'Order', 'class', NULL, NULL),
    ('go', 'Order.go', 'function', 'Order', 'class'),
    ('stop', 'Order.stop', 'function', 'Order', 'class'),
    ('main', 'main', 'function', NULL, NULL)) t(name, q, k, up, uk)
  UNION ALL SELECT path, 'run', 'run', 'function', NULL, NULL FROM cu WHERE local AND NOT missing
  UNION ALL SELECT path, 'work', 'work', 'function', NULL, NULL FROM na),
ext AS (SELECT unnest(['os.getcwd', 'builtins.len']) AS name
  UNION SELECT 'pkg.base.missing.work' FROM o WHERE missing),
made AS (SELECT {_made('folder', 'p', 'p')} AS id, 'folder' AS kind,
    CASE p WHEN '.' THEN p ELSE regexp_extract(p, '[^/]+$') END AS name, p AS qualified_name,
    nullif(p, '.') AS file_path, CASE WHEN p <> '.' THEN {_made('folder', _UP, _UP)} END AS parent_id,
    CAST(NULL AS VARCHAR) AS language FROM folder
  UNION ALL SELECT {_made('file', 'path', 'path')}, 'file', regexp_extract(path, '[^/]+$'), path, path,
    {_made('folder', _HOME, _HOME)}, 'python' FROM tree
  UNION ALL SELECT {_made('function', 'path', 'q', 'k')}, 'function', name, q, path,
    CASE WHEN up IS NULL THEN {_made('file', 'path', 'path')}
      ELSE {_made('function', 'path', 'up', 'uk')} END, 'python' FROM decl
  UNION ALL SELECT {_made('external', "''", 'name')}, 'external', name, name, NULL, NULL, NULL
    FROM ext)"""


@query("build_nodes", _NODES + "\nSELECT * FROM made")
def build_nodes(spark, sf):
    return _nodes(spark, sf)[0]


def _nodes(spark, sf):
    calls, linked = _linked(spark, sf)
    externals = linked.filter(F.col("external").isNotNull()).select(F.col("external").alias("name"))
    nodes = K.build_nodes("shop", source_files(spark, sf), _facts(spark, sf, "decl"), externals)
    return nodes, K.resolve_calls(calls, linked)


def _edge_rows(spark, sf):
    nodes, calls = _nodes(spark, sf)
    nodes = stage(nodes, "built-nodes")
    at = lambda a, b: [F.col("file_path").alias(a), F.col("qualified_name").alias(b)]
    funcs = nodes.filter(F.col("kind") == "function")
    ext = nodes.filter(F.col("kind") == "external")
    files = nodes.filter(F.col("kind") == "file")
    rows = (
        calls.withColumnRenamed("name", "sym")
        .join(funcs.select(F.col("id").alias("fn"), *at("path", "parent")), ["path", "parent"],
              "left")
        .join(files.select(F.col("id").alias("own"), F.col("file_path").alias("path")), "path")
        .join(funcs.select(F.col("id").alias("to_fn"), *at("target_path", "target_name")),
              ["target_path", "target_name"], "left")
        .join(ext.select(F.col("id").alias("to_ext"), F.col("name").alias("external")), "external",
              "left"))
    return rows.select(
        F.lit("calls").alias("type"), F.coalesce("fn", "own").alias("source_id"),
        F.coalesce("to_fn", "to_ext").alias("target_id"), "resolution", "path",
        F.col("start_line").cast("bigint").alias("line"), "text")


_EDGES = _NODES + "," + _CALLS + f""",
said AS (SELECT * FROM (VALUES (7, 'none', 'cb()'), (8, 'Order.stop', 'self.stop(helper(os.getcwd()))'),
  (8, 'helper', 'helper(os.getcwd())'), (8, 'os', 'os.getcwd()'), (10, 'helper', 'mod.run(len(x))'),
  (10, 'len', 'len(x)'), (12, 'none', 'helper()'), (13, 'none', 'Order().go(main)'),
  (13, 'Order', 'Order()'), (14, 'Order.stop', 'Order.stop(None, 1)'), (15, 'none', 'unknown()'))
  t(line, target, text)),
meant AS (SELECT c0.path, c0.src, c0.line, text, c0.target,
    CASE WHEN c0.target IN ('Order', 'Order.stop') THEN c0.path
      WHEN c0.target = 'helper' AND NOT missing THEN
        CASE WHEN local THEN 'pkg/customers/c' || c || '.py' ELSE 'pkg/base/n' || n || '.py' END END AS tp,
    CASE WHEN c0.target IN ('Order', 'Order.stop') THEN c0.target
      WHEN c0.target = 'helper' AND NOT missing THEN CASE WHEN local THEN 'run' ELSE 'work' END END AS tq,
    CASE c0.target WHEN 'os' THEN 'os.getcwd' WHEN 'len' THEN 'builtins.len'
      WHEN 'helper' THEN CASE WHEN missing THEN 'pkg.base.missing.work' END END AS x
  FROM calls c0 JOIN said ON said.line = c0.line AND said.target = c0.target),
edge AS (SELECT 'calls' AS type, CASE WHEN src = '' THEN {_made('file', 'path', 'path')}
      ELSE {_made('function', 'path', 'src', "'function'")} END AS source_id,
    CASE WHEN tq IS NOT NULL THEN
      CASE WHEN tq = 'Order' THEN {_made('function', 'tp', 'tq', "'class'")}
        ELSE {_made('function', 'tp', 'tq', "'function'")} END
      WHEN x IS NOT NULL THEN {_made('external', "''", 'x')} END AS target_id,
    CASE WHEN x IS NOT NULL THEN 'external' WHEN tq IS NOT NULL THEN 'resolved'
      ELSE 'unresolved' END AS resolution, path AS evidence_path,
    CAST(line AS BIGINT) AS evidence_line, text AS evidence_text FROM meant)
SELECT {_made('relation', 'type', 'source_id', "coalesce(target_id, '')", 'resolution',
              'evidence_path', 'CAST(evidence_line AS VARCHAR)', 'evidence_text', "'1'")} AS id,
  * FROM edge"""


@query("build_edges", _EDGES)
def build_edges(spark, sf):
    return K.build_edges("shop", _edge_rows(spark, sf))


def _words(rows: str) -> str:
    return " || ':' || ".join(
        f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)"
        for i in range(4)) + " " + rows


_CONTENT = """
WITH f AS (SELECT lang AS project_id, sha256('source:' || strlen(source || '/' || doc_id) || ':' ||
  source || '/' || doc_id || ':' || strlen(text) || ':' || sha256(text)) AS h FROM documents),
c AS (SELECT project_id, sha256('index-inputs-v1:' || sha256(CAST(count(*) AS VARCHAR) || ':' || """ \
    + _words("AS x") .replace(" AS x", "") + """)) AS content_hash FROM f GROUP BY project_id)"""


def _document_files(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("lang").alias("project_id"), F.lit("source").alias("type"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))


@query("content_hash", _CONTENT + "\nSELECT * FROM c")
def content_hash(spark, sf):
    """Documents as source files, one project per language."""
    return K.content_hash(_document_files(spark, sf))


@query("snapshot_id", _CONTENT + """,
g AS (SELECT lang AS project_id, sha256(doc_id || ':' || n_chars) AS h FROM documents),
m AS (SELECT project_id, sha256(CAST(count(*) AS VARCHAR) || ':' || """
       + _words("") + """) AS facts FROM g GROUP BY project_id)
SELECT project_id, content_hash, 'snapshot:' || substring(sha256(CAST(to_json(['snapshot',
  project_id, content_hash, facts]) AS VARCHAR)), 1, 32) AS snapshot_id
FROM c JOIN m USING (project_id)""")
def snapshot_id(spark, sf):
    facts = table(spark, sf, "documents").select(
        F.col("lang").alias("project_id"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
        .alias("fact"))
    return K.snapshot_id(K.content_hash(_document_files(spark, sf)), facts)


# ---- scanning --------------------------------------------------------------------------------------
@query("scan_source_tree", """
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS bytes, sha256(text || chr(10)) AS content_hash
FROM documents""")
def scan_source_tree(spark, sf):
    """Every document written as a file of a tree, found again with its size and content."""
    tree = f"{stage_root(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, sf, "documents").select("doc_id", "text").write.partitionBy("doc_id").text(tree)
    found = S.scan_source_tree(spark, tree, r"\.txt$", with_content=True)
    return found.select(
        F.regexp_extract("path", r"^doc_id=(\d+)/", 1).cast("bigint").alias("doc_id"),
        F.col("bytes").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("content_hash"))


def _tree(spark, sf):
    """One path per order; the priority decides the directory."""
    home = (
        F.when(F.col("o_orderpriority") == "5-LOW", "node_modules/lib")
        .when(F.col("o_orderpriority") == "1-URGENT", "src/build/tmp").otherwise("src"))
    return table(spark, sf, "orders").select(F.concat(
        F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), home, F.lit("/o"),
        F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"))


@query("exclude_fixed_roots", """
WITH p AS (SELECT 'c' || o_custkey AS c, o_orderpriority AS pr, o_orderkey AS k FROM orders)
SELECT c || '/src/o' || k || '.py' AS path, 'kept' AS state FROM p
  WHERE pr NOT IN ('5-LOW', '1-URGENT')
UNION ALL SELECT DISTINCT c || CASE pr WHEN '5-LOW' THEN '/node_modules' ELSE '/src/build' END,
  'excluded' FROM p WHERE pr IN ('5-LOW', '1-URGENT')""")
def exclude_fixed_roots(spark, sf):
    kept, gone = S.exclude_fixed_roots(_tree(spark, sf))
    return kept.withColumn("state", F.lit("kept")).unionByName(
        gone.withColumn("state", F.lit("excluded")))


@query("apply_ignore_rules", with_graph(r"""
f AS (SELECT file_path AS path, name, parent_id, language, string_split(file_path, '/')[2] AS n
      FROM nodes WHERE kind = 'file')
SELECT path, CASE WHEN n = 'n3' THEN true
  WHEN name LIKE 'c%5.py' THEN name <> 'c15.py' OR n = 'n4'
  WHEN name LIKE 's%.ts' THEN name NOT LIKE 's1%.ts'
  ELSE false END AS ignored FROM f"""))
def apply_ignore_rules(spark, sf):
    """Every file of the graph under a root rule file and one in each nation's folder.

    Nation 3 is ignored as a directory, so its own rule file (which would re-open it) is not read.
    """
    nodes = graph_nodes(spark, sf)
    files = nodes.filter(F.col("kind") == "file").select(F.col("file_path").alias("path"))
    nations = nodes.filter((F.col("kind") == "folder") & F.col("id").startswith("folder:n"))
    root = nodes.filter(F.col("id") == "folder:.").select(
        F.lit(".gitignore").alias("path"), F.lit("# root\ns*.ts\n!s1*.ts\nn3/\n").alias("text"))
    inner = nations.select(
        F.concat("file_path", F.lit("/.gitignore")).alias("path"),
        F.when(F.col("name") == "n3", "!*.py\n!*.ts\n")
        .when(F.col("name") == "n4", "c*5.py\n").otherwise("/c*5.py\n\n!c15.py\n").alias("text"))
    return S.apply_ignore_rules(files, root.unionByName(inner))


@query("metadata_budget", """
WITH RECURSIVE d AS (SELECT lang, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path,
    CAST(n_chars AS BIGINT) AS bytes, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
  FROM documents WHERE n_chars <= 6000),
g AS (SELECT lang, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS taken,
    false AS ok FROM (SELECT DISTINCT lang FROM d)
  UNION ALL SELECT d.lang, d.rn, CASE WHEN used + bytes <= 60000 AND taken < 100 THEN used + bytes
    ELSE used END, CASE WHEN used + bytes <= 60000 AND taken < 100 THEN taken + 1 ELSE taken END,
    used + bytes <= 60000 AND taken < 100
  FROM g JOIN d ON d.lang = g.lang AND d.rn = g.rn + 1)
SELECT lang, path, CASE WHEN ok THEN NULL ELSE 'budget' END AS reason FROM g JOIN d USING (lang, rn)
UNION ALL SELECT lang, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 'file size' FROM documents
  WHERE n_chars > 6000""")
def metadata_budget(spark, sf):
    """Documents as metadata files, one category per language, under a small budget."""
    files = table(spark, sf, "documents").select(
        "lang", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        F.col("n_chars").alias("bytes"))
    return S.metadata_budget(files, ["lang"], 100, 6000, 60000).drop("bytes")


@query("read_source_window", r"""
WITH d AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l
  FROM documents),
w AS (SELECT *, 1 + len(string_split(l[1], ' ')) % 3 AS f, least(8, len(l)) AS wanted FROM d),
x AS (SELECT *, least(wanted, f + 4) AS last FROM w),
y AS (SELECT *, unnest(generate_series(f, last)) AS line_no FROM x WHERE last >= f)
SELECT doc_id, line_no, l[line_no] AS line, last < wanted AS truncated FROM y""")
def read_source_window(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first_line = F.element_at(F.split("text", r"\r?\n"), 1)
    start = F.lit(1) + F.size(F.split(first_line, " ")) % 3
    return S.read_source_window(docs, start, F.lit(8), 5)


@query("decode_source", """
SELECT doc_id || CASE WHEN source = 'web' THEN '.ts' ELSE '.py' END AS path, sha256(text) AS text_hash,
  CAST(NULL AS VARCHAR) AS problem FROM documents""")
def decode_source(spark, sf):
    """Every document stored as UTF-16 or as UTF-8 with a byte order mark."""
    from ..extract.python_facts import decode_files

    mark = F.lit(bytearray(b"\xef\xbb\xbf"))
    n = F.col("doc_id").cast("string")
    files = table(spark, sf, "documents").select(
        F.lit("docs").alias("project_id"),
        F.concat(n, F.when(F.col("source") == "web", ".ts").otherwise(".py")).alias("path"),
        F.when(F.col("source") == "web", F.encode("text", "UTF-16")).otherwise(
            F.concat(mark, F.encode("text", "UTF-8"))).alias("content"))
    return decode_files(files).select(
        "path", F.sha2("text", 256).alias("text_hash"), "problem")


# ---- diagnostics --------------------------------------------------------------------------------------
@query("dedupe_diagnostics", """
SELECT DISTINCT 'c' || o_custkey AS file_path, o_orderpriority AS message FROM orders""")
def dedupe_diagnostics(spark, sf):
    return S.dedupe_diagnostics(_diagnostics(spark, sf), [])


def _diagnostics(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_path"),
        F.col("o_orderpriority").alias("message"))


@query("order_diagnostics", """
SELECT 'c' || o_custkey AS file_path, o_orderpriority AS message FROM orders ORDER BY 1, 2""")
def order_diagnostics(spark, sf):
    return S.order_diagnostics(_diagnostics(spark, sf))


# ---- rows of compiled languages -----------------------------------------------------------------------
@query("link_external_bindings", """
SELECT l_orderkey, l_linenumber, 'part-' || l_partkey || ':' || p_brand || ':m' || l_linenumber
  AS external FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'""")
def link_external_bindings(spark, sf):
    """Lines as calls through an alias of the part; lines returned as A import a local file."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey",
        "l_returnflag")
    calls = lines.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("path"),
        F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("root"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("expression"))
    flags = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    imports = table(spark, sf, "part").withColumn("path", flags).select(
        "path", F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("alias"),
        F.concat(F.when(F.col("path") == "A", "./").otherwise(""), F.lit("part-"),
                 F.col("p_partkey").cast("string")).alias("spec"), F.col("p_brand").alias("member"))
    return K.link_external_bindings(calls, imports).select(
        "l_orderkey", "l_linenumber", "external")


@query("const_binding_only", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O'
  AND o_orderpriority <> '1-URGENT')""")
def const_binding_only(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "function").when(
            F.col("o_orderstatus") == "O", "const").otherwise("let").alias("form"),
        (F.col("o_orderpriority") == "1-URGENT").alias("rewritten"))
    return K.const_binding_only(rows).select("o_orderkey")


# Orders as modules: module k (order k) belongs to its customer's module; customers without an order of
# their number are modules as well.  A module takes its nation, balance and segment from its customer.
_LINKS = """
WITH e AS MATERIALIZED (SELECT 'c' || o_custkey AS a, 'c' || o_orderkey AS b, o_orderpriority AS p,
             o_orderstatus AS s, o_orderkey AS k FROM orders),
mods AS MATERIALIZED (SELECT 'c' || key AS id, coalesce(c_nationkey, -1) AS nation,
    coalesce(c_acctbal, 0) AS balance, coalesce(c_mktsegment, '') AS segment
  FROM (SELECT o_orderkey AS key, o_custkey AS cust FROM orders UNION ALL SELECT c_custkey, c_custkey
    FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c_custkey))
  LEFT JOIN customer ON c_custkey = cust)"""


def _links(spark, sf):
    """(a, b, priority, status, k): a sparse directed graph over all orders, one way up each."""
    text = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    return table(spark, sf, "orders").select(
        text("o_custkey").alias("a"), text("o_orderkey").alias("b"),
        F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"),
        F.col("o_orderkey").alias("k"))


def _link_modules(spark, sf):
    """(id, nation, balance, segment) of all modules of ``_links``."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    keys = orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c_custkey"))
    alone = customers.join(keys.select(F.col("key").alias("c_custkey")), "c_custkey", "left_anti")
    keys = keys.unionByName(alone.select(F.col("c_custkey").alias("key"), "c_custkey"))
    return keys.join(customers, "c_custkey", "left").select(
        F.concat(F.lit("c"), F.col("key").cast("string")).alias("id"),
        F.coalesce("c_nationkey", F.lit(-1)).alias("nation"),
        F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"),
        F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


def _chain_sql(hops: int) -> str:
    """Follow b -> a, sixteen times at most (each module has one way up)."""
    parts = ["s0 AS MATERIALIZED (SELECT k AS id, b AS m, false AS t FROM e WHERE s <> 'P')",
             "f0 AS (SELECT id, true AS x FROM s0 WHERE false)"]
    for n in range(1, hops + 1):
        parts.append(f"""j{n} AS MATERIALIZED (SELECT s.id, h.a, h.p = '1-URGENT' AS t FROM s{n - 1} s
            LEFT JOIN e h ON h.b = s.m)""")
        parts.append(f"""f{n} AS MATERIALIZED (SELECT * FROM f{n - 1} UNION ALL SELECT id,
            a IS NOT NULL FROM j{n} WHERE a IS NULL OR t)""")
        parts.append(f"s{n} AS MATERIALIZED (SELECT id, a AS m FROM j{n} WHERE a IS NOT NULL AND NOT t)")
    return ",\n".join(parts)


@query("type_only_exclude", _LINKS + ",\n" + _chain_sql(16) + """
SELECT id AS import_id, x AS excluded FROM f16 UNION ALL SELECT id, true FROM s16
UNION ALL SELECT k, true FROM e WHERE s = 'P'""")
def type_only_exclude(spark, sf):
    """Each order's module re-exports from its customer's."""
    e = _links(spark, sf)
    hops = e.select(F.col("b").alias("module"), F.lit("x").alias("name"),
                    F.col("a").alias("to_module"), F.lit("x").alias("to_name"),
                    (F.col("p") == "1-URGENT").alias("type_only"))
    imports = e.select(F.col("k").alias("import_id"), F.col("b").alias("module"),
                       F.lit("x").alias("name"), (F.col("s") == "P").alias("type_only"))
    return K.type_only_exclude(imports, hops)


@query("export_veto", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_linenumber,
  l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier
  WHERE s_acctbal < 0) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def export_veto(spark, sf):
    """Suppliers as modules, parts as exports: overdrawn suppliers are rejected as a whole, large
    parts by name in every module."""
    exports = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("name")).distinct()
    whole = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select(
        F.col("s_suppkey").alias("module"), F.lit(None).cast("bigint").alias("name"))
    large = table(spark, sf, "part").filter(F.col("p_size") > 40).select(
        F.col("p_partkey").alias("name"))
    named = exports.join(large, "name").select("module", "name")
    return K.export_veto(exports, whole.unionByName(named)).select(
        "l_orderkey", "l_linenumber", F.col("name").alias("l_partkey"),
        F.col("module").alias("l_suppkey"))


@query("commonjs_link", """
WITH x AS (SELECT l_suppkey, l_partkey, count(*) AS n, bool_and(l_tax < 0.07) AS ok,
    min(l_orderkey) AS t FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND n = 1 AND ok THEN t END AS target_id,
  CASE WHEN o_orderstatus = 'P' THEN 'dynamic property' WHEN n IS NULL THEN 'no export'
  WHEN n > 1 THEN 'export written more than once' WHEN NOT ok THEN 'export not stable' END AS reason
FROM orders LEFT JOIN x ON l_suppkey = CAST(floor(o_custkey / 15) AS BIGINT)
  AND l_partkey = CAST(floor(o_orderkey / 8) AS BIGINT)""")
def commonjs_link(spark, sf):
    """Lines write the export (supplier, part); orders call one."""
    exports = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("name"),
        F.col("l_orderkey").alias("target_id"), (F.col("l_tax") < 0.07).alias("valid"))
    calls = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.floor(F.col("o_custkey") / 15).alias("module"),
        F.floor(F.col("o_orderkey") / 8).alias("name"),
        (F.col("o_orderstatus") == "P").alias("dynamic"))
    return K.commonjs_link(calls, exports).select(
        F.col("call_id").alias("o_orderkey"), "target_id", "reason")


def _component_table(spark, sf):
    from ..schemas import SCOPE

    e = _links(spark, sf)
    scope = [F.lit("shop").alias("project_id"), F.lit("full").alias("snapshot_id")]
    nodes = _link_modules(spark, sf).select(*scope, "id", F.lit("file").alias("kind"))
    edges = e.select(*scope, F.col("a").alias("source_id"), F.col("b").alias("target_id"),
                     F.lit("imports").alias("type"), F.lit("resolved").alias("resolution"))
    return e, stage(scc_condense(nodes, edges).drop(*SCOPE), "link-components")


_REACH = """,
ee AS MATERIALIZED (SELECT DISTINCT a, b FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM ee UNION SELECT r.a, x.b FROM reach r JOIN ee x ON x.a = r.b),
cyc AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS c FROM reach x JOIN reach y ON y.a = x.b
    AND y.b = x.a GROUP BY x.a),
comp AS MATERIALIZED (SELECT m.id, coalesce(c.c, m.id) AS component FROM
    mods m LEFT JOIN cyc c ON c.id = m.id)"""


def _rec(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("module_cycle_flag", _rec(_LINKS + _REACH + """
SELECT k, e.a AS importer, e.b AS target, x.component = y.component AS uncertain FROM e
JOIN comp x ON x.id = e.a JOIN comp y ON y.id = e.b"""))
def module_cycle_flag(spark, sf):
    e, components = _component_table(spark, sf)
    requires = e.select("k", F.col("a").alias("importer"), F.col("b").alias("target"))
    return K.module_cycle_flag(requires, components).select("k", "importer", "target", "uncertain")


def _forward_sql(hops: int) -> str:
    parts = ["""h AS MATERIALIZED (SELECT b AS at_, a AS nx, e.p <> '1-URGENT'
        AND t.segment <> 'FURNITURE' AND m.balance >= -500 AS sound FROM e
        JOIN mods t ON t.id = e.a JOIN mods m ON m.id = e.b)""",
             "w0 AS (SELECT at_ AS st, at_ AS cur FROM h)",
             "p0 AS (SELECT st, cur AS leaf FROM w0 WHERE false)"]
    for n in range(1, hops + 1):
        parts.append(f"y{n} AS MATERIALIZED (SELECT w.st, w.cur, h.nx, h.sound FROM w{n - 1} w "
                     "LEFT JOIN h ON h.at_ = w.cur)")
        parts.append(f"p{n} AS MATERIALIZED (SELECT * FROM p{n - 1} UNION ALL SELECT st, cur "
                     f"FROM y{n} WHERE nx IS NULL)")
        parts.append(f"w{n} AS MATERIALIZED (SELECT st, nx AS cur FROM y{n} WHERE sound)")
    return ",\n".join(parts)


@query("forwarding_chain", _LINKS + ",\n" + _forward_sql(17) + """,
ok AS (SELECT p.st, p.leaf FROM p17 p JOIN mods ON id = p.leaf WHERE balance >= -500)
SELECT DISTINCT h.at_ AS module, coalesce(leaf, h.at_) AS leaf, leaf IS NOT NULL AS proven
FROM h LEFT JOIN ok ON ok.st = h.at_""")
def forwarding_chain(spark, sf):
    """Orders' modules forward to their customers'; some by package name, some invalid or not
    CommonJS."""
    e = _links(spark, sf)
    forwarders = e.select(
        F.col("b").alias("module"), F.col("a").alias("target"),
        F.when(F.col("p") == "1-URGENT", "pkg").otherwise("./x").alias("specifier"))
    modules = _link_modules(spark, sf).select(
        F.col("id").alias("module"), (F.col("balance") < -500).alias("invalid"),
        F.when(F.col("segment") == "FURNITURE", "esm").otherwise("commonjs").alias("mode"))
    return K.forwarding_chain(forwarders, modules)


@query("alias_group_veto", """
WITH m AS (SELECT c_custkey AS module, c_nationkey || ':' || c_mktsegment AS leaf, c_acctbal < -900
    AS inv, c_acctbal > 9900 AS nam FROM customer),
g AS (SELECT leaf, bool_or(inv) AS inv, bool_or(nam) AS nam FROM m GROUP BY leaf),
v AS (SELECT DISTINCT leaf, o_orderpriority AS name FROM orders JOIN m ON module = o_custkey
      WHERE o_totalprice < 2000)
SELECT o_orderkey AS target_id, m.leaf, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END
  AS name FROM orders JOIN m ON module = o_custkey JOIN g ON g.leaf = m.leaf
WHERE NOT g.inv AND NOT (g.nam AND o_orderstatus <> 'F') AND NOT EXISTS (SELECT 1 FROM v
  WHERE v.leaf = m.leaf AND v.name = CASE WHEN o_orderstatus = 'F' THEN ''
    ELSE o_orderpriority END)""")
def alias_group_veto(spark, sf):
    """Customers of one nation and segment alias one leaf; orders are exports."""
    modules = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("module"),
        F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("leaf"),
        (F.col("c_acctbal") < -900).alias("invalid"),
        (F.col("c_acctbal") > 9900).alias("named_invalid"))
    orders = table(spark, sf, "orders")
    exports = orders.select(
        F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("target_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
        .alias("name"))
    rejected = orders.filter(F.col("o_totalprice") < 2000).select(
        F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("name"))
    return K.alias_group_veto(modules, exports, rejected).select("target_id", "leaf", "name")


# ---- owners and workspaces -------------------------------------------------------------------------------
@query("nearest_ancestor", with_graph("""
SELECT file_path AS path, CASE WHEN parent_id LIKE 'folder:n1%' THEN parent_id
  ELSE 'folder:' || string_split(file_path, '/')[1] END AS owner FROM nodes WHERE kind = 'file'"""))
def nearest_ancestor(spark, sf):
    """Files under owners at every region and at the nations whose number starts with 1."""
    nodes = graph_nodes(spark, sf)
    owners = nodes.filter(
        F.col("id").startswith("folder:r") | F.col("id").startswith("folder:n1")
    ).select(F.col("file_path").alias("dir"), F.col("id").alias("owner"))
    files = nodes.filter(F.col("kind") == "file").select(F.col("file_path").alias("path"))
    return C.nearest_ancestor(files, owners).select("path", "owner")


def _manifests(spark, sf):
    """A manifest per nation folder and region folder; some do not parse."""
    folders = graph_nodes(spark, sf).filter(
        (F.col("kind") == "folder") & F.col("file_path").isNotNull())
    kind = F.when(F.col("id").startswith("folder:r"), F.lit(',"type":"module"')).when(
        F.col("name").endswith("5"), F.lit(',"type":"weird"')).otherwise("")
    text = F.concat(F.lit('{"name":"@shop/'), "name", F.lit('"'), kind, F.lit("}"))
    broken = F.when(F.col("name").endswith("7"), F.lit("{oops")).otherwise(text)
    return folders.select(F.concat("file_path", F.lit("/package.json")).alias("path"),
                          broken.alias("text"))


_MAN = """
fo AS (SELECT file_path AS dir, name, CASE WHEN name LIKE '%7' THEN 'unknown'
    WHEN id LIKE 'folder:r%' THEN 'esm' WHEN name LIKE '%5' THEN 'unknown' ELSE 'commonjs' END
    AS mode, name NOT LIKE '%7' AS valid FROM nodes WHERE kind = 'folder'
    AND file_path IS NOT NULL)"""


@query("package_boundary_capture", with_graph(_MAN + """
SELECT dir, CASE WHEN valid THEN '@shop/' || name END AS name, mode, valid FROM fo"""))
def package_boundary_capture(spark, sf):
    return C.package_boundaries(_manifests(spark, sf)).select("dir", "name", "mode", "valid")


@query("module_mode", with_graph(_MAN + """,
f AS (SELECT regexp_replace(file_path, '\\.(py|ts)$', '') || e AS path,
        regexp_replace(file_path, '/[^/]*$', '') AS dir, e FROM nodes,
        (VALUES ('.js'), ('.mjs'), ('.cjs'), ('.ts')) t(e) WHERE kind = 'file')
SELECT path, CASE e WHEN '.cjs' THEN 'commonjs' WHEN '.mjs' THEN 'esm' WHEN '.ts' THEN 'unknown'
  ELSE fo.mode END AS mode FROM f JOIN fo ON fo.dir = f.dir"""))
def module_mode(spark, sf):
    manifests = C.package_boundaries(_manifests(spark, sf)).select("dir", "mode")
    ends = F.explode(F.array(*[F.lit(e) for e in (".js", ".mjs", ".cjs", ".ts")]))
    files = graph_nodes(spark, sf).filter(F.col("kind") == "file").withColumn("e", ends).select(
        F.concat(F.regexp_replace("file_path", r"\.(py|ts)$", ""), "e").alias("path"))
    return C.module_mode(files, manifests)


def _workspace(spark, sf):
    """Regions own workspaces: every second-level folder, in region 3 only nation n8."""
    manifests = C.package_boundaries(_manifests(spark, sf))
    owners = manifests.filter(~F.col("dir").contains("/")).select(
        "dir", F.when(F.col("dir") == "r3", F.array(F.lit("n8"))).otherwise(
            F.array(F.lit("*"), F.lit("x/*"))).alias("patterns"))
    return manifests, owners, C.workspace_members(owners, manifests)


@query("workspace_members", with_graph(_MAN + """
SELECT string_split(dir, '/')[1] AS owner_dir, dir, CASE WHEN valid THEN '@shop/' || name END AS name
FROM fo WHERE contains(dir, '/') AND (dir NOT LIKE 'r3/%' OR name = 'n8')"""))
def workspace_members(spark, sf):
    return _workspace(spark, sf)[2]


@query("workspace_resolve", with_graph(_MAN + """,
q AS (SELECT i.id, a.file_path AS path, '@shop/' || replace(b.parent_id, 'folder:', '') AS name,
    '@shop/' || replace(b.parent_id, 'folder:', '') || CASE WHEN i.id LIKE '%7' THEN '/../x'
      ELSE '/lib/a' END AS specifier,
    regexp_replace(a.file_path, '/[^/]*$', '') AS cdir, string_split(a.file_path, '/')[1] AS odir,
    regexp_replace(b.file_path, '/[^/]*$', '') AS tdir, i.id LIKE '%7' AS bad
  FROM imports i JOIN nodes a ON a.id = i.source_id JOIN nodes b ON b.id = i.target_id),
j AS (SELECT q.*, c.valid AS cvalid, '@shop/' || c.name = q.name AS own,
    t.valid AS known, (odir <> 'r3' OR c.name = 'n8') AS inside,
    (string_split(tdir, '/')[1] = odir AND (odir <> 'r3' OR q.name = '@shop/n8')) AS cand
  FROM q JOIN fo c ON c.dir = cdir JOIN fo t ON t.dir = tdir),
z AS (SELECT *, CASE WHEN bad THEN 'invalid subpath' WHEN NOT cvalid THEN 'consumer unavailable'
    WHEN own THEN NULL WHEN NOT inside THEN 'outside the workspace'
    WHEN NOT cand THEN 'not registered' END AS reason FROM j WHERE known)
SELECT id, reason, CASE WHEN reason IS NULL THEN CASE WHEN own THEN cdir ELSE tdir END END
  AS target_dir FROM z"""))
def workspace_resolve(spark, sf):
    """Every file import as a request for the package of the target's folder."""
    manifests, owners, members = _workspace(spark, sf)
    g = star_graph(spark, sf, types=("imports",))
    files = g.nodes.filter(F.col("kind") == "file")
    ends = g.relations.join(
        files.select(F.col("id").alias("source_id"), F.col("file_path").alias("path")), "source_id"
    ).join(files.select(F.col("id").alias("target_id"), "parent_id"), "target_id")
    tail = F.when(F.col("id").endswith("7"), "/../x").otherwise("/lib/a")
    asked = ends.select("id", "path", F.concat(
        F.lit("@shop/"), F.replace("parent_id", F.lit("folder:"), F.lit("")), tail)
        .alias("specifier"))
    return C.workspace_resolve(asked, manifests, owners, members).select(
        "id", "reason", "target_dir")


@query("exports_pattern_select", """
WITH r AS (SELECT DISTINCT p_brand AS package, './' || replace(p_name, ' ', '/') AS subpath FROM part),
x AS (SELECT DISTINCT p_brand AS package, './' || string_split(p_name, ' ')[1] || '/*' AS key,
    './a/*.ts' AS target FROM part WHERE p_size > 20
  UNION SELECT DISTINCT p_brand, './*' , './all/*/*.ts' FROM part WHERE p_size < 5
  UNION SELECT DISTINCT p_brand, './*/' || string_split(p_name, ' ')[2], './t/*.ts' FROM part
    WHERE p_size > 45
  UNION SELECT DISTINCT p_brand, './' || replace(p_name, ' ', '/'), './exact.ts' FROM part
    WHERE p_retailprice < 1000),
c AS (SELECT r.*, x.key, x.target, instr(x.key, '*') AS star FROM r JOIN x ON x.package = r.package
  AND ((NOT contains(x.key, '*') AND x.key = r.subpath) OR (contains(x.key, '*')
    AND starts_with(r.subpath, string_split(x.key, '*')[1])
    AND ends_with(r.subpath, string_split(x.key, '*')[2]) AND length(r.subpath) >= length(x.key)))),
b AS (SELECT *, row_number() OVER (PARTITION BY package, subpath ORDER BY star = 0 DESC, star DESC,
    length(key) DESC, key DESC) AS rn FROM c)
SELECT package, subpath, key, CASE WHEN star = 0 THEN target ELSE replace(target, '*',
  substring(subpath, star, length(subpath) - length(key) + 1)) END AS target FROM b WHERE rn = 1""")
def exports_pattern_select(spark, sf):
    """Part names as subpaths of their brand's package."""
    part = table(spark, sf, "part")
    words = F.split("p_name", " ")
    whole = F.concat(F.lit("./"), F.replace("p_name", F.lit(" "), F.lit("/")))
    row = lambda cond, key, target: F.when(cond, F.struct(
        key.alias("key"), F.lit(target).alias("target")))
    entries = part.select(F.col("p_brand").alias("package"), F.explode(F.array_compact(F.array(
        row(F.col("p_size") > 20, F.concat(F.lit("./"), words[0], F.lit("/*")), "./a/*.ts"),
        row(F.col("p_size") < 5, F.lit("./*"), "./all/*/*.ts"),
        row(F.col("p_size") > 45, F.concat(F.lit("./*/"), words[1]), "./t/*.ts"),
        row(F.col("p_retailprice") < 1000, whole, "./exact.ts"),
    ))).alias("x")).select("package", "x.*").distinct()
    asked = part.select(F.col("p_brand").alias("package"), whole.alias("subpath")).distinct()
    return C.exports_pattern_select(asked, entries)


@query("exports_condition_converge", """
SELECT p_partkey AS request_id, CASE WHEN p_size <= 30 AND p_size > 10 AND p_type <> 'PROMO'
    THEN 'b/' || p_partkey || '.ts' END AS target,
  CASE WHEN p_size > 40 THEN 'blocked, invalid or unmatched' WHEN p_type = 'PROMO'
    THEN 'not a captured file' WHEN p_size <= 30 AND p_size > 10 THEN NULL
    ELSE 'does not converge' END AS reason FROM part""")
def exports_condition_converge(spark, sf):
    """Each part exports one target, different targets per mode, or nothing for require."""
    key = F.col("p_partkey").cast("string")
    same = F.concat(F.lit('{"import":"./'), key, F.lit('.ts","default":"./'), key, F.lit('.ts"}'))
    split = F.concat(F.lit('{"require":"./'), key, F.lit('.ts","default":"./x'), key,
                     F.lit('.ts"}'))
    none = F.concat(F.lit('{"import":"./'), key, F.lit('.ts"}'))
    conditions = F.when(F.col("p_size") > 40, none).when(
        (F.col("p_size") <= 30) & (F.col("p_size") > 10), same).otherwise(split)
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"), F.lit("b").alias("dir"),
        conditions.alias("conditions"),
        F.explode(F.array(F.lit("import"), F.lit("require"))).alias("mode"))
    sources = table(spark, sf, "part").filter(F.col("p_type") != "PROMO").select(F.explode(F.array(
        F.concat(F.lit("b/"), key, F.lit(".ts")), F.concat(F.lit("b/x"), key, F.lit(".ts"))))
        .alias("path"))
    return C.exports_condition_converge(asked, sources)


@query("alias_match", """
WITH r AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS config,
    regexp_replace(url, '^https?://[^/]*/', '') AS specifier FROM pages),
a AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]*)', 1) AS config, unnest(['en/*', '*/1',
    'es/*/', regexp_replace(url, '^https?://[^/]*/', '')]) AS pattern FROM pages
    WHERE url NOT LIKE '%?%')
SELECT DISTINCT page_id, r.config, specifier FROM r JOIN a ON a.config = r.config
  AND ((NOT contains(pattern, '*') AND pattern = specifier) OR (contains(pattern, '*')
    AND starts_with(specifier, string_split(pattern, '*')[1])
    AND ends_with(specifier, string_split(pattern, '*')[2])
    AND length(specifier) >= length(pattern) - 1))""")
def alias_match(spark, sf):
    """Page paths as specifiers in their host's configuration."""
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("config"),
        F.regexp_replace("url", "^https?://[^/]*/", "").alias("specifier"), "url")
    aliases = pages.filter(~F.col("url").contains("?")).select("config", F.explode(F.array(
        F.lit("en/*"), F.lit("*/1"), F.lit("es/*/"), F.col("specifier"))).alias("pattern")).distinct()
    return C.alias_match(pages.drop("url"), aliases)


# ---- configuration graphs: modules as configurations, linked as above -------------------------------------
def _configs(spark, sf):
    return _link_modules(spark, sf).select(
        F.concat(F.lit("w"), F.col("nation").cast("string")).alias("workspace"),
        F.col("id").alias("path"), (F.col("balance") > -800).alias("own_valid"))


def _references(spark, sf):
    """Links between configurations; references of pending urgent orders name nothing."""
    e = _links(spark, sf)
    lost = (F.col("p") == "1-URGENT") & (F.col("s") == "P")
    return e.select(
        F.col("a").alias("path"), F.concat(F.lit("../"), "b").alias("raw"),
        F.when(lost, F.concat(F.lit("missing"), "b")).otherwise(F.col("b")).alias("target"), "k",
        F.when((F.col("p") == "5-LOW") & (F.col("s") == "P"), "extension").alias("problem"))


_CFG = _LINKS + """,
pr AS MATERIALIZED (SELECT 'w' || nation AS ws, id AS path, balance > -800 AS own FROM mods),
rf AS MATERIALIZED (SELECT a AS path, CASE WHEN p = '1-URGENT' AND s = 'P' THEN 'missing' || b ELSE b END
    AS target, k, CASE WHEN p = '5-LOW' AND s = 'P' THEN 'extension' END AS problem FROM e),
rv AS MATERIALIZED (SELECT path, CASE WHEN problem IS NULL THEN target END AS target FROM rf)"""


def _closure_sql(depth: int = 16) -> str:
    parts = ["z0 AS (SELECT path FROM pr WHERE false)"]
    for k in range(1, depth + 1):
        parts.append(f"""z{k} AS MATERIALIZED (SELECT path FROM pr WHERE own AND path NOT IN (
            SELECT path FROM rv WHERE target IS NULL OR target NOT IN
            (SELECT path FROM z{k - 1})))""")
    return ",\n".join(parts) + f""",
cl AS MATERIALIZED (SELECT path, path IN (SELECT path FROM z{depth}) AS valid FROM pr)"""


def _closure(spark, sf):
    refs = _references(spark, sf).withColumn(
        "target", F.when(F.col("problem").isNull(), F.col("target")))
    return stage(C.config_closure_valid(_configs(spark, sf), refs), "config-closure")


@query("config_closure_valid", _CFG + ",\n" + _closure_sql() + "\nSELECT * FROM cl")
def config_closure_valid(spark, sf):
    return _closure(spark, sf)


@query("config_reference_graph", _rec(_CFG + ",\n" + _closure_sql() + _REACH + """,
rk AS (SELECT path, row_number() OVER (PARTITION BY ws ORDER BY path) AS rn FROM pr)
SELECT rf.k, rf.path, rf.target, CASE WHEN problem IS NOT NULL THEN 'invalid'
  WHEN rf.path = rf.target OR coalesce(x.component = y.component AND rf.target = y.component, false)
    THEN 'cycle'
  WHEN pr.own IS NULL THEN 'unavailable' WHEN rk.rn > 40 THEN 'budget'
  WHEN NOT (pr.own AND cl.valid) THEN 'invalid' ELSE 'resolved' END AS status
FROM rf LEFT JOIN pr ON pr.path = rf.target LEFT JOIN rk ON rk.path = rf.target
LEFT JOIN cl ON cl.path = rf.target LEFT JOIN comp x ON x.id = rf.path
LEFT JOIN comp y ON y.id = rf.target"""))
def config_reference_graph(spark, sf):
    _, components = _component_table(spark, sf)
    return C.config_reference_graph(
        _configs(spark, sf), _references(spark, sf), components, _closure(spark, sf), 40
    ).select("k", "path", "target", "status")


def _unrolled_reach(depth: int = 16) -> str:
    parts = ["q1 AS MATERIALIZED (SELECT path AS root, path, 1 AS depth FROM pr)"]
    for n in range(2, depth + 1):
        parts.append(f"""q{n} AS MATERIALIZED (SELECT * FROM q{n - 1} UNION ALL SELECT DISTINCT q.root,
            v.target, {n} FROM q{n - 1} q JOIN rv v ON v.path = q.path AND q.depth = {n - 1}
            WHERE v.target IN (SELECT path FROM pr) AND NOT EXISTS (SELECT 1 FROM q{n - 1} x
              WHERE x.root = q.root AND x.path = v.target))""")
    return ",\n".join(parts)


def _reachable(spark, sf):
    configs = _configs(spark, sf)
    edges = _references(spark, sf).filter(F.col("problem").isNull()).join(
        configs.select(F.col("path").alias("target")), "target", "left_semi")
    return C.config_reachable(configs.select(F.col("path").alias("root")),
                              stage(edges.select("path", "target"), "reach-edges"))


@query("config_reachable", _CFG + ",\n" + _unrolled_reach() + """
SELECT root, path, CAST(depth AS BIGINT) AS depth FROM q16""")
def config_reachable(spark, sf):
    return _reachable(spark, sf).withColumn("depth", F.col("depth").cast("bigint"))


@query("config_extends_closure", _rec(_LINKS + """,
ex AS MATERIALIZED (SELECT DISTINCT a AS path, CASE WHEN s = 'P' THEN 'x' || b ELSE b END AS target FROM e),
w AS (SELECT id AS root, id AS path, [id] AS chain,
    CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS problem FROM mods
  UNION ALL SELECT w.root, x.target, list_append(w.chain, x.target), w.depth + 1,
    CASE WHEN list_contains(w.chain, x.target) THEN 'cycle' WHEN x.target LIKE 'x%' THEN 'missing'
      WHEN w.depth + 1 > 16 THEN 'depth' END
  FROM w JOIN ex x ON x.path = w.path WHERE w.problem IS NULL)
SELECT root, path, problem, min(depth) AS depth FROM w GROUP BY 1, 2, 3"""))
def config_extends_closure(spark, sf):
    e = _links(spark, sf)
    extends = e.select(F.col("a").alias("path"), F.when(
        F.col("s") == "P", F.concat(F.lit("x"), "b")).otherwise(F.col("b")).alias("target"))
    return C.config_extends_closure(_configs(spark, sf).select("path"), extends)


def _scopes(spark, sf):
    """Orders as files: anchored at their customer, members of one or two configurations."""
    orders = table(spark, sf, "orders")
    path = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    cust = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    files = orders.select(path.alias("path"))
    anchors = orders.select(
        path.alias("path"), F.when(F.col("o_orderpriority") != "5-LOW", cust).alias("anchor"),
        (F.col("o_orderstatus") != "P").alias("anchor_ok"))
    direct = orders.filter(F.col("o_orderpriority") != "4-NOT SPECIFIED").select(
        cust.alias("config"), path.alias("path"))
    e = _links(spark, sf).select(F.col("a"), F.col("b"))
    more = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        cust.alias("a"), path.alias("path")).join(e, "a").select(F.col("b").alias("config"), "path")
    return C.config_scope_assign(files, anchors, _reachable(spark, sf),
                                 direct.unionByName(more).distinct(), _closure(spark, sf))


_SCOPES = _CFG + ",\n" + _closure_sql() + ",\n" + _unrolled_reach() + """,
ofile AS (SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderpriority <> '5-LOW' THEN 'c' || o_custkey END
    AS anchor, o_orderstatus <> 'P' AS anchor_ok, o_orderpriority AS pri, 'c' || o_custkey AS cust
  FROM orders),
mem AS MATERIALIZED (SELECT cust AS config, path FROM ofile WHERE pri <> '4-NOT SPECIFIED'
  UNION SELECT e.b, path FROM ofile JOIN e ON e.a = cust WHERE pri = '1-URGENT'),
cnt AS (SELECT f.path, count(*) AS n, count(*) FILTER (WHERE cl.valid) AS nv,
    min(m.config) FILTER (WHERE cl.valid) AS config
  FROM ofile f JOIN q16 q ON q.root = f.anchor JOIN mem m ON m.config = q.path AND m.path = f.path
  LEFT JOIN cl ON cl.path = m.config GROUP BY f.path),
scopes AS MATERIALIZED (SELECT f.path, CASE WHEN anchor IS NULL THEN 'unconfigured'
    WHEN coalesce(nv, 0) = 1 THEN 'resolved' WHEN nv > 1 THEN 'ambiguous'
    WHEN coalesce(n, 0) > 0 OR NOT anchor_ok THEN 'invalid' ELSE 'unconfigured' END AS status,
    CASE WHEN anchor IS NOT NULL AND coalesce(nv, 0) = 1 THEN config END AS config
  FROM ofile f LEFT JOIN cnt c ON c.path = f.path)"""


@query("config_scope_assign", _SCOPES + "\nSELECT * FROM scopes")
def config_scope_assign(spark, sf):
    return _scopes(spark, sf)


@query("scope_status_counts", _SCOPES + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved,
  count(*) FILTER (WHERE status = 'unconfigured') AS unconfigured,
  count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE status = 'invalid') AS invalid FROM scopes""")
def scope_status_counts(spark, sf):
    return C.scope_status_counts(_scopes(spark, sf), [])


@query("config_graph_view", _LINKS + """
SELECT ws AS workspace, path, position, observed, observed > 50 AS truncated FROM (
  SELECT 'w' || nation AS ws, id AS path, row_number() OVER (PARTITION BY nation ORDER BY id)
    AS position, count(*) OVER (PARTITION BY nation) AS observed FROM mods) WHERE position <= 50""")
def config_graph_view(spark, sf):
    return C.config_graph_view("workspace", _configs(spark, sf), ["path"], 50).select(
        "workspace", "path", "position", "observed", "truncated")


@query("scope_can_resolve", _SCOPES + """,
pairs AS (SELECT l_orderkey, l_linenumber, 'o' || l_orderkey AS source, 'o' || l_partkey AS target,
    l_returnflag = 'N' AS proof FROM lineitem)
SELECT l_orderkey, l_linenumber, p.target, proof, CASE WHEN a.status IN ('invalid', 'ambiguous')
    OR coalesce(b.status, '') IN ('invalid', 'ambiguous') THEN false
  WHEN source = p.target OR coalesce(a.config = b.config, false) THEN true ELSE proof END AS allowed
FROM pairs p LEFT JOIN scopes a ON a.path = source LEFT JOIN scopes b ON b.path = p.target""")
def scope_can_resolve(spark, sf):
    """Lines as calls from their order's file to the order numbered like the part."""
    text = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    pairs = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        text("l_orderkey").alias("source"), text("l_partkey").alias("target"),
        (F.col("l_returnflag") == "N").alias("proof"))
    return C.scope_can_resolve(pairs, stage(_scopes(spark, sf), "scopes")).drop("source")
