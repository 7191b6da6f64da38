"""Graph queries over the star-schema graph: search, context, traversal, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import integrity as I
from ..operators import paging as P
from ..operators import search as S
from ..operators import traverse as T
from ..operators.postings import GramIndex, gram_index
from ..schemas import SCOPE
from ..sources.star_graph import PAIR, contains, graph_nodes as star_nodes, star_graph
from ..staging import stage, table
from .prelude import with_graph
from .registry import query

CALLS = ("calls",)
FACTS = ("calls", "imports")


def _requests(df, condition):
    return df.filter(condition).select(*SCOPE, F.col("id").alias("node_id"))


@query("calls_by_file", with_graph("""
SELECT n.parent_id AS file_id,
  count(*) FILTER (WHERE resolution = 'resolved') AS resolved,
  count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved,
  count(*) FILTER (WHERE resolution = 'external') AS external
FROM calls c JOIN nodes n ON c.source_id = n.id GROUP BY n.parent_id"""))
def calls_by_file(spark, sf):
    g = star_graph(spark, sf, types=CALLS)
    return C.calls_by_file(g.nodes, g.relations).drop(*SCOPE)


_INDEXES: dict[tuple, GramIndex] = {}


def _search_index(spark, sf, nodes) -> GramIndex:
    """The search index of the published graph, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = gram_index(nodes)
    return _INDEXES[key]


# ---- listings -------------------------------------------------------------------------------
@query("search_functions", with_graph("""
req AS (SELECT DISTINCT word AS q FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
        UNION SELECT upper(r_name) FROM region UNION SELECT '' UNION SELECT 'c1' UNION SELECT '7'),
hits AS (SELECT req.q, n.id, n.name, coalesce(n.file_path, '') AS fp FROM nodes n, req
         WHERE n.kind = 'function' AND (lower(req.q) = '' OR contains(lower(n.name), lower(req.q))
           OR contains(lower(n.qualified_name), lower(req.q))
           OR contains(lower(n.file_path), lower(req.q)))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY name, fp, id) AS position,
           count(*) OVER (PARTITION BY q) AS total FROM hits)
SELECT q AS request_id, id, position, total FROM ranked WHERE position <= 50"""))
def search_functions(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("q"))
    areas = table(spark, sf, "region").select(F.upper("r_name").alias("q"))
    fixed = spark.createDataFrame([("",), ("c1",), ("7",)], "q string")
    asked = words.unionByName(areas).unionByName(fixed).distinct().select(
        F.lit("shop").alias("project_id"), F.lit("full").alias("snapshot_id"),
        F.col("q").alias("request_id"), "q",
    )
    everyone = star_nodes(spark, sf)
    found = S.search_functions(everyone, asked, index=_search_index(spark, sf, everyone))
    return found.select("request_id", "id", "position", "total")


@query("paginate", with_graph("""
r AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY name, file_path, id)
        AS position, count(*) OVER (PARTITION BY parent_id) AS total
      FROM nodes WHERE kind = 'function')
SELECT parent_id, id, position, total FROM r WHERE position BETWEEN 6 AND 10"""))
def paginate(spark, sf):
    rows = star_nodes(spark, sf).filter(F.col("kind") == "function")
    return P.page(rows, [*SCOPE, "parent_id"], S.node_order(), 5, 5).select(
        "parent_id", "id", "position", "total"
    )


@query("page_wrap", with_graph("""
r AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY name, file_path, id)
        AS position, count(*) OVER (PARTITION BY parent_id) AS total
      FROM nodes WHERE kind = 'function')
SELECT parent_id, id, position, total, total > 8 AS truncated FROM r WHERE position <= 8"""))
def page_wrap(spark, sf):
    rows = star_nodes(spark, sf).filter(F.col("kind") == "function")
    return P.page_wrap(rows, [*SCOPE, "parent_id"], S.node_order(), 0, 8).select(
        "parent_id", "id", "position", "total", "truncated"
    )


@query("entrypoints", with_graph("""
e AS (SELECT n.snapshot_id, n.id, row_number() OVER (PARTITION BY n.snapshot_id
        ORDER BY n.name, coalesce(n.file_path, ''), n.id) AS position,
        count(*) OVER (PARTITION BY n.snapshot_id) AS total
      FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id AND n.snapshot_id = p.snapshot_id
      WHERE n.kind = 'function' AND n.exported
        AND (n.language <> 'python' OR p.kind = 'file'))
SELECT snapshot_id, id, position, total FROM e WHERE position <= 50""", pair=True))
def entrypoints(spark, sf):
    return S.entrypoints(star_nodes(spark, sf, PAIR)).select(
        "snapshot_id", "id", "position", "total"
    )


_SCOPE_SQL = """
req AS (SELECT CASE WHEN id = 'folder:.' THEN '.' ELSE file_path END AS path, kind, id AS root_id
        FROM nodes WHERE kind IN ('folder', 'file')),
kids AS (SELECT r.path, r.kind, r.root_id, n.id, coalesce(n.file_path, '') AS sk
         FROM req r JOIN nodes n ON n.parent_id = r.root_id
         WHERE r.kind = 'folder' AND n.kind IN ('file', 'folder')
         UNION ALL
         SELECT r.path, r.kind, r.root_id, n.id, coalesce(n.qualified_name, n.name)
         FROM req r JOIN nodes n ON n.file_path = r.path WHERE r.kind = 'file'
         AND n.kind = 'function'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY sk, id) AS position
           FROM kids),
sizes AS (SELECT root_id, count(*) AS n FROM kids GROUP BY root_id),
listed AS (
  SELECT path, kind, k.root_id, id, position, n + 1 > 80 AS truncated
  FROM ranked k JOIN sizes USING (root_id) WHERE position < 80
  UNION ALL
  SELECT path, kind, r.root_id, r.root_id, 0, coalesce(n, 0) + 1 > 80
  FROM req r LEFT JOIN sizes s ON r.root_id = s.root_id)"""


def _listing(spark, sf):
    g_nodes = star_nodes(spark, sf)
    places = g_nodes.filter(F.col("kind").isin("folder", "file")).select(
        *SCOPE, "kind", F.coalesce("file_path", F.lit(".")).alias("path")
    )
    # Every place under its other kind as well: those requests name nothing and are missing.
    other = F.when(F.col("kind") == "file", "folder").otherwise("file")
    return g_nodes, S.navigation_scope(
        g_nodes, places.unionByName(places.withColumn("kind", other))
    )


@query("navigation_scope", with_graph(_SCOPE_SQL + """
SELECT path, kind, id, position, truncated, false AS missing FROM listed
UNION ALL
SELECT path, CASE kind WHEN 'file' THEN 'folder' ELSE 'file' END, NULL, 0, false, path <> '.'
FROM req"""))
def navigation_scope(spark, sf):
    return _listing(spark, sf)[1].select("path", "kind", "id", "position", "truncated", "missing")


@query("top_k_budget", with_graph(_SCOPE_SQL + """,
edges AS (SELECT l.root_id, r.id FROM listed l
          JOIN contain r ON r.target_id = l.id
          JOIN listed s ON s.root_id = l.root_id AND s.id = r.source_id
          WHERE l.kind = 'file' OR r.source_id = l.root_id),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY id) AS position,
            count(*) OVER (PARTITION BY root_id) AS edge_total FROM edges)
SELECT root_id, id AS relation_id, position, edge_total FROM ranked2 WHERE position <= 900"""))
def top_k_budget(spark, sf):
    g_nodes, listing = _listing(spark, sf)
    return S.scope_edges(listing, contains(g_nodes)).select(
        "root_id", "relation_id", "position", "edge_total"
    )


@query("order_nodes", with_graph(
    "SELECT id, name, file_path FROM nodes ORDER BY name, coalesce(file_path, ''), id"))
def order_nodes(spark, sf):
    return star_nodes(spark, sf).orderBy(*S.node_order()).select("id", "name", "file_path")


@query("order_relations", with_graph(
    "SELECT id, type, source_id, target_id FROM relations ORDER BY id"))
def order_relations(spark, sf):
    return star_graph(spark, sf).relations.orderBy("id").select(
        "id", "type", "source_id", "target_id"
    )


# ---- context and ownership --------------------------------------------------------------------
_CONTEXT_SQL = """
ends AS (SELECT target_id AS node_id, 'incoming' AS direction, id, source_id, target_id FROM calls
         WHERE target_id LIKE 'function:%'
         UNION ALL SELECT source_id, 'outgoing', id, source_id, target_id FROM calls),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY id) AS position
           FROM ends),
sizes AS (SELECT node_id, count(*) FILTER (WHERE direction = 'incoming') AS total_incoming,
          count(*) FILTER (WHERE direction = 'outgoing') AS total_outgoing
          FROM ends GROUP BY node_id)"""


def _context(spark, sf, limit):
    g = star_graph(spark, sf, types=CALLS)
    asked = _requests(g.nodes, F.col("kind") == "function")
    return g, C.function_context(g.relations, g.nodes, asked, 0, limit)


@query("function_context", with_graph(_CONTEXT_SQL + """
SELECT node_id, direction, id, position, total_incoming, total_outgoing,
       greatest(total_incoming, total_outgoing) > 3 AS truncated
FROM ranked JOIN sizes USING (node_id) WHERE position <= 3"""))
def function_context(spark, sf):
    return _context(spark, sf, 3)[1].select(
        "node_id", "direction", "id", "position", "total_incoming", "total_outgoing", "truncated"
    )


@query("page_endpoint_nodes", with_graph(_CONTEXT_SQL + """,
ids AS (SELECT node_id, source_id AS id FROM ranked WHERE position <= 3
        UNION SELECT node_id, target_id FROM ranked WHERE position <= 3)
SELECT i.node_id, n.id, n.kind, n.name FROM ids i JOIN nodes n ON n.id = i.id"""))
def page_endpoint_nodes(spark, sf):
    g, rows = _context(spark, sf, 3)
    return C.page_endpoint_nodes(rows, g.nodes, ["node_id"]).select("node_id", "id", "kind", "name")


@query("owning_file", with_graph("""
SELECT id, CASE kind WHEN 'file' THEN id ELSE parent_id END AS file_id FROM nodes
WHERE kind IN ('file', 'function')"""))
def owning_file(spark, sf):
    return C.owning_file(star_nodes(spark, sf)).select("id", "file_id")


@query("file_context", with_graph("""
owner AS (SELECT id, CASE kind WHEN 'file' THEN id ELSE parent_id END AS file_id FROM nodes
          WHERE kind IN ('file', 'function')),
o AS (SELECT r.*, s.file_id AS sf, t.file_id AS tf FROM relations r
      LEFT JOIN owner s ON r.source_id = s.id LEFT JOIN owner t ON r.target_id = t.id
      WHERE type <> 'contains'),
rows0 AS (
  SELECT sf AS file_id, 'imports' AS category, id AS item_id, id AS o1, '' AS o2 FROM o
    WHERE type = 'imports' AND sf IS NOT NULL
  UNION ALL SELECT tf, 'imports', id, id, '' FROM o WHERE type = 'imports' AND tf <> sf
  UNION ALL SELECT sf, 'unknown', id, id, '' FROM o WHERE type = 'calls'
    AND resolution <> 'resolved'
  UNION ALL SELECT tf, 'incoming', id, id, '' FROM o WHERE type = 'calls'
    AND resolution = 'resolved' AND sf <> tf
  UNION ALL SELECT sf, 'outgoing', id, id, '' FROM o WHERE type = 'calls'
    AND resolution = 'resolved' AND sf <> tf
  UNION ALL SELECT parent_id, 'members', id, name, file_path FROM nodes WHERE kind = 'function'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, category ORDER BY o1, o2, item_id)
             AS position, count(*) OVER (PARTITION BY file_id, category) AS total FROM rows0),
flag AS (SELECT file_id, bool_or(total > 50) AS truncated FROM ranked GROUP BY file_id)
SELECT file_id, category, item_id, position, total, truncated
FROM ranked JOIN flag USING (file_id) WHERE position <= 50"""))
def file_context(spark, sf):
    g = star_graph(spark, sf, types=FACTS)
    return C.file_context(
        g.nodes, g.relations, _requests(g.nodes, F.col("kind") == "file")
    ).drop(*SCOPE)


@query("project_summary", with_graph("""
k AS (SELECT snapshot_id, count(*) FILTER (WHERE kind = 'file') AS files,
        count(*) FILTER (WHERE kind = 'folder') AS folders,
        count(*) FILTER (WHERE kind = 'function') AS functions FROM nodes GROUP BY snapshot_id),
r AS (SELECT snapshot_id, count(*) AS relations,
        count(*) FILTER (WHERE type = 'calls' AND resolution = 'resolved') AS calls_resolved,
        count(*) FILTER (WHERE type = 'calls' AND resolution = 'unresolved') AS calls_unresolved,
        count(*) FILTER (WHERE type = 'calls' AND resolution = 'external') AS calls_external
      FROM relations GROUP BY snapshot_id)
SELECT * FROM k JOIN r USING (snapshot_id)""", pair=True))
def project_summary(spark, sf):
    g = star_graph(spark, sf, PAIR)
    return C.project_summary(g.nodes, g.relations).drop("project_id")


@query("unresolved_count", with_graph("""
SELECT snapshot_id, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved
FROM relations GROUP BY snapshot_id""", pair=True))
def unresolved_count(spark, sf):
    return C.unresolved_count(star_graph(spark, sf, PAIR).relations).drop("project_id")


@query("kind_histogram", with_graph("""
SELECT snapshot_id, count(*) FILTER (WHERE kind = 'function') AS function,
  count(*) FILTER (WHERE kind = 'file') AS file, count(*) FILTER (WHERE kind = 'folder') AS folder,
  count(*) FILTER (WHERE kind = 'external') AS external FROM nodes GROUP BY snapshot_id""",
  pair=True))
def kind_histogram(spark, sf):
    return C.kind_histogram(star_nodes(spark, sf, PAIR)).drop("project_id")


@query("unknown_count", with_graph("""
u AS (SELECT source_id AS node_id, id FROM calls WHERE resolution <> 'resolved'
      UNION SELECT target_id, id FROM calls WHERE resolution <> 'resolved'
      AND target_id IS NOT NULL),
c AS (SELECT node_id, count(*) AS unknown FROM u GROUP BY node_id)
SELECT n.id AS node_id, coalesce(unknown, 0) AS unknown FROM nodes n LEFT JOIN c ON n.id = node_id"""))
def unknown_count(spark, sf):
    g = star_graph(spark, sf, types=CALLS)
    return C.unknown_count(g.relations, _requests(g.nodes, F.lit(True))).drop(*SCOPE)


@query("layout_target", with_graph("""
k AS (SELECT snapshot_id, count(*) AS nodes, count(*) FILTER (WHERE kind = 'function') AS function,
        count(*) FILTER (WHERE kind = 'file') AS file,
        count(*) FILTER (WHERE kind = 'folder') AS folder,
        count(*) FILTER (WHERE kind = 'external') AS external,
        sum(strlen('{"id":"' || id || '","kind":"' || kind || '"' ||
            coalesce(',"parentId":"' || parent_id || '"', '') || '}')) AS nb
      FROM nodes GROUP BY snapshot_id),
r AS (SELECT snapshot_id, count(*) AS relations,
        sum(strlen('{"id":"' || id || '","sourceId":"' || source_id || '","targetId":' ||
            coalesce('"' || target_id || '"', 'null') || ',"type":"' || type ||
            '","resolution":"' || resolution || '"}')) AS eb
      FROM relations GROUP BY snapshot_id),
b AS (SELECT *, CAST(nb + nodes - 1 + 2 + eb + relations - 1 + 2 AS BIGINT) AS fact_bytes
      FROM k JOIN r USING (snapshot_id)),
d AS (SELECT *, CASE WHEN nodes > 5000 THEN 'node_budget' WHEN relations > 20000
        THEN 'relation_budget' WHEN fact_bytes > 8388608 THEN 'byte_budget' END AS reason FROM b)
SELECT snapshot_id, nodes, relations, function, file, folder, external, fact_bytes,
  CASE WHEN reason IS NULL THEN 'ready' ELSE 'rejected' END AS status, reason FROM d""", pair=True))
def layout_target(spark, sf):
    g = star_graph(spark, sf, PAIR)
    return I.layout_target(g.nodes, g.relations).drop("project_id")


@query("integrity_check", with_graph("""
n AS (SELECT * FROM nodes WHERE kind <> 'external'),
missing AS (SELECT r.id, target_id AS detail FROM relations r ANTI JOIN n ON n.id = target_id
            WHERE target_id IS NOT NULL),
raw AS (SELECT l_orderkey || ':' || l_linenumber AS id, count(*) AS k FROM lineitem GROUP BY 1)
SELECT 'DANGLING_ENDPOINT' AS code, id, detail FROM missing
UNION ALL SELECT 'DUPLICATE_RELATION', id, CAST(k AS VARCHAR) FROM raw WHERE k > 1""", once=True))
def integrity_check(spark, sf):
    """A damaged graph: externals dropped and line items keyed by order and line only."""
    g = star_graph(spark, sf)
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"),
        F.lit("calls").alias("type"), F.lit("unresolved").alias("resolution"),
        F.lit("shop").alias("project_id"), F.lit("full").alias("snapshot_id"),
        F.lit("folder:.").alias("source_id"), F.lit(None).cast("string").alias("target_id"),
    )
    relations = g.relations.select(*lines.columns).unionByName(lines)
    kept = g.nodes.filter(F.col("kind") != "external")
    return I.integrity_check(kept, relations).drop(*SCOPE)


# ---- traversal -----------------------------------------------------------------------------------
def bfs_sql(seeds: str, edges: str, nodes: str, depth: int, budget: int) -> str:
    """CTEs ``sel(req, id, level)``, ``anc(req, id)``, ``edge`` and ``over(req)``."""
    ctes = [
        f"bn AS MATERIALIZED (SELECT * FROM {nodes})",
        f"be AS MATERIALIZED (SELECT * FROM {edges})",
        """near AS (SELECT DISTINCT a AS hub, b AS nb FROM (
             SELECT source_id AS a, target_id AS b FROM be UNION ALL
             SELECT target_id, source_id FROM be) SEMI JOIN bn ON bn.id = b WHERE a <> b)""",
        # A request has at most `budget` nodes: past them, `budget` + 1 of a hub's least neighbours
        # fill it and tell that it overflows, so further ones never matter.
        f"""adj AS MATERIALIZED (SELECT hub, nb FROM (SELECT *, row_number() OVER (
             PARTITION BY hub ORDER BY nb) AS nth FROM near) WHERE nth <= {2 * budget + 1})""",
        f"""q0 AS (SELECT req, id, row_number() OVER (PARTITION BY req ORDER BY id) AS pos
             FROM ({seeds}))""",
        f"s0 AS MATERIALIZED (SELECT req, id, 0 AS level FROM q0 WHERE pos <= {budget})",
        f"v0 AS (SELECT DISTINCT req FROM q0 WHERE pos > {budget})",
    ]
    for n in range(1, depth + 1):
        p = n - 1
        ctes += [
            f"""c{n} AS (SELECT DISTINCT f.req, nb AS id FROM s{p} f JOIN adj ON hub = f.id
                WHERE f.level = {p} AND NOT EXISTS (SELECT 1 FROM s{p} s WHERE s.req = f.req
                AND s.id = nb))""",
            f"k{n} AS (SELECT req, count(*) AS n FROM s{p} GROUP BY req)",
            f"""q{n} AS MATERIALIZED (SELECT c.req, c.id, k.n + row_number() OVER (
                PARTITION BY c.req ORDER BY c.id) AS pos FROM c{n} c JOIN k{n} k USING (req))""",
            f"""s{n} AS MATERIALIZED (SELECT * FROM s{p} UNION ALL
                SELECT req, id, {n} FROM q{n} WHERE pos <= {budget})""",
            f"""v{n} AS (SELECT req FROM v{p} UNION SELECT req FROM q{n} WHERE pos > {budget})""",
        ]
    d = depth
    ctes += [
        f"sel AS MATERIALIZED (SELECT req, id, CAST(level AS BIGINT) AS level FROM s{d})",
        """up1 AS (SELECT s.req, s.level, s.id AS origin, p.id, 1 AS d FROM sel s
             JOIN bn n ON n.id = s.id JOIN bn p ON p.id = n.parent_id)""",
    ]
    for n in range(2, 5):
        ctes.append(f"""up{n} AS (SELECT u.req, u.level, u.origin, p.id, {n} AS d FROM up{n - 1} u
             JOIN bn n ON n.id = u.id JOIN bn p ON p.id = n.parent_id)""")
    ctes += [
        "ups AS (" + " UNION ALL ".join(f"SELECT * FROM up{n}" for n in range(1, 5)) + ")",
        """firsts AS (SELECT *, row_number() OVER (PARTITION BY req, id ORDER BY level, origin, d)
             AS f FROM ups)""",
        """aq AS MATERIALIZED (SELECT f.req, f.id, (SELECT count(*) FROM sel s
               WHERE s.req = f.req) + row_number() OVER (PARTITION BY f.req
               ORDER BY f.level, f.origin, f.d) AS pos
             FROM firsts f WHERE f.f = 1 AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.req = f.req
               AND s.id = f.id))""",
        f"anc AS MATERIALIZED (SELECT req, id FROM aq WHERE pos <= {budget})",
        """chosen AS MATERIALIZED (SELECT req, id FROM sel UNION ALL SELECT req, id FROM anc)""",
        """eq AS MATERIALIZED (SELECT c.req, e.id, e.source_id, e.target_id, row_number() OVER (
               PARTITION BY c.req ORDER BY e.id) AS pos FROM be e JOIN chosen c
             ON c.id = e.source_id WHERE e.target_id IS NULL OR EXISTS (SELECT 1 FROM chosen t
               WHERE t.req = c.req AND t.id = e.target_id))""",
        f"""edge AS (SELECT req, id, source_id, target_id, pos FROM eq WHERE pos <= {3 * budget})""",
        f"""over_ AS (SELECT req FROM v{d} UNION SELECT req FROM aq WHERE pos > {budget}
             UNION SELECT req FROM eq WHERE pos > {3 * budget})""",
    ]
    return ",\n".join(ctes)


# One request per customer: the customer's file and all its order functions.
_SEEDS = """SELECT parent_id AS req, id FROM nodes WHERE language = 'python' AND kind = 'function'
  UNION ALL SELECT id, id FROM nodes WHERE language = 'python' AND kind = 'file'"""
_BUDGET = 40


def _customer_seeds(g):
    python = g.nodes.filter(F.col("language") == "python")
    mine = F.when(F.col("kind") == "file", F.col("id")).otherwise(F.col("parent_id"))
    return python.select(*SCOPE, mine.alias("request_id"), F.col("id").alias("node_id"))


def _flat(df, *cols):
    return df.select("request_id", *cols)


_BFS = bfs_sql(_SEEDS, "relations", "nodes", 2, _BUDGET)


def _neighbourhood(spark, sf):
    g = star_graph(spark, sf)
    return T.subgraph(g.nodes, g.relations, _customer_seeds(g), 2, _BUDGET,
                      ("calls", "imports", "contains"))


@query("subgraph_bfs", with_graph(_BFS + """
SELECT s.req AS request_id, s.id, s.level, o.req IS NOT NULL AS truncated
FROM sel s LEFT JOIN over_ o ON s.req = o.req""", once=True))
def subgraph_bfs(spark, sf):
    out = _neighbourhood(spark, sf)
    return _flat(
        out.nodes.filter(F.col("level").isNotNull())
        .withColumn("level", F.col("level").cast("bigint")).join(out.flags, T.REQ),
        "id", "level", "truncated",
    )


@query("ancestor_closure", with_graph(
    bfs_sql("SELECT id AS req, id FROM nodes", "relations", "nodes", 0, 80) + """
SELECT req AS request_id, id FROM anc"""))
def ancestor_closure(spark, sf):
    """Physical ancestors of every node, each node being its own request."""
    all_nodes = star_nodes(spark, sf)
    selected = all_nodes.select(
        *SCOPE, F.col("id").alias("request_id"), "id", F.lit(0).alias("level")
    )
    return _flat(T.ancestor_closure(all_nodes, selected)[0], "id")


@query("induced_edges", with_graph(_BFS + """
SELECT req AS request_id, id, source_id, target_id, pos AS position FROM edge"""))
def induced_edges(spark, sf):
    out = _neighbourhood(spark, sf)
    return _flat(out.relations, "id", "source_id", "target_id", "position")


@query("subgraph_by_relation", with_graph(bfs_sql(
    """SELECT id AS req, source_id AS id FROM imports UNION ALL
       SELECT id, target_id FROM imports""", "imports", "nodes", 0, 8) + """
SELECT req AS request_id, id, 'node' AS part FROM chosen
UNION ALL SELECT req, id, 'edge' FROM edge
UNION ALL SELECT 'missing:' || o_orderkey, NULL, 'unknown relation' FROM orders"""))
def subgraph_by_relation(spark, sf):
    """Every import relation as an anchor, plus one unknown anchor per order."""
    g = star_graph(spark, sf, types=("imports",))
    asked = g.relations.select(*SCOPE, F.col("id").alias("request_id"),
                               F.col("id").alias("relation_id"))
    ghost = F.concat(F.lit("missing:"), F.col("o_orderkey").cast("string"))
    ghosts = table(spark, sf, "orders").select(
        F.lit("shop").alias("project_id"), F.lit("full").alias("snapshot_id"),
        ghost.alias("request_id"), ghost.alias("relation_id"),
    )
    seeds, bad = T.seeds_from_relations(g.relations, asked.unionByName(ghosts))
    out = T.subgraph(g.nodes, g.relations, stage(seeds, "seeds"), 0, 8, ("imports",))
    return (
        _flat(out.nodes, "id", F.lit("node").alias("part"))
        .unionByName(_flat(out.relations, "id", F.lit("edge").alias("part")))
        .unionByName(bad.select("request_id", F.lit(None).cast("string").alias("id"),
                                F.lit("unknown relation").alias("part")))
    )


@query("function_dependencies", with_graph(bfs_sql(
    "SELECT id AS req, id FROM nodes WHERE kind = 'function'",
    """(SELECT id, source_id, CASE resolution WHEN 'resolved' THEN target_id END AS target_id
        FROM calls)""",
    "(SELECT * FROM nodes WHERE kind <> 'external')", 1, 12) + """,
u AS (SELECT source_id AS node_id, count(*) AS unknown FROM calls WHERE resolution <> 'resolved'
      GROUP BY 1)
SELECT c.req AS request_id, c.id, coalesce(unknown, 0) AS unknown, o.req IS NOT NULL AS truncated
FROM chosen c LEFT JOIN u ON u.node_id = c.req LEFT JOIN over_ o ON o.req = c.req""", once=True))
def function_dependencies(spark, sf):
    g = star_graph(spark, sf, types=CALLS)
    all_nodes, calls = g.nodes, g.relations
    roots = all_nodes.filter(F.col("kind") == "function").select(
        *SCOPE, F.col("id").alias("request_id"), F.col("id").alias("node_id")
    )
    out = T.function_dependencies(all_nodes, calls, roots, 12)
    unknown = C.unknown_count(calls, roots).withColumnRenamed("node_id", "request_id")
    return _flat(out.nodes.join(unknown, T.REQ).join(out.flags, T.REQ),
                 "id", "unknown", "truncated")


@query("file_dependencies", with_graph("""
owner AS (SELECT id, CASE kind WHEN 'file' THEN id ELSE parent_id END AS file_id FROM nodes
          WHERE kind IN ('file', 'function')),
o AS (SELECT r.id, r.type, r.resolution, s.file_id AS sf, t.file_id AS tf FROM relations r
      JOIN owner s ON r.source_id = s.id LEFT JOIN owner t ON r.target_id = t.id
      WHERE type <> 'contains'),
pairs AS MATERIALIZED (SELECT sf, tf, CASE WHEN bool_or(type = 'imports') THEN 'imports'
            ELSE 'calls' END AS type FROM o
          WHERE resolution = 'resolved' AND tf IS NOT NULL AND sf <> tf GROUP BY sf, tf),
unk AS (SELECT sf AS root, id, type FROM o WHERE resolution <> 'resolved' OR tf IS NULL),
touch AS (SELECT sf AS root, tf AS other, * FROM pairs UNION ALL SELECT tf, sf, * FROM pairs),
near AS (SELECT root, other, row_number() OVER (PARTITION BY root ORDER BY other) AS rn
         FROM (SELECT DISTINCT root, other FROM touch)),
e AS (SELECT t.root, 'file:["' || sf || '","' || tf || '"]' AS id, sf AS source_id,
        tf AS target_id, type FROM touch t JOIN near n ON n.root = t.root AND n.other = t.other
        AND rn < 30
      UNION ALL SELECT root, 'file:' || id, root, NULL, type FROM unk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS position,
             count(*) OVER (PARTITION BY root) AS edges FROM e),
f AS (SELECT n.id AS root, (SELECT count(*) FROM unk u WHERE u.root = n.id) AS unknown,
        (SELECT count(*) FROM near x WHERE x.root = n.id) AS neighbours
      FROM nodes n WHERE n.kind = 'file')
SELECT r.root, id, source_id, target_id, type, position, unknown,
  neighbours + 1 > 30 OR edges > 90 AS truncated
FROM ranked r JOIN f USING (root) WHERE position <= 90"""))
def file_dependencies(spark, sf):
    g = star_graph(spark, sf, types=FACTS)
    roots = _requests(g.nodes, F.col("kind") == "file")
    _, edges, flags = T.file_dependencies(g.nodes, g.relations, roots, 30)
    return edges.join(flags, [*SCOPE, "root"]).drop(*SCOPE, "neighbours")


@query("graph_union", with_graph("""
pairs AS (SELECT DISTINCT source_id, target_id, id FROM imports),
newn AS (SELECT target_id AS req, source_id AS id FROM pairs UNION SELECT target_id, target_id
         FROM pairs),
oldn AS (SELECT n.id AS req, k.id FROM nodes n JOIN nodes k ON k.parent_id = n.parent_id
         AND k.kind = 'file' WHERE n.kind = 'file' AND n.id IN (SELECT req FROM newn)),
alln AS (SELECT req, id, 0 AS part FROM newn UNION ALL SELECT req, id, 1 FROM oldn o
         WHERE NOT EXISTS (SELECT 1 FROM newn n WHERE n.req = o.req AND n.id = o.id)),
rankn AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY part, id) AS position,
          count(*) OVER (PARTITION BY req) AS total FROM alln)
SELECT req AS request_id, id, position, total > 60 AS truncated FROM rankn WHERE position <= 60"""))
def graph_union(spark, sf):
    """Each imported file as new root: its importers, beside the earlier view of its folder."""
    g = star_graph(spark, sf, types=("imports",))
    rel = g.relations
    new_edges = rel.select(*SCOPE, F.col("target_id").alias("request_id"), "id", "source_id",
                           "target_id", "type", F.col("id").alias("ord"))
    new_nodes = new_edges.select(
        *SCOPE, "request_id", F.explode(F.array("source_id", "target_id")).alias("id")
    ).distinct().withColumn("ord", F.col("id"))
    roots = new_nodes.select(*SCOPE, "request_id", F.col("request_id").alias("node_id")).distinct()
    files = g.nodes.filter(F.col("kind") == "file").select(*SCOPE, "id", "parent_id")
    # The earlier view: the files of the root's folder, capped like any view before the union.
    view = P.top_n(files, [*SCOPE, "parent_id"], [F.col("id")], 300).drop("position")
    shown = (
        roots.select(*SCOPE, "request_id")
        .join(files.withColumnRenamed("id", "request_id"), T.REQ)
        .join(view, [*SCOPE, "parent_id"])
        .select(*T.REQ, "id", F.col("id").alias("ord"))
    )
    no_edges = new_edges.limit(0)
    nodes, _, flags = T.graph_union(shown, no_edges, new_nodes, new_edges, roots, 60, 900)
    return _flat(nodes.join(flags, T.REQ), "id", "position", "truncated")
