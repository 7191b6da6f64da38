"""View projections, plan overlay and edits, routes, components and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import condense as Z
from ..operators import views as V
from ..operators.asked import Asked
from ..operators.paging import top_n
from ..plans import overlay as O
from ..plans import state as S
from ..schemas import SCOPE
from ..sources import plan_log as L
from ..sources.star_graph import star_graph
from ..staging import stage, table
from .knowledge import with_notes
from .plan_prelude import with_plans
from .plans import _load
from .prelude import with_graph
from .registry import query

# ---- lanes: every function with its resolved callers and callees; siblings are side context ------
_LANES = """
e AS (SELECT id, source_id AS s, target_id AS t FROM calls WHERE resolution = 'resolved'
      UNION ALL SELECT id, source_id, target_id FROM imports),
both_ AS (SELECT s AS root, t AS id, false AS inn, true AS out FROM e WHERE s <> t
          UNION ALL SELECT t, s, true, false FROM e WHERE s <> t),
nb AS MATERIALIZED (SELECT root, id, bool_or(inn) AS inn, bool_or(out) AS out FROM both_
      GROUP BY 1, 2),
lanes AS MATERIALIZED (SELECT root, id, CASE WHEN inn THEN 'dependent' ELSE 'dependency' END AS lane,
    inn AND out AS reciprocal FROM nb
  UNION ALL SELECT id, id, 'selected', false FROM nodes WHERE kind IN ('function', 'file')
  UNION ALL SELECT c.source_id, c.target_id, 'side', false FROM contain c JOIN nodes f
    ON f.id = c.source_id AND f.kind = 'file'),
card AS (SELECT l.*, n.kind, n.file_path FROM lanes l JOIN nodes n ON n.id = l.id)"""


def _lanes(spark, sf, linked_only=False):
    """Roots are all functions and files; a file's own functions are its side context.

    ``linked_only`` leaves out what has no link to its root (no lane of dependents holds it)."""
    g = star_graph(spark, sf)
    links = g.relations.filter(
        F.col("type").isin("calls", "imports") & (F.col("resolution") == "resolved"))
    ends = F.explode(F.array("source_id", "target_id"))
    edges = links.select("id", "type", F.col("source_id").alias("source"),
                         F.col("target_id").alias("target"), ends.alias("root"))
    near = edges.select("root", F.when(F.col("root") == F.col("source"), F.col("target"))
                        .otherwise(F.col("source")).alias("id"))
    if linked_only:
        return g, edges, V.lane_assign(near.distinct(), edges)
    own = g.nodes.filter(F.col("kind").isin("function", "file")).select(
        F.col("id").alias("root"), "id")
    inside = g.nodes.filter(F.col("kind") == "function").select(
        F.col("parent_id").alias("root"), "id")
    view = near.unionByName(own).unionByName(inside).distinct()
    return g, edges, V.lane_assign(view, edges)


def _cards(g, lanes):
    return lanes.join(g.nodes.select("id", "kind", "file_path"), "id")


@query("lane_assign", with_graph(_LANES + "\nSELECT root, id, lane, reciprocal FROM lanes"))
def lane_assign(spark, sf):
    return _lanes(spark, sf)[2]


@query("lane_intersection", with_graph(_LANES + "\nSELECT root, id FROM nb WHERE inn AND out"))
def lane_intersection(spark, sf):
    return V.lane_intersection(_lanes(spark, sf)[2])


@query("reciprocal_count", with_graph(_LANES + """
SELECT root, count(*) FILTER (WHERE reciprocal) AS reciprocal FROM lanes GROUP BY root"""))
def reciprocal_count(spark, sf):
    return V.reciprocal_count(_lanes(spark, sf)[2])


@query("lane_page", with_graph(_LANES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY root, lane ORDER BY id) AS position,
        count(*) OVER (PARTITION BY root, lane) AS total FROM lanes),
q AS (SELECT *, CAST(ceil(total / 3.0) AS BIGINT) AS pages FROM r),
w AS (SELECT *, least(1, pages - 1) AS page FROM q)
SELECT root, lane, id, page, pages, total, page * 3 + 1 AS range_start,
  least(page * 3 + 3, total) AS range_end FROM w
WHERE position > page * 3 AND position <= page * 3 + 3"""))
def lane_page(spark, sf):
    return V.lane_page(_lanes(spark, sf)[2], 1, 3).withColumn(
        "page", F.col("page").cast("bigint")).withColumn(
        "range_start", F.col("range_start").cast("bigint"))


_GROUPS = _LANES + r""",
cp AS (SELECT *, CASE WHEN kind = 'file' THEN regexp_replace(file_path, '/[^/]*$', '')
         ELSE file_path END AS path FROM card WHERE lane IN ('dependent', 'dependency')),
g0 AS (SELECT root, lane, path, count(*) AS members, arg_min(kind, id) AS fk FROM cp
       GROUP BY 1, 2, 3),
g1 AS (SELECT g.*, n.file_path AS rp, string_split(CASE WHEN fk = 'file' THEN path
         ELSE regexp_replace(path, '/[^/]*$', '') END, '/') AS x,
         string_split(regexp_replace(n.file_path, '/[^/]*$', ''), '/') AS y,
         sum(members) OVER (PARTITION BY root, lane) AS lane_total
       FROM g0 g JOIN nodes n ON n.id = g.root),
g2 AS (SELECT *, CAST(CASE WHEN path = rp THEN -1 ELSE len(x) + len(y) - 2 * CASE
         WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1 ELSE 2 END END AS BIGINT) AS distance
       FROM g1),
g3 AS MATERIALIZED (SELECT root, lane, path, members, distance, lane_total > 5 AND row_number()
         OVER (PARTITION BY root, lane ORDER BY distance, path) > 2 AS collapsed FROM g2)"""


def _groups(spark, sf):
    g, edges, lanes = _lanes(spark, sf, linked_only=True)
    cards = stage(_cards(g, lanes.filter(
        F.col("lane").isin("dependent", "dependency"))), "lane-cards")
    roots = g.nodes.select(F.col("id").alias("root"), F.col("file_path").alias("root_path"))
    return g, edges, cards, V.lane_group_by_path(cards, roots, 5, 2)


@query("lane_group_by_path", with_graph(_GROUPS + "\nSELECT * FROM g3"))
def lane_group_by_path(spark, sf):
    return _groups(spark, sf)[3]


@query("fold_edges", with_graph(_GROUPS + """,
hid AS (SELECT c.root, c.id, 'filegroup:' || c.lane || ':' || c.path AS h FROM cp c JOIN g3
        ON g3.root = c.root AND g3.lane = c.lane AND g3.path = c.path AND collapsed),
ve AS (SELECT s AS root, id, s, t FROM e UNION ALL SELECT t, id, s, t FROM e),
m AS (SELECT v.root, v.id, coalesce(a.h, v.s) AS s2, coalesce(b.h, v.t) AS t2,
        a.h IS NOT NULL OR b.h IS NOT NULL AS moved FROM ve v
      LEFT JOIN hid a ON a.root = v.root AND a.id = v.s
      LEFT JOIN hid b ON b.root = v.root AND b.id = v.t)
SELECT root, id, s2 AS source, t2 AS target, 1 AS merged FROM m WHERE NOT moved AND s2 <> t2
UNION ALL SELECT root, 'fg:' || s2 || '>' || t2, s2, t2, count(*) FROM m WHERE moved
  AND s2 <> t2 AND (s2 = root OR t2 = root) GROUP BY root, s2, t2"""))
def fold_edges(spark, sf):
    _, edges, cards, groups = _groups(spark, sf)
    return V.fold_edges(edges, V.hidden_cards(cards, groups))


# ---- frames ---------------------------------------------------------------------------------------
@query("bounding_frames", with_graph("""
c AS (SELECT file_path, start_line * 40 AS x, length(name) * 30 AS y FROM nodes
      WHERE kind = 'function')
SELECT file_path, min(x) - 24 AS x0, min(y) - 24 AS y0, max(x) + 270 - min(x) + 48 AS width,
  max(y) + 150 - min(y) + 48 AS height FROM c GROUP BY file_path"""))
def bounding_frames(spark, sf):
    g = star_graph(spark, sf)
    none = F.lit(None).cast("bigint")
    cards = g.nodes.filter(F.col("kind") == "function").select(
        "file_path", (F.col("start_line") * 40).alias("x"),
        (F.length("name") * 30).cast("bigint").alias("y"), none.alias("w"), none.alias("h"))
    return V.bounding_frames(cards, "file_path")


_POS = """
c AS (SELECT id, kind, parent_id, CAST(length(name) * 97 AS BIGINT) AS x,
        CAST(coalesce(start_line, length(id)) * 53 AS BIGINT) AS y FROM nodes
      WHERE kind IN ('file', 'folder'))"""


@query("nested_frames", with_graph(_POS + """,
b AS (SELECT *, x AS x0, y AS y0, x + 270 AS x1, y + 150 AS y1 FROM c),
f3 AS (SELECT p.id, least(min(k.x0), p.x0) - 28 AS x0, least(min(k.y0), p.y0) - 54 AS y0,
    greatest(max(k.x1), p.x1) + 28 AS x1, greatest(max(k.y1), p.y1) + 28 AS y1
  FROM b k JOIN b p ON p.id = k.parent_id WHERE k.kind = 'file'
  GROUP BY p.id, p.x0, p.y0, p.x1, p.y1),
f2 AS (SELECT p.id, least(min(k.x0), p.x0) - 28 AS x0, least(min(k.y0), p.y0) - 54 AS y0,
    greatest(max(k.x1), p.x1) + 28 AS x1, greatest(max(k.y1), p.y1) + 28 AS y1
  FROM (SELECT f.id, c.parent_id, f.x0, f.y0, f.x1, f.y1 FROM f3 f JOIN c ON c.id = f.id
        UNION ALL SELECT id, parent_id, x0, y0, x1, y1 FROM b WHERE kind = 'folder'
          AND id NOT IN (SELECT id FROM f3) AND parent_id LIKE 'folder:r%') k
  JOIN b p ON p.id = k.parent_id GROUP BY p.id, p.x0, p.y0, p.x1, p.y1),
f1 AS (SELECT p.id, least(min(k.x0), p.x0) - 28 AS x0, least(min(k.y0), p.y0) - 54 AS y0,
    greatest(max(k.x1), p.x1) + 28 AS x1, greatest(max(k.y1), p.y1) + 28 AS y1
  FROM (SELECT f.id, c.parent_id, f.x0, f.y0, f.x1, f.y1 FROM f2 f JOIN c ON c.id = f.id) k
  JOIN b p ON p.id = k.parent_id GROUP BY p.id, p.x0, p.y0, p.x1, p.y1)
SELECT * FROM f3 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f1"""))
def nested_frames(spark, sf):
    g = star_graph(spark, sf)
    cards = g.nodes.filter(F.col("kind").isin("file", "folder")).select(
        "id", "kind", (F.length("name") * 97).cast("bigint").alias("x"),
        (F.coalesce("start_line", F.length("id")) * 53).cast("bigint").alias("y"))
    links = g.relations.filter(F.col("type") == "contains").select(
        F.col("source_id").alias("parent"), F.col("target_id").alias("child"))
    return V.nested_frames(cards, links)


@query("rect_overlap_pairs", with_graph("""
b AS MATERIALIZED (SELECT id, parent_id AS board, CAST(start_line * 67 AS BIGINT) AS x,
        CAST(length(name) * 45 AS BIGINT) AS y FROM nodes WHERE kind = 'function'),
s AS (SELECT board, x, y, count(*) AS boxes FROM b GROUP BY 1, 2, 3),
o AS (SELECT a.board, a.x, a.y, sum(c.boxes) AS others FROM s a JOIN s c ON c.board = a.board
      AND (c.x > a.x OR (c.x = a.x AND c.y > a.y)) AND abs(c.x - a.x) < 300
      AND abs(c.y - a.y) < 220 GROUP BY 1, 2, 3)
SELECT s.board, s.x, s.y, boxes, CAST(boxes * (boxes - 1) // 2 + boxes * coalesce(others, 0)
  AS BIGINT) AS pairs FROM s LEFT JOIN o ON o.board = s.board AND o.x = s.x AND o.y = s.y"""))
def rect_overlap_pairs(spark, sf):
    boxes = star_graph(spark, sf).nodes.filter(F.col("kind") == "function").select(
        "id", F.col("parent_id").alias("board"),
        (F.col("start_line") * 67).cast("bigint").alias("x"),
        (F.length("name") * 45).cast("bigint").alias("y"))
    return V.rect_overlaps(boxes, "board")


# ---- groups: products by brand and by type --------------------------------------------------------
_GRP = """
gr AS (SELECT DISTINCT 'b:' || p_brand AS group_id, false AS collapsed FROM part
       UNION SELECT DISTINCT 't:' || p_type, p_type < 'M' FROM part),
mem AS (SELECT DISTINCT g AS group_id, id FROM (
    SELECT 'b:' || p_brand AS g, 'function:s' || l_suppkey || 'p' || l_partkey AS id
      FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 't:' || p_type, 'function:s' || l_suppkey || 'p' || l_partkey
      FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 't:' || p_type, 'function:x' || p_partkey FROM part)),
inside AS MATERIALIZED (SELECT m.*, collapsed FROM mem m JOIN nodes n ON n.id = m.id
    AND n.kind = 'function' JOIN gr USING (group_id))"""


def _group_tables(spark, sf):
    part = table(spark, sf, "part")
    brand, kind = F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("t:"), "p_type")
    groups = part.select(brand.alias("group_id"), F.lit(False).alias("collapsed")).unionByName(
        part.select(kind.alias("group_id"), (F.col("p_type") < "M").alias("collapsed"))).distinct()
    offers = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(
        part, F.col("l_partkey") == F.col("p_partkey"))
    fid = F.concat(F.lit("function:s"), F.col("l_suppkey").cast("string"), F.lit("p"),
                   F.col("l_partkey").cast("string"))
    members = offers.select(F.explode(F.array(brand, kind)).alias("group_id"), fid.alias("id")) \
        .unionByName(part.select(kind.alias("group_id"), F.concat(
            F.lit("function:x"), F.col("p_partkey").cast("string")).alias("id")))
    return groups, members


@query("group_projection", with_graph(_GRP + """
SELECT id AS view_id, 'node' AS role, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS unknown
FROM nodes ANTI JOIN inside USING (id)
UNION ALL SELECT 'group:' || group_id, 'group', count(*), count(*) FILTER (WHERE f.id IS NULL)
  FROM mem LEFT JOIN (SELECT id FROM nodes WHERE kind = 'function') f USING (id)
  WHERE group_id IN (SELECT group_id FROM inside) GROUP BY group_id
UNION ALL SELECT 'group-member:' || group_id || ':' || id, 'alias', NULL, NULL FROM inside
  WHERE NOT collapsed""", once=True))
def group_projection(spark, sf):
    groups, members = _group_tables(spark, sf)
    nodes = star_graph(spark, sf).nodes.select("id", "kind", F.lit("fact").alias("layer"))
    return V.group_projection(nodes, groups, members)


_ROUTES = _GRP + """,
edges AS MATERIALIZED (SELECT id, source_id AS source, target_id AS target FROM calls
    WHERE resolution = 'resolved'
  UNION ALL SELECT 'contains:' || id, parent_id, id FROM nodes WHERE kind = 'function'),
hitv AS (SELECT e.id, e.source, e.target, g.group_id FROM edges e JOIN inside g
    ON g.id = e.source OR g.id = e.target),
firsts AS (SELECT id, min(group_id) AS fg FROM inside GROUP BY id),
ends AS (SELECT e.*, s.fg AS sf, t.fg AS tf FROM edges e LEFT JOIN firsts s ON s.id = e.source
    LEFT JOIN firsts t ON t.id = e.target),
aff AS (SELECT e.id, i.group_id, true AS ins, false AS inq FROM edges e JOIN inside i
    ON i.id = e.source UNION ALL SELECT e.id, i.group_id, false, true FROM edges e JOIN inside i
    ON i.id = e.target),
aff2 AS MATERIALIZED (SELECT id, group_id, bool_or(ins) AS ins, bool_or(inq) AS inq FROM aff
    GROUP BY 1, 2),
rt AS (SELECT e.id, source, target, CASE WHEN ins THEN 1 ELSE 2 END AS p, group_id AS gk,
    CASE WHEN ins THEN group_id ELSE sf END AS sg, CASE WHEN inq THEN group_id ELSE tf END AS tg
  FROM ends e JOIN aff2 a ON a.id = e.id
  UNION ALL SELECT id, source, target, 0, '', sf, tf FROM ends
    WHERE sf IS NOT NULL OR tf IS NOT NULL),
rv AS (SELECT r.id, p, gk, CASE WHEN sg IS NULL THEN source WHEN a.collapsed THEN 'group:' || sg
      ELSE 'group-member:' || sg || ':' || source END AS source_view,
    CASE WHEN tg IS NULL THEN target WHEN b.collapsed THEN 'group:' || tg
      ELSE 'group-member:' || tg || ':' || target END AS target_view,
    CASE WHEN a.collapsed THEN source END AS source_port,
    CASE WHEN b.collapsed THEN target END AS target_port
  FROM rt r LEFT JOIN gr a ON a.group_id = sg LEFT JOIN gr b ON b.group_id = tg),
rd AS (SELECT id, source_view, target_view, source_port, target_port, min((p, gk)) AS turn FROM rv
  WHERE NOT (source_view = target_view AND starts_with(source_view, 'group:'))
  GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS n,
    count(*) OVER (PARTITION BY id) AS k FROM rd),
routes AS MATERIALIZED (SELECT 'group-edge:' || id || ':' || (n - 1) AS edge_id, id, source_view,
    target_view, source_port, target_port, k > 1 AS mirrored FROM rn
  UNION ALL SELECT id, id, source, target, NULL, NULL, false FROM ends
    WHERE sf IS NULL AND tf IS NULL)"""


def _routes(spark, sf):
    groups, members = _group_tables(spark, sf)
    g = star_graph(spark, sf)
    nodes = g.nodes.select("id", "kind", F.lit("fact").alias("layer"))
    calls = g.relations.filter(
        (F.col("type") == "calls") & (F.col("resolution") == "resolved"))
    inside = g.relations.filter(
        (F.col("type") == "contains") & F.col("target_id").startswith("function:"))
    edges = calls.unionByName(inside).select(
        "id", F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return V.group_edge_routes(edges, nodes, groups, members)


@query("group_edge_routes", with_graph(_ROUTES + "\nSELECT * FROM routes"))
def group_edge_routes(spark, sf):
    return _routes(spark, sf)[0]


@query("group_ports", with_graph(_ROUTES + """
SELECT DISTINCT source_view AS card, source_port AS port FROM routes WHERE source_port IS NOT NULL
UNION SELECT DISTINCT target_view, target_port FROM routes WHERE target_port IS NOT NULL"""))
def group_ports(spark, sf):
    return V.group_ports(_routes(spark, sf)[0])


@query("circle_functions", with_graph("SELECT id FROM nodes WHERE kind = 'function'"))
def circle_functions(spark, sf):
    """A selection that holds every node twice, once through its container."""
    g = star_graph(spark, sf)
    view = g.nodes.select("id", "kind", F.lit("fact").alias("layer"))
    return V.circle_functions(view.unionByName(view))


@query("member_bindings", with_graph(_GRP + """,
m AS (SELECT group_id, id, CASE WHEN group_id LIKE 'b:%' THEN 'full' ELSE 'old' END AS ss FROM mem),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id) AS position FROM m)
SELECT group_id, r.id, position, CASE WHEN n.id IS NULL THEN 'missing' WHEN ss <> 'full'
  THEN 'snapshot-changed' ELSE 'bound' END AS status
FROM r LEFT JOIN nodes n ON n.id = r.id WHERE position BETWEEN 21 AND 40"""))
def member_bindings(spark, sf):
    _, members = _group_tables(spark, sf)
    seen = members.distinct().withColumn(
        "snapshot_id", F.when(F.col("group_id").startswith("b:"), "full").otherwise("old")
    ).withColumn("project_id", F.lit("shop"))
    graph = star_graph(spark, sf)
    return V.member_bindings(seen, graph.nodes, graph.snapshots, 20, 20)


@query("group_change_detect", with_graph(_GRP + """
SELECT DISTINCT group_id, group_id LIKE 't:%' AS changed FROM mem"""))
def group_change_detect(spark, sf):
    """The same groups with members repeated (no change) and without unknown members (change)."""
    _, members = _group_tables(spark, sf)
    before = members.select("group_id", F.col("group_id").alias("title"),
                            F.lit("d").alias("description"), "id")
    after = before.unionByName(before).filter(~F.col("id").startswith("function:x"))
    return V.group_change_detect(before, after)


@query("valid_group_members", with_graph(_GRP + """
SELECT group_id, 'MEMBER' AS code, id AS detail FROM mem WHERE id LIKE 'function:x%'
UNION ALL SELECT group_id, 'TITLE', NULL FROM gr WHERE collapsed"""))
def valid_group_members(spark, sf):
    groups, members = _group_tables(spark, sf)
    titled = groups.withColumn("title", F.when(F.col("collapsed"), " ").otherwise("t"))
    return V.valid_group_members(titled, members.distinct(), star_graph(spark, sf).nodes)


@query("collapsed_known_groups", with_graph(_GRP + """
SELECT DISTINCT 'shop' AS project_id, 'b:' || p_brand AS group_id FROM part"""))
def collapsed_known_groups(spark, sf):
    groups, _ = _group_tables(spark, sf)
    asked = table(spark, sf, "part").select(F.lit("shop").alias("project_id"), F.explode(F.array(
        F.concat(F.lit("b:"), "p_brand"), F.concat(F.lit("x:"), "p_brand"))).alias("group_id"))
    return V.collapsed_known_groups(asked, groups.withColumn("project_id", F.lit("shop")))


@query("normalize_view", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount = 0 OR l_tax = 0
  THEN 'NOT_FINITE' END AS problem FROM lineitem""")
def normalize_view(spark, sf):
    """Positions whose coordinates divide by discount and tax: zero gives infinity or NaN."""
    zero = lambda c: F.when(F.col(c) == 0, F.lit(float("nan"))).otherwise(1 / F.col(c))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey",
        "l_quantity", zero("l_discount").alias("x"),
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(1 / F.col("l_tax")).alias("y"))
    return V.normalize_view(rows).drop("x", "y")


# ---- highlight: one request per customer file ----------------------------------------------------------
_FOCUS = """
req AS (SELECT f.id AS request_id, min(o.id) AS node_id FROM nodes f JOIN nodes o
        ON o.parent_id = f.id WHERE f.language = 'python' AND f.kind = 'file' GROUP BY f.id),
ed AS (SELECT n.parent_id AS request_id, c.id, c.source_id AS source, c.target_id AS target
       FROM calls c JOIN nodes n ON n.id = c.source_id WHERE c.target_id IS NOT NULL),
nd AS (SELECT parent_id AS request_id, id FROM nodes WHERE language = 'python'
         AND kind = 'function' UNION SELECT request_id, target FROM ed),
act AS (SELECT e.* FROM ed e JOIN req r ON r.request_id = e.request_id
        AND (e.source = r.node_id OR e.target = r.node_id)),
near AS (SELECT request_id, source AS id FROM act UNION SELECT request_id, target FROM act)"""


def _focus(spark, sf):
    g = star_graph(spark, sf)
    python = g.nodes.filter((F.col("language") == "python") & (F.col("kind") == "function"))
    asked = python.groupBy(F.col("parent_id").alias("request_id")).agg(
        F.min("id").alias("node_id")).withColumn("relation_id", F.lit(None).cast("string"))
    edges = g.relations.filter((F.col("type") == "calls") & F.col("target_id").isNotNull()).select(
        "id", F.col("source_id").alias("source"), F.col("target_id").alias("target")
    ).join(python.select(F.col("id").alias("source"), F.col("parent_id").alias("request_id")),
           "source").select("request_id", "id", "source", "target")
    nodes = python.select(F.col("parent_id").alias("request_id"), "id").unionByName(
        edges.select("request_id", F.col("target").alias("id"))).distinct()
    return nodes, edges, asked


@query("focus_roles", with_graph(_FOCUS + """
SELECT n.request_id, n.id, 'node' AS part, CASE WHEN n.id = r.node_id THEN 'selected'
  WHEN x.id IS NOT NULL THEN 'neighbor' ELSE 'muted' END AS role
FROM nd n JOIN req r ON r.request_id = n.request_id
LEFT JOIN near x ON x.request_id = n.request_id AND x.id = n.id
UNION ALL SELECT e.request_id, e.id, 'edge', CASE WHEN e.source <> r.node_id
    AND e.target <> r.node_id THEN 'muted' WHEN e.target = r.node_id THEN 'incoming'
    ELSE 'outgoing' END
FROM ed e JOIN req r ON r.request_id = e.request_id"""))
def focus_roles(spark, sf):
    nodes, edges = V.focus_roles(*_focus(spark, sf))
    return nodes.withColumn("part", F.lit("node")).unionByName(
        edges.withColumn("part", F.lit("edge")))


@query("focus_targets", with_graph(_FOCUS + _GRP.replace("\ngr AS", ",\ngr AS", 1) + """
SELECT DISTINCT request_id, view_id FROM (
  SELECT request_id, target AS id FROM ed) q
JOIN (SELECT id, 'fact:' || id AS view_id FROM nodes
      UNION ALL SELECT id, 'group:' || group_id FROM inside) v USING (id)"""))
def focus_targets(spark, sf):
    _, edges, _ = _focus(spark, sf)
    groups, members = _group_tables(spark, sf)
    nodes = star_graph(spark, sf).nodes
    view = nodes.select("id", F.concat(F.lit("fact:"), "id").alias("view_id"))
    loaded = members.distinct().join(
        nodes.filter(F.col("kind") == "function").select("id"), "id", "left_semi")
    cards = loaded.select("id", F.concat(F.lit("group:"), "group_id").alias("view_id"))
    return V.focus_targets(view, cards, edges.select(
        "request_id", F.col("target").alias("node_id")).distinct())


# ---- components and ranks -------------------------------------------------------------------------------
_SCC = """
re AS MATERIALIZED (SELECT DISTINCT source_id AS a, target_id AS b FROM imports),
reach(a, b) AS (SELECT a, b FROM re UNION SELECT r.a, e.b FROM reach r JOIN re e ON e.a = r.b),
cyc AS MATERIALIZED (SELECT x.a AS id, min(x.b) AS c FROM reach x JOIN reach y ON y.a = x.b
    AND y.b = x.a GROUP BY x.a),
comp AS MATERIALIZED (SELECT n.id, coalesce(c.c, n.id) AS component FROM nodes n
    LEFT JOIN cyc c ON c.id = n.id WHERE kind <> 'external')"""


def _rec(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _components(spark, sf):
    g = star_graph(spark, sf)
    return g, Z.scc_condense(g.nodes, g.relations)


@query("scc_condense", _rec(with_graph(_SCC + "\nSELECT id, component FROM comp")))
def scc_condense(spark, sf):
    return _components(spark, sf)[1].drop(*SCOPE)


@query("dag_rank", _rec(with_graph(_SCC + """,
all_e AS (SELECT a, b FROM re UNION SELECT source_id, target_id FROM calls
          WHERE resolution = 'resolved'),
ce AS MATERIALIZED (SELECT DISTINCT s.component AS a, t.component AS b FROM all_e e
    JOIN comp s ON s.id = e.a JOIN comp t ON t.id = e.b WHERE s.component <> t.component),
walk(c, r) AS (SELECT DISTINCT component, 0 FROM comp UNION SELECT e.b, w.r + 1 FROM walk w
    JOIN ce e ON e.a = w.c)
SELECT c AS component, CAST(max(r) AS BIGINT) AS rank FROM walk GROUP BY c""")))
def dag_rank(spark, sf):
    g, components = _components(spark, sf)
    components = stage(components, "components")
    ranks = Z.dag_rank(components, Z.rank_edges(g.nodes, g.relations))
    return ranks.select("component", F.col("rank").cast("bigint").alias("rank"))


@query("structure_preorder", with_graph("""
SELECT n.id, CASE WHEN n.id = 'folder:.' THEN n.id WHEN p.id = 'folder:.' THEN p.id || chr(1) || n.id
  WHEN g.id = 'folder:.' THEN g.id || chr(1) || p.id || chr(1) || n.id
  ELSE h.id || chr(1) || g.id || chr(1) || p.id || chr(1) || n.id END AS sort_path
FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id LEFT JOIN nodes g ON g.id = p.parent_id
LEFT JOIN nodes h ON h.id = g.parent_id WHERE n.kind IN ('file', 'folder')""", once=True))
def structure_preorder(spark, sf):
    return Z.structure_preorder(star_graph(spark, sf).nodes).drop(*SCOPE).orderBy("sort_path")


# ---- overlay: a plan's view holds the functions it moves or removes and their calls ------------------------
_OV = """
vn AS MATERIALIZED (SELECT DISTINCT o.plan_id, o.node_id AS id FROM ops o JOIN bn ON bn.id = o.node_id
    WHERE o.node_id IS NOT NULL),
ved AS MATERIALIZED (SELECT v.plan_id, r.* FROM br r JOIN vn v ON v.id = r.source_id
    WHERE r.type = 'calls'),
refd AS MATERIALIZED (SELECT plan_id, node_id AS id FROM ops WHERE node_id IS NOT NULL
  UNION SELECT plan_id, source_id FROM ops WHERE source_id IS NOT NULL
  UNION SELECT plan_id, target_id FROM ops WHERE target_id IS NOT NULL
  UNION SELECT e.plan_id, e.source_id FROM ved e JOIN ops o ON o.plan_id = e.plan_id
    AND o.kind = 'remove_relation' AND o.relation_id = e.id
  UNION SELECT e.plan_id, e.target_id FROM ved e JOIN ops o ON o.plan_id = e.plan_id
    AND o.kind = 'remove_relation' AND o.relation_id = e.id WHERE e.target_id IS NOT NULL),
lastmove AS (SELECT plan_id, node_id AS id, arg_max(file_path, op_index) AS p FROM ops
  WHERE kind = 'move_function' GROUP BY 1, 2),
ovn0 AS (SELECT v.plan_id, v.id, 'fact' AS layer, bn.file_path FROM vn v JOIN bn ON bn.id = v.id
  UNION ALL SELECT o.plan_id, temp_id, 'plan', coalesce(m.p, o.file_path) FROM ops o
    LEFT JOIN lastmove m ON m.plan_id = o.plan_id AND m.id = o.temp_id
    WHERE kind = 'add_function'),
ovn AS MATERIALIZED (SELECT * FROM ovn0 UNION ALL SELECT r.plan_id, r.id, 'anchor', bn.file_path
  FROM refd r JOIN bn ON bn.id = r.id WHERE NOT EXISTS (SELECT 1 FROM ovn0 x
    WHERE x.plan_id = r.plan_id AND x.id = r.id)),
fx AS (SELECT DISTINCT plan_id, id FROM ovn WHERE layer <> 'plan'),
ax AS (SELECT DISTINCT plan_id, id FROM ovn)"""


def _overlay(spark, sf):
    c = _load(spark, sf, ("calls",))
    touched = S.of_kind(c.ops, "move_function", "remove_function")
    asked = Asked(touched.select("node_id"))
    view = touched.select("plan_id", F.col("node_id").alias("id")).distinct().join(
        asked.among(c.nodes.select("id"), "id"), "id", "left_semi")
    edges = asked.among(c.relations.filter(F.col("type") == "calls"), "source_id").join(
        view.withColumnRenamed("id", "source_id"), "source_id").drop(*SCOPE)
    view, edges = stage(view, "plan-view"), stage(edges, "plan-view-edges")
    return c, view, edges, O.overlay_nodes(view, c.ops, edges, c.nodes)


@query("overlay_referenced", with_plans(_OV + "\nSELECT * FROM refd"))
def overlay_referenced(spark, sf):
    c, _, edges, _ = _overlay(spark, sf)
    return O.overlay_referenced(c.ops, edges)


@query("plan_overlay", with_plans(_OV + """
SELECT plan_id, id, layer, file_path, NULL AS source_id, NULL AS target_id, NULL AS removed FROM ovn
UNION ALL SELECT e.plan_id, 'fact:' || e.id, 'fact', NULL, e.source_id, e.target_id,
  EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = e.plan_id AND o.kind = 'remove_relation'
    AND o.relation_id = e.id)
FROM ved e JOIN fx a ON a.plan_id = e.plan_id AND a.id = e.source_id
JOIN fx b ON b.plan_id = e.plan_id AND b.id = e.target_id
UNION ALL SELECT o.plan_id, 'plan:' || o.relation_id, 'plan', NULL, o.source_id, o.target_id, false
FROM ops o JOIN ax a ON a.plan_id = o.plan_id AND a.id = o.source_id
JOIN ax b ON b.plan_id = o.plan_id AND b.id = o.target_id WHERE o.kind = 'add_relation'"""))
def plan_overlay(spark, sf):
    c, _, edges, nodes = _overlay(spark, sf)
    none = F.lit(None).cast("string")
    drawn = O.overlay_edges(nodes, edges, c.ops)
    return nodes.select(
        "plan_id", "id", "layer", "file_path", none.alias("source_id"), none.alias("target_id"),
        F.lit(None).cast("boolean").alias("removed"),
    ).unionByName(drawn.withColumn("file_path", none))


@query("layer_filter", with_plans(_OV + """
SELECT plan_id, id, layer FROM ovn WHERE layer IN ('plan', 'anchor')"""))
def layer_filter(spark, sf):
    return O.layer_filter(_overlay(spark, sf)[3], "plan").select("plan_id", "id", "layer")


@query("overlay_notices", with_plans(_OV + """
SELECT plan_id, id, resolution || ' · ' || evidence_path || ':' || evidence_line || ' · ' ||
  evidence_text AS notice FROM ved WHERE resolution <> 'resolved'
UNION ALL SELECT o.plan_id, o.relation_id, 'outside: ' || CASE WHEN a.id IS NULL THEN o.source_id
  ELSE o.target_id END
FROM ops o LEFT JOIN ax a ON a.plan_id = o.plan_id AND a.id = o.source_id
LEFT JOIN ax b ON b.plan_id = o.plan_id AND b.id = o.target_id
WHERE o.kind = 'add_relation' AND (a.id IS NULL OR b.id IS NULL)"""))
def overlay_notices(spark, sf):
    c, _, edges, nodes = _overlay(spark, sf)
    return O.overlay_notices(nodes, edges, c.ops)


@query("op_changes_label", with_plans("""
m AS (SELECT plan_id, node_id AS id, max(op_index) AS op_index, arg_max(file_path, op_index) AS p
      FROM ops WHERE kind = 'move_function' GROUP BY 1, 2)
SELECT plan_id, id, op_index, '→ ' || p AS label FROM m
UNION ALL SELECT plan_id, node_id, op_index, '− removal' FROM ops WHERE kind = 'remove_function'
UNION ALL SELECT plan_id, target_id, op_index, 'note · ' || text FROM ops
  WHERE kind = 'annotate'"""))
def op_changes_label(spark, sf):
    return O.op_changes_label(L.plan_operations(spark, sf))


# ---- edits ------------------------------------------------------------------------------------------------
_PREV = """
prev AS MATERIALIZED (SELECT * FROM ops WHERE kind <> 'remove_function'
  UNION ALL SELECT plan_id, op_index, 'add_function', 'gone:' || op_index, 'g', 'a/b.py', NULL, NULL,
    NULL, NULL, NULL, NULL FROM ops WHERE kind = 'remove_function'),
tagc AS MATERIALIZED (SELECT 'added' AS side, o.*, concat_ws('|', o.kind, coalesce(temp_id, '-'),
    coalesce(name, '-'), coalesce(file_path, '-'), coalesce(language, '-'),
    coalesce(node_id, '-'), coalesce(relation_id, '-'), coalesce(source_id, '-'),
    coalesce(target_id, '-'), coalesce(text, '-')) AS content FROM ops o
  UNION ALL SELECT 'removed', o.*, concat_ws('|', o.kind, coalesce(temp_id, '-'),
    coalesce(name, '-'), coalesce(file_path, '-'), coalesce(language, '-'),
    coalesce(node_id, '-'), coalesce(relation_id, '-'), coalesce(source_id, '-'),
    coalesce(target_id, '-'), coalesce(text, '-')) FROM prev o),
chg AS MATERIALIZED (SELECT * FROM tagc t WHERE NOT EXISTS (SELECT 1 FROM tagc x
    WHERE x.plan_id = t.plan_id AND x.content = t.content AND x.side <> t.side))"""


def _previous(spark, sf):
    """The same plans before: planned functions in place of the removals."""
    ops = L.plan_operations(spark, sf).drop("ts")
    gone = F.col("kind") == "remove_function"
    none = F.lit(None).cast("string")
    before = ops.withColumn(
        "temp_id", F.when(gone, F.concat(F.lit("gone:"), F.col("op_index").cast("string")))
        .otherwise(F.col("temp_id"))
    ).withColumn("name", F.when(gone, "g").otherwise(F.col("name"))) \
        .withColumn("file_path", F.when(gone, "a/b.py").otherwise(F.col("file_path"))) \
        .withColumn("node_id", F.when(gone, none).otherwise(F.col("node_id"))) \
        .withColumn("kind", F.when(gone, "add_function").otherwise(F.col("kind")))
    return ops, before


@query("affected_operations", with_plans(_PREV + """
SELECT plan_id, op_index, kind, side FROM chg"""))
def affected_operations(spark, sf):
    return O.affected_operations(*_previous(spark, sf)).select(
        "plan_id", "op_index", "kind", "side")


@query("affected_nodes", with_plans(_PREV + """
SELECT DISTINCT plan_id, node_id AS id FROM chg WHERE node_id IS NOT NULL"""))
def affected_nodes(spark, sf):
    c = _load(spark, sf)
    return O.affected_nodes(*_previous(spark, sf), c.relations)


@query("delete_temporary", with_plans("""
d AS (SELECT DISTINCT plan_id, temp_id AS id FROM ops WHERE temp_id LIKE 'temp:u%'),
k AS (SELECT o.*, EXISTS (SELECT 1 FROM d WHERE d.plan_id = o.plan_id AND d.id IN
        (o.temp_id, o.node_id, o.source_id, o.target_id)) AS hit FROM ops o)
SELECT plan_id, op_index, kind FROM k WHERE NOT CASE kind WHEN 'annotate' THEN false
  WHEN 'remove_relation' THEN EXISTS (SELECT 1 FROM k x WHERE x.plan_id = k.plan_id
    AND x.kind = 'add_relation' AND x.hit AND x.relation_id = k.relation_id)
  ELSE hit END"""))
def delete_temporary(spark, sf):
    ops = L.plan_operations(spark, sf)
    doomed = ops.filter(F.col("temp_id").startswith("temp:u")).select("plan_id", "temp_id")
    return O.delete_temporary(ops, doomed).select("plan_id", "op_index", "kind")


_RT = """
req AS (SELECT plan_id, node_id, max(CASE WHEN op_index > 0 THEN 'next/' || node_id || '.py' END) AS t,
    min(op_index) AS f FROM ops WHERE kind = 'move_function' GROUP BY 1, 2),
want AS (SELECT r.plan_id, r.node_id, CASE WHEN node_id < 'function:o2' THEN bn.file_path
    WHEN node_id < 'function:o3' THEN '../x.py' ELSE 'next/a.py' END AS target, bn.file_path AS bp,
    f FROM req r JOIN bn ON bn.id = r.node_id AND bn.kind = 'function'),
ok AS MATERIALIZED (SELECT w.* FROM want w JOIN lastm l ON l.plan_id = w.plan_id
    AND l.id = w.node_id WHERE target <> '../x.py' AND l.p <> target
    AND NOT EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = w.plan_id AND o.node_id = w.node_id
      AND o.kind = 'remove_function'))"""


@query("retarget_coalesce", with_plans("""
lastm AS (SELECT plan_id, node_id AS id, arg_max(file_path, op_index) AS p FROM ops
  WHERE kind = 'move_function' GROUP BY 1, 2),""" + _RT + """
SELECT o.plan_id, o.op_index, o.kind, CASE WHEN k.node_id IS NOT NULL THEN k.target
  ELSE o.file_path END AS file_path
FROM ops o LEFT JOIN ok k ON k.plan_id = o.plan_id AND k.node_id = o.node_id
  AND o.kind = 'move_function'
WHERE k.node_id IS NULL OR (o.op_index = k.f AND k.target <> k.bp)"""))
def retarget_coalesce(spark, sf):
    """Moved functions get a new target: their old file, an escaping path or a new file."""
    c = _load(spark, sf, ())
    moved = S.of_kind(c.ops, "move_function").select("plan_id", "node_id").distinct().join(
        c.nodes.filter(F.col("kind") == "function").select(
            F.col("id").alias("node_id"), "file_path"), "node_id")
    asked = moved.select("plan_id", "node_id", F.when(
        F.col("node_id") < "function:o2", F.col("file_path")).when(
        F.col("node_id") < "function:o3", "../x.py").otherwise("next/a.py").alias("target"))
    return O.retarget_coalesce(c.ops, asked, c.nodes).select(
        "plan_id", "op_index", "kind", "file_path")


@query("reconnect_relation", with_plans("""
sz AS (SELECT plan_id, max(op_index) + 1 AS n FROM ops GROUP BY 1),
pr AS (SELECT DISTINCT plan_id, relation_id FROM ops WHERE kind = 'add_relation'),
fr AS (SELECT DISTINCT plan_id, target_id FROM ops WHERE kind = 'annotate' AND target_id LIKE 'f%'),
f2 AS (SELECT plan_id, 'contains:' || target_id AS d FROM fr)
SELECT plan_id, op_index, kind, relation_id, CASE kind WHEN 'add_relation' THEN 'a'
  ELSE source_id END AS source_id, CASE kind WHEN 'add_relation' THEN 'b' ELSE target_id END
  AS target_id FROM ops
UNION ALL SELECT f.plan_id, n, 'remove_relation', d, NULL, NULL FROM f2 f JOIN sz USING (plan_id)
  WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = f.plan_id AND o.kind = 'remove_relation'
    AND o.relation_id = d)
UNION ALL SELECT f.plan_id, n + 1, 'add_relation', 'new:' || d, 'a', 'b' FROM f2 f
  JOIN sz USING (plan_id)"""))
def reconnect_relation(spark, sf):
    """Every planned edge and the containment of every noted function get new ends."""
    ops = L.plan_operations(spark, sf)
    ends = [F.lit("a").alias("source"), F.lit("b").alias("target")]
    planned = S.of_kind(ops, "add_relation").select(
        "plan_id", F.lit("plan").alias("layer"), F.col("relation_id").alias("domain_id"), *ends,
        F.lit(None).cast("string").alias("new_id")).distinct()
    noted = S.of_kind(ops, "annotate").filter(F.col("target_id").startswith("f")).select(
        "plan_id", F.concat(F.lit("contains:"), "target_id").alias("domain_id")).distinct()
    facts = noted.select("plan_id", F.lit("fact").alias("layer"), "domain_id", *ends,
                         F.concat(F.lit("new:"), "domain_id").alias("new_id"))
    return O.reconnect_relation(ops, planned.unionByName(facts)).select(
        "plan_id", "op_index", "kind", "relation_id", "source_id", "target_id")


@query("edit_function", with_plans("""
sz AS (SELECT plan_id, max(op_index) + 1 AS n FROM ops GROUP BY 1),
ed AS (SELECT DISTINCT plan_id, temp_id AS id FROM ops WHERE kind = 'add_function'
       UNION SELECT DISTINCT plan_id, node_id FROM ops WHERE kind = 'move_function'),
nt AS (SELECT e.plan_id, e.id, concat_ws(chr(10), CASE WHEN bn.name <> '1-URGENT'
    THEN 'name: 1-URGENT' END, CASE WHEN coalesce(signature, '') <> '(F)' THEN 'signature: (F)' END)
    AS t FROM ed e JOIN bn ON bn.id = e.id WHERE NOT EXISTS (SELECT 1 FROM ops o
      WHERE o.plan_id = e.plan_id AND o.temp_id = e.id AND o.kind = 'add_function'))
SELECT plan_id, op_index, kind, CASE kind WHEN 'add_function' THEN '1-URGENT' ELSE name END AS name,
  target_id, text FROM ops
UNION ALL SELECT plan_id, n, 'annotate', NULL, id, t FROM nt JOIN sz USING (plan_id)
  WHERE t <> ''"""))
def edit_function(spark, sf):
    c = _load(spark, sf, ())
    ids = S.of_kind(c.ops, "add_function").select("plan_id", F.col("temp_id").alias("node_id")) \
        .unionByName(S.of_kind(c.ops, "move_function").select("plan_id", "node_id")).distinct()
    edits = ids.select("plan_id", "node_id", F.lit("1-URGENT").alias("name"),
                       F.lit("(F)").alias("signature"), F.lit("").alias("description"))
    return O.edit_function(c.ops, edits, c.nodes).select(
        "plan_id", "op_index", "kind", "name", "target_id", "text")


@query("scope_with_planned", with_plans("""
dest AS (SELECT plan_id, coalesce(temp_id, node_id) AS id, arg_max(file_path, op_index) AS target,
    min(op_index) AS first_at FROM ops o WHERE kind IN ('add_function', 'move_function')
  GROUP BY 1, 2),
dest2 AS MATERIALIZED (SELECT * FROM dest d WHERE NOT EXISTS (SELECT 1 FROM ops o
  WHERE o.plan_id = d.plan_id AND o.kind = 'remove_function' AND o.node_id = d.id)),
rq AS (SELECT DISTINCT plan_id, target AS path FROM dest2),
ls AS (SELECT r.plan_id, r.path, f.id, 0 AS part, CAST(0 AS BIGINT) AS at_ FROM rq r JOIN bn f
    ON f.file_path = r.path AND f.kind = 'file'
  UNION ALL SELECT r.plan_id, r.path, k.id, 0, row_number() OVER (PARTITION BY r.plan_id, r.path
    ORDER BY k.qualified_name) FROM rq r JOIN bn k ON k.file_path = r.path
    AND k.kind = 'function'),
al AS (SELECT * FROM ls UNION ALL SELECT plan_id, target, id, 1, first_at FROM dest2),
on_ AS (SELECT plan_id, path, id, min((part, at_)) AS turn FROM al GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, path ORDER BY turn, id) AS position,
    count(*) OVER (PARTITION BY plan_id, path) AS total FROM on_)
SELECT plan_id, path, id, position, total > 10 AS truncated FROM rk WHERE position <= 10"""))
def scope_with_planned(spark, sf):
    """Every planned file: its indexed functions first, then the functions planned into it."""
    from ..operators.search import navigation_scope

    c = _load(spark, sf, ())
    dest = S.planned_destinations(c.ops).select(
        "plan_id", F.col("target").alias("path"), F.lit("file").alias("kind"), "id", "first_at")
    asked = dest.select("plan_id", "path", "kind").distinct()
    requests = asked.select(F.lit("shop").alias("project_id"), F.lit("base").alias("snapshot_id"),
                            "path", "kind").distinct()
    listing = navigation_scope(c.nodes, requests).filter(~F.col("missing") & F.col("id").isNotNull())
    mine = asked.join(listing.select("path", "kind", "id", "position"), ["path", "kind"])
    return O.scope_with_planned(mine, dest, 10).select(
        "plan_id", "path", "id", "position", "truncated")


# ---- routes: conversations walk along calls --------------------------------------------------------------
_RTE = """
fr AS (SELECT source_id, min(id) AS rid, arg_min(target_id, id) AS tgt FROM br WHERE type = 'calls'
       AND resolution = 'resolved' GROUP BY 1),
steps AS MATERIALIZED (SELECT conv_id AS route_id, turn AS step, CASE WHEN turn = 1 THEN
    coalesce(fr.tgt, 'missing') ELSE 'function:o' || (conv_id + turn) END AS node_id,
    CASE WHEN turn = 1 THEN fr.rid WHEN turn > 2 THEN 'nope' END AS relation_id
  FROM conversations LEFT JOIN fr ON fr.source_id = 'function:o' || conv_id),
routes AS MATERIALIZED (SELECT conv_id AS route_id, CASE WHEN min(text) < 'M' THEN 'base' ELSE 'old'
    END AS snapshot_id, CASE WHEN max(turn) > 2 THEN 'call_chain' ELSE 'tour' END AS kind
  FROM conversations GROUP BY 1)"""


def _route_tables(spark, sf):
    c = _load(spark, sf, ("calls",))
    first = c.relations.filter(
        (F.col("type") == "calls") & (F.col("resolution") == "resolved")
    ).groupBy(F.col("source_id").alias("origin")).agg(
        F.min("id").alias("rid"), F.min_by("target_id", "id").alias("tgt"))
    talk = table(spark, sf, "conversations")
    turn = F.col("turn")
    steps = talk.withColumn(
        "origin", F.concat(F.lit("function:o"), F.col("conv_id").cast("string"))
    ).join(first, "origin", "left").select(
        F.col("conv_id").alias("route_id"), turn.alias("step"),
        F.when(turn == 1, F.coalesce("tgt", F.lit("missing"))).otherwise(F.concat(
            F.lit("function:o"), (F.col("conv_id") + turn).cast("string"))).alias("node_id"),
        F.when(turn == 1, F.col("rid")).when(turn > 2, "nope").alias("relation_id"))
    routes = talk.groupBy(F.col("conv_id").alias("route_id")).agg(
        F.when(F.min("text") < "M", "base").otherwise("old").alias("snapshot_id"),
        F.when(F.max("turn") > 2, "call_chain").otherwise("tour").alias("kind")
    ).withColumn("project_id", F.lit("shop"))
    return c, routes, steps


@query("validate_route", with_plans(_RTE + """
SELECT route_id, CAST(NULL AS BIGINT) AS step, 'SNAPSHOT_MISMATCH' AS code FROM routes
  WHERE snapshot_id <> 'base'
UNION ALL SELECT route_id, step, 'INVALID_ENDPOINT' FROM steps WHERE node_id NOT IN
  (SELECT id FROM bn)
UNION ALL SELECT route_id, step, 'INVALID_RELATION' FROM steps s WHERE relation_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM br WHERE br.id = s.relation_id
    AND (br.source_id = s.node_id OR br.target_id = s.node_id))
UNION ALL SELECT s.route_id, s.step, 'INVALID_CALL_CHAIN' FROM steps s JOIN routes r
  ON r.route_id = s.route_id AND r.kind = 'call_chain'
  JOIN steps p ON p.route_id = s.route_id AND p.step = s.step - 1
  WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.id = s.relation_id AND br.type = 'calls'
    AND br.resolution = 'resolved' AND br.source_id = p.node_id
    AND br.target_id = s.node_id)"""))
def validate_route(spark, sf):
    c, routes, steps = _route_tables(spark, sf)
    return O.validate_route(routes, steps, ("shop", "base"), c.nodes, c.relations)


@query("call_chain_check", with_plans(_RTE + """
SELECT s.route_id, s.step, EXISTS (SELECT 1 FROM br WHERE br.id = s.relation_id
  AND br.source_id = p.node_id AND br.target_id = s.node_id AND br.resolution = 'resolved'
  AND br.type = 'calls') AS holds
FROM steps s JOIN steps p ON p.route_id = s.route_id AND p.step = s.step - 1"""))
def call_chain_check(spark, sf):
    c, _, steps = _route_tables(spark, sf)
    return O.call_chain_check(steps, c.relations)


@query("route_stale", with_plans(_RTE + """
SELECT route_id, snapshot_id <> 'base' AS stale FROM routes"""))
def route_stale(spark, sf):
    c, routes, _ = _route_tables(spark, sf)
    projects = c.snapshots.select("project_id", F.col("snapshot_id").alias("current_snapshot_id"))
    return O.route_stale(routes, projects)
