"""View projections: lanes, folded groups, group aliases, highlights, frames and overlaps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import dir_distance, dirname
from ..staging import stage
from .paging import top_n, totals

# Fixed card and frame sizes of the views.
CARD_W, CARD_H, FRAME_PAD, FOLDER_PAD, TITLE = 270, 150, 24, 28, 26
BOX_W, BOX_H = 300, 220


# ---- lanes ------------------------------------------------------------------------------------
def lane_assign(view: DataFrame, edges: DataFrame) -> DataFrame:
    """Lane of every (root, id) of a view: dependents, dependencies or side context.

    ``edges``: root, source, target, type - edges of the root's view.  A reciprocal neighbour sits
    among the dependents; containment is no dependency.
    """
    links = edges.filter((F.col("type") != "contains") & (F.col("source") != F.col("target")))
    ends = links.select("root", F.explode(F.array(
        F.struct(F.col("target").alias("id"), (F.col("source") == F.col("root")).alias("out"),
                 F.lit(False).alias("inn")),
        F.struct(F.col("source").alias("id"), F.lit(False).alias("out"),
                 (F.col("target") == F.col("root")).alias("inn")),
    )).alias("e")).select("root", "e.*").filter(F.col("id") != F.col("root"))
    sides = ends.groupBy("root", "id").agg(
        F.bool_or("inn").alias("incoming"), F.bool_or("out").alias("outgoing"))
    rows = view.join(sides, ["root", "id"], "left").na.fill(False, ["incoming", "outgoing"])
    lane = (
        F.when(F.col("id") == F.col("root"), "selected").when(F.col("incoming"), "dependent")
        .when(F.col("outgoing"), "dependency").otherwise("side")
    )
    return rows.select(
        *view.columns, lane.alias("lane"),
        (F.col("incoming") & F.col("outgoing") & (F.col("id") != F.col("root")))
        .alias("reciprocal"))


def lane_intersection(lanes: DataFrame) -> DataFrame:
    return lanes.filter("reciprocal").select("root", "id")


def reciprocal_count(lanes: DataFrame) -> DataFrame:
    return lanes.groupBy("root").agg(F.count_if("reciprocal").alias("reciprocal"))


def lane_page(lanes: DataFrame, requested: int, size: int) -> DataFrame:
    """One page per lane; a page beyond the end is clamped to the last one."""
    keys = ["root", "lane"]
    # Clamping only lowers the page, so ranks beyond the requested page are never needed.
    rows = top_n(lanes, keys, [F.col("id")], (requested + 1) * size).join(
        totals(lanes, keys), keys)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    at = F.least(F.lit(requested), pages - 1)
    start = at * size
    return rows.withColumn("pages", pages).withColumn("page", at).filter(
        (F.col("position") > start) & (F.col("position") <= start + size)
    ).select("root", "lane", "id", "page", "pages", "total", (start + 1).alias("range_start"),
             F.least(start + size, F.col("total")).alias("range_end"))


def lane_group_by_path(lanes: DataFrame, roots: DataFrame, auto_limit: int = 24,
                       expanded: int = 2) -> DataFrame:
    """Cards of a lane grouped by file (files by directory), nearest groups first.

    ``lanes`` carries kind and file_path, ``roots`` root and root_path.  In a crowded lane only
    the ``expanded`` nearest groups stay open.
    """
    cards = lanes.filter(F.col("lane").isin("dependent", "dependency"))
    flat = lambda c: F.when(dirname(c) == ".", "").otherwise(dirname(c))
    group = F.when(F.col("kind") == "file", flat("file_path")).otherwise(
        F.coalesce("file_path", F.lit("")))
    groups = cards.withColumn("path", group).groupBy("root", "lane", "path").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("kind", "id").alias("first_kind"))
    sizes = groups.groupBy("root", "lane").agg(F.sum("members").alias("lane_total"))
    scored = groups.join(roots, "root").withColumn(
        "distance", F.when(F.col("path") == F.col("root_path"), -1).otherwise(dir_distance(
            F.when(F.col("first_kind") == "file", F.col("path")).otherwise(flat("path")),
            flat("root_path"))))
    nearest = top_n(scored, ["root", "lane"], [F.col("distance"), F.col("path")], expanded)
    return (
        scored.join(nearest.select("root", "lane", "path", F.lit(True).alias("near")),
                    ["root", "lane", "path"], "left")
        .join(sizes, ["root", "lane"])
        .select("root", "lane", "path", "members",
                F.col("distance").cast("bigint").alias("distance"),
                ((F.col("lane_total") > auto_limit) & F.col("near").isNull()).alias("collapsed"))
    )


def hidden_cards(lanes: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, id, header) of cards inside collapsed groups."""
    flat = F.when(dirname("file_path") == ".", "").otherwise(dirname("file_path"))
    path = F.when(F.col("kind") == "file", flat).otherwise(F.coalesce("file_path", F.lit("")))
    shown = F.when(F.col("path") == "", ".").otherwise(F.col("path"))
    return lanes.withColumn("path", path).join(
        groups.filter("collapsed").select("root", "lane", "path"), ["root", "lane", "path"]
    ).select("root", "id", F.concat(F.lit("filegroup:"), "lane", F.lit(":"), shown).alias("header"))


def fold_edges(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges of hidden cards redirected to group headers and merged with a count.

    Redirected edges survive only when they touch the root; others pass unchanged.
    """
    rows = edges.filter(F.col("type") != "contains")
    for side in ("source", "target"):
        rows = rows.join(
            hidden.select("root", F.col("id").alias(side), F.col("header").alias(f"{side}_h")),
            ["root", side], "left")
    rows = rows.withColumn("s", F.coalesce("source_h", "source")).withColumn(
        "t", F.coalesce("target_h", "target")
    ).withColumn("moved", F.col("source_h").isNotNull() | F.col("target_h").isNotNull()).filter(
        F.col("s") != F.col("t"))
    kept = rows.filter(~F.col("moved")).select(
        "root", "id", F.col("s").alias("source"), F.col("t").alias("target"),
        F.lit(1).cast("bigint").alias("merged"))
    folded = rows.filter(
        F.col("moved") & ((F.col("s") == F.col("root")) | (F.col("t") == F.col("root")))
    ).groupBy("root", F.col("s").alias("source"), F.col("t").alias("target")).agg(
        F.count(F.lit(1)).alias("merged"))
    return kept.unionByName(folded.select(
        "root", F.concat(F.lit("fg:"), "source", F.lit(">"), "target").alias("id"),
        "source", "target", "merged"))


# ---- frames and boxes ---------------------------------------------------------------------------
def bounding_frames(cards: DataFrame, key: str, pad: int = FRAME_PAD) -> DataFrame:
    """Box around all cards of a group (x, y, optional w and h)."""
    w, h = F.coalesce("w", F.lit(CARD_W)), F.coalesce("h", F.lit(CARD_H))
    box = cards.groupBy(key).agg(
        (F.min("x") - pad).alias("x0"), (F.min("y") - pad).alias("y0"),
        (F.max(F.col("x") + w) + pad).alias("x1"), (F.max(F.col("y") + h) + pad).alias("y1"))
    return box.select(key, "x0", "y0", (F.col("x1") - F.col("x0")).alias("width"),
                      (F.col("y1") - F.col("y0")).alias("height"))


def nested_frames(cards: DataFrame, contains: DataFrame) -> DataFrame:
    """Folder boxes enclosing children and sub-folder boxes, innermost folders first.

    ``cards``: id, kind, x, y; ``contains``: parent, child.  One round per tree level; folders
    caught in a cycle fall back to their children's own cards.
    """
    edge = cards.select(
        "id", "kind", F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("x") + CARD_W).alias("x1"), (F.col("y") + CARD_H).alias("y1"))
    folders = edge.filter(F.col("kind") == "folder").select(F.col("id").alias("parent"))
    kids = stage(
        contains.filter(F.col("parent") != F.col("child")).distinct()
        .join(folders, "parent", "left_semi")
        .join(edge.select(F.col("id").alias("child")), "child", "left_semi"), "frame-kids")
    pending = stage(kids.select("parent").distinct(), "frame-pending")
    frames = edge.select("id", "x0", "y0", "x1", "y1").limit(0)
    for n in count():
        if pending.isEmpty():
            return frames
        blocked = kids.join(pending.select(F.col("parent").alias("child")), "child", "left_semi")
        ready = pending.join(blocked.select("parent").distinct(), "parent", "left_anti")
        if ready.isEmpty():
            ready = pending
        boxes = edge.select("id", "x0", "y0", "x1", "y1").join(
            frames.select("id"), "id", "left_anti").unionByName(frames)
        inside = kids.join(ready, "parent", "left_semi").join(
            boxes.withColumnRenamed("id", "child"), "child"
        ).drop("child").unionByName(
            edge.select(F.col("id").alias("parent"), "x0", "y0", "x1", "y1").join(
                ready, "parent", "left_semi"))
        step = stage(inside.groupBy(F.col("parent").alias("id")).agg(
            (F.min("x0") - FOLDER_PAD).alias("x0"),
            (F.min("y0") - FOLDER_PAD - TITLE).alias("y0"),
            (F.max("x1") + FOLDER_PAD).alias("x1"), (F.max("y1") + FOLDER_PAD).alias("y1")),
            f"frames-{n}")
        frames = frames.unionByName(step)
        pending = stage(pending.join(step.select(F.col("id").alias("parent")), "parent",
                                     "left_anti"), f"frame-pending-{n}")


def rect_overlaps(boxes: DataFrame, board: str) -> DataFrame:
    """Overlapping pinned boxes per board: for each position, its boxes and overlapping pairs.

    Boxes at one position collapse to a count first, so a pile of copies adds n(n-1)/2 pairs in
    closed form.  Distinct positions meet through grid cells of one box size and are counted at
    the smaller position; pairs are never listed.
    """
    spots = boxes.groupBy(board, "x", "y").agg(
        F.count(F.lit(1)).alias("boxes"), F.min("id").alias("first_id"))
    cell = lambda v, size, add: (F.floor(F.col(v) / size) + add)
    home = spots.withColumn("cx", cell("x", BOX_W, 0)).withColumn("cy", cell("y", BOX_H, 0))
    around = spots.withColumn("dx", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))) \
        .withColumn("dy", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))) \
        .select(board, F.col("x").alias("ox"), F.col("y").alias("oy"),
                F.col("boxes").alias("others"), cell("x", BOX_W, 0).alias("bx"),
                cell("y", BOX_H, 0).alias("by"), "dx", "dy") \
        .select(board, "ox", "oy", "others", (F.col("bx") + F.col("dx")).alias("cx"),
                (F.col("by") + F.col("dy")).alias("cy"))
    later = (F.col("ox") > F.col("x")) | ((F.col("ox") == F.col("x")) & (F.col("oy") > F.col("y")))
    near = home.join(around, [board, "cx", "cy"]).filter(
        later & (F.abs(F.col("ox") - F.col("x")) < BOX_W)
        & (F.abs(F.col("oy") - F.col("y")) < BOX_H)
    ).groupBy(board, "x", "y").agg(F.sum("others").alias("others"))
    own = F.col("boxes") * (F.col("boxes") - 1) / 2
    return spots.join(near, [board, "x", "y"], "left").select(
        board, "x", "y", "boxes",
        (own + F.col("boxes") * F.coalesce("others", F.lit(0))).cast("bigint").alias("pairs"))


# ---- groups -------------------------------------------------------------------------------------
def _memberships(nodes: DataFrame, members: DataFrame) -> DataFrame:
    loaded = nodes.filter((F.col("layer") != "plan") & (F.col("kind") == "function")).select("id")
    return members.distinct().join(loaded, "id", "left_semi")


def group_projection(nodes: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """View rows after grouping: untouched nodes, group cards and one alias per open membership.

    ``nodes``: id, kind, layer; ``groups``: group_id, collapsed; ``members``: group_id, id.
    """
    inside = _memberships(nodes, members)
    sizes = members.distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("total"))
    loaded = inside.groupBy("group_id").agg(F.count(F.lit(1)).alias("loaded"))
    none = F.lit(None).cast("bigint")
    plain = nodes.join(
        inside.select("id").distinct().withColumn("layer_hit", F.lit(True)), "id", "left"
    ).filter((F.col("layer") == "plan") | F.col("layer_hit").isNull()).select(
        F.col("id").alias("view_id"), F.lit("node").alias("role"), none.alias("total"),
        none.alias("unknown"))
    cards = groups.join(loaded, "group_id").join(sizes, "group_id").select(
        F.concat(F.lit("group:"), "group_id").alias("view_id"), F.lit("group").alias("role"),
        "total", (F.col("total") - F.col("loaded")).alias("unknown"))
    aliases = inside.join(groups.filter(~F.col("collapsed")), "group_id").select(
        F.concat(F.lit("group-member:"), "group_id", F.lit(":"), "id").alias("view_id"),
        F.lit("alias").alias("role"), none.alias("total"), none.alias("unknown"))
    return plain.unionByName(cards).unionByName(aliases)


def group_edge_routes(edges: DataFrame, nodes: DataFrame, groups: DataFrame,
                      members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drawn routes of every edge and (group, relation) pairs internal to a group.

    An edge has one default route through the first group of each end, and one more per affected
    group; equal routes collapse, a route inside one collapsed group is not drawn.  Edges meet the
    list of groups of each end and then their equals by id, a shuffle each; routes are made after it.
    """
    groups = stage(groups.select("group_id", "collapsed"), "route-groups")
    loaded = nodes.filter((F.col("layer") != "plan") & (F.col("kind") == "function")).select("id")
    lists = members.join(groups, "group_id", "left_semi").groupBy("id").agg(
        F.array_sort(F.collect_set("group_id")).alias("groups")).join(loaded, "id", "left_semi")
    base = edges.select("id", "source", "target")
    for side in ("source", "target"):
        base = base.join(lists.select(F.col("id").alias(side),
                                      F.col("groups").alias(f"{side}_groups")), side, "left")
    none = F.array().cast("array<string>")
    sg, tg = (F.coalesce(f"{side}_groups", none) for side in ("source", "target"))
    edge = Window.partitionBy("id")
    # Rows of one id share the groups that affect it.
    met = base.select("id", "source", "target", sg.alias("sg"), tg.alias("tg")).repartition(
        "id").withColumn("all_sg", F.array_distinct(F.flatten(F.collect_set("sg").over(edge)))
                         ).withColumn("all_tg", F.array_distinct(F.flatten(
                             F.collect_set("tg").over(edge))))
    internal = met.select(
        F.explode(F.array_intersect("all_sg", "all_tg")).alias("group_id"),
        F.col("id").alias("relation_id")).distinct()
    first_s, first_t = F.get("sg", F.lit(0)), F.get("tg", F.lit(0))
    grouped = first_s.isNotNull() | first_t.isNotNull()

    def route(p, group, s, t):
        return F.struct(F.struct(p.alias("p"), group.alias("group_id")).alias("turn"),
                        s.alias("sg"), t.alias("tg"))

    default = F.array(route(F.when(grouped, 0).otherwise(3), F.lit(""), first_s, first_t))
    in_s, in_t = (lambda g: F.array_contains("all_sg", g)), (lambda g: F.array_contains("all_tg", g))
    affected = F.transform(F.array_union("all_sg", "all_tg"), lambda g: route(
        F.when(in_s(g), 1).otherwise(2), g, F.when(in_s(g), g).otherwise(first_s),
        F.when(in_t(g), g).otherwise(first_t)))
    routes = met.select("id", "source", "target", F.inline(
        F.when(grouped, F.concat(default, affected)).otherwise(default)))
    for side, column in (("source", "sg"), ("target", "tg")):
        routes = routes.join(
            groups.select(F.col("group_id").alias(column),
                          F.col("collapsed").alias(f"{side}_folded")), column, "left")
        folded = F.coalesce(f"{side}_folded", F.lit(False))
        routes = routes.withColumn(
            f"{side}_view",
            F.when(F.col(column).isNull(), F.col(side))
            .when(folded, F.concat(F.lit("group:"), column))
            .otherwise(F.concat(F.lit("group-member:"), column, F.lit(":"), side)),
        ).withColumn(f"{side}_port", F.when(folded & F.col(column).isNotNull(), F.col(side)))
    views = ["id", "source_view", "target_view", "source_port", "target_port"]
    # Edges without groups (p = 3) stay as they are, equal ones too.
    plain = F.col("turn.p") == 3
    inner = (F.col("source_view") == F.col("target_view")) & F.col("source_view").startswith("group:")
    drawn = routes.filter(plain | (F.col("id").isNotNull() & ~inner)).groupBy(
        *views, plain.alias("plain")).agg(
        F.min("turn").alias("turn"), F.count(F.lit(1)).alias("times"))
    numbered = drawn.withColumn("n", F.row_number().over(edge.orderBy("turn"))).withColumn(
        "routes", F.count_if(~F.col("plain")).over(edge)).withColumn("nth", F.explode(F.sequence(
            F.lit(1).cast("bigint"), F.when(F.col("plain"), F.col("times")).otherwise(1))))
    out = numbered.select(
        F.when(F.col("plain"), F.col("id")).otherwise(F.concat(
            F.lit("group-edge:"), "id", F.lit(":"), (F.col("n") - 1).cast("string")))
        .alias("edge_id"), *views, (~F.col("plain") & (F.col("routes") > 1)).alias("mirrored"))
    return out, internal


def group_ports(routes: DataFrame) -> DataFrame:
    """Distinct member ports on collapsed group cards."""
    sides = F.explode(F.array(
        F.struct(F.col("source_view").alias("card"), F.col("source_port").alias("port")),
        F.struct(F.col("target_view").alias("card"), F.col("target_port").alias("port"))))
    return routes.select(sides.alias("s")).select("s.*").filter(
        F.col("port").isNotNull()).distinct()


def circle_functions(view: DataFrame) -> DataFrame:
    return view.filter((F.col("layer") != "plan") & (F.col("kind") == "function")).select(
        "id").dropDuplicates(["id"])


def member_bindings(members: DataFrame, nodes: DataFrame, current: DataFrame, offset: int = 0,
                    limit: int = 20) -> DataFrame:
    """A page of each group's members: bound, missing, or asked for in another snapshot.

    ``members``: project_id, group_id, id, snapshot_id; ``nodes``: project_id, snapshot_id, id, kind
    of any snapshots; ``current``: the current snapshot of each project.
    """
    rows = top_n(members, ["project_id", "group_id"], [F.col("id")], offset + limit).filter(
        F.col("position") > offset)
    now = current.select("project_id", "snapshot_id").distinct()
    here = nodes.join(now, ["project_id", "snapshot_id"], "left_semi").select(
        "project_id", "id", F.col("snapshot_id").alias("current_id"), "kind").distinct()
    return rows.join(here, ["project_id", "id"], "left").select(
        "group_id", "id", "position",
        F.when(F.col("current_id").isNull(), "missing")
        .when(F.col("current_id") != F.col("snapshot_id"), "snapshot-changed")
        .when(F.col("kind") != "function", "missing").otherwise("bound").alias("status"))


def group_change_detect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether title, description or the member *set* of a group differs.

    Both sides: group_id, title, description, id (one row per member).
    """
    from ..functions.ids import unordered_digest

    def shape(df, name):
        sets = df.select("group_id", "title", "description", "id").distinct()
        return sets.groupBy("group_id").agg(
            F.max("title").alias(f"{name}_title"), F.max("description").alias(f"{name}_text"),
            unordered_digest(F.col("id")).alias(f"{name}_set"))

    rows = shape(before, "old").join(shape(after, "new"), "group_id", "full")
    same = (
        F.col("old_title").eqNullSafe(F.col("new_title"))
        & F.col("old_text").eqNullSafe(F.col("new_text"))
        & F.col("old_set").eqNullSafe(F.col("new_set")))
    return rows.select("group_id", (~same).alias("changed"))


def valid_group_members(groups: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Problems of group requests: blank titles and members that are no function here."""
    functions = nodes.filter(F.col("kind") == "function").select("id")
    lost = members.join(functions, "id", "left_anti").select(
        "group_id", F.lit("MEMBER").alias("code"), F.col("id").alias("detail"))
    blank = groups.filter(F.trim("title") == "").select(
        "group_id", F.lit("TITLE").alias("code"), F.lit(None).cast("string").alias("detail"))
    return lost.unionByName(blank)


def collapsed_known_groups(asked: DataFrame, groups: DataFrame) -> DataFrame:
    return asked.select("project_id", "group_id").distinct().join(
        groups.select("project_id", "group_id"), ["project_id", "group_id"], "left_semi")


def normalize_view(positions: DataFrame) -> DataFrame:
    """Positions with finite coordinates; others carry a problem."""
    def finite(c):
        return ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))

    bad = ~(F.coalesce(finite("x"), F.lit(False)) & F.coalesce(finite("y"), F.lit(False)))
    return positions.withColumn("problem", F.when(bad, "NOT_FINITE"))


# ---- highlight ----------------------------------------------------------------------------------
def focus_roles(nodes: DataFrame, edges: DataFrame, requests: DataFrame
                ) -> tuple[DataFrame, DataFrame]:
    """Roles of view nodes and edges for each request (root node or relation).

    ``nodes``: request_id, id; ``edges``: request_id, id, source, target; ``requests``:
    request_id, node_id, relation_id.  A relation request outranks a node request.
    """
    asked = requests.select("request_id", "node_id", "relation_id")
    rows = edges.join(asked, "request_id")
    root = F.col("node_id")
    touches = F.coalesce((F.col("source") == root) | (F.col("target") == root), F.lit(False))
    active = F.when(F.col("relation_id").isNotNull(), F.col("id") == F.col("relation_id")).otherwise(
        touches)
    idle = F.col("node_id").isNull() & F.col("relation_id").isNull()
    role = (
        F.when(idle, "idle").when(~active, "muted")
        .when(F.col("relation_id").isNotNull(), "relation")
        .when(F.col("target") == root, "incoming").otherwise("outgoing"))
    edge_roles = rows.select("request_id", "id", role.alias("role"))
    ends = rows.filter(active).select(
        "request_id", F.explode(F.array("source", "target")).alias("id"),
        F.lit(True).alias("near")).distinct()
    node_rows = nodes.join(asked, "request_id").join(ends, ["request_id", "id"], "left")
    node_role = (
        F.when(idle, "idle").when(F.col("id") == root, "selected")
        .when(F.col("near"), "neighbor").otherwise("muted"))
    return node_rows.select("request_id", "id", node_role.alias("role")), edge_roles


def focus_targets(view: DataFrame, members: DataFrame, requests: DataFrame) -> DataFrame:
    """View nodes whose own id, or any group member, is requested."""
    direct = view.select("view_id", F.col("id"))
    through = members.select("view_id", F.col("id"))
    return direct.unionByName(through).join(
        requests.select("request_id", F.col("node_id").alias("id")), "id"
    ).select("request_id", "view_id").distinct()
