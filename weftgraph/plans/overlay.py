"""Planned changes laid over a loaded view, and edits of a plan's operation list.

A view is (plan_id, id) rows with its relations; operations refer to it by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import function_target, normalize_repo_path, symbol_location
from ..operators.asked import Asked
from ..staging import stage
from .state import of_kind

OP_FIELDS = ["kind", "temp_id", "name", "file_path", "signature", "language", "node_id",
             "relation_id", "source_id", "target_id", "text"]


def overlay_referenced(ops: DataFrame, view_edges: DataFrame) -> DataFrame:
    """Ids that operations refer to, with the ends of relations they remove from the view."""
    direct = ops.select("plan_id", F.explode(F.array_compact(F.array(
        "node_id", "source_id", "target_id"))).alias("id"))
    removed = of_kind(ops, "remove_relation").select("plan_id", F.col("relation_id").alias("rid"))
    ends = view_edges.select("plan_id", F.col("id").alias("rid"), "source_id", "target_id").join(
        removed, ["plan_id", "rid"], "left_semi"
    ).select("plan_id", F.explode(F.array_compact(F.array("source_id", "target_id"))).alias("id"))
    return direct.unionByName(ends).distinct()


def op_changes_label(ops: DataFrame) -> DataFrame:
    """Change labels of each node, one row per label, to be read in operation order."""
    last = of_kind(ops, "move_function").groupBy("plan_id", F.col("node_id").alias("id")).agg(
        F.max_by(F.struct("op_index", "file_path"), "op_index").alias("m"))
    moves = last.select("plan_id", "id", F.col("m.op_index").alias("op_index"),
                        F.concat(F.lit("→ "), F.col("m.file_path")).alias("label"))
    gone = of_kind(ops, "remove_function").select(
        "plan_id", F.col("node_id").alias("id"), "op_index", F.lit("− removal").alias("label"))
    notes = of_kind(ops, "annotate").select(
        "plan_id", F.col("target_id").alias("id"), "op_index",
        F.concat(F.lit("note · "), F.col("text")).alias("label"))
    return moves.unionByName(gone).unionByName(notes)


def layer_filter(view: DataFrame, choice: str) -> DataFrame:
    """fact: facts only; plan: planned rows and their anchors; both: everything."""
    if choice not in ("fact", "plan", "both"):
        raise ValueError("layer must be fact, plan or both")
    if choice == "both":
        return view
    keep = ["fact"] if choice == "fact" else ["plan", "anchor"]
    return view.filter(F.col("layer").isin(*keep))


def overlay_nodes(view_nodes: DataFrame, ops: DataFrame, view_edges: DataFrame,
                  reference: DataFrame, choice: str = "both") -> DataFrame:
    """(plan_id, id, layer, file_path): loaded facts, planned functions and anchors."""
    ops = ops if choice != "fact" else ops.limit(0)
    referenced = stage(overlay_referenced(ops, view_edges), "overlay-referenced")
    shown_or_named = view_nodes.select("id").unionByName(referenced.select("id"))
    facts = Asked(shown_or_named).among(reference.select("id", "file_path"), "id")
    loaded = view_nodes.select("plan_id", "id").join(facts, "id", "left")
    if choice == "plan":
        loaded = loaded.join(referenced, ["plan_id", "id"], "left_semi")
    shown = loaded.select("plan_id", "id", F.lit("anchor" if choice == "plan" else "fact")
                          .alias("layer"), "file_path")
    moves = of_kind(ops, "move_function").groupBy("plan_id", F.col("node_id").alias("id")).agg(
        F.max_by("file_path", "op_index").alias("moved"))
    adds = of_kind(ops, "add_function").select(
        "plan_id", F.col("temp_id").alias("id"), F.col("file_path").alias("planned")
    ).join(moves, ["plan_id", "id"], "left").select(
        "plan_id", "id", F.lit("plan").alias("layer"),
        F.coalesce("moved", "planned").alias("file_path"))
    present = shown.select("plan_id", "id").unionByName(adds.select("plan_id", "id")).distinct()
    anchors = referenced.join(facts, "id").join(present, ["plan_id", "id"], "left_anti").select(
        "plan_id", "id", F.lit("anchor").alias("layer"), "file_path")
    return shown.unionByName(adds).unionByName(anchors)


def overlay_edges(nodes: DataFrame, view_edges: DataFrame, ops: DataFrame) -> DataFrame:
    """Fact edges between shown facts (removed ones flagged) and planned edges."""
    facts = nodes.filter(F.col("layer") != "plan").select("plan_id", "id").distinct()
    every = nodes.select("plan_id", "id").distinct()
    gone = of_kind(ops, "remove_relation").select(
        "plan_id", F.col("relation_id").alias("id"), F.lit(True).alias("removed")).distinct()

    def between(edges, ends):
        for side in ("source_id", "target_id"):
            edges = edges.join(ends.withColumnRenamed("id", side), ["plan_id", side], "left_semi")
        return edges

    shown = between(view_edges.filter(F.col("target_id").isNotNull()), facts).join(
        gone, ["plan_id", "id"], "left"
    ).select("plan_id", F.concat(F.lit("fact:"), "id").alias("id"), "source_id", "target_id",
             F.lit("fact").alias("layer"), F.coalesce("removed", F.lit(False)).alias("removed"))
    planned = between(of_kind(ops, "add_relation"), every).select(
        "plan_id", F.concat(F.lit("plan:"), "relation_id").alias("id"), "source_id", "target_id",
        F.lit("plan").alias("layer"), F.lit(False).alias("removed"))
    return shown.unionByName(planned)


def overlay_notices(nodes: DataFrame, view_edges: DataFrame, ops: DataFrame) -> DataFrame:
    """Relations of the view that are not resolved, and planned edges with an end outside it."""
    open_ends = view_edges.filter(F.col("resolution") != "resolved").select(
        "plan_id", "id", F.concat_ws(" · ", "resolution", symbol_location(
            "evidence_path", F.lit(""), "evidence_line"), "evidence_text").alias("notice"))
    every = nodes.select("plan_id", "id").distinct()
    adds = of_kind(ops, "add_relation")
    for side in ("source", "target"):
        adds = adds.join(every.select("plan_id", F.col("id").alias(f"{side}_id"),
                                      F.lit(True).alias(f"has_{side}")),
                         ["plan_id", f"{side}_id"], "left")
    outside = adds.filter(F.col("has_source").isNull() | F.col("has_target").isNull()).select(
        "plan_id", F.col("relation_id").alias("id"),
        F.concat(F.lit("outside: "), F.when(F.col("has_source").isNull(), F.col("source_id"))
                 .otherwise(F.col("target_id"))).alias("notice"))
    return open_ends.unionByName(outside)


# ---- edits ----------------------------------------------------------------------------------------
def _content(df: DataFrame) -> DataFrame:
    """Operations with one text per content, nulls kept apart from blanks."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in OP_FIELDS]
    return df.withColumn("content", F.to_json(F.array(*parts)))


def affected_operations(ops: DataFrame, previous: DataFrame) -> DataFrame:
    """Operations of one list whose content the other lacks; the removed ones come first."""
    now, old = _content(ops), _content(previous)
    key = ["plan_id", "content"]
    removed = old.join(now.select(*key).distinct(), key, "left_anti").withColumn(
        "side", F.lit("removed"))
    added = now.join(old.select(*key).distinct(), key, "left_anti").withColumn(
        "side", F.lit("added"))
    return removed.unionByName(added).drop("content")


def affected_nodes(ops: DataFrame, previous: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct nodes touched by changed operations, without planned functions that are gone."""
    changed = stage(affected_operations(ops, previous), "changed-operations")
    planned = of_kind(ops, "add_relation").unionByName(of_kind(previous, "add_relation")).groupBy(
        "plan_id", "relation_id").agg(
        F.min(F.struct("source_id", "target_id")).alias("p"))
    removed = of_kind(changed, "remove_relation").select("plan_id", "relation_id")
    facts = Asked(removed.select("relation_id")).among(relations, "id").select(
        F.col("id").alias("relation_id"), F.struct("source_id", "target_id").alias("f"))
    dropped = removed.join(
        facts, "relation_id", "left").join(planned, ["plan_id", "relation_id"], "left").select(
        "plan_id", F.coalesce("f", "p").alias("e")).select(
        "plan_id", F.explode(F.array_compact(F.array("e.source_id", "e.target_id"))).alias("id"))
    ids = F.array_compact(F.array("temp_id", "node_id", "source_id", "target_id"))
    direct = changed.filter(F.col("kind") != "remove_relation").select(
        "plan_id", F.explode(ids).alias("id"))
    still = of_kind(ops, "add_function").select("plan_id", F.col("temp_id").alias("id"))
    gone = of_kind(previous, "add_function").select("plan_id", F.col("temp_id").alias("id")).join(
        still, ["plan_id", "id"], "left_anti")
    return direct.unionByName(dropped).distinct().join(gone, ["plan_id", "id"], "left_anti")


def delete_temporary(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """Operations left after removing planned functions (plan_id, temp_id).

    Their relations, moves and removals go too, and removals of those relations; notes stay.
    """
    gone = requests.select("plan_id", F.col("temp_id").alias("gone_id")).distinct()

    def without(df, column):
        return df.join(gone.withColumnRenamed("gone_id", column), ["plan_id", column], "left_anti")

    edges = of_kind(ops, "add_relation")
    kept_edges = without(without(edges, "source_id"), "target_id")
    lost = edges.select("plan_id", "relation_id", "op_index").join(
        kept_edges.select("plan_id", "op_index"), ["plan_id", "op_index"], "left_anti"
    ).select("plan_id", "relation_id").distinct()
    parts = [
        without(of_kind(ops, "add_function"), "temp_id"), kept_edges,
        without(of_kind(ops, "move_function", "remove_function"), "node_id"),
        of_kind(ops, "remove_relation").join(lost, ["plan_id", "relation_id"], "left_anti"),
        of_kind(ops, "annotate"),
    ]
    out = parts[0].select(*ops.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ops.columns))
    return out


def retarget_coalesce(ops: DataFrame, requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Operations after giving functions a new target path (plan_id, node_id, target).

    All moves of a node become one at the place of the first; a move back to the baseline path
    disappears; a planned function takes the path into its addition.  Requests for removed
    functions, bad targets or no change leave the operations as they are.
    """
    base = nodes.filter(F.col("kind") == "function").select(
        F.col("id").alias("node_id"), F.col("file_path").alias("base_path"))
    gone = of_kind(ops, "remove_function").select("plan_id", "node_id").distinct()
    moved = of_kind(ops, "move_function").groupBy("plan_id", "node_id").agg(
        F.min("op_index").alias("first_move"),
        F.max_by("file_path", "op_index").alias("last_path"))
    added = of_kind(ops, "add_function").groupBy("plan_id", F.col("temp_id").alias("node_id")).agg(
        F.min("op_index").alias("added_at"),
        F.min_by("file_path", "op_index").alias("added_path"))
    asked = (
        requests.withColumn("path", function_target("target"))
        .filter(F.col("path").isNotNull()).join(gone, ["plan_id", "node_id"], "left_anti")
        .join(base, "node_id", "left").join(moved, ["plan_id", "node_id"], "left")
        .join(added, ["plan_id", "node_id"], "left")
        .filter(F.col("base_path").isNotNull() | F.col("added_at").isNotNull())
        .filter(~F.coalesce("last_path", "added_path", "base_path").eqNullSafe(F.col("path")))
        .withColumn("is_new", F.col("added_at").isNotNull())
        .withColumn("back", ~F.col("is_new") & (F.col("path") == normalize_repo_path("base_path")))
        .select("plan_id", "node_id", "path", "first_move", "added_at", "is_new", "back")
    )
    subject = F.when(F.col("kind") == "move_function", F.col("node_id")).when(
        F.col("kind") == "add_function", F.col("temp_id"))
    rows = ops.withColumn("subject", subject).join(
        asked.withColumnRenamed("node_id", "subject"), ["plan_id", "subject"], "left")
    hit = F.col("path").isNotNull()
    is_move, is_add = F.col("kind") == "move_function", F.col("kind") == "add_function"
    dropped = hit & is_move & (
        F.col("is_new") | F.col("back") | (F.col("op_index") != F.col("first_move")))
    takes = hit & ((is_move & ~F.col("is_new")) | (is_add & (F.col("op_index") == F.col("added_at"))))
    kept = rows.filter(~F.coalesce(dropped, F.lit(False))).withColumn(
        "file_path", F.when(takes, F.col("path")).otherwise(F.col("file_path"))
    ).select(*ops.columns)
    # A function without any move gets one at the end of its plan.
    size = ops.groupBy("plan_id").agg((F.max("op_index") + 1).alias("size"))
    fresh = asked.filter(~F.col("is_new") & F.col("first_move").isNull() & ~F.col("back")).join(
        size, "plan_id")
    values = {"plan_id": F.col("plan_id"), "op_index": F.col("size"),
              "kind": F.lit("move_function"), "node_id": F.col("node_id"),
              "file_path": F.col("path")}
    appended = fresh.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ops.schema.fields])
    return kept.unionByName(appended)


def reconnect_relation(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """Operations after moving edges to new ends (plan_id, layer, domain_id, source, target,
    new_id): a planned edge is rewritten in place, a fact becomes a removal and an addition."""
    planned = requests.filter(F.col("layer") == "plan").select(
        "plan_id", F.col("domain_id").alias("relation_id"),
        F.col("source").alias("to_source"), F.col("target").alias("to_target"))
    joined = ops.join(planned, ["plan_id", "relation_id"], "left")
    hit = (F.col("kind") == "add_relation") & F.col("to_source").isNotNull()
    rewritten = joined.withColumn(
        "source_id", F.when(hit, F.col("to_source")).otherwise(F.col("source_id"))
    ).withColumn("target_id", F.when(hit, F.col("to_target")).otherwise(F.col("target_id"))
                 ).select(*ops.columns)
    facts = requests.filter(F.col("layer") == "fact")
    size = ops.groupBy("plan_id").agg((F.max("op_index") + 1).alias("size"))
    already = of_kind(ops, "remove_relation").select(
        "plan_id", F.col("relation_id").alias("domain_id"), F.lit(True).alias("already")).distinct()
    rows = facts.join(size, "plan_id").join(already, ["plan_id", "domain_id"], "left")

    def op(df, **values):
        return df.select(*[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ops.schema.fields])

    removals = op(rows.filter(F.col("already").isNull()), plan_id=F.col("plan_id"),
                  op_index=F.col("size"), kind=F.lit("remove_relation"),
                  relation_id=F.col("domain_id"))
    adds = op(rows, plan_id=F.col("plan_id"), op_index=F.col("size") + 1,
              kind=F.lit("add_relation"), relation_id=F.col("new_id"),
              source_id=F.col("source"), target_id=F.col("target"))
    return rewritten.unionByName(removals).unionByName(adds)


def edit_function(ops: DataFrame, edits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Operations after function edits (plan_id, node_id, name, signature, description).

    A planned function takes the new fields; for a fact, changes of name or signature and the
    description become one note at the end of the plan.
    """
    asked = edits.select("plan_id", "node_id", F.col("name").alias("new_name"),
                         F.col("signature").alias("new_signature"),
                         F.col("description").alias("new_text"))
    rows = ops.join(asked.withColumnRenamed("node_id", "temp_id"), ["plan_id", "temp_id"], "left")
    hit = (F.col("kind") == "add_function") & F.col("new_name").isNotNull()
    renamed = rows.withColumn(
        "name", F.when(hit, F.col("new_name")).otherwise(F.col("name"))
    ).withColumn("signature", F.when(hit, F.col("new_signature")).otherwise(F.col("signature"))
                 ).select(*ops.columns)
    planned = of_kind(ops, "add_function").select(
        "plan_id", F.col("temp_id").alias("node_id")).distinct()
    facts = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("old_name"),
                         F.coalesce("signature", F.lit("")).alias("old_signature"))
    size = ops.groupBy("plan_id").agg((F.max("op_index") + 1).alias("size"))
    lines = F.array_compact(F.array(
        F.when(F.col("new_name") != F.col("old_name"),
               F.concat(F.lit("name: "), F.col("new_name"))),
        F.when(F.col("new_signature") != F.col("old_signature"),
               F.concat(F.lit("signature: "), F.col("new_signature"))),
        F.when(F.col("new_text") != "", F.col("new_text"))))
    noted = asked.join(planned, ["plan_id", "node_id"], "left_anti").join(facts, "node_id").join(
        size, "plan_id").withColumn("note", F.array_join(lines, "\n")).filter(F.col("note") != "")
    values = {"plan_id": F.col("plan_id"), "op_index": F.col("size"), "kind": F.lit("annotate"),
              "target_id": F.col("node_id"), "text": F.col("note")}
    return renamed.unionByName(noted.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ops.schema.fields]))


def scope_with_planned(listing: DataFrame, planned: DataFrame, cap: int = 80) -> DataFrame:
    """Listed nodes of a scope plus planned ids of its path, distinct, at most ``cap``.

    Both: plan_id, path, kind, id; listed rows come first in their position, planned ones after
    in the order of their first operation.  A path only the plan knows lists planned ids alone.
    """
    from ..operators.paging import top_n, totals

    keys = ["plan_id", "path", "kind"]
    rows = listing.select(*keys, "id", F.struct(
        F.lit(0).alias("part"), F.col("position").cast("bigint").alias("at")).alias("turn")
    ).unionByName(planned.select(*keys, "id", F.struct(
        F.lit(1).alias("part"), F.col("first_at").cast("bigint").alias("at")).alias("turn")))
    once = rows.groupBy(*keys, "id").agg(F.min("turn").alias("turn"))
    return top_n(once, keys, [F.col("turn"), F.col("id")], cap).drop("turn").join(
        totals(once, keys), keys).withColumn("truncated", F.col("total") > cap)


def validate_route(routes: DataFrame, steps: DataFrame, snapshot: tuple[str, str], nodes: DataFrame,
                   relations: DataFrame) -> DataFrame:
    """Issues of browsing routes against a snapshot.

    ``steps``: route_id, step, node_id, relation_id.  The previous step is found by joining the
    step number, so a long route is not sorted in one task.
    """
    def issue(df, code, step=F.col("step")):
        return df.select("route_id", step.cast("bigint").alias("step"), F.lit(code).alias("code"))

    project_id, snapshot_id = snapshot
    facts = relations.select(F.col("id").alias("relation_id"), "source_id", "target_id", "type",
                             "resolution", F.lit(True).alias("known"))
    evidence = steps.join(facts, "relation_id", "left")
    unrelated = F.col("relation_id").isNotNull() & ~F.coalesce(
        F.col("known") & ((F.col("source_id") == F.col("node_id"))
                          | F.coalesce(F.col("target_id") == F.col("node_id"), F.lit(False))),
        F.lit(False))
    before = steps.select("route_id", (F.col("step") + 1).alias("step"),
                          F.col("node_id").alias("previous"))
    chain = evidence.join(routes.filter(F.col("kind") == "call_chain").select("route_id"),
                          "route_id", "left_semi").join(before, ["route_id", "step"])
    holds = (
        F.col("known") & (F.col("type") == "calls") & (F.col("resolution") == "resolved")
        & (F.col("source_id") == F.col("previous")) & (F.col("target_id") == F.col("node_id")))
    none = F.lit(None)
    return (
        issue(routes.filter(F.col("project_id") != project_id), "PROJECT_MISMATCH", none)
        .unionByName(issue(routes.filter(F.col("snapshot_id") != snapshot_id),
                           "SNAPSHOT_MISMATCH", none))
        .unionByName(issue(steps.join(nodes.select(F.col("id").alias("node_id")), "node_id",
                                      "left_anti"), "INVALID_ENDPOINT"))
        .unionByName(issue(evidence.filter(unrelated), "INVALID_RELATION"))
        .unionByName(issue(chain.filter(~F.coalesce(holds, F.lit(False))), "INVALID_CALL_CHAIN"))
    )


def call_chain_check(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """Whether each later step is reached from the one before by a resolved call."""
    before = steps.select("route_id", (F.col("step") + 1).alias("step"),
                          F.col("node_id").alias("previous"))
    calls = relations.filter(
        (F.col("type") == "calls") & (F.col("resolution") == "resolved")
    ).select(F.col("id").alias("relation_id"), "source_id", "target_id")
    rows = steps.join(before, ["route_id", "step"]).join(calls, "relation_id", "left")
    holds = (F.col("source_id") == F.col("previous")) & (F.col("target_id") == F.col("node_id"))
    return rows.select("route_id", "step", F.coalesce(holds, F.lit(False)).alias("holds"))


def route_stale(routes: DataFrame, projects: DataFrame) -> DataFrame:
    return routes.join(projects.select("project_id", "current_snapshot_id"), "project_id",
                       "left").select("route_id", (~F.col("snapshot_id").eqNullSafe(
                           F.col("current_snapshot_id"))).alias("stale"))
