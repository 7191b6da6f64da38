"""Planned state of nodes: additions, moves and removals per plan over a snapshot.

Operations are never ranked per plan: first and last occurrences come from aggregates that
combine map-side, so one very long plan is no bottleneck.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import normalize_repo_path, path_within
from ..operators.asked import Asked
from ..schemas import SCOPE
from ..staging import stage

PLAN = [*SCOPE, "plan_id"]


def of_kind(ops: DataFrame, *kinds: str) -> DataFrame:
    return ops.filter(F.col("kind").isin(*kinds))


def additions(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Planned functions: the first addition of each temporary id that no fact uses."""
    first = of_kind(ops, "add_function").groupBy(*PLAN, "temp_id").agg(
        F.min_by(F.struct("name", "file_path", "language", "signature", "op_index"), "op_index")
        .alias("a")
    )
    facts = nodes.select(*SCOPE, F.col("id").alias("temp_id"))
    return first.join(facts, [*SCOPE, "temp_id"], "left_anti").select(
        *PLAN, F.col("temp_id").alias("id"), "a.name",
        normalize_repo_path(F.col("a.file_path")).alias("file_path"), "a.language",
        "a.signature", "a.op_index",
    )


def last_moves(ops: DataFrame) -> DataFrame:
    return of_kind(ops, "move_function").groupBy(*PLAN, F.col("node_id").alias("id")).agg(
        normalize_repo_path(F.max_by("file_path", "op_index")).alias("moved_to")
    )


def _lookup(refs: DataFrame, added: DataFrame, nodes: DataFrame) -> DataFrame:
    """Kind, name and path of referenced ids before moves and removals."""
    planned = added.select(
        *PLAN, "id", F.lit("function").alias("a_kind"), F.col("name").alias("a_name"),
        F.col("file_path").alias("a_path"),
    )
    facts = nodes.select(*SCOPE, "id", F.col("kind").alias("f_kind"), F.col("name").alias("f_name"),
                         F.col("file_path").alias("f_path"))
    ids = refs.select(*PLAN, "id").filter(F.col("id").isNotNull()).distinct()
    return (
        ids.join(facts, [*SCOPE, "id"], "left").join(planned, [*PLAN, "id"], "left")
        .select(*PLAN, "id", F.coalesce("f_kind", "a_kind").alias("node_kind"),
                F.coalesce("f_name", "a_name").alias("node_name"),
                F.coalesce("f_path", "a_path").alias("node_path"))
        .filter(F.col("node_kind").isNotNull())
    )


@dataclass(frozen=True)
class PlanState:
    """What a plan log says about the nodes it refers to, computed once for all rules."""

    ops: DataFrame
    nodes: DataFrame
    added: DataFrame    # planned functions that use a fresh id
    known: DataFrame    # referenced ids that exist, before moves and removals
    gone: DataFrame     # removed functions with the first removing operation
    moves: DataFrame    # last planned path per id

    def effective(self, known: DataFrame | None = None) -> DataFrame:
        """Surviving nodes at their planned paths (moves apply to functions only)."""
        rows = self.known if known is None else known
        alive = rows.join(self.gone.select(*PLAN, "id"), [*PLAN, "id"], "left_anti")
        moved = (F.col("node_kind") == "function") & F.col("moved_to").isNotNull()
        return alive.join(self.moves, [*PLAN, "id"], "left").select(
            *PLAN, "id", "node_kind", "node_name",
            F.when(moved, F.col("moved_to")).otherwise(F.col("node_path")).alias("node_path"),
        )

    @cached_property
    def alive(self) -> DataFrame:
        """Surviving referenced nodes, written once because several rules read them."""
        return stage(self.effective(), "plan-alive")

    @cached_property
    def endpoints(self) -> DataFrame:
        """Planned relations with the planned state of both ends and whether they are usable."""
        rows = of_kind(self.ops, "add_relation")
        for side in ("source", "target"):
            rows = rows.join(
                self.alive.select(*PLAN, F.col("id").alias(f"{side}_id"),
                                  F.col("node_kind").alias(f"{side}_kind"),
                                  F.col("node_name").alias(f"{side}_name"),
                                  F.col("node_path").alias(f"{side}_path")),
                [*PLAN, f"{side}_id"], "left",
            )
        usable = (F.col("source_kind") == "function") & F.col("target_kind").isin(
            "function", "external"
        )
        return stage(rows.withColumn("usable", F.coalesce(usable, F.lit(False))),
                     "plan-endpoints")

    def look_up(self, refs: DataFrame) -> DataFrame:
        nodes = Asked(refs.select("id")).among(self.nodes, "id")
        return _lookup(refs, self.added, nodes)


def named_nodes(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without most of those that no operation names."""
    return Asked(ops.select(F.explode(F.array_compact(F.array(
        "temp_id", "node_id", "source_id", "target_id"))))).among(nodes, "id")


def plan_state(ops: DataFrame, nodes: DataFrame) -> PlanState:
    named = named_nodes(ops, nodes)
    added = stage(additions(ops, named), "plan-added")
    refs = ops.select(
        *PLAN, F.explode(F.array_compact(F.array("node_id", "source_id", "target_id"))).alias("id")
    )
    known = stage(_lookup(refs, added, named), "plan-known")
    removals = of_kind(ops, "remove_function").groupBy(*PLAN, F.col("node_id").alias("id")).agg(
        F.min("op_index").alias("removed_at")
    )
    functions = known.filter(F.col("node_kind") == "function").select(*PLAN, "id")
    gone = stage(removals.join(functions, [*PLAN, "id"], "left_semi"), "plan-gone")
    return PlanState(ops, nodes, added, known, gone, last_moves(ops))


def effective_path(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Planned path of every touched function: the last move, else its addition, else physical."""
    touched = ops.select(*PLAN, F.coalesce("node_id", "temp_id").alias("id"))
    added = of_kind(ops, "add_function").groupBy(*PLAN, F.col("temp_id").alias("id")).agg(
        F.min_by("file_path", "op_index").alias("added_path")
    )
    moved = of_kind(ops, "move_function").groupBy(*PLAN, F.col("node_id").alias("id")).agg(
        F.max_by("file_path", "op_index").alias("moved_path")
    )
    facts = named_nodes(ops, nodes).select(*SCOPE, "id", "file_path")
    ids = touched.filter(F.col("id").isNotNull()).distinct()
    return (
        ids.join(added, [*PLAN, "id"], "left").join(moved, [*PLAN, "id"], "left")
        .join(facts, [*SCOPE, "id"], "left")
        .select(*PLAN, "id",
                F.coalesce("moved_path", "added_path", "file_path").alias("planned_path"))
    )


def planned_destinations(ops: DataFrame) -> DataFrame:
    """Last planned destination of each id; ids removed anywhere in the plan are left out."""
    last = of_kind(ops, "add_function", "move_function").groupBy(
        *PLAN, F.coalesce("temp_id", "node_id").alias("id")
    ).agg(F.max_by("file_path", "op_index").alias("target"),
          F.min("op_index").alias("first_at"))
    gone = of_kind(ops, "remove_function").select(*PLAN, F.col("node_id").alias("id"))
    return last.join(gone, [*PLAN, "id"], "left_anti")


def planned_scope(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """Planned ids whose destination lies in a requested file or folder.

    Destinations carry their ancestors (and the root), so membership is an equality join on the
    path; requests are ``(plan key, path, kind)``.
    """
    from ..functions.paths import ancestors

    dest = planned_destinations(ops)
    exact = dest.withColumn("path", F.col("target")).withColumn("scope_kind", F.lit("file"))
    above = dest.withColumn(
        "path",
        F.explode(F.array_distinct(
            F.array_prepend(ancestors(F.col("target"), include_self=False), F.lit(".")))),
    ).withColumn("scope_kind", F.lit("folder"))
    asked = requests.select(*PLAN, "path", F.col("kind").alias("scope_kind")).distinct()
    return exact.unionByName(above).join(asked, [*PLAN, "path", "scope_kind"])


def normalized_policies(policies: DataFrame) -> DataFrame:
    """Policies with canonical prefixes; ``ok`` is false when a prefix does not normalize."""
    raw = F.regexp_replace(F.replace("path_prefix", F.lit("\\"), F.lit("/")), r"/+$", "")
    prefix = F.when(raw.isin("", "."), "").otherwise(normalize_repo_path(raw))
    targets = F.transform(
        "forbidden", lambda d: normalize_repo_path(F.regexp_replace(d, r"[/\\]+$", ""))
    )
    return policies.select(
        "project_id", F.col("id").alias("policy_id"), prefix.alias("prefix"),
        targets.alias("targets"),
        (prefix.isNotNull() & ~F.exists(targets, lambda t: t.isNull())).alias("ok"),
    )


def forbidden_by(paths: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows whose ``source_path`` lies under a policy that forbids their ``target_key``.

    The source's ancestors meet policy prefixes by equality instead of a prefix loop.
    """
    from ..functions.paths import ancestors

    usable = normalized_policies(policies).filter("ok").select(
        F.col("project_id").alias("policy_project"), "policy_id", "prefix", "targets"
    )
    spread = paths.withColumn(
        "prefix", F.explode(F.array_prepend(ancestors(F.col("source_path")), F.lit("")))
    )
    return spread.join(usable, ["policy_project", "prefix"]).filter(
        F.exists("targets", lambda t: path_within(F.col("target_key"), t))
    ).drop("prefix", "targets")
