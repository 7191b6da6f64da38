"""Plan validation: every rule is a DataFrame of issues, the report is their union.

``ops`` carries the snapshot a plan is checked against (project_id, snapshot_id) and plan_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.asked import Asked
from ..schemas import SCOPE
from ..staging import stage
from .state import PLAN, PlanState, forbidden_by, normalized_policies, of_kind

ISSUE = ["plan_id", "op_index", "severity", "code", "message"]


def _issues(df: DataFrame, code: str, message, severity: str = "error") -> DataFrame:
    index = F.col("op_index") if "op_index" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        *SCOPE, "plan_id", index.cast("bigint").alias("op_index"),
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"),
    )


def _text(template: str, *cols: str):
    return F.format_string(template, *[F.col(c) for c in cols])


def rule_project_mismatch(plans: DataFrame, snapshots: DataFrame) -> DataFrame:
    rows = plans.join(
        snapshots.withColumnRenamed("project_id", "against"), "snapshot_id"
    ).filter(F.col("project_id") != F.col("against"))
    return _issues(rows, "PROJECT_MISMATCH",
                   F.lit("plan of another project than the snapshot"))


def rule_baseline_mismatch(plans: DataFrame, snapshots: DataFrame) -> DataFrame:
    rows = plans.join(snapshots.select("snapshot_id", "content_hash"), "snapshot_id").filter(
        (F.col("baseline_snapshot_id") != F.col("snapshot_id"))
        | (F.col("baseline_content_hash") != F.col("content_hash"))
    )
    return _issues(rows, "BASELINE_MISMATCH",
                   F.lit("plan made on another baseline"))


def rule_duplicate_node(state: PlanState) -> DataFrame:
    """Additions whose id is a fact or an earlier addition of the plan."""
    kept = state.added.select(*PLAN, F.col("id").alias("temp_id"), "op_index")
    rows = of_kind(state.ops, "add_function").join(kept, [*PLAN, "temp_id", "op_index"], "left_anti")
    return _issues(rows, "DUPLICATE_NODE", _text("id %s is taken", "temp_id"))


def rule_invalid_function(state: PlanState) -> DataFrame:
    touched = of_kind(state.ops, "move_function", "remove_function")
    known = state.known.filter(F.col("node_kind") == "function").select(
        *PLAN, F.col("id").alias("node_id")
    )
    rows = touched.join(known, [*PLAN, "node_id"], "left_anti")
    return _issues(rows, "INVALID_FUNCTION", _text("no function %s", "node_id"))


def rule_invalid_relation(ops: DataFrame, relations: DataFrame) -> DataFrame:
    removed = of_kind(ops, "remove_relation")
    facts = Asked(removed.select("relation_id")).among(relations, "id")
    rows = removed.join(
        facts.select(*SCOPE, F.col("id").alias("relation_id")),
        [*SCOPE, "relation_id"], "left_anti",
    )
    return _issues(rows, "INVALID_RELATION", _text("no relation %s", "relation_id"))


def rule_duplicate_removal(state: PlanState) -> DataFrame:
    """Second and later removals of the same function or relation, in operation order."""
    ops = state.ops
    gone = state.gone.withColumnRenamed("id", "node_id")
    again = of_kind(ops, "remove_function").join(gone, [*PLAN, "node_id"]).filter(
        F.col("op_index") > F.col("removed_at")
    )
    edges = of_kind(ops, "remove_relation")
    first = edges.groupBy(*PLAN, "relation_id").agg(F.min("op_index").alias("removed_at"))
    twice = edges.join(first, [*PLAN, "relation_id"]).filter(
        F.col("op_index") > F.col("removed_at")
    )
    return _issues(
        again, "DUPLICATE_REMOVAL", _text("function %s removed again", "node_id")
    ).unionByName(_issues(
        twice, "DUPLICATE_REMOVAL", _text("relation %s removed again", "relation_id")
    ))


def rule_removed_function(state: PlanState) -> DataFrame:
    gone = state.gone.select(*PLAN, F.col("id").alias("node_id"))
    rows = of_kind(state.ops, "move_function").join(gone, [*PLAN, "node_id"], "left_semi")
    return _issues(rows, "REMOVED_FUNCTION", _text("function %s moves although it is removed", "node_id"))


def _planned_relations(ops: DataFrame) -> DataFrame:
    return of_kind(ops, "add_relation").groupBy(*PLAN, "relation_id").agg(
        F.min("op_index").alias("first_added")
    )


def rule_invalid_target(state: PlanState, relations: DataFrame) -> DataFrame:
    """Annotations of nothing: neither a surviving node nor a surviving relation that is a fact
    or was planned by an earlier operation."""
    ops = state.ops
    notes = of_kind(ops, "annotate")
    alive = state.alive.select(*PLAN, F.col("id").alias("target_id"))
    orphan = notes.join(alive, [*PLAN, "target_id"], "left_anti")
    facts = Asked(notes.select("target_id")).among(relations, "id").select(
        *SCOPE, F.col("id").alias("target_id"), F.lit(True).alias("fact"))
    planned = _planned_relations(ops).withColumnRenamed("relation_id", "target_id")
    gone = of_kind(ops, "remove_relation").select(
        *PLAN, F.col("relation_id").alias("target_id"), F.lit(True).alias("gone")
    ).distinct()
    rows = (
        orphan.join(facts, [*SCOPE, "target_id"], "left")
        .join(planned, [*PLAN, "target_id"], "left").join(gone, [*PLAN, "target_id"], "left")
        .filter(~(
            (F.coalesce("fact", F.lit(False))
             | F.coalesce(F.col("first_added") < F.col("op_index"), F.lit(False)))
            & F.col("gone").isNull()
        ))
    )
    return _issues(rows, "INVALID_TARGET", _text("nothing to annotate at %s",
                                                 "target_id"))


def rule_duplicate_relation(ops: DataFrame, relations: DataFrame) -> DataFrame:
    adds = of_kind(ops, "add_relation").join(_planned_relations(ops), [*PLAN, "relation_id"])
    added = of_kind(ops, "add_relation").select("relation_id")
    facts = Asked(added).among(relations, "id").select(
        *SCOPE, F.col("id").alias("relation_id"), F.lit(True).alias("fact"))
    rows = adds.join(facts, [*SCOPE, "relation_id"], "left").filter(
        F.col("fact").isNotNull() | (F.col("op_index") > F.col("first_added"))
    )
    return _issues(rows, "DUPLICATE_RELATION", _text("relation id %s is taken", "relation_id"))


def rule_invalid_endpoint(state: PlanState) -> DataFrame:
    return _issues(
        state.endpoints.filter(~F.col("usable")), "INVALID_ENDPOINT",
        F.lit("a call needs a function and a callable"),
    )


def rule_compatibility_unknown(state: PlanState) -> DataFrame:
    return _issues(
        state.endpoints.filter("usable"), "COMPATIBILITY_UNKNOWN",
        F.lit("a reader must judge whether the call fits"), "warning",
    )


def rule_invalid_policy_path(plans: DataFrame, policies: DataFrame) -> DataFrame:
    broken = normalized_policies(policies).filter(~F.col("ok")).select("project_id", "policy_id")
    return _issues(plans.join(broken, "project_id"), "INVALID_POLICY_PATH",
                   _text("policy %s names a path outside the tree", "policy_id"))


def rule_forbidden_planned(plans: DataFrame, state: PlanState, policies: DataFrame) -> DataFrame:
    owner = plans.select("plan_id", F.col("project_id").alias("policy_project"))
    rows = state.endpoints.filter("usable").join(owner, "plan_id").select(
        *PLAN, "op_index", "policy_project", F.col("source_path"),
        F.coalesce("target_path", "target_name").alias("target_key"),
    ).filter(F.col("source_path").isNotNull())
    return _issues(forbidden_by(rows, policies), "FORBIDDEN_DEPENDENCY",
                   _text("forbidden by policy %s", "policy_id"))


def fact_violations(nodes: DataFrame, relations: DataFrame, policies: DataFrame) -> DataFrame:
    """(scope, relation_id, policy_id): calls and imports of a snapshot that break a policy."""
    # Both joins read the same columns of the nodes, which are shuffled once.
    ends = nodes.select(*SCOPE, "id", "file_path", F.coalesce("file_path", "name").alias("key"))
    rows = (
        relations.filter(F.col("type").isin("calls", "imports") & F.col("target_id").isNotNull())
        .select(*SCOPE, F.col("id").alias("relation_id"), "source_id", "target_id")
        .join(ends.toDF(*SCOPE, "source_id", "source_path", "source_key"), [*SCOPE, "source_id"])
        .join(ends.toDF(*SCOPE, "target_id", "target_path", "target_key"), [*SCOPE, "target_id"])
        .filter(F.col("source_path").isNotNull())
        .withColumn("policy_project", F.col("project_id"))
    )
    return forbidden_by(rows, policies).select(
        *SCOPE, "relation_id", "policy_id", "source_id", "target_id"
    )


def rule_forbidden_existing(plans: DataFrame, state: PlanState, relations: DataFrame,
                            policies: DataFrame) -> DataFrame:
    """Existing relations against policies after the planned moves and removals, as changes.

    A snapshot's own violations hold for every plan, so they are listed once (``plan_id`` null,
    change ``baseline``).  Per plan only the differences follow: ``cleared`` where the plan
    removes the relation or an end or moves an end out, ``introduced`` where a move breaks a
    policy.  Plans therefore never multiply with the snapshot's relations.
    """
    ops = state.ops
    base = stage(fact_violations(state.nodes, relations, policies), "fact-violations")
    owner = plans.select("plan_id", F.col("project_id").alias("policy_project"))
    changed = state.moves.select(*PLAN, "id").unionByName(
        state.gone.select(*PLAN, "id")
    ).distinct()
    facts = relations.filter(
        F.col("type").isin("calls", "imports") & F.col("target_id").isNotNull()
    ).select(*SCOPE, F.col("id").alias("relation_id"), "source_id", "target_id")
    dropped = of_kind(ops, "remove_relation").select(*PLAN, "relation_id").distinct()
    ids = Asked(of_kind(ops, "move_function", "remove_function").select("node_id"))
    removed = Asked(of_kind(ops, "remove_relation").select("relation_id"))
    near = (
        ids.among(facts, "source_id")
        .join(changed.withColumnRenamed("id", "source_id"), [*SCOPE, "source_id"])
        .unionByName(ids.among(facts, "target_id").join(
            changed.withColumnRenamed("id", "target_id"), [*SCOPE, "target_id"]))
        .unionByName(removed.among(facts, "relation_id").join(dropped, [*SCOPE, "relation_id"]))
        .select(*PLAN, "relation_id", "source_id", "target_id").distinct()
    )
    near = stage(near.join(owner, "plan_id"), "touched-facts")
    touched = near.select(*PLAN, F.explode(F.array("source_id", "target_id")).alias("id"))
    ends = stage(state.effective(state.look_up(touched)), "touched-ends")
    after = near.join(dropped, [*PLAN, "relation_id"], "left_anti").join(
        ends.select(*PLAN, F.col("id").alias("source_id"),
                    F.col("node_path").alias("source_path")), [*PLAN, "source_id"]
    ).join(
        ends.select(*PLAN, F.col("id").alias("target_id"),
                     F.coalesce("node_path", "node_name").alias("target_key")),
        [*PLAN, "target_id"],
    ).filter(F.col("source_path").isNotNull())
    now = forbidden_by(after, policies).select(*PLAN, "relation_id", "policy_id")
    before = near.join(base.select(*SCOPE, "relation_id", "policy_id"),
                       [*SCOPE, "relation_id"]).filter(
        F.col("policy_project") == F.col("project_id")
    ).select(*PLAN, "relation_id", "policy_id")
    pair = [*PLAN, "relation_id", "policy_id"]
    listed = base.select(*SCOPE, F.lit(None).cast("string").alias("plan_id"), "relation_id",
                         "policy_id", F.lit("baseline").alias("change"))
    return (
        listed
        .unionByName(before.join(now, pair, "left_anti").withColumn("change", F.lit("cleared")))
        .unionByName(now.join(before, pair, "left_anti")
                     .withColumn("change", F.lit("introduced")))
    )


def schema_issues(plans: DataFrame, ops: DataFrame) -> DataFrame:
    """Closed-record checks of plans and operations as INVALID_INPUT rows with their field."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    need = {
        "add_function": ["temp_id", "name", "file_path"], "move_function": ["node_id", "file_path"],
        "remove_function": ["node_id"], "add_relation": ["relation_id", "source_id", "target_id"],
        "remove_relation": ["relation_id"], "annotate": ["target_id", "text"],
    }
    from ..functions.paths import normalize_repo_path

    found = [F.when(~F.col("kind").isin(*need), F.lit("kind"))]
    for kind, fields in need.items():
        for name in fields:
            bad = blank(name)
            if name == "file_path":
                bad = bad | normalize_repo_path(name).isNull()
            found.append(F.when((F.col("kind") == kind) & bad, F.lit(name)))
    bad_ops = ops.select(
        *SCOPE, "plan_id", "op_index", F.explode(F.array_compact(F.array(*found))).alias("field")
    ).withColumn("field", F.concat(F.lit("operations."), F.col("op_index").cast("string"),
                                   F.lit("."), F.col("field")))
    bad_plans = plans.select(
        *SCOPE, "plan_id",
        F.explode(F.array_compact(F.array(
            F.when(blank("title"), F.lit("title")),
            F.when(F.col("description").isNull(), F.lit("description")),
            F.when(F.col("revision").isNull() | (F.col("revision") < 1), F.lit("revision")),
        ))).alias("field"),
    )
    return _issues(bad_ops, "INVALID_INPUT", F.col("field")).unionByName(
        _issues(bad_plans, "INVALID_INPUT", F.col("field"))
    )


def validate_plan(plans: DataFrame, state: PlanState, relations: DataFrame,
                  snapshots: DataFrame, policies: DataFrame,
                  forbidden: DataFrame | None = None) -> DataFrame:
    """All issues of every plan; baseline policy violations are counted per snapshot instead.

    ``plans`` carries ``plan_id``, its own ``project_id`` and the ``snapshot_id`` checked against.
    """
    if forbidden is None:
        forbidden = rule_forbidden_existing(plans, state, relations, policies)
    existing = forbidden.filter(F.col("change") == "introduced")
    parts = [
        rule_project_mismatch(plans, snapshots), rule_baseline_mismatch(plans, snapshots),
        rule_duplicate_node(state), rule_invalid_function(state),
        rule_invalid_relation(state.ops, relations), rule_duplicate_removal(state),
        rule_invalid_policy_path(plans, policies), rule_removed_function(state),
        rule_invalid_target(state, relations), rule_duplicate_relation(state.ops, relations),
        rule_invalid_endpoint(state), rule_compatibility_unknown(state),
        rule_forbidden_planned(plans, state, policies),
        _issues(existing, "FORBIDDEN_DEPENDENCY",
                F.format_string("present relation %s is forbidden by policy %s",
                                F.col("relation_id"), F.col("policy_id"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def plan_issue_summary(plans: DataFrame, issues: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Errors and warnings per plan, counting inherited policy violations without listing them."""
    counts = issues.groupBy("plan_id").agg(
        F.count_if(F.col("severity") == "error").alias("own_errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    inherited = forbidden.filter(F.col("change") == "baseline").groupBy(
        "project_id", "snapshot_id").agg(F.count(F.lit(1)).alias("inherited"))
    cleared = forbidden.filter(F.col("change") == "cleared").groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("cleared"))
    return (
        plans.select("plan_id", "project_id", "snapshot_id")
        .join(counts, "plan_id", "left").join(cleared, "plan_id", "left")
        .join(inherited, ["project_id", "snapshot_id"], "left").na.fill(0)
        .select("plan_id", "warnings",
                (F.col("own_errors") + F.col("inherited") - F.col("cleared")).alias("errors"))
        .withColumn("has_error", F.col("errors") > 0)
    )
