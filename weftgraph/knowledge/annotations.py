"""Versioned notes: resolution, binding, reconciliation, listing and revision-checked changes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import digest, unordered_digest
from ..functions.paths import ancestors, slashes
from ..operators.paging import page, top_n, totals
from ..schemas import SCOPE
from ..staging import stage

FIELDS = ["text", "author", "source"]


def capture_unavailable(paths: DataFrame, coverage: DataFrame, diagnostics: DataFrame,
                        snapshots: DataFrame) -> DataFrame:
    """``unavailable`` per (scope, path): no record, an incomplete capture, or a path that touches
    an unread, excluded or diagnosed one in either direction."""
    gaps = coverage.filter(F.col("role").isin("unavailable", "excluded")).select(
        *SCOPE, F.col("path").alias("gap")
    ).unionByName(diagnostics.select(*SCOPE, slashes("file_path").alias("gap"))).distinct()
    asked = paths.select(*SCOPE, "path").distinct()
    below = asked.withColumn("gap", F.explode(ancestors("path"))).join(
        gaps, [*SCOPE, "gap"], "left_semi"
    )
    above = gaps.withColumn("path", F.explode(ancestors("gap"))).join(
        asked, [*SCOPE, "path"], "left_semi"
    )
    touched = below.select(*SCOPE, "path").unionByName(above.select(*SCOPE, "path")).distinct()
    whole = gaps.filter(F.col("gap") == ".").select(*SCOPE, F.lit(True).alias("all")).distinct()
    return (
        asked.join(touched.withColumn("hit", F.lit(True)), [*SCOPE, "path"], "left")
        .join(whole, SCOPE, "left")
        .join(snapshots.select(*SCOPE, "availability_recorded", "capture_complete"), SCOPE, "left")
        .select(*SCOPE, "path", (
            ~F.coalesce("availability_recorded", F.lit(False))
            | ~F.coalesce("capture_complete", F.lit(False))
            | F.coalesce("hit", F.lit(False)) | F.coalesce("all", F.lit(False))
        ).alias("unavailable"))
    )


def fact_targets(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Everything a note may be bound to: non-external nodes and relations."""
    return nodes.filter(F.col("kind") != "external").select(
        *SCOPE, F.lit("node").alias("target_kind"), F.col("id").alias("target_id"),
        F.coalesce("qualified_name", "name").alias("label"),
        F.coalesce("file_path", F.when(F.col("kind").isin("file", "folder"), F.col("name")))
        .alias("path"), F.col("kind").alias("node_kind"),
    ).unionByName(relations.select(
        *SCOPE, F.lit("relation").alias("target_kind"), F.col("id").alias("target_id"),
        F.concat(F.col("type"), F.lit(": "), F.col("source_id"), F.lit(" → "),
                 F.coalesce("target_id", F.lit("unknown"))).alias("label"),
        F.col("evidence_path").alias("path"), F.lit(None).cast("string").alias("node_kind"),
    ))


def resolve_annotations(notes: DataFrame, snapshot_id: str, nodes: DataFrame,
                        relations: DataFrame, coverage: DataFrame, diagnostics: DataFrame,
                        snapshots: DataFrame) -> DataFrame:
    """Status of every note against one snapshot of its project.

    Orphans stay orphans; nothing is called absent where the capture cannot prove it.
    """
    rows = notes.withColumn("snapshot_id", F.lit(snapshot_id))
    here = snapshots.select(*SCOPE, F.lit(True).alias("indexed"))
    facts = fact_targets(nodes, relations).select(
        *SCOPE, "target_kind", "target_id", F.lit(True).alias("found")
    )
    gaps = capture_unavailable(
        rows.filter(F.col("last_path").isNotNull()).select(*SCOPE, F.col("last_path").alias("path")),
        coverage, diagnostics, snapshots,
    ).withColumnRenamed("path", "last_path")
    joined = (
        rows.join(here, SCOPE, "left").join(facts, [*SCOPE, "target_kind", "target_id"], "left")
        .join(gaps, [*SCOPE, "last_path"], "left")
    )
    status = (
        F.when(F.col("binding_state").isNull(), "unbound")
        .when(F.col("binding_state") == "orphan", "orphan")
        .when(F.col("indexed").isNull(), "unknown")
        .when(F.coalesce("unavailable", F.lit(True)), "unknown")
        .when(F.col("found"), "bound").otherwise("orphan")
    )
    return joined.select(
        *notes.columns, "snapshot_id", status.alias("status"),
        F.when(F.col("binding_state") == "bound", F.when(
            F.col("indexed").isNull(), "no snapshot of the project"
        ).when(F.coalesce("unavailable", F.lit(True)),
               "capture cannot tell whether the target is there")).alias("reason"),
    )


def select_target(selections: DataFrame, nodes: DataFrame, relations: DataFrame,
                  coverage: DataFrame, diagnostics: DataFrame,
                  snapshots: DataFrame) -> DataFrame:
    """Bind selections (scope, selected_snapshot_id, target) or say why they are refused."""
    facts = fact_targets(nodes, relations)
    rows = selections.join(facts.withColumn("found", F.lit(True)),
                           [*SCOPE, "target_kind", "target_id"], "left")
    gaps = capture_unavailable(rows.filter(F.col("path").isNotNull()), coverage, diagnostics,
                               snapshots)
    rows = rows.join(gaps, [*SCOPE, "path"], "left")
    problem = (
        F.when(F.col("selected_snapshot_id") != F.col("snapshot_id"), "SNAPSHOT_CHANGED")
        .when(F.col("found").isNull(), "NOT_A_FACT")
        .when(F.coalesce("unavailable", F.lit(True)), "CAPTURE_UNAVAILABLE")
    )
    ok = problem.isNull()
    return rows.select(
        *selections.columns, problem.alias("problem"), F.when(ok, F.col("label")).alias("label"),
        F.when(ok, F.col("path")).alias("path"), F.when(ok, F.col("node_kind")).alias("node_kind"),
    )


def reconcile_annotations(resolved: DataFrame) -> DataFrame:
    """New revisions of live bound notes whose target is proven absent."""
    lost = (
        F.col("deleted_at").isNull() & (F.col("binding_state") == "bound")
        & (F.col("status") == "orphan")
    )
    return resolved.filter(lost).select(
        "project_id", "id", (F.col("revision") + 1).alias("revision"),
        F.lit("orphan").alias("binding_state"), F.col("snapshot_id").alias("orphaned_at"),
        "target_id", F.lit("orphan").alias("action"),
    )


def annotation_order() -> list[Column]:
    return [F.col("created_at"), F.col("id")]


def annotation_list(resolved: DataFrame, status: str | None = None, offset: int = 0,
                    limit: int = 50) -> DataFrame:
    live = resolved.filter(F.col("deleted_at").isNull())
    if status is not None:
        live = live.filter(F.col("status") == status)
    return page(live, ["project_id"], annotation_order(), offset, limit, 100).withColumn(
        "truncated", (F.lit(offset) > 0) | (F.lit(offset + limit) < F.col("total"))
    )


def apply_changes(current: DataFrame, changes: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revision-checked changes in ``seq`` order: (current, history, conflicts).

    ``current``: id, revision, text, target_id.  A change holds when its expected revision is the
    note's revision at its turn; an edit that changes nothing is accepted without a revision.
    Each round accepts the next change of every note at once (an aggregate, never a sorted
    group), so the number of rounds is the longest accepted chain of a single note.  A round
    writes only the notes it changed; they alone can change in the next one.
    """
    state = current.select(
        "id", "revision", "text", "target_id", F.lit(False).alias("deleted"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    moving, taken = state, None
    for n in count():
        turn = (
            changes.withColumnRenamed("seq", "at_seq").withColumnRenamed("text", "new_text")
            .withColumnRenamed("target_id", "new_target")
            .join(moving.filter(~F.col("deleted")).select(
                "id", "revision", "seq", "text", "target_id"), "id")
            .filter((F.col("at_seq") > F.col("seq")) & (F.col("expected") == F.col("revision")))
            .groupBy("id").agg(F.min_by(F.struct(
                "revision", "text", "target_id", "action", "at_seq", "new_text", "new_target",
                "expected"), "at_seq").alias("c"))
        )
        noop = (
            ((F.col("c.action") == "edit") & F.col("c.new_text").eqNullSafe(F.col("c.text")))
            | ((F.col("c.action") == "bind")
               & F.col("c.new_target").eqNullSafe(F.col("c.target_id")))
            | ((F.col("c.action") == "detach") & F.col("c.target_id").isNull())
        )
        step = stage(turn.select(
            "id", F.col("c.action").alias("action"), F.col("c.at_seq").alias("seq"),
            noop.alias("noop"),
            F.when(noop, F.col("c.revision")).otherwise(F.col("c.revision") + 1)
            .alias("revision"),
            F.when(F.col("c.action") == "edit", F.col("c.new_text"))
            .otherwise(F.col("c.text")).alias("text"),
            F.when(F.col("c.action") == "bind", F.col("c.new_target"))
            .when(F.col("c.action") != "detach", F.col("c.target_id")).alias("target_id"),
        ), f"note-round-{n}")
        if step.isEmpty():
            break
        taken = step if taken is None else taken.unionByName(step)
        moving = step.select("id", "revision", "text", "target_id",
                             (F.col("action") == "delete").alias("deleted"), "seq")
    if taken is None:
        taken = state.limit(0).select(
            "id", F.lit("").alias("action"), "seq", F.lit(False).alias("noop"), "revision",
            "text", "target_id",
        )
    row = F.struct("revision", "text", "target_id", (F.col("action") == "delete").alias("deleted"),
                   "seq")
    last = taken.groupBy("id").agg(F.max_by(row, "seq").alias("c")).select("id", "c.*")
    state = state.join(last.select("id"), "id", "left_anti").unionByName(last)
    conflicts = changes.join(taken.select("id", "seq"), ["id", "seq"], "left_anti")
    return state, taken.filter(~F.col("noop")), conflicts


def annotation_history(history: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """Revisions of each note, newest first."""
    return page(history, ["id"], [F.col("revision").desc(), F.col("seq").desc()], offset, limit,
                100).withColumn(
        "truncated", (F.lit(offset) > 0) | (F.lit(offset + limit) < F.col("total"))
    )


def stored_note_check(notes: DataFrame, projects: DataFrame) -> DataFrame:
    """Schema problems of ALL stored notes, before any project filter can hide one."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    bound = F.col("binding_state").isNotNull()
    checks = {
        "id": blank("id") | (F.length("id") > 200) | F.col("id").rlike(r"[\x00-\x1f\x7f]"),
        "text": blank("text") | (F.length("text") > 20000),
        "author": blank("author"),
        "source": ~F.col("source").isin("user", "agent"),
        "revision": F.col("revision").isNull() | (F.col("revision") < 1),
        "binding": bound & (~F.col("binding_state").isin("bound", "orphan") | blank("target_id")
                            | blank("last_path")),
        "orphan": (F.col("binding_state") == "orphan") & F.col("orphaned_at").isNull(),
        "project_id": blank("project_id") | F.col("owner").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    owners = projects.select("project_id", F.lit(True).alias("owner")).distinct()
    return notes.join(owners, "project_id", "left").select("id", F.explode(found).alias("field"))


def knowledge_hash(notes: DataFrame, snapshot_id: str) -> DataFrame:
    """Digest of a project's live notes, free of timestamps, revisions and order."""
    framed = F.to_json(F.array(
        "id", "project_id", "text", "author", "source", F.col("is_constraint").cast("string"),
        F.coalesce("target_kind", F.lit("")), F.coalesce("target_id", F.lit("")),
        F.coalesce("selected_snapshot_id", F.lit("")), F.coalesce("last_label", F.lit("")),
        F.coalesce("last_path", F.lit("")), F.coalesce("last_node_kind", F.lit("")),
        F.coalesce("binding_state", F.lit("")), F.coalesce("orphaned_at", F.lit("")),
    ))
    return notes.filter(F.col("deleted_at").isNull()).groupBy("project_id").agg(
        unordered_digest(framed).alias("d")
    ).select("project_id", digest(F.concat_ws(
        "|", F.lit("annotation-review-v1"), "project_id", F.lit(snapshot_id), "d"
    )).alias("knowledge_hash"))
