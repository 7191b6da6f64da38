"""Three-valued verification of planned operations against a later snapshot.

Candidates are pre-aggregated per identity key, so a symbol name shared by a large part of a
snapshot joins as one row; nothing is concluded from files that were not captured.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ancestors, evidence_text, language_family, normalize_repo_path
from ..functions.paths import symbol_location
from ..operators.asked import Asked
from ..schemas import SCOPE
from ..staging import stage
from .state import of_kind

REF = ["plan_id", "id"]


def capture_gaps(coverage: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(scope, path, family, source): places whose content is not fully known."""
    unread = coverage.filter(F.col("role").isin("unavailable", "excluded")).select(
        *SCOPE, "path", F.col("role").alias("source")
    )
    broken = diagnostics.select(
        *SCOPE, normalize_repo_path("file_path").alias("path"), F.lit("diagnostic").alias("source")
    )
    return unread.unionByName(broken).distinct().withColumn("family", language_family("path"))


def capture_incomplete(paths: DataFrame, coverage: DataFrame, diagnostics: DataFrame,
                       snapshots: DataFrame) -> DataFrame:
    """``incomplete`` for each (scope, path, search_all): can absence be trusted there?

    A path is affected by a gap at itself or an ancestor; a whole-language search also by any gap
    in the same language family.  Without an availability record only listed files count.
    """
    gaps = capture_gaps(coverage, diagnostics)
    asked = paths.select(*SCOPE, "path", "search_all").distinct()
    above = asked.withColumn("at", F.explode(ancestors("path")))
    touched = above.join(
        gaps.select(*SCOPE, F.col("path").alias("at"), "source"), [*SCOPE, "at"]
    ).groupBy(*SCOPE, "path", "search_all").agg(
        F.bool_or(F.col("source") == "diagnostic").alias("near_diagnostic"),
        F.bool_or(F.col("source") != "diagnostic").alias("near_unread"),
    )
    unread, broken = F.col("source") == "unavailable", F.col("source") == "diagnostic"
    families = gaps.groupBy(*SCOPE).agg(*[
        F.bool_or(kind & (F.col("family") == family)).alias(f"{label}_{family}")
        for label, kind in (("unread", unread), ("broken", broken))
        for family in ("python", "javascript", "unknown")
    ], F.bool_or(broken).alias("broken_any"))
    listed = coverage.filter(F.col("role") == "file").select(
        *SCOPE, "path", F.lit(True).alias("listed")
    ).distinct()
    rows = (
        asked.join(snapshots.select(*SCOPE, "availability_recorded", "capture_complete"), SCOPE)
        .join(touched, [*SCOPE, "path", "search_all"], "left")
        .join(families, SCOPE, "left").join(listed, [*SCOPE, "path"], "left")
    )
    family = language_family("path")

    def same_family(label: str) -> Column:
        return reduce(lambda a, b: a | b, [
            (family == f) & F.coalesce(f"{label}_{f}", F.lit(False))
            for f in ("python", "javascript", "unknown")
        ]) | F.coalesce(f"{label}_unknown", F.lit(False))

    named = F.col("path") != ""
    missing = F.col("listed").isNull() & named
    searched = F.col("search_all")
    by_capture = F.when(~F.col("availability_recorded"), missing).otherwise(
        (~F.col("capture_complete") & (searched | missing))
        | F.coalesce("near_unread", F.lit(False)) | (searched & named & same_family("unread"))
    )
    in_unknown = (family == "unknown") & F.coalesce("broken_any", F.lit(False))
    by_diagnostic = F.coalesce("near_diagnostic", F.lit(False)) | (
        searched & named & (same_family("broken") | in_unknown)
    )
    return rows.select(*SCOPE, "path", "search_all",
                       (by_capture | by_diagnostic).alias("incomplete"))


def _candidates(nodes: DataFrame, *keys: str) -> DataFrame:
    """One row per key: how many nodes share it, and the id of the first of them."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("found_id"))


def _described(nodes: DataFrame) -> DataFrame:
    """One row per id: how many nodes share it, their kind and place."""
    place = symbol_location("file_path", "name", "start_line")
    return nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_id"), F.min_by(F.struct(
            F.col("kind").alias("found_kind"), place.alias("found_at")), "id").alias("hit"))


def _with_symbol(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("symbol", F.coalesce("qualified_name", "name")).withColumn(
        "lang", F.coalesce("language", F.lit(""))
    )


@dataclass(frozen=True)
class Verification:
    """Plans (operations), the baseline they were made for and the current snapshot.

    All frames of one side hold one snapshot per plan; ``current_*`` frames carry the scope whose
    coverage decides what may be concluded.
    """

    scope: tuple[str, str]
    ops: DataFrame
    baseline_nodes: DataFrame
    baseline_relations: DataFrame
    nodes: DataFrame
    relations: DataFrame
    coverage: DataFrame
    diagnostics: DataFrame
    snapshots: DataFrame

    @cached_property
    def additions(self) -> DataFrame:
        """The last addition of each temporary id."""
        return of_kind(self.ops, "add_function").groupBy(
            "plan_id", F.col("temp_id").alias("id")
        ).agg(F.max_by(F.struct(
            F.col("name").alias("add_name"), normalize_repo_path("file_path").alias("add_path"),
            F.col("language").alias("add_language"), F.col("signature").alias("add_signature"),
        ), "op_index").alias("a")).select("plan_id", "id", "a.*")

    @cached_property
    def moves(self) -> DataFrame:
        return of_kind(self.ops, "move_function").groupBy(
            "plan_id", F.col("node_id").alias("id")
        ).agg(normalize_repo_path(F.max_by("file_path", "op_index")).alias("moved_to"))

    def bind(self, refs: DataFrame) -> DataFrame:
        """Resolve (plan_id, id, enforce, removing) to a node of the current snapshot.

        Output: ``n`` candidates, the first one, and ``uncertain``.
        """
        keys = [*REF, "enforce", "removing"]
        asked = (
            refs.select(*keys).distinct()
            .join(self.additions, REF, "left").join(self.moves, REF, "left")
            .withColumn("moved_to", F.when(F.col("enforce"), F.col("moved_to")))
        )
        asked = stage(asked, "asked-symbols")
        added = asked.filter(F.col("add_path").isNotNull() | F.col("add_name").isNotNull())
        added = added.withColumn("path", F.coalesce("moved_to", "add_path"))
        functions = self.nodes.filter(F.col("kind") == "function").withColumn(
            "label", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name"))))
        )
        # Only functions that are asked for by path and label move and are counted.  (A semi join here
        # would be pushed below the test of the bits and move them all.)
        wanted = added.select(F.col("path").alias("file_path"), F.col("add_name").alias("label"))
        by_label = _candidates(Asked(wanted).among(functions, "file_path", "label"),
                               "file_path", "label", "language", "signature")
        hits_added = (
            added.join(by_label, (F.col("path") == F.col("file_path"))
                       & (F.col("add_name") == F.col("label"))
                       & (F.col("add_language").isNull() | (F.col("add_language") == F.col("language")))
                       & (F.col("add_signature").isNull()
                          | (F.col("add_signature") == F.col("signature"))), "left")
            .groupBy(*keys, "path")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("found_id").alias("found_id"))
            .withColumn("search_all", F.lit(False)).withColumn("known", F.lit(True))
        )
        by_id = asked.filter(F.col("add_path").isNull() & F.col("add_name").isNull())
        facts = by_id.join(
            Asked(by_id.select("id")).among(_with_symbol(self.baseline_nodes), "id").select(
                "id", F.col("kind").alias("b_kind"), F.col("symbol").alias("b_symbol"),
                F.col("lang").alias("b_lang"), F.col("file_path").alias("b_path")),
            "id", "left",
        )
        facts = stage(facts, "asked-facts")
        current = _with_symbol(self.nodes)
        symbol = (F.col("b_kind") == F.col("kind")) & (F.col("b_symbol") == F.col("symbol")) & (
            F.col("b_lang") == F.col("lang"))
        moved = facts.filter(F.col("moved_to").isNotNull() & F.col("b_kind").isNotNull())
        places = Asked(moved.select("b_symbol", "moved_to")).among(current, "symbol", "file_path")
        moved = moved.join(
            _candidates(places, "kind", "symbol", "lang", "file_path"),
            symbol & (F.col("moved_to") == F.col("file_path")), "left",
        ).select(*keys, F.col("moved_to").alias("path"), F.coalesce("n", F.lit(0)).alias("n"),
                 "found_id", F.lit(False).alias("search_all"), F.lit(True).alias("known"))
        still = facts.filter(F.col("moved_to").isNull() & F.col("b_kind").isNotNull())
        here = _described(Asked(still.select("id")).among(current, "id"))
        still = stage(still.join(here.select("id", "n_id"), "id", "left"), "asked-here")
        # Symbols are searched for where the id is gone.
        absent = still.filter(F.col("n_id").isNull())
        by_symbol = _candidates(
            Asked(absent.select("b_symbol")).among(current, "symbol"), "kind", "symbol", "lang")
        stayed = still.filter(F.col("n_id").isNotNull()).withColumns(
            {"n": F.lit(None).cast("bigint"), "found_id": F.lit(None).cast("string")}
        ).unionByName(absent.join(by_symbol, symbol, "left").drop("kind", "symbol", "lang")).select(
            *keys, F.col("b_path").alias("path"), F.coalesce("n_id", "n", F.lit(0)).alias("n"),
            F.when(F.col("n_id").isNotNull(), F.col("id")).otherwise(F.col("found_id"))
            .alias("found_id"),
            F.col("n_id").isNull().alias("search_all"), F.lit(True).alias("known"),
        )
        lost = facts.filter(F.col("b_kind").isNull()).select(
            *keys, F.lit(None).cast("string").alias("path"), F.lit(0).cast("bigint").alias("n"),
            F.lit(None).cast("string").alias("found_id"), F.lit(False).alias("search_all"),
            F.lit(False).alias("known"),
        )
        bound = hits_added.select(*moved.columns).unionByName(moved).unionByName(
            stayed).unionByName(lost)
        # Pathless nodes (externals) are asked under the empty path, which no gap touches.
        bound = stage(bound.withColumn("path", F.coalesce("path", F.lit(""))), "bindings")
        gaps = self.incomplete(bound)
        uncertain = (
            ~F.col("known") | (F.col("n") > 1)
            | (F.col("search_all") & (F.col("n") > 0) & ~F.col("removing"))
            | F.coalesce("incomplete", F.lit(False))
        )
        # Kind and place of a node are read by its id once it is found, not moved with each candidate.
        found = bound.filter(F.col("found_id").isNotNull()).select("found_id")
        hits = _described(Asked(found).among(current, "id")).select(
            F.col("id").alias("found_id"), "hit")
        return bound.join(gaps, ["path", "search_all"], "left").join(
            hits, "found_id", "left").select(
            *keys, "path", "n", "found_id", "hit.found_kind", "hit.found_at",
            uncertain.alias("uncertain"),
        )

    def incomplete(self, paths: DataFrame) -> DataFrame:
        """Capture verdicts for the (path, search_all) pairs in use, in the current snapshot."""
        pairs = paths.filter(F.col("path").isNotNull()).select("path", "search_all").distinct()
        tagged = pairs.select(
            *[F.lit(v).alias(c) for c, v in zip(SCOPE, self.scope)], "path", "search_all"
        )
        return capture_incomplete(
            tagged, self.coverage, self.diagnostics, self.snapshots
        ).drop(*SCOPE)

    @cached_property
    def removed_relations(self) -> DataFrame:
        """Baseline relations that removals name."""
        names = of_kind(self.ops, "remove_relation").select("relation_id")
        return stage(Asked(names).among(self.baseline_relations, "id"), "removed-relations")

    @cached_property
    def bindings(self) -> DataFrame:
        """Every binding the verdicts need, computed in one pass."""
        op = self.ops
        flags = lambda e, r: [F.lit(e).alias("enforce"), F.lit(r).alias("removing")]
        base = self.removed_relations.select(
            F.col("id").alias("relation_id"), F.col("source_id").alias("b_source"),
            F.col("target_id").alias("b_target"),
        )
        dropped = of_kind(op, "remove_relation").join(base, "relation_id")
        parts = [
            of_kind(op, "add_function").select("plan_id", F.col("temp_id").alias("id"),
                                               *flags(True, False)),
            of_kind(op, "move_function").select("plan_id", F.col("node_id").alias("id"),
                                                *flags(True, False)),
            of_kind(op, "move_function").select("plan_id", F.col("node_id").alias("id"),
                                                *flags(False, False)),
            of_kind(op, "remove_function").select("plan_id", F.col("node_id").alias("id"),
                                                  *flags(False, True)),
            of_kind(op, "add_relation").select(
                "plan_id", F.explode(F.array("source_id", "target_id")).alias("id"),
                *flags(True, False)),
            dropped.select(
                "plan_id",
                F.explode(F.array_compact(F.array("b_source", "b_target"))).alias("id"),
                *flags(False, False)),
        ]
        return stage(self.bind(reduce(DataFrame.unionByName, parts)), "bound")

    def _bound(self, prefix: str, key: str, enforce: bool, removing: bool) -> DataFrame:
        rows = self.bindings.filter(
            (F.col("enforce") == enforce) & (F.col("removing") == removing)
        )
        return rows.select(
            "plan_id", F.col("id").alias(key),
            *[F.col(c).alias(f"{prefix}_{c}")
              for c in ("n", "found_id", "found_kind", "found_at", "uncertain")],
        )

    def verify_add(self) -> DataFrame:
        rows = of_kind(self.ops, "add_function").join(
            self._bound("t", "temp_id", True, False), ["plan_id", "temp_id"])
        return _verdict(rows, [
            (F.col("t_uncertain"), "unknown", "function not bound for certain", None),
            (F.col("t_n") > 0, "satisfied", "found at the planned path",
             F.col("t_found_at")),
            (F.lit(True), "unmet", "not at the planned path", None),
        ])

    def verify_move(self) -> DataFrame:
        asked = Asked(of_kind(self.ops, "move_function").select("node_id"))
        base = asked.among(self.baseline_nodes, "id").select(
            F.col("id").alias("node_id"), F.col("file_path").alias("b_path"))
        now = asked.among(self.nodes, "id").select(
            F.col("id").alias("node_id"), F.lit(True).alias("still_there"))
        added = self.additions.select("plan_id", F.col("id").alias("node_id"), "add_path")
        rows = (
            of_kind(self.ops, "move_function")
            .join(self._bound("t", "node_id", True, False), ["plan_id", "node_id"])
            .join(self._bound("o", "node_id", False, False), ["plan_id", "node_id"])
            .join(base, "node_id", "left").join(now, "node_id", "left")
            .join(added, ["plan_id", "node_id"], "left")
            .withColumn("path", F.coalesce("add_path", "b_path"))
            .withColumn("search_all", F.lit(False))
        )
        changed = ~F.col("path").eqNullSafe(normalize_repo_path("file_path"))
        rows = rows.withColumn("changed", changed)
        rows = rows.join(self.incomplete(rows), ["path", "search_all"], "left")
        old = F.col("changed") & F.when(F.col("add_path").isNotNull(), F.col("o_n") > 0).otherwise(
            F.coalesce("still_there", F.lit(False)) & F.col("b_path").isNotNull()
        )
        hidden = F.col("changed") & F.coalesce("incomplete", F.lit(False))
        return _verdict(rows, [
            (F.col("t_uncertain") | hidden, "unknown",
             "moved function not bound for certain", None),
            ((F.col("t_n") > 0) & ~old, "satisfied",
             "moved as planned", F.col("t_found_at")),
            (F.lit(True), "unmet", "move not seen",
             F.col("t_found_at")),
        ])

    def verify_remove(self) -> DataFrame:
        rows = of_kind(self.ops, "remove_function").join(
            self._bound("t", "node_id", False, True), ["plan_id", "node_id"])
        return _verdict(rows, [
            (F.col("t_uncertain"), "unknown",
             "removal cannot be told", None),
            (F.col("t_n") > 0, "unmet", "function still there", F.col("t_found_at")),
            (F.lit(True), "satisfied", "function gone", None),
        ])

    def relation_check(self) -> DataFrame:
        """Planned and removed relations with both ends bound and matching evidence counted."""
        base = self.removed_relations.select(
            F.col("id").alias("relation_id"), F.col("source_id").alias("from_id"),
            F.col("target_id").alias("to_id"), F.col("type").alias("rel_type"),
            F.col("resolution").alias("b_resolution"),
        )
        planned = of_kind(self.ops, "add_relation").select(
            "plan_id", "op_index", F.col("source_id").alias("from_id"),
            F.col("target_id").alias("to_id"), F.lit("calls").alias("rel_type"),
            F.lit("resolved").alias("b_resolution"), F.lit(False).alias("removing_rel"),
        )
        dropped = of_kind(self.ops, "remove_relation").select(
            "plan_id", "op_index", "relation_id"
        ).join(base, "relation_id", "left").select(
            "plan_id", "op_index", "from_id", "to_id", "rel_type", "b_resolution",
            F.lit(True).alias("removing_rel"),
        )
        parts = []
        for rows, enforce in ((planned, True), (dropped, False)):
            parts.append(
                rows.join(self._bound("s", "from_id", enforce, False), ["plan_id", "from_id"],
                          "left")
                .join(self._bound("t", "to_id", enforce, False), ["plan_id", "to_id"], "left")
            )
        checked = stage(parts[0].unionByName(parts[1]), "relation-ends")
        sources = checked.filter(F.col("s_found_id").isNotNull()).select("s_found_id")
        relations = Asked(sources).among(self.relations, "source_id")
        found = relations.filter(F.col("target_id").isNotNull()).groupBy(
            F.col("source_id").alias("s_found_id"), F.col("target_id").alias("t_found_id"),
            F.col("type").alias("rel_type"),
        ).agg(
            F.count_if(F.col("resolution") == "resolved").alias("resolved_n"),
            F.count_if(F.col("resolution") == "external").alias("external_n"),
            F.min(F.when(F.col("resolution") != "unresolved", evidence_text(
                "evidence_path", "evidence_line", "evidence_text"))).alias("found_text"),
        )
        open_ends = relations.filter(F.col("resolution") == "unresolved").groupBy(
            F.col("source_id").alias("s_found_id"), F.col("type").alias("rel_type")
        ).agg(F.count(F.lit(1)).alias("open_n"), F.min(evidence_text(
            "evidence_path", "evidence_line", "evidence_text")).alias("open_text"))
        return (
            checked.join(found, ["s_found_id", "t_found_id", "rel_type"], "left")
            .join(open_ends, ["s_found_id", "rel_type"], "left")
            .withColumn("found_n", F.coalesce("resolved_n", F.lit(0)) + F.when(
                F.col("t_found_kind") == "external", F.coalesce("external_n", F.lit(0))
            ).otherwise(0))
        )

    def relation_steps(self) -> DataFrame:
        """Relation checks with the step that decides them: no baseline, uncertain ends, an end gone,
        found, hidden by open calls, or absent."""
        rows = self.relation_check()
        gone = F.col("removing_rel")
        no_base = gone & (F.col("to_id").isNull() | (F.col("b_resolution") == "unresolved"))
        return rows.withColumn("step", (
            F.when(F.coalesce(no_base, F.lit(True)), "no baseline")
            .when(F.col("s_uncertain") | F.col("t_uncertain"), "uncertain")
            .when((F.col("s_n") == 0) | (F.col("t_n") == 0), "end gone")
            .when(F.col("found_n") > 0, "found")
            .when(F.coalesce("open_n", F.lit(0)) > 0, "open").otherwise("absent")))

    def verify_relation(self) -> DataFrame:
        at = lambda step: F.col("step") == step
        flip = lambda yes, no: F.when(F.col("removing_rel"), yes).otherwise(no)
        return _verdict(self.relation_steps(), [
            (at("no baseline"), "unknown", "baseline relation without known ends", None),
            (at("uncertain"), "unknown", "an end is not bound for certain", None),
            (at("end gone"), flip("satisfied", "unmet"), "an end is gone", None),
            (at("found"), flip("unmet", "satisfied"),
             flip("relation still there", "relation found"), F.col("found_text")),
            (at("open"), "unknown", "open calls may hide the relation", F.col("open_text")),
            (F.lit(True), flip("satisfied", "unmet"), flip("relation gone", "no such call"),
             F.col("s_found_at")),
        ])

    def relation_evidence(self) -> DataFrame:
        """Every place that decides a relation check, one row each: the relations found, or the open
        calls of the source that may hide one."""
        rows = self.relation_steps().select(
            "plan_id", "op_index", "step", F.col("s_found_id").alias("source_id"),
            F.col("t_found_id").alias("target_id"), "t_found_kind", F.col("rel_type").alias("type"))
        facts = self.relations.select(
            "source_id", "target_id", "type", "resolution",
            evidence_text("evidence_path", "evidence_line", "evidence_text").alias("evidence"))
        counts = (F.col("resolution") == "resolved") | (
            (F.col("resolution") == "external") & (F.col("t_found_kind") == "external"))
        found = rows.filter(F.col("step") == "found").join(
            facts, ["source_id", "target_id", "type"]).filter(counts)
        hidden = rows.filter(F.col("step") == "open").drop("target_id").join(
            facts.filter(F.col("resolution") == "unresolved"), ["source_id", "type"])
        out = ["plan_id", "op_index", "step", "evidence"]
        return found.select(*out).unionByName(hidden.select(*out))

    def verify_annotate(self) -> DataFrame:
        return _verdict(of_kind(self.ops, "annotate"), [
            (F.lit(True), "unknown", "for a reader to judge", None),
        ])

    def report(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            self.verify_add(), self.verify_move(), self.verify_remove(), self.verify_relation(),
            self.verify_annotate(),
        ])


def _verdict(rows: DataFrame, ladder) -> DataFrame:
    """First matching step of (condition, status, message, first evidence)."""
    def lit(value):
        return value if isinstance(value, Column) else F.lit(value)

    status = message = evidence = None
    for condition, s, m, e in ladder:
        s, m, e = lit(s), lit(m), lit(e)
        status = F.when(condition, s) if status is None else status.when(condition, s)
        message = F.when(condition, m) if message is None else message.when(condition, m)
        evidence = F.when(condition, e) if evidence is None else evidence.when(condition, e)
    return rows.select("plan_id", "op_index", status.alias("status"), message.alias("message"),
                       evidence.cast("string").alias("evidence"))


def verification_rollup(report: DataFrame) -> DataFrame:
    return report.groupBy("plan_id", "status").agg(F.count(F.lit(1)).alias("items"))
