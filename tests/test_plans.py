import pytest
from pyspark.sql import functions as F

from helpers import (P, S, collect, coverage, diagnostics, node, nodes, ops, rel, relations,
                     snapshots)
from weftgraph.plans import overlay as O
from weftgraph.plans import rules as R
from weftgraph.plans import state as St
from weftgraph.plans import status as U
from weftgraph.plans.verify import Verification


@pytest.fixture(scope="module")
def base(spark):
    n = nodes(spark, [
        node("a", path="src/a.ts"), node("b", path="lib/b.ts"), node("c", path="src/c.ts"),
        node("fa", "file", path="src/a.ts"), node("x", "external", "lib/pkg")])
    return n, relations(spark, [rel("ab", "a", "b"), rel("bc", "b", "c")])


def _plan(spark, project=P, content="hash1"):
    return spark.createDataFrame(
        [("plan1", project, S, S, content)],
        "plan_id string, project_id string, snapshot_id string, baseline_snapshot_id string, "
        "baseline_content_hash string")


def _policies(spark, prefix="src", forbidden=("lib",)):
    return spark.createDataFrame([(P, "pol", prefix, "why", list(forbidden))],
                                 "project_id string, id string, path_prefix string, "
                                 "purpose string, forbidden array<string>")


def _codes(spark, base, rows, policies=None, plan=None):
    n, r = base
    state = St.plan_state(ops(spark, rows), n)
    issues = R.validate_plan(plan or _plan(spark), state, r, snapshots(spark),
                             policies or _policies(spark, "nowhere"))
    return sorted((i.op_index, i.code) if i.op_index is not None else (-1, i.code)
                  for i in issues.collect())


def test_clean_and_stale_plans(spark, base):
    assert _codes(spark, base, [dict(kind="annotate", target_id="a", text="t")]) == []
    other = _codes(spark, base, [], plan=_plan(spark, "p2", "old"))
    assert other == [(-1, "BASELINE_MISMATCH"), (-1, "PROJECT_MISMATCH")]


def test_additions_are_seen_by_every_operation(spark, base):
    rows = [
        dict(kind="add_relation", relation_id="n1", source_id="t1", target_id="b"),
        dict(kind="add_function", temp_id="t1", name="new", file_path="src/./n.ts"),
        dict(kind="add_function", temp_id="t1", name="again", file_path="src/n.ts"),
        dict(kind="add_function", temp_id="a", name="taken", file_path="src/n.ts")]
    assert _codes(spark, base, rows) == [
        (0, "COMPATIBILITY_UNKNOWN"), (2, "DUPLICATE_NODE"), (3, "DUPLICATE_NODE")]


def test_removals_moves_and_late_targets(spark, base):
    rows = [
        dict(kind="remove_function", node_id="a"), dict(kind="remove_function", node_id="a"),
        dict(kind="move_function", node_id="a", file_path="src/z.ts"),
        dict(kind="move_function", node_id="fa", file_path="src/z.ts"),
        dict(kind="remove_relation", relation_id="ab"), dict(kind="remove_relation", relation_id="ab"),
        dict(kind="remove_relation", relation_id="none"),
        dict(kind="annotate", target_id="n1", text="early"),
        dict(kind="add_relation", relation_id="n1", source_id="b", target_id="x"),
        dict(kind="annotate", target_id="n1", text="late"),
        dict(kind="annotate", target_id="ab", text="removed"),
        dict(kind="annotate", target_id="a", text="removed"),
        dict(kind="add_relation", relation_id="n1", source_id="b", target_id="fa")]
    assert _codes(spark, base, rows) == [
        (1, "DUPLICATE_REMOVAL"), (2, "REMOVED_FUNCTION"), (3, "INVALID_FUNCTION"),
        (5, "DUPLICATE_REMOVAL"), (6, "INVALID_RELATION"), (7, "INVALID_TARGET"),
        (8, "COMPATIBILITY_UNKNOWN"), (10, "INVALID_TARGET"), (11, "INVALID_TARGET"),
        (12, "DUPLICATE_RELATION"), (12, "INVALID_ENDPOINT")]


def test_policies_after_moves(spark, base):
    n, r = base

    def changes(rows, policies):
        state = St.plan_state(ops(spark, rows), n)
        got = R.rule_forbidden_existing(_plan(spark), state, r, policies)
        return collect(got, "change", "relation_id")

    moved = [dict(kind="move_function", node_id="b", file_path="src/b.ts")]
    assert changes(moved, _policies(spark)) == [("baseline", "ab"), ("cleared", "ab")]
    assert changes(moved, _policies(spark, "src", ("src",))) == [
        ("introduced", "ab"), ("introduced", "bc")]
    both = moved + [dict(kind="remove_relation", relation_id=x) for x in ("ab", "bc")]
    assert changes(both, _policies(spark, "src", ("src",))) == []
    assert changes([], _policies(spark, "sr")) == []


def test_planned_relations_against_policies(spark, base):
    rows = [dict(kind="add_relation", relation_id="n1", source_id="a", target_id="x"),
            dict(kind="add_relation", relation_id="n2", source_id="b", target_id="x")]
    got = _codes(spark, base, rows, _policies(spark, "src\\", ("lib/",)))
    assert (0, "FORBIDDEN_DEPENDENCY") in got and (1, "FORBIDDEN_DEPENDENCY") not in got
    assert _codes(spark, base, [], _policies(spark, "../x")) == [(-1, "INVALID_POLICY_PATH")]


def _verify(spark, rows, now_nodes, now_rel=(), cover=None, broken=(), complete=True,
            recorded=True, base_nodes=None, base_rel=()):
    none = [rel("zz", "q", "q")]
    v = Verification(
        scope=(P, S), ops=ops(spark, rows),
        baseline_nodes=nodes(spark, base_nodes or [node("a", path="src/a.ts", lang="ts", q="A")]),
        baseline_relations=relations(spark, list(base_rel) or none), nodes=nodes(spark, now_nodes),
        relations=relations(spark, list(now_rel) or none),
        coverage=coverage(spark, cover or [("file", "src/a.ts")]),
        diagnostics=diagnostics(spark, broken or ["zz/none.txt"]),
        snapshots=snapshots(spark, complete, recorded))
    return [s for _, s in collect(v.report(), "op_index", "status")]


def test_removal_verdicts(spark):
    gone = [dict(kind="remove_function", node_id="a")]
    keep, away = [node("a", path="src/a.ts", lang="ts", q="A")], [node("z", path="src/z.ts")]
    assert _verify(spark, gone, keep) == ["unmet"]
    assert _verify(spark, gone, away, broken=["docs/n.py"]) == ["satisfied"]
    # A namesake elsewhere blocks removal but proves nothing else.
    assert _verify(spark, gone, [node("m", path="src/m.ts", lang="ts", q="A")],
                   broken=["docs/n.py"]) == ["unmet"]


def test_missing_capture_never_means_absent(spark):
    gone = [dict(kind="remove_function", node_id="a")]
    away = [node("z", path="src/z.ts")]
    assert _verify(spark, gone, away, cover=[("unavailable", "src")]) == ["unknown"]
    assert _verify(spark, gone, away, cover=[("unavailable", "other/x.js")]) == ["unknown"]
    assert _verify(spark, gone, away, cover=[("unavailable", "other/x.py")],
                   broken=["d/n.py"]) == ["satisfied"]
    assert _verify(spark, gone, away, broken=["src/q.ts"]) == ["unknown"]
    assert _verify(spark, gone, away, complete=False, broken=["d/n.py"]) == ["unknown"]
    assert _verify(spark, gone, away, cover=[("file", "x.ts")], recorded=False,
                   broken=["d/n.py"]) == ["unknown"]


def test_move_and_relation_verdicts(spark):
    move = [dict(kind="move_function", node_id="a", file_path="src/n.ts")]
    new = node("a2", path="src/n.ts", lang="ts", q="A")
    old = node("a", path="src/a.ts", lang="ts", q="A")
    assert _verify(spark, move, [new]) == ["satisfied"]
    assert _verify(spark, move, [new, old]) == ["unmet"]
    assert _verify(spark, move, [new, node("a3", path="src/n.ts", lang="ts", q="A")]) == ["unknown"]
    both = [node("a", path="src/a.ts"), node("b", path="src/b.ts")]
    call = [dict(kind="add_relation", relation_id="n", source_id="a", target_id="b")]
    assert _verify(spark, call, both, [rel("r", "a", "b")], base_nodes=both) == ["satisfied"]
    assert _verify(spark, call, both, [rel("r", "b", "a")], base_nodes=both) == ["unmet"]
    assert _verify(spark, call, both, [rel("r", "a", None)], base_nodes=both) == ["unknown"]
    drop = [dict(kind="remove_relation", relation_id="ab")]
    ab = [rel("ab", "a", "b")]
    assert _verify(spark, drop, both, ab, base_nodes=both, base_rel=ab) == ["unmet"]
    assert _verify(spark, drop, both, base_nodes=both, base_rel=ab) == ["satisfied"]


def test_added_functions_match_name_language_and_signature(spark):
    add = [dict(kind="add_function", temp_id="t", name="m", file_path="src/./a.ts", language="ts",
                signature="(x)")]
    hit = node("h", name="z", q="m", path="src/a.ts", lang="ts", sig="(x)")
    assert _verify(spark, add, [hit]) == ["satisfied"]
    assert _verify(spark, add, [node("h", name="m", path="src/a.ts", lang="py", sig="(x)")]) == [
        "unmet"]


def test_newest_approval_is_authoritative_even_if_corrupt(spark):
    cols = ("id string, plan_id string, project_id string, revision bigint, approved_at string, "
            "insertion bigint, semantic_hash string, has_context boolean, knowledge_hash string, "
            "frozen_revision bigint, frozen_hash string, context_hash string, in_registry boolean")
    rows = [("old", "plan1", P, 1, "t1", 1, "h", True, "k", 1, "h", "k", False),
            ("new", "plan1", P, 2, "t0", 2, "h", True, "k", 2, "h", "changed", False)]
    latest = U.latest_approval(spark.createDataFrame(rows, cols))
    assert collect(U.approval_guard(latest), "id", "context_status") == [("new", "invalid")]


def test_semantic_hash_ignores_revision_but_not_order(spark):
    plan = spark.createDataFrame(
        [("plan1", P, "t", "d", S, "h", 1)], "plan_id string, project_id string, title string, "
        "description string, baseline_snapshot_id string, baseline_content_hash string, "
        "revision bigint")
    rows = [dict(kind="remove_function", node_id="a"), dict(kind="remove_function", node_id="b")]
    one = U.semantic_hash(plan, ops(spark, rows)).first().semantic_hash
    again = U.semantic_hash(plan.withColumn("revision", F.lit(9)),
                            ops(spark, rows).orderBy(F.rand(3))).first().semantic_hash
    turned = U.semantic_hash(plan, ops(spark, rows[::-1])).first().semantic_hash
    assert one == again != turned


def test_edits(spark, base):
    n, _ = base
    rows = [
        dict(kind="add_function", temp_id="t", name="n", file_path="src/n.ts"),
        dict(kind="move_function", node_id="a", file_path="one.ts"),
        dict(kind="annotate", target_id="t", text="kept"),
        dict(kind="add_relation", relation_id="r", source_id="t", target_id="b"),
        dict(kind="move_function", node_id="a", file_path="two.ts"),
        dict(kind="move_function", node_id="t", file_path="src/m.ts"),
        dict(kind="remove_relation", relation_id="r")]
    o = ops(spark, rows)
    doomed = spark.createDataFrame([("plan1", "t")], "plan_id string, temp_id string")
    assert [k for _, k in collect(O.delete_temporary(o, doomed), "op_index", "kind")] == [
        "move_function", "annotate", "move_function"]

    def retarget(node_id, target):
        ask = spark.createDataFrame([("plan1", node_id, target)],
                                    "plan_id string, node_id string, target string")
        return collect(O.retarget_coalesce(o, ask, n).filter("file_path is not null"),
                       "op_index", "file_path")

    assert retarget("a", "new.ts") == [(0, "src/n.ts"), (1, "new.ts"), (5, "src/m.ts")]
    assert retarget("a", "src/a.ts") == [(0, "src/n.ts"), (5, "src/m.ts")]
    assert retarget("t", "src/q.ts") == [(0, "src/q.ts"), (1, "one.ts"), (4, "two.ts")]
    assert retarget("c", "d/c.ts")[-1] == (7, "d/c.ts")


def test_routes(spark, base):
    n, r = base
    routes = spark.createDataFrame([("r1", P, S, "call_chain"), ("r2", "p2", "s0", "tour")],
                                   "route_id string, project_id string, snapshot_id string, "
                                   "kind string")
    steps = spark.createDataFrame(
        [("r1", 0, "a", None), ("r1", 1, "b", "ab"), ("r1", 2, "a", "bc"), ("r2", 0, "gone", None)],
        "route_id string, step bigint, node_id string, relation_id string")
    got = O.validate_route(routes, steps, (P, S), n, r)
    assert collect(got.fillna(-1, ["step"]), "route_id", "step", "code") == [
        ("r1", 2, "INVALID_CALL_CHAIN"), ("r1", 2, "INVALID_RELATION"),
        ("r2", -1, "PROJECT_MISMATCH"), ("r2", -1, "SNAPSHOT_MISMATCH"),
        ("r2", 0, "INVALID_ENDPOINT")]


def test_every_operation_field_changes_the_plan_hash(spark):
    from weftgraph.plans.status import OPERATION_FIELDS, semantic_hash

    base = dict.fromkeys(OPERATION_FIELDS, "x")
    plans = [("0", "p", "t", "d", "s", "h")]
    rows = [{**base, "plan_id": "0", "op_index": 0}]
    for n, field in enumerate(OPERATION_FIELDS):
        for value in ("y", "", None):
            key = f"{n}-{value}"
            plans.append((key, "p", "t", "d", "s", "h"))
            rows.append({**base, "plan_id": key, "op_index": 0, field: value})
    kinds = ", ".join(f"{c} string" for c in OPERATION_FIELDS) + ", plan_id string, op_index long"
    names = [c.split()[0] for c in kinds.split(", ")]
    ops = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kinds)
    head = spark.createDataFrame(plans, "plan_id string, project_id string, title string, "
                                 "description string, baseline_snapshot_id string, "
                                 "baseline_content_hash string")
    # One plan id for all, so that only the operation differs.
    got = semantic_hash(head, ops).select("plan_id", "semantic_hash").collect()
    assert len({r["semantic_hash"] for r in got}) == len(rows)
    one = ops.withColumn("plan_id", F.lit("0"))
    digests = {semantic_hash(head.where("plan_id = '0'"), one.where(F.to_json(F.array(
        *OPERATION_FIELDS)) == F.lit(j))).first()["semantic_hash"]
        for j in [r["j"] for r in ops.select(F.to_json(F.array(*OPERATION_FIELDS)).alias("j"))
                  .limit(7).collect()]}
    assert len(digests) == 7


def test_symbol_candidates_move_as_ids(spark):
    """Kind and place of a node are read by its id once it is bound; candidates carry the id alone."""
    from weftgraph.plans import verify as V

    nodes = spark.createDataFrame(
        [("b", "function", "f", "x.py", 1), ("a", "function", "f", "x.py", 2), (None, "file", "f", "y.py", 3)],
        "id string, kind string, name string, file_path string, start_line long")
    found = V._candidates(nodes, "kind", "name")
    assert found.columns == ["kind", "name", "n", "found_id"]
    assert sorted(tuple(r) for r in found.collect() if r["found_id"]) == [("function", "f", 2, "a")]
    known = {r["id"]: (r["n_id"], r["hit"]["found_kind"], r["hit"]["found_at"])
             for r in V._described(nodes).collect()}
    assert known.keys() == {"a", "b"} and known["a"][:2] == (1, "function") and "x.py" in known["a"][2]
