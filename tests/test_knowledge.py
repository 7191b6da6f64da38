import pytest
from pyspark.sql import functions as F

from helpers import P, S, collect, coverage, diagnostics, node, nodes, rel, relations, snapshots
from weftgraph.knowledge import annotations as A
from weftgraph.knowledge import structure as X
from weftgraph.sources import records as D

NOTE = ("project_id string, id string, revision bigint, text string, author string, "
        "source string, is_constraint boolean, binding_state string, target_kind string, "
        "target_id string, selected_snapshot_id string, last_label string, last_path string, "
        "last_node_kind string, orphaned_at string, created_at string, deleted_at string")


def _note(id, state="bound", target="a", path="src/a.ts", kind="node", **more):
    row = dict(project_id=P, id=id, revision=1, text="t", author="é", source="user",
               is_constraint=True, binding_state=state, target_kind=kind if state else None,
               target_id=target if state else None, selected_snapshot_id="s0", last_label="a",
               last_path=path if state else None, last_node_kind=None, orphaned_at=None,
               created_at="1", deleted_at=None)
    return tuple({**row, **more}[f.split()[0]] for f in NOTE.split(", "))


def _resolve(spark, notes, cover=(("file", "x"),), broken=("zz/q",), complete=True, recorded=True):
    n = nodes(spark, [node("a", path="src/a.ts"), node("ext", "external")])
    r = relations(spark, [rel("r", "a", "a")])
    got = A.resolve_annotations(
        spark.createDataFrame(notes, NOTE), S, n, r, coverage(spark, cover),
        diagnostics(spark, broken), snapshots(spark, complete, recorded))
    return got


def test_statuses(spark):
    got = _resolve(spark, [
        _note("bound"), _note("sticky", "orphan"), _note("free", None),
        _note("lost", target="gone"), _note("ext", target="ext"),
        _note("edge", target="r", kind="relation"), _note("other", project_id="p9")])
    assert dict(collect(got, "id", "status")) == {
        "bound": "bound", "sticky": "orphan", "free": "unbound", "lost": "orphan",
        "ext": "orphan", "edge": "bound", "other": "unknown"}
    assert collect(A.reconcile_annotations(got), "id", "revision", "orphaned_at") == [
        ("ext", 2, S), ("lost", 2, S)]


@pytest.mark.parametrize("how", [
    dict(cover=[("unavailable", "src")]), dict(cover=[("excluded", "src/a.ts/deep")]),
    dict(cover=[("unavailable", ".")]), dict(broken=["src\\a.ts"]), dict(complete=False),
    dict(recorded=False)])
def test_missing_capture_never_makes_an_orphan(spark, how):
    got = _resolve(spark, [_note("lost", target="gone")], **how)
    assert collect(got, "status") == [("unknown",)]
    assert A.reconcile_annotations(got).count() == 0


def test_knowledge_hash_is_free_of_order_and_times(spark):
    rows = [_note("a"), _note("b", text="u")]
    first = A.knowledge_hash(spark.createDataFrame(rows, NOTE), S).first().knowledge_hash
    later = [_note("b", text="u", created_at="9", revision=4), _note("a")]
    assert A.knowledge_hash(spark.createDataFrame(later, NOTE), S).first().knowledge_hash == first
    other = [_note("a"), _note("b", text="v")]
    assert A.knowledge_hash(spark.createDataFrame(other, NOTE), S).first().knowledge_hash != first


CHANGE = "id string, seq bigint, action string, expected bigint, text string, target_id string"


def test_revision_checked_changes(spark):
    notes = spark.createDataFrame([_note("n", None)], NOTE)
    changes = spark.createDataFrame([
        ("n", 1, "edit", 1, "t", None),      # no effect: no revision
        ("n", 2, "edit", 1, "u", None), ("n", 3, "edit", 1, "v", None),
        ("n", 4, "bind", 2, None, "a"), ("n", 5, "detach", 3, None, None),
        ("n", 6, "delete", 4, None, None), ("n", 7, "edit", 5, "w", None)], CHANGE)
    state, history, conflicts = A.apply_changes(notes, changes)
    assert collect(history, "seq", "revision") == [(2, 2), (4, 3), (5, 4), (6, 5)]
    assert collect(conflicts, "seq") == [(3,), (7,)]
    assert collect(state, "revision", "deleted", "text") == [(5, True, "u")]


def _files(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)],
                                 "project_id string, text string")


GOOD = '{"schemaVersion":1,"folders":[],"dependencyRules":[],"own":{"k":1}}'


@pytest.mark.parametrize("text,pointer,kind", [
    ("{", "", "json"),
    (GOOD.replace('"k":1', '"k":1,"k":2'), "", "duplicate_key"),
    (GOOD.replace(":1,", ":2,", 1), "/schemaVersion", "version"),
    (GOOD.replace('"folders":[]', '"folders":{}'), "/folders", "type"),
    (GOOD.replace('"folders":[]', '"folders":[{"path":"a/../b","purpose":"p"}]'),
     "/folders/0/path", "path"),
    (GOOD.replace('"folders":[]',
                  '"folders":[{"path":"a/","purpose":"p"},{"path":"./a","purpose":"q"}]'),
     "/folders/1/path", "duplicate_path"),
    (GOOD.replace('"dependencyRules":[]',
                  '"dependencyRules":[{"from":"s","mustNotImport":[" "],"reason":"r"}]'),
     "/dependencyRules/0/mustNotImport", "type"),
])
def test_structure_problems(spark, text, pointer, kind):
    got = X.structure_validate(_files(spark, GOOD, text))
    assert collect(got, "project_id", "pointer", "kind") == [("1", pointer, kind)]


def test_canonical_structure_ignores_order_and_spelling(spark):
    def doc(*folders):
        return GOOD.replace('"folders":[]', '"folders":[' + ",".join(folders) + "]")

    one = doc('{"path":"a/","purpose":"p","allowed":["y","x","y"]}', '{"path":"b","purpose":"q"}')
    two = doc('{"purpose":"q","path":"./b"}', '{"allowed":["x","y"],"path":"a","purpose":"p"}')
    rows = collect(X.structure_canonical(_files(spark, one, two, GOOD)), "semantic_digest")
    assert len(rows) == 3 and len(set(rows)) == 2


def test_idempotent_mutations(spark):
    asked = spark.createDataFrame(
        [(P, m, h, s) for m, h, s in [("m1", "h", 1), ("m1", "h", 2), ("m1", "g", 3),
                                      ("m2", "h", 4), ("m3", "x", 5), ("m4", "h", 6)]],
        "project_id string, mutation_id string, request_hash string, seq bigint")
    receipts = spark.createDataFrame(
        [(P, "m2", "h", "no_op"), (P, "m3", "h", "committed"), (P, "m4", "h", "conflicted")],
        "project_id string, mutation_id string, request_hash string, outcome string")
    assert [o for _, o in collect(X.idempotent_mutations(asked, receipts), "seq", "outcome")] == [
        "new", "done", "conflict", "done", "conflict", "ended"]


def test_records_keep_their_place(spark):
    log = spark.createDataFrame(
        [("k", i, s, a, v) for i, s, a, v in [
            ("x", 1, "put", "1"), ("y", 2, "put", "2"), ("x", 3, "put", "3"),
            ("y", 4, "delete", None), ("y", 5, "put", "5"), ("z", 6, "delete", None)]],
        "kind string, id string, seq bigint, action string, value string")
    assert collect(D.records_current(log), "id", "position", "value") == [
        ("x", 1, "3"), ("y", 5, "5")]


def test_publish_collisions(spark):
    cols = "project_id string, snapshot_id string, content_hash string"
    known = spark.createDataFrame([(P, "s1", "h")], cols)
    new = spark.createDataFrame(
        [(P, "s1", "h", 1), (P, "s1", "g", 2), (P, "s2", "h", 3), (P, "s2", "g", 4)],
        cols + ", seq bigint")
    assert [o for _, o in collect(D.publish_snapshot(known, new), "seq", "outcome")] == [
        "unchanged", "collision", "inserted", "collision"]


def test_capture_touches_both_ways(spark):
    paths = spark.createDataFrame([(P, S, p) for p in ("a", "a/b", "ab", "c")],
                                  "project_id string, snapshot_id string, path string")
    got = A.capture_unavailable(paths, coverage(spark, [("unavailable", "a/b")]),
                                diagnostics(spark, ["zz"]), snapshots(spark))
    assert collect(got.filter(F.col("unavailable")), "path") == [("a",), ("a/b",)]


@pytest.mark.parametrize("old,new", [
    ('"own":{"k":1}', '"own":{"k":2}'),
    ('"own":{"k":1}', '"x-graph":{"legacyPathPolicies":[{"id":"p","forbiddenDependencies":["a"]}]}'),
    ('"folders":[]', '"folders":[{"path":"a","purpose":"p","extra":1}]'),
])
def test_canonical_structure_takes_the_whole_document(spark, old, new):
    changed = GOOD.replace(old, new)
    again = changed.replace('"schemaVersion":1,', "", 1).replace("}", ',"schemaVersion":1}') \
        if new.startswith('"x') else changed
    rows = dict(collect(X.structure_canonical(_files(spark, GOOD, changed, again)), "project_id",
                        "semantic_digest"))
    assert len({rows["0"], rows["1"]}) == 2


def test_edits_of_invalid_documents_are_refused(spark):
    current = spark.createDataFrame([("a", "src", "{}")], "project_id string, path string, body string")
    ops = spark.createDataFrame([("a", "lib", None, "p"), ("b", "lib", None, "p")],
                                "project_id string, path string, previous_path string, purpose string")
    bad = spark.createDataFrame([("b",), ("b",)], "project_id string")
    assert collect(X.structure_apply(current, ops, bad), "project_id", "outcome") == [
        ("a", "added"), ("b", "DOCUMENT_INVALID")]
