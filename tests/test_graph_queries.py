import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import P, S, collect, node, nodes, ordered, rel, relations, requests, shuffled
from weftgraph.operators import context as C
from weftgraph.operators import integrity as I
from weftgraph.operators import paging as G
from weftgraph.operators import postings
from weftgraph.operators import search as Q
from weftgraph.operators import traverse as T


@pytest.fixture(scope="module")
def tiny(spark):
    n = nodes(spark, [
        node("folder", "folder", "src", "src"),
        node("file", "file", "main.ts", "src/main.ts", "folder"),
        node("b", name="Beta", path="src/main.ts", parent="file"),
        node("a", name="Alpha", path="src/main.ts", parent="file", q="api.Alpha", exported=True),
        node("ext", "external", "lib"),
    ])
    r = relations(spark, [
        rel("r1", "a", "b"), rel("r2", "a", "ext", resolution="external"), rel("r3", "a", None),
        rel("r4", "b", "a"), rel("c1", "file", "a", "contains"),
    ])
    return n, r


def _ask(spark, *qs):
    return spark.createDataFrame([(P, S, q, q) for q in qs],
                                 "project_id string, snapshot_id string, request_id string, q string")


def test_search_finds_every_field(spark, tiny):
    asked = _ask(spark, "", " API ", "a", "main.ts", "nothing", "et")
    found = Q.search_matches(tiny[0], asked)
    assert collect(found, "q", "id") == [
        ("", "a"), ("", "b"), ("a", "a"), ("a", "b"), ("api", "a"), ("et", "b"),
        ("main.ts", "a"), ("main.ts", "b")]


def test_posting_lists_come_back():
    rng = np.random.default_rng(4)
    lists = [np.sort(rng.choice(top, size, replace=False)) + 1
             for top, size in ((300, 300), (1, 1), (10**6, 40), (2**31, 9))]
    offsets = np.cumsum([0] + [len(x) for x in lists])
    raw, ends = postings.encode(np.concatenate(lists), offsets)
    for n, want in enumerate(lists):
        assert postings.decode(raw[ends[n]:ends[n + 1]].tobytes()).tolist() == want.tolist()
    assert ends[1] == 300  # a byte a neighbour


def test_search_by_posting_lists_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)  # many blocks
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abÉ𝄞é/", k=n))
    scopes = [(P, S), (P, "s2")]
    rows = [node(f"f{i}", name=word(rng.randint(1, 6)), path=rng.choice([None, "", word(9)]),
                 q=rng.choice([None, word(4)]), scope=rng.choice(scopes)) for i in range(300)]
    rows.append(node("file", "file", "abab"))
    asked = [(*s, q) for s in scopes for q in [word(rng.randint(1, 5)) for _ in range(60)] + ["zz", ""]]
    got = collect(Q.search_matches(nodes(spark, rows), spark.createDataFrame(
        asked, "project_id string, snapshot_id string, q string")), "snapshot_id", "q", "id")
    want = {(s, q.lower(), r[2]) for p, s, q in asked for r in rows
            if r[1] == s and r[3] == "function"
            and any(q.lower() in (r[c] or "").lower() for c in (4, 5, 6))}
    assert got == sorted(want)


def test_blocks_are_indexed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = postings.gram_index(nodes(spark, [node(f"f{i}", name=f"n{i}") for i in range(400)]))
    assert len(index.texts.inputFiles()) > 4 and len(index.lists.inputFiles()) > 4
    held = {(r.block, r.place): r.text for r in index.texts.collect()}
    grams = {(at[0], text[i:i + w], at[1]) for at, text in held.items() for w in (1, 2, 3)
             for i in range(len(text) - w + 1)}
    rows = index.lists.collect()
    assert grams == {(r.block, r.gram, int(p)) for r in rows for p in postings.decode(bytes(r.gaps))}
    assert len(grams) == sum(r.n for r in rows)


def test_search_of_nothing(spark, tiny):
    assert not collect(Q.search_matches(tiny[0], _ask(spark, "a").limit(0)), "q", "id")
    assert not collect(Q.search_matches(tiny[0].limit(0), _ask(spark, "a", "")), "q", "id")


def test_search_pages_in_name_order(spark, tiny):
    page = Q.search_functions(tiny[0], _ask(spark, ""), 1, 1)
    assert ordered(page, "id", "position", "total") == [("b", 2, 2)]


@pytest.mark.parametrize("offset,limit", [(-1, 5), (0, 0), (0, 201), (True, 1), (0, 1.5)])
def test_page_bounds_are_errors(offset, limit):
    with pytest.raises(ValueError):
        G.check_page(offset, limit)


def test_function_context_pages_both_directions(spark, tiny):
    n, r = tiny
    got = C.function_context(r, n, requests(spark, ["a", "ext", "gone"]), 0, 2)
    assert collect(got, "node_id", "direction", "id", "total_outgoing", "truncated") == [
        ("a", "incoming", "r4", 3, True), ("a", "outgoing", "r1", 3, True),
        ("a", "outgoing", "r2", 3, True)]


def test_summary_and_entrypoints(spark, tiny):
    n, r = tiny
    row = C.project_summary(n, r).first()
    assert (row.files, row.folders, row.functions, row.relations) == (1, 1, 2, 5)
    assert (row.calls_resolved, row.calls_unresolved, row.calls_external) == (2, 1, 1)
    assert ordered(Q.entrypoints(n), "id", "total") == [("a", 1)]


def test_python_entrypoints_need_a_file_parent(spark):
    n = nodes(spark, [
        node("f", "file", path="m.py"), node("top", parent="f", lang="python", exported=True),
        node("inner", parent="top", lang="python", exported=True)])
    assert ordered(Q.entrypoints(n), "id") == [("top",)]


def test_owning_file_walks_parents_and_survives_cycles(spark):
    n = nodes(spark, [
        node("f", "file", path="a.ts"), node("x", path="a.ts"), node("y", parent="x"),
        node("z", path="lost.ts", parent="y"), node("ext", "external", path="a.ts"),
        node("l1", parent="l2"), node("l2", parent="l1")])
    assert collect(C.owning_file(n), "id", "file_id") == [
        ("f", "f"), ("x", "f"), ("y", "f"), ("z", "f")]


@pytest.fixture(scope="module")
def funnel(spark):
    n = nodes(spark, [
        *[node(f, "file", path=f"src/{f}.ts") for f in "abc"],
        node("a1", path="src/a.ts"), node("a2", path="src/a.ts"), node("b1", path="src/b.ts"),
        node("c1", path="src/c.ts"), node("ext", "external")])
    r = relations(spark, [
        rel("ab1", "a1", "b1", order="1"), rel("ab2", "a2", "b1", order="2"),
        rel("imp", "a", "b", "imports", order="3"), rel("ca", "c1", "a2", order="4"),
        rel("own", "a1", "a", "contains", order="5"), rel("unknown", "a1", None, order="6"),
        rel("ex", "a1", "ext", resolution="external", order="7")])
    return n, r


def test_file_dependencies(spark, funnel):
    near, edges, flags = T.file_dependencies(*funnel, requests(spark, ["a"]), 80)
    assert collect(near, "other") == [("b",), ("c",)]
    assert collect(edges.filter("target_id is not null"), "source_id", "target_id", "type") == [
        ("a", "b", "imports"), ("c", "a", "calls")]
    assert collect(flags, "unknown", "truncated") == [(2, False)]
    _, _, tight = T.file_dependencies(*funnel, requests(spark, ["a"]), 2)
    assert collect(tight, "truncated") == [(True,)]


def test_function_dependencies_drop_externals(spark, funnel):
    out = T.function_dependencies(*funnel, requests(spark, ["a1"]), 80)
    assert collect(out.nodes, "id") == [("a1",), ("b1",)]
    unknown = C.unknown_count(funnel[1], requests(spark, ["a1"]))
    assert collect(unknown, "unknown") == [(2,)]


def test_file_context_groups(spark, funnel):
    rows = C.file_context(*funnel, requests(spark, ["a"]), 0, 2)
    assert collect(rows, "category", "item_id", "total") == [
        ("imports", "imp", 1), ("incoming", "ca", 1), ("members", "a1", 2), ("members", "a2", 2),
        ("outgoing", "ab1", 2), ("outgoing", "ab2", 2), ("unknown", "ex", 2),
        ("unknown", "unknown", 2)]


def test_navigation_scope(spark):
    n = nodes(spark, [
        node("root", "folder", "."), node("d", "folder", path="d", parent="root"),
        node("f", "file", path="d/x.ts", parent="d"), node("g", path="d/x.ts", parent="f", q="g"),
        node("h", path="d/x.ts", parent="g", q="g.h")])
    asked = spark.createDataFrame(
        [(P, S, p, k) for p, k in [(".", "folder"), ("d", "folder"), ("d/x.ts", "file"),
                                   ("no", "folder"), ("../d", "folder"), ("d//x", "file")]],
        "project_id string, snapshot_id string, path string, kind string")
    got = Q.navigation_scope(n, asked, 2)
    assert collect(got.filter("not missing"), "path", "position", "id", "truncated") == [
        (".", 0, "root", False), (".", 1, "d", False), ("d", 0, "d", False), ("d", 1, "f", False),
        ("d/x.ts", 0, "f", True), ("d/x.ts", 1, "g", True)]
    assert collect(got.filter("missing"), "path") == [("no",)]


def test_layout_limits_at_the_boundary(spark):
    base = spark.range(4).select(
        F.lit(P).alias("project_id"), F.lit(S).alias("snapshot_id"),
        F.col("id").cast("string").alias("id"), F.lit("function").alias("kind"),
        F.lit(None).cast("string").alias("parent_id"))
    r = relations(spark, [rel("e", "0", "1")])
    status = lambda **k: I.layout_target(base, r, **k).first()
    assert status(max_nodes=4).status == "ready"
    assert status(max_nodes=3).reason == "node_budget"
    assert status(max_relations=0).reason == "relation_budget"
    size = status().fact_bytes
    assert status(max_bytes=size).status == "ready"
    assert status(max_bytes=size - 1).reason == "byte_budget"


def _brute(ids, edges, parents, seeds, depth, budget):
    """The sequential rule: sorted levels, then parents in selection order, then edges."""
    selected, over = [], False

    def add(i):
        nonlocal over
        if i in selected:
            return False
        if len(selected) >= budget:
            over = True
            return False
        selected.append(i)
        return True

    near = {}
    for _, a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    frontier = [s for s in sorted(set(seeds)) if add(s)]
    for _ in range(depth):
        nxt = {n for f in frontier for n in near.get(f, ()) if n in ids and n not in selected}
        frontier = [n for n in sorted(nxt) if add(n)]
    for i in list(selected):
        p, seen = parents.get(i), set()
        while p and p in ids and p not in seen:
            seen.add(p)
            add(p)
            p = parents.get(p)
    inside = sorted(e for e, a, b in edges if a in selected and (b is None or b in selected))
    return set(selected), inside[:budget * 3], over or len(inside) > budget * 3


@pytest.mark.parametrize("depth,budget", [(0, 3), (1, 5), (2, 12), (3, 40)])
def test_bfs_matches_the_sequential_rule_on_a_hub_graph(spark, depth, budget):
    """A third of all edges meets one hub; repeated, targetless and looping edges included."""
    rnd = random.Random(depth)
    names = [f"n{i:02d}" for i in range(60)]
    parents = {n: rnd.choice(names) for n in names if rnd.random() < 0.5}
    edges = []
    for k in range(240):
        a = "n30" if k % 3 == 0 else rnd.choice(names)
        b = rnd.choice([*names, None, "ghost"])
        edges.append((f"e{k:03d}", a, b) if rnd.random() < 0.5 or b is None or b == "ghost"
                     else (f"e{k:03d}", b, a))
    n = shuffled(nodes(spark, [node(x, parent=parents.get(x)) for x in names]))
    r = shuffled(relations(spark, [rel(e, a, b) for e, a, b in edges]))
    wanted = {"q1": ["n30"], "q2": ["n01", "n02", "n59"], "q3": names[:20]}
    seeds = spark.createDataFrame(
        [(P, S, q, i) for q, ids in wanted.items() for i in ids],
        "project_id string, snapshot_id string, request_id string, node_id string")
    out = T.subgraph(n, r, seeds, depth, budget)
    flags = dict(collect(out.flags, "request_id", "truncated"))
    for q, ids in wanted.items():
        want, inside, over = _brute(set(names), edges, parents, ids, depth, budget)
        mine = F.col("request_id") == q
        assert {i for (i,) in collect(out.nodes.filter(mine), "id")} == want
        assert [i for (i,) in collect(out.relations.filter(mine), "id")] == inside
        assert flags[q] == over


def test_unknown_seeds_reject_the_whole_request(spark, tiny):
    out = T.subgraph(*tiny, requests(spark, ["a", "nobody"]), 1, 80)
    assert {q for (q,) in collect(out.nodes, "request_id")} == {"a"}


def test_graph_union_keeps_new_first(spark):
    q = [(P, S, "r", i, i) for i in ("x", "y", "z")]
    cols = "project_id string, snapshot_id string, request_id string, id string, ord string"
    e = "project_id string, snapshot_id string, request_id string, id string, source_id string, " \
        "target_id string, type string, ord string"
    shown_edges = spark.createDataFrame([
        (P, S, "r", "old", "x", "y", "calls", "1"), (P, S, "r", "rooted", "z", "x", "calls", "2"),
        (P, S, "r", "same", "x", "y", "imports", "3")], e)
    new_edges = spark.createDataFrame([(P, S, "r", "same", "z", "y", "calls", "1")], e)
    got_nodes, got_edges, flags = T.graph_union(
        spark.createDataFrame(q, cols), shown_edges,
        spark.createDataFrame([(P, S, "r", "z", "z")], cols), new_edges,
        requests(spark, ["z"]).withColumn("request_id", F.lit("r")), 2, 900)
    assert collect(got_nodes, "position", "id") == [(1, "z"), (2, "x")]
    assert collect(flags, "truncated") == [(True,)]
    assert collect(got_edges, "id") == []


def test_prefix_ranks_equal_a_window(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    ranked = G.prefix_ranks(df, ["k"], F.floor(F.col("v") / 100), [F.col("v"), F.col("id")])
    rows = collect(ranked, "k", "v", "id", "position")
    want = {}
    for k, v, i, pos in rows:
        want[k] = want.get(k, 0) + 1
        assert pos == want[k]


def test_integrity_issues(spark, tiny):
    bad = nodes(spark, [node("a"), node("a"), node("z", "thing", parent="nobody"), node(" ")])
    r = relations(spark, [rel("r", "a", "gone"), rel("r", "a", "a", "jumps")])
    assert {(c, i) for c, i in collect(I.integrity_check(bad, r), "code", "id")} == {
        ("DUPLICATE_NODE", "a"), ("BLANK_NODE_ID", " "), ("BAD_KIND", "z"),
        ("UNKNOWN_PARENT", "z"), ("DUPLICATE_RELATION", "r"), ("DANGLING_ENDPOINT", "r"),
        ("BAD_RELATION_ENUM", "r")}
    assert I.integrity_check(*tiny).count() == 0
