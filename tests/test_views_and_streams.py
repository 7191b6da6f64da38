import random

import pytest
from pyspark.sql import functions as F

from helpers import P, S, collect, node, nodes, rel, relations, shuffled
from weftgraph.functions import ids as I
from weftgraph.operators import condense as Z
from weftgraph.operators import views as V
from weftgraph.staging import stage_root
from weftgraph.streaming import streams as T


def _components(edges, names):
    reach = {a: {a} for a in names}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            for x in names:
                if a in reach[x] and b not in reach[x]:
                    reach[x].add(b)
                    grown = True
    return {a: min(b for b in names if b in reach[a] and a in reach[b]) for a in names}


def _graph(spark, edges, names):
    return (shuffled(nodes(spark, [node(n) for n in names])),
            shuffled(relations(spark, [rel(f"e{i}", a, b) for i, (a, b) in enumerate(edges)])))


@pytest.mark.parametrize("seed,size,count", [(1, 12, 16), (2, 25, 40), (3, 30, 30)])
def test_components_of_random_graphs(spark, seed, size, count):
    rnd = random.Random(seed)
    names = [f"v{i:02d}" for i in range(size)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(count)]
    got = Z.scc_condense(*_graph(spark, edges, names))
    assert dict(collect(got, "id", "component")) == _components(edges, names)


def test_rings_and_chains(spark):
    names = [f"v{i:03d}" for i in range(90)]
    ring = [(names[i], names[(i + 1) % 40]) for i in range(40)]
    chain = [(names[i], names[i + 1]) for i in range(40, 89)]
    n, r = _graph(spark, [*ring, (names[39], names[40]), *chain], names)
    components = Z.scc_condense(n, r)
    got = dict(collect(components, "id", "component"))
    assert {got[x] for x in names[:40]} == {"v000"}
    assert all(got[x] == x for x in names[40:])


def test_ranks_take_the_longest_path(spark):
    names = list("abcdef")
    n, r = _graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "c"), ("d", "e")],
                  names)
    components = Z.scc_condense(n, r)
    ranks = Z.dag_rank(components, Z.rank_edges(n, r))
    assert dict(collect(ranks, "component", "rank")) == {"a": 0, "b": 1, "c": 2, "e": 3, "f": 0}


def test_preorder_with_orphans_and_cycles(spark):
    n = nodes(spark, [
        node("r", "folder"), node("b", "folder", parent="r"), node("a", "file", parent="r"),
        node("z", "file", parent="b"), node("orphan", "file", parent="gone"),
        node("k1", "folder", parent="k3"), node("k2", "folder", parent="k1"),
        node("k3", "folder", parent="k2"), node("k0", "file", parent="k2")])
    order = [r.id for r in Z.structure_preorder(n).orderBy("sort_path").collect()]
    assert order == ["k0", "k1", "k2", "k3", "orphan", "r", "a", "b", "z"]


def test_lanes_pages_and_groups(spark):
    ups = [f"up{i}" for i in range(8)]
    edges = [("root", f"e{i}", u, "root", "calls") for i, u in enumerate(ups)]
    edges += [("root", "out", "root", "dep", "calls"), ("root", "back", "root", "up0", "calls"),
              ("root", "own", "root", "kid", "contains")]
    e = spark.createDataFrame(edges, "root string, id string, source string, target string, "
                                     "type string")
    view = spark.createDataFrame([("root", i) for i in ["root", *ups, "dep", "kid"]],
                                 "root string, id string")
    lanes = V.lane_assign(view, e)
    got = dict(collect(lanes, "id", "lane"))
    assert got["up0"] == "dependent" and got["dep"] == "dependency"
    assert got["kid"] == "side" and got["root"] == "selected"
    assert collect(V.reciprocal_count(lanes), "reciprocal") == [(1,)]
    first = V.lane_page(lanes.filter("lane = 'dependent'"), 0, 3)
    assert collect(first, "range_start", "range_end", "total", "pages")[0] == (1, 3, 8, 3)
    last = V.lane_page(lanes.filter("lane = 'dependent'"), 9, 3)
    assert collect(last, "id") == [("up6",), ("up7",)]


def test_group_aliases_and_routes(spark):
    n = spark.createDataFrame([(i, "function", "fact") for i in ("a", "b", "outside")],
                              "id string, kind string, layer string")
    g = spark.createDataFrame([("g1", False), ("g2", True), ("g3", True)],
                              "group_id string, collapsed boolean")
    m = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "not-loaded"), ("g2", "a"),
                               ("g3", "nobody")], "group_id string, id string")
    view = {r.view_id: r.unknown for r in V.group_projection(n, g, m).collect()}
    assert view == {"outside": None, "group:g1": 1, "group:g2": 0, "group-member:g1:a": None,
                    "group-member:g1:b": None}
    e = spark.createDataFrame([("o", "a", "outside"), ("i", "b", "a")],
                              "id string, source string, target string")
    routes, internal = V.group_edge_routes(e, n, g, m)
    assert collect(routes, "edge_id", "source_view", "target_view") == [
        ("group-edge:i:0", "group-member:g1:b", "group-member:g1:a"),
        ("group-edge:i:1", "group-member:g1:b", "group:g2"),
        ("group-edge:o:0", "group-member:g1:a", "outside"),
        ("group-edge:o:1", "group:g2", "outside")]
    assert collect(internal, "group_id", "relation_id") == [("g1", "i")]


def test_frames_nest(spark):
    cards = spark.createDataFrame(
        [("top", "folder", 0, 0), ("sub", "folder", 400, 200), ("f", "file", 500, 400),
         ("empty", "folder", 9, 9)], "id string, kind string, x bigint, y bigint")
    links = spark.createDataFrame([("top", "sub"), ("sub", "f")], "parent string, child string")
    rows = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in V.nested_frames(cards, links).collect()}
    assert rows == {"sub": (372, 146, 798, 578), "top": (-28, -54, 826, 606)}


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(5)
    boxes = [("B", f"b{i}", rnd.randrange(0, 2000, 50), rnd.randrange(0, 900, 50))
             for i in range(80)] + [("B", f"pile{i}", 100, 100) for i in range(40)]
    want = sum(
        abs(p[2] - q[2]) < 300 and abs(p[3] - q[3]) < 220
        for i, p in enumerate(boxes) for q in boxes[i + 1:])
    got = V.rect_overlaps(spark.createDataFrame(
        boxes, "board string, id string, x bigint, y bigint"), "board")
    assert got.agg(F.sum("pairs")).first()[0] == want


def test_display_names(spark):
    names = ['a.<callback:[[80,"x.y"]]:1>.b', "plain.name", "<anonymous>.f",
             '<callback:[[80,"' + "q" * 50 + '"]]:0>', "<callback:[]:0>"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(
        I.display_name("n")).collect()]
    assert got == ["a › x.y(…) callback › b", "plain.name", "anonymous › f",
                   "q" * 39 + "…(…) callback", "<callback:[]:0>"]


CHANGE = ("id string, seq bigint, action string, expected bigint, text string, "
          "target_id string")


@pytest.mark.parametrize("merge_every", [2, 32])
def test_revision_batches_keep_a_log_of_state(spark, monkeypatch, merge_every):
    monkeypatch.setattr(T, "MERGE_EVERY", merge_every)
    path = f"{stage_root(spark)}/cas-batches-{random.random()}"
    for rows in ([("n", 2, "edit", 1, "u", None), ("m", 3, "edit", 7, "u", None)],
                 [("n", 4, "edit", 2, "u", None), ("n", 3, "edit", 1, "late", None)],
                 [("n", 5, "delete", 2, None, None)], [("n", 6, "edit", 3, "x", None)]):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(path)
    current = spark.createDataFrame([("n", 1, "t", None)],
                                    "id string, revision bigint, text string, target_id string")
    out = T.revision_cas(T.stream_table(spark, path, 1), current)
    assert collect(out, "id", "seq", "outcome") == [
        ("m", 3, "conflict"), ("n", 2, "applied"), ("n", 3, "conflict"), ("n", 5, "applied"),
        ("n", 6, "conflict")]


def test_copies_are_numbered_across_blocks(spark):
    from weftgraph.operators.paging import expand_copies

    counted = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "k string, n bigint")
    rows = collect(expand_copies(counted, "n", "i", block=10), "k", "i")
    assert rows == [("a", i) for i in range(1, 26)] + [("b", 1)] + [("c", i) for i in range(1, 11)]


def test_late_rows_are_dropped_after_the_watermark(spark):
    path = f"{stage_root(spark)}/late-test-{random.random()}"
    for rows in ([("2024-01-01 00:10:00",)], [("2024-01-01 05:00:00",)], [("2024-01-01 06:00:00",)],
                 [("2024-01-01 00:20:00",), ("2024-01-01 09:00:00",)]):
        spark.createDataFrame(rows, "ts string").select(F.to_timestamp("ts").alias("ts")).coalesce(
            1).write.mode("append").parquet(path)
    rate = T.change_rate(T.stream_table(spark, path, 1), "ts", "1 hour", F.window("ts", "1 hour"))
    out = T.run_to_table(rate, "late-test")
    assert [(str(s)[11:16], n) for s, n in collect(out, "start", "changes")] == [
        ("00:00", 1), ("05:00", 1), ("06:00", 1)]


def test_members_meet_the_current_snapshot_of_their_project(spark):
    members = spark.createDataFrame(
        [("p", "g", "a", "s2"), ("p", "g", "b", "s1"), ("p", "g", "c", "s2"), ("q", "g", "a", "s1")],
        "project_id string, group_id string, id string, snapshot_id string")
    nodes = spark.createDataFrame(
        [(p, s, i, "function") for p, s, i in [
            ("p", "s1", "a"), ("p", "s2", "a"), ("p", "s2", "b"), ("p", "s1", "c"), ("q", "s1", "a")]],
        "project_id string, snapshot_id string, id string, kind string")
    current = spark.createDataFrame([("p", "s2"), ("q", "s1")],
                                    "project_id string, snapshot_id string")
    got = V.member_bindings(members, nodes, current)
    assert collect(got, "id", "status") == [
        ("a", "bound"), ("a", "bound"), ("b", "snapshot-changed"), ("c", "missing")]


def test_repeated_requests_within_the_watermark_and_after_it(spark):
    path = f"{stage_root(spark)}/dedupe-test-{random.random()}"
    for rows in ([("m", "00:10"), ("m", "00:20"), ("k", "00:15")], [("x", "09:00")],
                 [("y", "09:05")], [("m", "00:30"), ("m", "09:30"), ("x", "09:10")]):
        spark.createDataFrame(rows, "id string, at string").select(
            "id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")).alias("at")).coalesce(
            1).write.mode("append").parquet(path)
    kept = T.dedupe_mutations(T.stream_table(spark, path, 1), "at", "1 hour", ["id"])
    out = T.run_to_table(kept, "dedupe-test")
    # m at 00:30 is late; at 09:30 its first request is forgotten; x at 09:10 is not.
    assert sorted((r["id"], str(r["at"])[11:16]) for r in out.collect()) == [
        ("k", "00:15"), ("m", "00:10"), ("m", "09:30"), ("x", "09:00"),
        ("y", "09:05")]


def test_staged_tables_can_be_released(spark):
    from weftgraph.staging import release, stage, table_exists

    kept, gone = stage(spark.range(3), "kept"), stage(spark.range(3), "gone")
    assert table_exists(spark, gone.inputFiles()[0].rsplit("/", 1)[0])
    release(gone)
    assert kept.count() == 3
    assert not table_exists(spark, gone.inputFiles()[0].rsplit("/", 1)[0])
