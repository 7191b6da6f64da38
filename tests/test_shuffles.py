"""Queries move each row no more often than they need to."""

import pytest

from helpers import P, S, collect, node, nodes
from test_published_graph import tables
from weftgraph import catalog
from weftgraph.catalog import changes as C
from weftgraph.catalog import views as CV
from weftgraph.operators import traverse, views as V

catalog.load()


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("star-shuffles")
    for name, (schema, rows) in tables().items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_digests_and_effects_store_what_they_read(spark, star):
    assert C.folder_digests(spark, star).filter("path = '.'").count() == 2
    assert set(C._stored(spark, star)) == {"tree"}
    C.snapshot_diff_effects(spark, star).count()
    assert "facts" not in C._stored(spark, star)
    assert "id" not in C._references(spark, star).columns


def test_ancestors_meet_their_request_in_one_shuffle(spark, monkeypatch):
    plans, written = {}, traverse.stage
    monkeypatch.setattr(traverse, "stage", lambda df, name, *a: (
        plans.setdefault(name, _shuffles(df)), written(df, name, *a))[1])
    tree = nodes(spark, [node("r", "folder"), node("d", "folder", parent="r"),
                         node("f", "file", parent="d"), node("x", "function", parent="f"),
                         node("lost", "file", parent="gone")])
    chosen = spark.createDataFrame(
        [(P, S, "one", "x", 0), (P, S, "one", "d", 1), (P, S, "two", "lost", 0),
         (P, S, "two", "f", 0)],
        "project_id string, snapshot_id string, request_id string, id string, level int")
    got, over = traverse.ancestor_closure(tree, chosen)
    assert collect(got, "request_id", "id", "rank") == [
        ("one", "f", 1), ("one", "r", 2), ("two", "d", 1), ("two", "r", 2)]
    got, over = traverse.ancestor_closure(tree, chosen, 3)
    assert collect(got, "request_id", "id") == [("one", "f"), ("two", "d")]
    assert collect(over, "request_id") == [("one",), ("two",)]
    assert plans["ancestors"] == 1


def test_routes_shuffle_edges_once_an_end_and_once_by_id(spark):
    n = spark.createDataFrame([(i, "function", "fact") for i in ("a", "b", "c")],
                              "id string, kind string, layer string")
    g = spark.createDataFrame([("g1", False), ("g2", True)], "group_id string, collapsed boolean")
    m = spark.createDataFrame([("g1", "a"), ("g2", "a"), ("g2", "b")], "group_id string, id string")
    e = spark.createDataFrame(
        [("ab", "a", "b"), ("ab", "a", "b"), ("cc", "c", "c"), ("cc", "c", "c"), ("ca", "c", "a"),
         (None, "a", "c"), ("cn", "c", None)],
        "id string, source string, target string")
    routes, internal = V.group_edge_routes(e, n, g, m)
    assert collect(routes, "edge_id", "source_view", "target_view", "mirrored") == [
        ("cc", "c", "c", False), ("cc", "c", "c", False), ("cn", "c", None, False),
        ("group-edge:ab:0", "group-member:g1:a", "group:g2", False),
        ("group-edge:ca:0", "c", "group-member:g1:a", True),
        ("group-edge:ca:1", "c", "group:g2", True)]
    assert collect(internal, "group_id", "relation_id") == [("g2", "ab")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(V.group_edge_routes(e, n, g, m)[0]) < 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_cards_of_linked_lanes_are_written(spark, star):
    cards = CV._groups(spark, star)[2]
    assert {r.lane for r in cards.select("lane").distinct().collect()} == {
        "dependent", "dependency"}
