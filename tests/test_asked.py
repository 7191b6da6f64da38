"""Joins of a snapshot with the few ids that plans name move only rows that may match."""

import pytest
from pyspark.sql import functions as F

from helpers import collect, node, nodes, ops, rel, relations
from weftgraph.operators.asked import Asked
from weftgraph.plans import overlay as O
from weftgraph.plans import rules as R
from weftgraph.plans import state as S


@pytest.fixture(autouse=True)
def no_small_tables(spark):
    """As at size: Spark broadcasts nothing by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _holds(df, side):
    """Is a step named ``side`` part of the plan?"""
    return side in df._jdf.queryExecution().optimizedPlan().toString()


def test_no_asked_row_is_lost_and_few_others_stay(spark):
    keys = spark.createDataFrame([(f"a{i}", "x" if i % 2 else None) for i in range(500)],
                                 "a string, b string")
    rows = spark.range(20000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("p"),
                                     F.when(F.col("id") % 2 == 1, "x").alias("q"))
    rows = rows.unionByName(rows.limit(3)).unionByName(
        spark.createDataFrame([(None, "x")], "p string, q string"))
    kept = Asked(keys.unionByName(keys)).among(rows, "p", "q")
    assert kept.columns == ["p", "q"]
    wanted = keys.select(F.col("a").alias("p"))
    assert kept.join(wanted, "p", "left_semi").count() == 503
    assert kept.count() < 5000
    assert Asked(keys.limit(0)).among(rows, "p", "q").count() == 0


def test_relations_that_no_plan_names_are_dropped_where_they_are_read(spark):
    facts = relations(spark, [rel(f"r{i}", "a", "b") for i in range(9)])
    log = ops(spark, [{"kind": "remove_relation", "relation_id": "r1"},
                      {"kind": "remove_relation", "relation_id": "gone"},
                      {"kind": "add_relation", "relation_id": "r2", "source_id": "a",
                       "target_id": "b"}])
    lost = R.rule_invalid_relation(log, facts)
    taken = R.rule_duplicate_relation(log, facts)
    touched = O.affected_nodes(log.filter("op_index > 0"), log, facts)
    for issues in (lost, taken, touched):
        assert _holds(issues, "getbit")
    assert collect(lost, "op_index") == [(1,)]
    assert collect(taken, "op_index") == [(2,)]
    assert collect(touched, "id") == [("a",), ("b",)]


def test_nodes_that_no_plan_names_are_dropped_where_they_are_read(spark):
    tree = nodes(spark, [node(f"f{i}", path=f"p{i}.py") for i in range(9)])
    log = ops(spark, [{"kind": "move_function", "node_id": "f1", "file_path": "q.py"},
                      {"kind": "remove_function", "node_id": "f2"},
                      {"kind": "add_function", "temp_id": "f3", "name": "n", "file_path": "n.py"},
                      {"kind": "add_function", "temp_id": "t", "name": "n", "file_path": "n.py"}])
    paths = S.effective_path(log, tree)
    assert _holds(paths, "getbit")
    assert collect(paths, "id", "planned_path") == [
        ("f1", "q.py"), ("f2", "p2.py"), ("f3", "n.py"), ("t", "n.py")]
    state = S.plan_state(log, tree)
    assert collect(state.added, "id") == [("t",)]
    assert collect(state.known, "id") == [("f1",), ("f2",)]
    assert collect(state.alive, "id", "node_path") == [("f1", "q.py")]
    view = spark.createDataFrame([("plan1", "f5"), ("plan1", "none")], "plan_id string, id string")
    edges = relations(spark, []).withColumn("plan_id", F.lit("plan1"))
    shown = O.overlay_nodes(view, log, edges, tree)
    assert _holds(shown, "getbit")
    assert collect(shown.na.fill("-"), "id", "layer", "file_path") == [
        ("f1", "anchor", "p1.py"), ("f2", "anchor", "p2.py"), ("f3", "plan", "n.py"),
        ("f5", "fact", "p5.py"), ("none", "fact", "-"), ("t", "plan", "n.py")]
