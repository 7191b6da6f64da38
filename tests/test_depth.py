"""Trees, chains and names deeper than any fixed number of rounds."""

import random

import pytest

from helpers import P, S, collect, node, nodes, rel, relations
from weftgraph.extract import linking
from weftgraph.functions.ids import display_name, split_qualified
from weftgraph.operators import condense, context, traverse, views
from weftgraph.sources import scan

DEEP = 12  # loops without a bound: their length does not matter, but ...
DEEPER = 66  # ... one tree and one folder go beyond any customary one


def _chain(spark, depth=DEEP):
    rows = [node("n0", "file", path="top.py")]
    rows += [node(f"n{i}", "folder" if i < depth else "function", parent=f"n{i - 1}")
             for i in range(1, depth + 1)]
    return nodes(spark, rows)


def test_owner_of_a_deep_node(spark):
    assert dict(collect(context.owning_file(_chain(spark)), "id", "file_id"))[f"n{DEEP}"] == "n0"


def test_ancestors_of_a_deep_node(spark):
    start = spark.createDataFrame([(P, S, f"n{DEEPER}")],
                                  "project_id string, snapshot_id string, top string")
    got = traverse.parent_chains(_chain(spark, DEEPER), start)
    assert dict(collect(got, "id", "depth")) == {f"n{DEEPER - i}": i + 1 for i in range(DEEPER + 1)}


def test_preorder_of_a_deep_tree(spark):
    path = dict(collect(condense.structure_preorder(_chain(spark)), "id", "sort_path"))
    assert path[f"n{DEEP - 1}"].split("\x01") == [f"n{i}" for i in range(DEEP)]


def test_frames_of_deep_folders(spark):
    cards = spark.createDataFrame([(f"f{i}", "folder", 0, 0) for i in range(DEEP)],
                                  "id string, kind string, x int, y int")
    links = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(DEEP - 1)],
                                  "parent string, child string")
    got = {r.id: r.x0 for r in views.nested_frames(cards, links).collect()}
    assert got["f0"] == -views.FOLDER_PAD * (DEEP - 1)


def test_ranks_of_long_paths_and_random_graphs(spark):
    rng = random.Random(3)
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(30)]
    dag = [(f"d{a:02}", f"d{b:02}") for a in range(40) for b in range(a + 1, 40) if rng.random() < .1]
    edges = spark.createDataFrame([(P, S, a, b) for a, b in path + dag],
                                  "project_id string, snapshot_id string, a string, b string")
    names = sorted({x for e in path + dag for x in e} | {"alone"})
    own = spark.createDataFrame([(P, S, n, n) for n in names],
                                "project_id string, snapshot_id string, id string, component string")
    want = dict.fromkeys(names, 0)
    for a, b in sorted(path + dag):
        want[b] = max(want[b], want[a] + 1)
    for _ in range(30):
        for a, b in path + dag:
            want[b] = max(want[b], want[a] + 1)
    assert dict(collect(condense.dag_rank(own, edges), "component", "rank")) == want


def test_long_re_export_chains(spark):
    files = spark.createDataFrame([("p", f"m{i}.py") for i in range(DEEP)],
                                  "project_id string, path string")
    rows = [("p", f"m{i}.py", "", "f", "import", None, f"m{i + 1}", "f", False)
            for i in range(DEEP - 1)] + [("p", f"m{DEEP - 1}.py", "", "f", "function", "f", None, None, False)]
    names = spark.createDataFrame(
        rows, "project_id string, path string, parent string, name string, kind string, "
              "qualified string, module string, member string, relative boolean")
    calls = spark.createDataFrame(
        [("p", "c", "import", "m0.py", None, None, "m0", ["f"], False)],
        "project_id string, call_id string, kind string, path string, qualified string, "
        "name string, module string, attrs array<string>, relative boolean")
    got = linking.link_calls(calls, linking.module_table(files), names)
    assert collect(got, "call_id", "target_path", "target_name") == [("c", f"m{DEEP - 1}.py", "f")]


def test_rule_files_in_deep_folders(spark):
    folder = "/".join(f"d{i}" for i in range(DEEPER))
    files = spark.createDataFrame([(f"{folder}/x.log",), (f"{folder}/y.py",)], "path string")
    rules = spark.createDataFrame([(f"{folder}/.gitignore", "*.log\n"), (".gitignore", "none\n")],
                                  "path string, text string")
    got = scan.apply_ignore_rules(files, rules)
    assert collect(got, "path", "ignored") == [(f"{folder}/x.log", True), (f"{folder}/y.py", False)]


@pytest.mark.parametrize("name,want", [
    ("a.<b<c<d<e.f>g>.h>i>.j", ["a", "<b<c<d<e.f>g>.h>i>", "j"]),
    ("a.<b<c<d.e>f>g>.h", ["a", "<b<c<d.e>f>g>", "h"]),
    ('<x "a.>\\".<" y>.b', ['<x "a.>\\".<" y>', "b"]),
    ("a.b<c.d", ["a", "b<c.d"]), ("a>.b", ["a>", "b"]), ("", [""]), (".", ["", ""]),
])
def test_names_split_outside_brackets_at_any_depth(spark, name, want):
    rows = spark.createDataFrame([(name,)], "q string")
    got = rows.select(split_qualified("q").alias("p"), display_name("q").alias("d")).first()
    assert got["p"] == want and got["d"] is not None
