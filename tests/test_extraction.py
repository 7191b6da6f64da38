import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import collect
from weftgraph.extract import configs as C
from weftgraph.extract import linking as K
from weftgraph.extract import python_facts as E
from weftgraph.functions import paths as P
from weftgraph.sources import scan as S

FILES = {
    "app/__init__.py": "from .tools import send as post\n",
    "app/tools.py": "def send(x):\n    return x\nclass Box:\n    def open(self):\n        pass\n",
    "app/main.py": """from app import post
from app.tools import Box as B
from . import tools, nothing
import os.path
import missing.pkg as mp

def fetch(dynamic, post2):
    post(1)
    tools.send(2)
    dynamic()
    os.getcwd()
    mp.call()
    nothing()
    B()
    B.open()
    len(post2)
    return lambda post: post()

class Client:
    def run(self):
        return self.send()
    def send(self):
        def inner():
            return Client()
        return inner()
    @staticmethod
    def lone(self):
        self.send()

def shadow(post):
    post()

if os:
    def maybe():
        pass
maybe()
late()
def late():
    early = fetch
    return early()
def late():
    pass
""",
    "app/bad.py": "def broken(:\n",
    "app/loop_a.py": "from app.loop_b import f\n",
    "app/loop_b.py": "from app.loop_a import f\n",
    "app/user.py": "from app.loop_a import f\nf()\nfrom ....up import g\ng()\n",
}


def _facts(spark, files):
    rows = [("p", path, bytearray(text.encode())) for path, text in files.items()]
    src = spark.createDataFrame(rows, "project_id string, path string, content binary")
    return src, E.extract_python(src).cache()


@pytest.fixture(scope="module")
def linked(spark):
    src, facts = _facts(spark, FILES)
    calls = facts.filter("fact = 'call'").withColumn(
        "call_id", F.concat_ws(":", "path", F.col("ordinal").cast("string")))
    got = K.link_calls(calls, K.module_table(src), facts.filter("fact = 'binding'"))
    rows = K.resolve_calls(calls.select("project_id", "call_id", "path", "parent", "text"), got)
    return facts, {(r.path, r.parent, r.text): (r.resolution, r.target_path, r.target_name,
                                                r.external) for r in rows.collect()}


@pytest.mark.parametrize("key,want", [
    (("fetch", "post(1)"), ("resolved", "app/tools.py", "send", None)),
    (("fetch", "tools.send(2)"), ("resolved", "app/tools.py", "send", None)),
    (("fetch", "dynamic()"), ("unresolved", None, None, None)),
    (("fetch", "os.getcwd()"), ("external", None, None, "os.getcwd")),
    (("fetch", "mp.call()"), ("external", None, None, "missing.pkg.call")),
    (("fetch", "nothing()"), ("unresolved", None, None, None)),
    (("fetch", "B()"), ("resolved", "app/tools.py", "Box", None)),
    (("fetch", "B.open()"), ("resolved", "app/tools.py", "Box.open", None)),
    (("fetch", "len(post2)"), ("external", None, None, "builtins.len")),
    (("fetch", "post()"), ("unresolved", None, None, None)),
    (("Client.run", "self.send()"), ("resolved", "app/main.py", "Client.send", None)),
    (("Client.lone", "self.send()"), ("unresolved", None, None, None)),
    (("Client.send", "inner()"), ("resolved", "app/main.py", "Client.send.inner", None)),
    (("Client.send.inner", "Client()"), ("resolved", "app/main.py", "Client", None)),
    (("shadow", "post()"), ("unresolved", None, None, None)),
    (("", "maybe()"), ("unresolved", None, None, None)),
    (("", "late()"), ("unresolved", None, None, None)),
    (("late", "early()"), ("unresolved", None, None, None)),
])
def test_python_calls(linked, key, want):
    assert linked[1][("app/main.py", *key)] == want


def test_cyclic_reexports_and_bad_levels_stay_unresolved(linked):
    assert linked[1][("app/user.py", "", "f()")][0] == "unresolved"
    assert linked[1][("app/user.py", "", "g()")][0] == "unresolved"


def test_declarations_and_diagnostics(linked):
    facts = linked[0]
    names = {q for p, q in collect(facts.filter("fact = 'decl'"), "path", "qualified")
             if p == "app/main.py"}
    assert {"late", "late#2", "Client.send.inner", "maybe"} <= names
    assert collect(facts.filter("fact = 'diagnostic'"), "path") == [("app/bad.py",)]


def test_blank_lines_change_the_content_but_not_the_ids(spark):
    def ids(files):
        src, facts = _facts(spark, files)
        made = K.build_nodes("p", src, facts.filter("fact = 'decl'"),
                             spark.createDataFrame([("os",)], "name string"))
        hashed = K.content_hash(src.withColumn("type", F.lit("source")))
        return collect(made, "id"), hashed.first().content_hash

    one = ids({"a.py": "def f():\n    pass\n"})
    two = ids({"a.py": "\n\ndef f():\n\n    pass\n"})
    assert one[0] == two[0] and one[1] != two[1]


def test_repeated_calls_keep_distinct_ids(spark):
    raw = spark.createDataFrame(
        [("calls", "s", t, "resolved", "f", 1, "x") for t in ("t", "t", "t", "u")],
        "type string, source_id string, target_id string, resolution string, path string, "
        "line bigint, text string")
    assert K.build_edges("p", raw).select("id").distinct().count() == 4


def test_coding_cookies_and_marks(spark):
    rows = [("p", "a.py", bytearray("# coding: latin-1\né".encode("latin-1"))),
            ("p", "b.ts", bytearray("é".encode("utf-16"))),
            ("p", "c.ts", bytearray(b"\xff"))]
    got = E.decode_files(spark.createDataFrame(
        rows, "project_id string, path string, content binary"))
    texts = {p: (t, e) for p, t, e in got.select("path", "text", "problem").collect()}
    assert texts["a.py"][0].endswith("é") and texts["b.ts"][0] == "é"
    assert texts["c.ts"] == (None, "UnicodeDecodeError")


def test_ignore_rules(spark):
    paths = ["a.py", "b/a.py", "b/keep.py", "c/x/y.py", "c/z.py", "d/gone/q.py", "d/q.log",
             "e/deep/one.py", "top.txt", "e/top.txt"]
    rules = [(".gitignore", "a.py\nc/\n*.log\n/top.txt\n**/gone/\n"), ("b/.gitignore", "!a.py\n"),
             ("c/.gitignore", "!*\n"), ("e/.gitignore", "deep/*\n!deep/one.py\n")]
    got = S.apply_ignore_rules(
        spark.createDataFrame([(p,) for p in paths], "path string"),
        spark.createDataFrame(rules, "path string, text string"))
    assert {p for p, i in collect(got, "path", "ignored") if i} == {
        "a.py", "c/x/y.py", "c/z.py", "d/gone/q.py", "d/q.log", "top.txt"}


@pytest.mark.parametrize("seed", [1, 2])
def test_metadata_budget_equals_the_greedy_scan(spark, seed):
    rnd = random.Random(seed)
    rows = [(c, f"f{i:03d}", rnd.choice([1, 7, 30, 80, 200])) for c in "xy" for i in range(60)]
    got = S.metadata_budget(spark.createDataFrame(rows, "c string, path string, bytes bigint"),
                            ["c"], 25, 100, 400)
    want = set()
    for c in "xy":
        used = taken = 0
        for cat, path, size in sorted(rows):
            if cat == c and size <= 100 and taken < 25 and used + size <= 400:
                used, taken = used + size, taken + 1
                want.add((c, path))
    assert {(c, p) for c, p, r in got.select("c", "path", "reason").collect() if r is None} == want


def test_metadata_budget_takes_512_but_not_513(spark):
    files = spark.range(513).select(F.lit("c").alias("c"), F.format_string("%04d", "id").alias(
        "path"), F.lit(1).cast("bigint").alias("bytes"))
    got = S.metadata_budget(files, ["c"])
    assert collect(got.filter("reason is not null"), "path", "reason") == [("0512", "budget")]


def test_config_closure_depth(spark):
    def valid(edges, own=()):
        names = sorted({n for e in edges for n in e if n})
        projects = spark.createDataFrame([(n, n not in own) for n in names],
                                         "path string, own_valid boolean")
        got = C.config_closure_valid(projects, spark.createDataFrame(
            edges, "path string, target string"))
        return {p for p, v in collect(got, "path", "valid") if v}

    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(16)]
    assert valid(chain) == {f"c{i:02d}" for i in range(1, 17)}
    assert valid([("a", "b"), ("b", "a"), ("x", "a"), ("y", "z")]) == {"y", "z"}
    assert valid([("a", "b"), ("b", "c")], own=("c",)) == set()


def test_forwarding_chains(spark):
    hops = [(f"m{i:02d}", f"m{i + 1:02d}", "./x") for i in range(17)]
    hops += [("p", "q", "./x"), ("q", "p", "./x"), ("ext", "m17", "pkg")]
    modules = sorted({m for a, b, _ in hops for m in (a, b)})
    got = K.forwarding_chain(
        spark.createDataFrame(hops, "module string, target string, specifier string"),
        spark.createDataFrame([(m, False, "commonjs") for m in modules],
                              "module string, invalid boolean, mode string"))
    rows = {m: (leaf, ok) for m, leaf, ok in collect(got, "module", "leaf", "proven")}
    assert rows["m01"] == ("m17", True) and rows["m00"] == ("m00", False)
    assert rows["p"] == ("p", False) and rows["ext"] == ("ext", False)


def test_export_conditions(spark):
    rows = [("a", '{"import":"./x","default":"./x"}', "require"), ("b", '{"node":"./x"}', "import"),
            ("c", '{"import":"./x"}', "require"), ("d", "null", "import"),
            ("e", '{"node":"./y","default":"./x"}', "import"),
            ("f", '{"node":{"import":null,"default":"./n"},"import":{"x":"./p"},"default":"./q"}',
             "import"), ("g", '{"0":"./x"}', "import"), ("h", "oops", "import"),
            ("i", '{"default":{"import":"./x","require":"./y"},"import":"./z"}', "require"),
            ("j", '{"default":{"import":"./x"},"require":"./z","node":"./w"}', "require"),
            ("k", '["./x"]', "import"), ("l", "{}", "import")]
    got = spark.createDataFrame(rows, "k string, c string, m string").withColumn(
        "e", C.condition_rows("c")).select(
        "k", C.export_outcomes(F.col("e"), F.col("m")).alias("o"))
    assert {k: list(o) for k, o in got.collect()} == {
        "a": ["./x"], "b": ["!none", "./x"], "c": ["!none"], "d": ["!blocked"],
        "e": ["./x", "./y"], "f": ["!blocked", "./p", "./q"], "g": ["!invalid"],
        "h": ["!invalid"], "i": ["./y"], "j": ["./z"], "k": ["!invalid"], "l": ["!none"]}


def test_export_targets_are_plain_files_of_their_package(spark):
    outcomes = ["./a.ts", "./d/b.mjs", "./a.d.ts", "./a.json", "./../x.ts", "./n//a.ts", "a.ts",
                "./Node_Modules/a.js", "./a%20.js", "./sub/own.js", "./gone.ts"]
    asked = spark.createDataFrame([(o, "p", json.dumps(o), "import") for o in outcomes],
                                  "request_id string, dir string, conditions string, mode string")
    files = spark.createDataFrame(
        [("p/" + o[2:],) for o in outcomes[:-1]] + [("q.ts",)], "path string")
    homes = spark.createDataFrame([("p",), ("p/sub",), (".",)], "dir string")
    got = C.exports_condition_converge(asked, files, homes)
    assert {r for r, t in collect(got, "request_id", "target") if t} == {"./a.ts", "./d/b.mjs"}


@pytest.mark.parametrize("text,want", [
    ("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", None), ("a/..", None), ("/a", None),
    ("C:x", None), ("a/", None), ("a\\b.ts", "a/b.ts"), (" ", None), ("a\x01b", None),
    ("./C:x", None), (".", None)])
def test_normalize_repo_path(spark, text, want):
    got = spark.createDataFrame([(text,)], "p string").select(P.normalize_repo_path("p")).first()[0]
    assert got == want
