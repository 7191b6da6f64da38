"""Longest-prefix decisions at both ends of a reference against a scan of all rules."""

import random

from weftgraph.plans import allow_rules as A

RULE = ("project_id string, rule_id string, kind string, source_prefix string, "
        "target_prefix string, reason string")
PAIR = "project_id string, snapshot_id string, source_path string, target_path string"


def within(path, prefix):
    return prefix == "." or path == prefix or path.startswith(prefix + "/")


def depth(prefix):
    return 0 if prefix == "." else prefix.count("/") + 1


def slow(pair, rules):
    held = [r for r in rules if r[0] == pair[0] and within(pair[2], r[3]) and within(pair[3], r[4])
            and (r[2] != "exception" or (r[5] or "").strip())]
    if not held:
        return "unruled", None
    top = max((depth(r[3]) + depth(r[4]), depth(r[3])) for r in held)
    best = [r for r in held if (depth(r[3]) + depth(r[4]), depth(r[3])) == top]
    kinds = {k: min((r[1] for r in best if r[2] == k), default=None) for k in A.KINDS}
    if kinds["exception"]:
        return "excepted", kinds["exception"]
    if kinds["forbid"]:
        return "conflict" if kinds["allow"] else "forbidden", kinds["forbid"]
    return "allowed", kinds["allow"]


def test_decisions_equal_a_scan_of_all_rules(spark):
    rng = random.Random(2)
    folders = [".", "a", "a/b", "a/b/c", "a/bc", "d", "d/e"]
    rules = [(rng.choice(["p1", "p2"]), f"r{i}", rng.choice(A.KINDS), rng.choice(folders[i % 3:]),
              rng.choice(folders), rng.choice([None, " ", "agreed"])) for i in range(40)]
    paths = [f"{f}/x.py".removeprefix("./") for f in folders] + ["z.py", "ab/c.py"]
    pairs = [(p, "s", a, b) for p in ("p1", "p2", "p3") for a in paths for b in paths]
    got = A.decide(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(rules, RULE)).collect()
    assert sorted((*r[:4], r["verdict"], r["rule_id"]) for r in got) == sorted(
        ((*p, *slow(p, rules)) for p in pairs), key=lambda r: r[:4])
    assert {r["verdict"] for r in got} >= {"unruled", "excepted", "forbidden", "allowed"}


def test_conflicts_and_faulty_rules_are_named(spark):
    rules = [("p", "1", "allow", "a", "b", None), ("p", "2", "forbid", "a", "b", "layers"),
             ("p", "3", "forbid", ".", ".", None), ("p", "4", "exception", "a", "b", " "),
             ("p", "5", "maybe", "a", "b", None), ("p", "6", "forbid", "../a", "b", None),
             ("p", "7", "forbid", "a", None, None)]
    frame = spark.createDataFrame(rules, RULE)
    pair = spark.createDataFrame([("p", "s", "a/x.py", "b/y.py"), ("p", "s", "b/y.py", "q.py")], PAIR)
    got = {r["source_path"]: r for r in A.decide(pair, frame).collect()}
    one = got["a/x.py"]
    assert (one["verdict"], one["rule_id"], one["other_id"], one["reason"]) == (
        "conflict", "2", "1", "layers")
    assert (got["b/y.py"]["verdict"], got["b/y.py"]["rule_id"]) == ("forbidden", "3")
    assert {r["rule_id"]: r["code"] for r in A.rule_issues(frame).collect()} == {
        "4": "MISSING_REASON", "5": "UNKNOWN_KIND", "6": "INVALID_SOURCE_PREFIX",
        "7": "INVALID_TARGET_PREFIX"}
