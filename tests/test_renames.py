"""Rename candidates against a plain greedy matching over all pairs."""

import hashlib
import random
import re

import pytest

from weftgraph.operators import renames as R
from weftgraph.staging import stage

from helpers import node, nodes, rel, relations

A, B = ("p1", "a"), ("p1", "b")


def words(text):
    apart = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()
    return {w for w in re.split("[^a-z0-9]+", apart) if w}


def slow(node_rows, link_rows, likeness):
    held = {}
    for n in node_rows:
        if n[2] is not None and n[3] is not None:
            held.setdefault(n[2], {"at": set(), "row": n})["at"].add(n[1])
    def tokens(i):
        _, _, _, _, name, _, path, _, lang, sig, _, _ = held[i]["row"]
        out = {f"name:{w}" for w in words(name)} | {f"signature:{w}" for w in words(sig)}
        parts = path.split("/") if path is not None else []
        out |= {"path:" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)}
        out |= {f"language:{lang}"} if lang is not None else set()
        for link in link_rows:
            s, t, kind = link[5], link[6], link[4]
            if kind == "contains" or s is None or t is None:
                continue
            if s == i and len(held.get(t, {"at": ()})["at"]) == 2:
                out.add(f"{kind}>{t}")
            if t == i and len(held.get(s, {"at": ()})["at"]) == 2:
                out.add(f"{kind}<{s}")
        return frozenset(out)
    sides = {"a": {}, "b": {}}
    for i, h in held.items():
        if len(h["at"]) == 1 and h["row"][3] == "function" and tokens(i):
            sides[next(iter(h["at"]))].setdefault(tokens(i), []).append(i)
    mark = lambda text: hashlib.md5(text.encode()).hexdigest()
    classes = {s: [(min(m), t, sorted(m, key=lambda i: (mark(i), i))) for t, m in c.items()]
               for s, c in sides.items()}
    pairs = []
    for r, x, rm in classes["a"]:
        for a, y, am in classes["b"]:
            shared = len(x & y)
            if 100 * shared >= likeness * len(x | y) and shared:
                pairs.append((shared / len(x | y), mark(f"{r}|{a}"), shared, rm, am))
    choices = {}
    for _, _, _, rm, am in pairs:
        choices[rm[0]] = choices.get(rm[0], 0) + len(am)
    used, out = {}, []
    for alike, _, shared, rm, am in sorted(pairs, key=lambda p: (-p[0], [-ord(c) for c in p[1]])):
        i, j = used.get(("r", rm[0]), 0), used.get(("a", am[0]), 0)
        take = min(len(rm) - i, len(am) - j)
        out += [(rm[i + k], am[j + k], alike, shared, choices[rm[0]]) for k in range(take)]
        used["r", rm[0]], used["a", am[0]] = i + take, j + take
    return sorted(out)


def fast(spark, node_rows, link_rows, likeness):
    got = R.rename_candidates(nodes(spark, node_rows), relations(spark, link_rows), "a", "b",
                              likeness=likeness)
    return sorted((r.removed_id, r.added_id, r.likeness, r.shared, r.choices) for r in got.collect())


def random_graph(seed):
    dice = random.Random(seed)
    pick = dice.choice
    some = lambda: dict(
        name=pick(["getUser", "get_user", "loadUserRow", "save", None, "résumé", "-"]),
        path=pick(["a/b/c.py", "a/b/d.py", "x.py", None]), sig=pick(["(int a)", "(a)", None, ""]),
        lang=pick(["python", None]))
    rows, ids = [], {}
    for i in range(60):
        where = pick("abab" + "2")
        n = node(f"n{i}", kind="function", **some())
        n = (*n[:4], n[4] if pick([True, False]) else None, *n[5:])
        for scope in {"a": [A], "b": [B], "2": [A, B]}[where]:
            rows.append((*scope, *n[2:]))
        ids[f"n{i}"] = where
    links = []
    for k in range(120):
        s, t = pick(list(ids)), pick([*ids, None])
        link = (*pick([A, B]), *rel(f"r{k}", s, t, type=pick(["calls", "contains", "imports"]))[2:])
        links += [link] * pick([1, 1, 2])
    return rows + rows[:5], links


@pytest.mark.parametrize("seed,likeness", [(1, 50), (2, 30), (3, 80), (4, 57)])
def test_candidates_equal_a_greedy_matching_over_all_pairs(spark, seed, likeness):
    rows, links = random_graph(seed)
    want = slow(rows, links, likeness)
    assert want and fast(spark, rows, links, likeness) == want


def test_copies_are_one_class_and_pair_one_to_one(spark):
    old = [node(f"o{i}", name="readConfig", path="src/old.py", scope=A) for i in range(300)]
    new = [node(f"w{i}", name="readConfig", path="src/new.py", scope=B) for i in range(200)]
    got = fast(spark, old + new, [], 50)
    assert len(got) == 200 == len({g[0] for g in got}) == len({g[1] for g in got})
    assert {g[4] for g in got} == {200} and got == slow(old + new, [], 50)
    members, described = R.classes(stage(R.tokens(
        R.one_sided(nodes(spark, old + new), "a", "b"), nodes(spark, old + new),
        relations(spark, []), "a", "b"), "t"))
    pairs = R.class_pairs(described).collect()
    assert [(p.removed_n, p.added_n) for p in pairs] == [(300, 200)]


def test_a_hub_is_found_by_its_callers(spark):
    """A renamed and moved function keeps its callers; nothing else tells that it is the same."""
    rows = [node("old", name="alpha", path="a.py", scope=A), node("new", name="beta", path="z.py", scope=B),
            node("other", name="alphaTwo", path="q.py", scope=B)]
    links = []
    for i in range(50):
        rows += [node(f"c{i}", scope=A), node(f"c{i}", scope=B)]
        links += [(*A, *rel(f"r{i}", f"c{i}", "old")[2:]), (*B, *rel(f"s{i}", f"c{i}", "new")[2:])]
    got = fast(spark, rows, links, 50)
    assert [g[:2] for g in got] == [("old", "new")] and got[0][3] == 50


def test_nothing_to_match(spark):
    assert fast(spark, [], [], 50) == []
    assert fast(spark, [node("x", scope=A), node("y", name="other", scope=B)], [], 50) == []
    bare = (*A, "k", "function", *[None] * 8), (*B, "l", "function", *[None] * 8)
    assert fast(spark, [*bare, (*A, None, "function", *[None] * 8), (*B, "z", *[None] * 9)], [], 50) == []


def test_only_accepted_candidates_move_notes(spark):
    pair = "project_id string, removed_id string, added_id string"
    candidates = spark.createDataFrame([("p", "o1", "w1"), ("p", "o2", "w2"), ("p", "o3", "w3")], pair)
    accepted = spark.createDataFrame(
        [("p", "o1", "w1"), ("p", "o1", "w1"), ("p", "o2", "w2"), ("p", "o2", "w3"), ("p", "o9", "w9")],
        pair)
    notes = spark.createDataFrame(
        [("p", "n1", "o1", 1), ("p", "n2", "o2", 4), ("p", "n3", "o3", 1), ("p", "n4", None, 2),
         ("q", "n5", "o1", 1)], "project_id string, id string, target_id string, revision bigint")
    moved, refused = R.accept(notes, candidates, accepted)
    assert sorted((r.id, r.target_id or "", r.revision) for r in moved.collect()) == [
        ("n1", "w1", 2), ("n2", "o2", 4), ("n3", "o3", 1), ("n4", "", 2), ("n5", "o1", 1)]
    assert sorted((r.removed_id, r.added_id, r.reason) for r in refused.collect()) == [
        ("o2", "w2", "contradictory"), ("o2", "w3", "contradictory"), ("o9", "w9", "not a candidate")]
