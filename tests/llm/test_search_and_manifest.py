"""Exact vector search, the Merkle manifest and ranked lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lexical, merkle, vector_search

from .conftest import DOCS, ODD, rows_of

VECTORS = "vec_id long, embedding array<float>, block long, place int, score long, rank int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1) for i, v in rows], VECTORS).repartition(3)


def slow_search(rows, k, every):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(whole):
        if q is None or q % every:
            continue
        found = [(-sum(s * t for s, t in zip(x, y)), i is None, i) for b, (i, y) in enumerate(whole)
                 if a != b and len(x) == len(y)]
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(
            found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out)


def rows_found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 2, 7, 16])
def test_vector_search_is_exact(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(0, 1) for _ in range(size)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)]  # ties at every rank
    got = vector_search.search(vectors_of(spark, rows), k=5, every=10, group=60, chunk=8)
    assert rows_found(got) == slow_search(rows, 5, 10)


def test_vector_search_takes_odd_rows(spark):
    nan, big = float("nan"), 1e6
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]),
            (4, [float("inf"), 1.0]), (None, [3.0, 3.0]), (5, [3.0, 3.0]), (20, []), (21, []),
            (40, [1.0]), (60, [big, -big]), (61, [big, big]), (80, [-0.01, 0.01])]
    got = [r for r in vector_search.search(vectors_of(spark, rows)).collect()]
    assert sorted(map(tuple, got), key=str) == sorted(slow_search(rows, 20, 20), key=str)
    empty = vectors_of(spark, rows).limit(0)
    assert vector_search.search(empty).count() == 0


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-40, 40, (200, 13)), rng.integers(-40, 40, (1, 13))
    last = np.full(200, np.inf)
    for s in vector_search.resolutions(13):
        bound = vector_search.statistics(x * 1.0, s) @ vector_search.statistics(q * 1.0, s)[0]
        assert (bound + 1e-6 >= x @ q[0]).all()
        last = bound
    assert last.mean() < 1.0 * np.linalg.norm(x, axis=1).mean() * np.linalg.norm(q)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(hashes):
    """Root and the (left, right) siblings of every leaf."""
    paths, at, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(now) > 1:
        for i, j in enumerate(at):
            b = j // 3 * 3
            paths[i].append(("".join(now[b:j]), "".join(now[j + 1:b + 3])))
        at = [j // 3 for j in at]
        now = ["".join(now[i:i + 3]) for i in range(0, len(now), 3)]
        now = [sha(h) for h in now]
    return now[0], paths


def slow_manifest(rows):
    """The rows of ``checked`` for dicts of documents."""
    def leaf(row):
        return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}"
                           for c in merkle.FIELDS))

    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row, leaf(row)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1]))
        trees[name] = slow_tree([h for _, h in groups[name]])
    root, over = slow_tree([trees[n][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for (row, h), path in zip(groups[name], trees[name][1]):
            path, text, i = path + over[k], row["text"], row["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf({**row, "text": text})
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((i, h, trees[name][0], root, sha("".join(a + b for a, b in path)), fold,
                        fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, odd, levels):
    rng = random.Random(levels)
    rows = [(rng.randrange(200), f"line {i}\nline" * (i % 3), "en",
             rng.choice([None, "", "s", "s", "s", "é", "z"]), i) for i in range(130)]
    rows += [rows[0], (None, None, None, None, None), (500, "a\nb", None, "lone", -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long").repartition(4)
    want = slow_manifest([r.asDict() for r in docs.collect()])
    got = merkle.checked(docs, levels=levels)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {v for *_, v in want} == {True, False}
    if levels == 6:
        want = slow_manifest([r.asDict() for r in odd.collect()])
        assert sorted(map(tuple, merkle.checked(odd).collect()), key=str) == want


def test_manifest_of_few_rows(spark, nothing):
    assert merkle.checked(nothing).count() == 0
    one = spark.createDataFrame(rows_of([(3, "a")]), DOCS)
    row = merkle.checked(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == sha("")


def test_ranks_do_not_depend_on_the_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 300).alias("v"), F.lit("g").alias("grp"))
    got = merkle.ranked(rows.repartition(5), [F.col("v")], rows_a_part=90).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert [r["v"] for r in got] == sorted(i % 300 for i in range(1000))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranking(docs, items, k):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(s for _, _, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(slow_terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for i, b, size in bags:
            m = 100 - 50 + (50 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in words if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_lexical_search_equals_brute_force(spark, odd, nothing, monkeypatch):
    rng = random.Random(9)
    words = [f"Wort{i}" for i in range(150)] + ["the", "é漢", "x-y", "a_b"]
    docs = [(i, " ".join(rng.choices(words[:rng.randrange(1, 154)], k=rng.randrange(1, 60))))
            for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(70)]  # ties beyond the last rank
    items = [(i, " ".join(rng.sample(words, rng.choice([1, 5, 30, 120])))) for i in range(12)]
    items += [(12, None), (13, "?!"), (None, "Wort1, wort2"), (3, "also this one"), (14, "the the")]
    table = spark.createDataFrame([(*r, "?") for r in items], "item_id long, text string, term string")
    for block, part in ((4096, 512), (37, 3)):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
        monkeypatch.setattr(lexical.item_parts, "__defaults__", (part, 1 << 20))
        frame = spark.createDataFrame(rows_of(docs), DOCS).repartition(3)
        got = lexical.search(frame, table, k=20)
        assert sorted(map(tuple, got.collect()), key=str) == slow_ranking(docs, items, 20)
    asked = spark.createDataFrame([(0, "the quick END one a w5"), (1, "x 漢字 no")],
                                  "item_id long, text string")
    want = slow_ranking(ODD, [(r[0], r[1]) for r in asked.collect()], 50)
    assert sorted(map(tuple, lexical.search(odd, asked).collect()), key=str) == want
    assert lexical.search(nothing, asked).count() == 0
    assert lexical.search(odd, asked.limit(0)).count() == 0


def test_long_texts_are_searched_whole(spark):
    docs = [(1, "filler " * 200_000 + "needle"), (2, "needle"), (3, "filler")]
    frame = spark.createDataFrame(rows_of(docs), DOCS)
    items = spark.createDataFrame([(7, "needle")], "item_id long, text string")
    assert sorted(map(tuple, lexical.search(frame, items).collect())) == slow_ranking(
        docs, [(7, "needle")], 50)
