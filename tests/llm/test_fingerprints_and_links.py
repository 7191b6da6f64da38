"""Homomorphic fingerprints, SimHash classes, and shards by virtual slots."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import fingerprint, sharding, simhash
from weftgraph.llm.components import stars

from .conftest import DOCS, LONG, ODD, rows_of


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"]: (r["d"], r["n"], r["s"])
            for r in fingerprint.fingerprints(rows, ["id"]).collect()}


def test_order_does_not_matter_and_edits_are_incremental(spark):
    one, other, extra = "first line\nsecond one\n\nthird", "third\n\nfirst line\nsecond one", "new bit"
    got = prints(spark, [one, other, one + "\n" + extra, extra, one + "\n" + one, ""])
    assert got[0] == got[1] and len({str(v) for v in got.values()}) == 5
    vectors = fingerprint.paragraph_vectors(
        spark.createDataFrame([(0, one, 1), (0, extra, 1)], "id long, text string, sign int"),
        ["id", "sign"])
    added = fingerprint.combine(vectors, ["id"], F.col("sign")).first()
    assert (added["d"], added["n"], added["s"]) == got[2]
    vectors = fingerprint.paragraph_vectors(
        spark.createDataFrame([(0, one + "\n" + extra, 1), (0, extra, -1)],
                              "id long, text string, sign int"), ["id", "sign"])
    taken = fingerprint.combine(vectors, ["id"], F.col("sign")).first()
    assert (taken["d"], taken["n"], taken["s"]) == got[0]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or "")))


def test_edited_texts_and_likeness(odd, nothing):
    found = fingerprint.edits(odd).collect()
    rows = ordered(ODD)
    want = Counter()
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        want[(str(i), len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[7]["fingerprint"] == by_id[8]["fingerprint"] and by_id[7]["near_next"] == 1.0
    assert by_id[5]["near_edited"] > 0.6
    texts = {i: t or "" for i, t in ODD}
    assert len({by_id[i]["fingerprint"] for i in texts if i is not None}) == len(
        {"\n".join(sorted(t.split("\n"))) for i, t in texts.items() if i is not None})
    assert fingerprint.edits(nothing).count() == 0


def test_a_single_document_follows_itself(spark):
    row = fingerprint.edits(spark.createDataFrame(rows_of([(4, "abcdefgh")]), DOCS)).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert row["near_next"] == 1.0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(points, radius=2):
    label = list(range(len(points)))
    for _ in points:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(points))]
        if new == label:
            return label
        label = new
    return label


def ball_and_noise(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    parts = [base]
    for start in (base[:100], np.full(250, base[5])):
        near = start.copy()
        for _ in range(3):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        parts.append(near)
    return np.unique(np.concatenate([*parts, np.zeros(1, np.uint64), ~np.zeros(1, np.uint64)]))


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_fingerprints_equal_brute_force():
    for _, text in ODD[:5] + ODD[7:]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(LONG[:6000]) == slow_fingerprint(LONG[:6000])


def test_tree_and_shards_lose_no_link():
    points = ball_and_noise()
    want = slow_classes(points)
    assert same_partition(simhash.link(points, len(points)).tolist(), want)
    tree = simhash.grow(points, 12)
    label = list(range(len(points)))
    for _, home, guest in simhash.deal(tree, points):
        index = np.concatenate([home, guest])
        for i, r in enumerate(simhash.link(points[index], len(home)).tolist()):
            a, b = label[index[i]], label[index[r]]
            label = [min(a, b) if x in (a, b) else x for x in label]
    assert same_partition(label, want)


def test_large_blocks_are_split_by_vantage_points(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    points = ball_and_noise(7)
    assert same_partition(simhash.link(points, len(points)).tolist(), slow_classes(points))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    path = list(range(200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    got = {r["u"]: r["v"] for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_classes_of_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    points = np.array([slow_fingerprint(t) if i != 5 else simhash.fingerprint(t) for i, t in ODD],
                      np.uint64)
    label = slow_classes(points)
    least = {}
    for (i, _), c in zip(ODD, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((str(i), f"{int(p):016x}", str(least.get(c)))
                   for (i, _), p, c in zip(ODD, points, label))
    assert Counter((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_class_stays(odd, nothing):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    classes = simhash.near_duplicates(odd).select("component_id").distinct().count()
    rows = kept.collect()
    assert len(rows) == classes
    assert sum(r["doc_id"] == 8 for r in rows) == 0  # 7 has the same text
    assert simhash.keep_first(nothing).count() == 0


def test_small_shards_give_the_same_classes(spark):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)]
    texts += [t + " tail" for t in texts[:40]] + texts[:20]
    docs = spark.createDataFrame(rows_of(list(enumerate(texts))), DOCS)
    big = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    small = {r["doc_id"]: r["component_id"]
             for r in simhash.near_duplicates(docs, shard_size=12).collect()}
    points = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    assert big == small and same_partition([big[i] for i in range(len(texts))], slow_classes(points))


def check_places(rows):
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(
            range(sum(r["shard"] == shard for r in rows)))


def test_shards_of_odd_rows(odd, nothing):
    rows = sharding.assign(odd).collect()
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == Counter(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert all(0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    check_places(rows)
    assert sharding.assign(nothing).count() == 0


def test_shards_level_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 1)  # many cells
    rng = random.Random(1)
    docs = spark.createDataFrame(
        rows_of([(i, "x" * rng.randrange(2000)) for i in range(3000)]), DOCS)
    rows = sharding.assign(docs, slots=256).collect()
    check_places(rows)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.002 * sum(load.values()) / 8


def test_map_versions_list_edits_only(spark):
    owner = sharding.first_map(32, 4)
    weights = [1] * 24 + [50] * 8
    edits = sharding.rebalance(weights, owner, 4)
    now = [edits.get(s, n) for s, n in enumerate(owner)]
    load = [sum(w for w, n in zip(weights, now) if n == k) for k in range(4)]
    assert edits and max(load) - min(load) <= 1
    grown = sharding.grow(now, weights, 4)
    assert set(grown.values()) <= {4}  # a new shard only takes slots into itself
    table = sharding.map_versions(spark, [dict(enumerate(owner)), edits, {}])
    assert table.where("version = 1").count() == len(edits)
    at = lambda v: [r["shard"] for r in sharding.current(table, v).orderBy("virtual_slot").collect()]
    assert at(0) == owner and at(1) == at(2) == now
