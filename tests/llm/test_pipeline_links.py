"""The pipeline's near-duplicate stage links by SimHash and by exact likeness."""

import random

import corpus_pipeline as pipeline
from weftgraph.llm import near_copies, simhash

from .conftest import DOCS, rows_of


def made():
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    chant = " ".join([words(31)] * 60)
    long = [words(300) for _ in range(4)]
    edited = [t.split() for t in long]
    for t in edited:
        for i in range(0, 300, 60):
            t[i] = "changed"
    return [(0, chant + " " + words(60)), (1, chant + " " + words(60)), (2, None), (3, " \t"),
            *((10 + i, t) for i, t in enumerate(long)),
            *((20 + i, " ".join(t)) for i, t in enumerate(edited)), (30, words(200)), (31, words(2))]


def test_stage_drops_what_simhash_links_and_what_is_alike(spark):
    texts = made()
    bits = lambda a, b: bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1")
    assert bits(texts[0][1], texts[1][1]) <= simhash.RADIUS
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(3)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    alike = ids(near_copies.keep_first(docs))
    assert {0, 1} <= alike and not alike & {20, 21, 22, 23}
    left = pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert ids(left) == alike - {1}
    assert ids(left) <= ids(simhash.keep_first(docs))


def test_links_of_both_kinds_meet_in_one_class(spark):
    texts = made()
    docs = spark.createDataFrame(rows_of([t for t in texts if t[0] in (0, 1, 10)]), DOCS)
    rows = near_copies.keys(docs)
    pairs = near_copies.simhash_links(docs, rows).collect()
    fp = {r["doc_id"]: r["fp"] for r in rows.collect()}
    assert [{r["u"], r["v"]} for r in pairs] == [{fp[0], fp[1]}]
    joined = spark.createDataFrame([(fp[1], fp[10])], "u long, v long").union(
        near_copies.simhash_links(docs, rows))
    found = near_copies.classes(docs, rows, joined).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 3
