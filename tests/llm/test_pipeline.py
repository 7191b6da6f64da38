"""The corpus pipeline, stage by stage, and the registered queries of the text operators."""

import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from weftgraph.compare import compare_frames, duck_connection
from weftgraph.llm import near_copies, packing, quality_classifier, queries, toxicity
from weftgraph.staging import stage, table

from .test_near_copies import slow_classes

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_are_the_four_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash", "packing"]


@needs_tables
def test_each_stage_does_what_its_operator_says(spark):
    docs = table(spark, SF, "documents")
    marks = table(spark, SF, "labels")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    left = stage(pipeline.drop_toxic(spark, docs, SF), "t1")
    assert left.columns == docs.columns
    assert ids(left) == ids(toxicity.toxicity(docs, marks).where("predicted = 0"))
    good = stage(pipeline.drop_poor(spark, left, SF), "t2")
    assert ids(good) == ids(quality_classifier.quality_scores(left, marks).where("predicted = 1"))
    once = stage(pipeline.drop_near_duplicates(spark, good, SF), "t3")
    assert ids(once) == ids(near_copies.near_copies(good).where("doc_id = component_id"))
    texts = [(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()]
    assert ids(once) == sorted({c for _, c in slow_classes(texts)})
    packed = pipeline.pack(spark, once, SF)
    assert sorted(packed.select("doc_id").distinct().toPandas()["doc_id"]) == ids(once)
    whole = pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(
        map(tuple, packed.select(columns).collect()))


def test_stages_take_odd_and_empty_documents(spark, odd, nothing, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, nothing):
        docs = start
        for name, run in pipeline.STAGES:
            before = docs
            docs = stage(run(spark, docs, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert docs.columns == before.columns and docs.count() <= before.count()
    assert set(docs.columns) >= {"doc_id", "sequence_id", "offset"}
    assert packing.pack(nothing).columns == docs.columns


@needs_tables
@pytest.mark.parametrize("key", sorted(k for k in queries.QUERIES
                                       if not k.startswith(("op11_", "op13_"))))
def test_queries_cover_whole_tables(spark, key):
    source = "pages" if key.startswith("op2_") else "documents"
    found = queries.QUERIES[key](spark, SF)
    name = "page_id" if source == "pages" else "doc_id"
    assert found.select(name).distinct().count() == table(spark, SF, source).count()


@needs_tables
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_statements_give_the_rows_of_queries(spark, key):
    duckdb = pytest.importorskip("duckdb")
    want = duck_connection(duckdb, SF).execute(queries.ORACLES[key]).fetchdf()
    assert len(want) and compare_frames(queries.QUERIES[key](spark, SF).toPandas(), want) == ""
