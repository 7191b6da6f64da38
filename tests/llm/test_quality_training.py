"""The quality model learns from all labelled rows, in cells."""

import zlib

import numpy as np

from weftgraph.llm import quality_classifier as quality

from .conftest import DOCS, rows_of


def made(spark, n):
    docs = [(i, " ".join(["word"] * (i % 97 + 1)) if i % 5 else "#| 7 |" * (i % 31 + 1)) for i in range(n)]
    marks = [(i, int(i % 5 > 0), 0) for i, _ in docs]
    return (docs, spark.createDataFrame(rows_of(docs), DOCS).repartition(3),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_statistics_and_cut_come_from_all_labelled_rows(spark):
    docs, frame, marks = made(spark, 9000)
    model = quality.train(quality.measured(frame), marks)
    learned = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([quality.features(t) for _, t in learned])
    assert np.allclose(model.mean, x.mean(0), atol=1e-8)
    raw = np.sort(model.raw(x))
    bad = sum(i % 5 == 0 for i, _ in learned)
    assert model.cut == (raw[bad - 1] + raw[bad]) / 2
    whole = quality.fit(x, np.array([int(i % 5 > 0) for i, _ in learned]), (bad, len(x) - bad))
    assert abs((whole.raw(x) < whole.cut).mean() - (model.raw(x) < model.cut).mean()) < 0.01
    found = quality.quality_scores(frame, marks).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 > 0) for r in found)


def test_every_row_is_in_a_cell_and_every_cell_has_both_classes(spark, monkeypatch):
    monkeypatch.setattr(quality, "CELL", 100)
    rows = spark.range(5000).selectExpr("id AS doc_id", "int(id >= 5) AS label", "array(1.0D) AS x")
    got = quality.dealt(rows, (5, 4995)).select("doc_id", "label", "cell").collect()
    assert {r["doc_id"] for r in got} == set(range(5000))
    assert len([r for r in got if r["label"] == 1]) == 4995
    assert {r["cell"] for r in got if r["label"] == 0} == {r["cell"] for r in got} == set(range(50))


def test_order_statistics_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 10)
    monkeypatch.setattr(quality, "BINS", 7)
    values = np.concatenate([np.repeat(2.5, 300), np.random.default_rng(3).normal(size=500)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [0, 1, 399, 400, 600, 799]
    assert quality.order_statistics(frame, ranks) == [float(np.sort(values)[r]) for r in ranks]


def test_newton_reaches_the_least_loss():
    rng = np.random.default_rng(5)
    d = rng.normal(size=(500, 4)) + [2.0, 0.5, 0.0, -3.0]
    w = quality.newton(lambda at: quality.sums(d, at), 4)
    slope = quality.sums(d, w)[2:6] / len(d) + 1e-3 * w
    assert np.abs(slope).max() < 1e-5
