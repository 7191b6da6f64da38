"""Quality rules, the pairwise quality classifier and toxic passages."""

import random
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np

from weftgraph.llm import quality_classifier as quality
from weftgraph.llm import quality_rules as rules
from weftgraph.llm import toxicity
from weftgraph.llm.common import calibrate, repeated_words

from .conftest import ODD, rows_of, DOCS

SPACES = " \t\n\x0b\x0c\r"


def slow_words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = ([*out, word] if word else out), ""
        else:
            word += c
    return [*out, word] if word else out


def slow_repeats(words, width=8):
    windows = Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    inside = {j for i in range(len(words) - width + 1) if windows[tuple(words[i:i + width])] > 1
              for j in range(i, i + width)}
    return len(inside)


def test_repeated_words_meet_the_definition():
    rng = random.Random(5)
    for _ in range(150):
        words = [rng.choice("ab").encode() for _ in range(rng.randrange(40))]
        assert repeated_words(words) == slow_repeats(words)


def test_base_statistics_equal_brute_force(odd):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                  r["n_repeat_words"], r["base_failed"]) for r in rules.quality_rules(odd).collect())
    want = []
    for i, text in ODD:
        words, lines = slow_words(text), [x for x in (text or "").split("\n") if slow_words(x)]
        again = slow_repeats(words)
        want.append((str(i), len(words), sum(map(len, words)),
                     sum(c in "#*$%&|<>" for c in text or ""),
                     sum(x in lines[:k] for k, x in enumerate(lines)), again,
                     len(words) < 20 or 100 * again > 30 * len(words)))
    assert got == sorted(want)


def test_verdict_does_not_depend_on_the_order_and_base_failures_go(odd):
    found = rules.quality_rules(odd).collect()
    assert not any(r["kept"] for r in found if r["base_failed"])
    for _, text in ODD:
        one, other = rules.BASE + rules.MORE, (rules.BASE + rules.MORE)[::-1]
        assert (rules.verdict(rules.Text(text), one) is None) == \
            (rules.verdict(rules.Text(text), other) is None)


def test_cascade_puts_cheap_and_rejecting_rules_first():
    found = {"a": (1.0, 0.5), "b": (0.1, 0.1), "c": (0.1, 0.0), "d": (5.0, 0.9)}
    order = rules.plan(found, [rules.Rule(n, bool) for n in found])
    assert [r.name for r in order] == ["b", "a", "d", "c"]
    ticks = accumulate([0, 1] * 100)
    measured = rules.measure(["x", "y " * 50], rules.BASE, clock=lambda: next(ticks))
    assert measured["too_few_words"] == (1.0, 0.5)


def test_kept_rows_carry_all_columns(odd, nothing):
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        r["doc_id"] for r in rules.quality_rules(odd).where("kept").collect())
    assert rules.quality_rules(nothing).count() == 0 and rules.keep_good(nothing).count() == 0


def test_pairwise_model_ranks_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 15))
    label = (x[:, 0] - 2 * x[:, 3] + rng.normal(scale=0.3, size=600) > -1).astype(int)
    counts = int((label[:400] == 0).sum()), int((label[:400] == 1).sum())
    model = quality.fit(x[:400], label[:400], counts)
    raw = model.raw(x[400:])
    good, bad = raw[label[400:] == 1], raw[label[400:] == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert abs((model.raw(x[:400]) < model.cut).mean() - counts[0] / 400) < 0.01


def test_cut_is_a_weighted_quantile():
    values, weights = np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0, 1.0])
    assert quality.quantile(values, weights, 0.5) == 2.5
    assert quality.quantile(values, np.array([1.0, 7.0, 1.0, 1.0]), 0.7) == 1.5


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def test_quality_scores_of_odd_rows(odd, nothing, labels):
    found = quality.quality_scores(odd, labels).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in found) == sorted(
        (str(i), held(i, 3, 1)) for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 8}) == 1
    none = quality.quality_scores(odd, labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def slow_segments(scores):
    """Maximal segments by definition: best segment, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores))
                for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-9:
        return []
    a, b = -best[2], -best[2] - best[1]
    right = [(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]
    return slow_segments(scores[:a]) + [(a, b, best[0])] + right


def test_segments_are_the_maximal_ones():
    rng = random.Random(9)
    for _ in range(300):
        scores = [rng.choice([-0.5, -0.5, -0.5, 0.7, 1.3, 2.1]) for _ in range(rng.randrange(1, 14))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(np.array(at, int), np.array([scores[i] for i in at]), 0.5)
        want = slow_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], scores
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxic_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(400)]

    def text(bad):
        words = [rng.choice(plain) for _ in range(120)]
        if bad:
            for w in ("vile", "rotten", "nasty"):
                words.insert(rng.randrange(50, 60), w)
        return " ".join(words)

    made = [(i, text(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows_of(made), DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in made],
                                  "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, marks).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in found if r["held_out"])
    where = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in
             toxicity.passages(docs, marks).orderBy("score").collect()}
    assert len(where) == 150 and all(45 <= a <= b <= 65 for a, b in where.values())
    left = toxicity.keep_clean(docs, marks)
    assert left.columns == docs.columns and left.count() == 450


def test_every_occurrence_of_a_toxic_word_scores(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(400)], ("vile", "rotten", "nasty")
    some = lambda n: [rng.choice(plain) for _ in range(n)]
    made = [(i, " ".join(some(55) + list(bad if i % 4 == 0 else ()) + some(65))) for i in range(600)]
    # Each word stands alone early on, then two equal passages follow.
    words = some(3000)
    words[100], words[500], words[900] = bad
    words[1500:1506] = words[2500:2506] = bad * 2
    docs = spark.createDataFrame(rows_of([*made, (9000, " ".join(words))]), DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in made],
                                  "doc_id long, quality int, toxic int")
    found = toxicity.passages(docs, marks).where("doc_id = 9000").orderBy("first_word").collect()
    long = [r for r in found if r["last_word"] > r["first_word"]]
    assert [(r["first_word"], r["last_word"]) for r in long] == [(1500, 1505), (2500, 2505)]
    assert abs(long[0]["score"] - long[1]["score"]) < 1e-9
    row = toxicity.toxicity(docs, marks).where("doc_id = 9000").first()
    assert row["n_passages"] == len(found) and row["predicted"] == 1


def test_toxicity_of_odd_rows(odd, nothing, labels):
    found = toxicity.toxicity(odd, labels).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in found) == sorted(
        (str(i), held(i, 4, 2)) for i, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert len({r["score"] for r in toxicity.toxicity(odd, labels.where("false")).collect()}) == 1
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.passages(nothing, labels).count() == 0


def test_nothing_is_rejected_when_nothing_can_be_learned(spark, odd, labels):
    ids = sorted(str(i) for i, _ in ODD)
    few = spark.createDataFrame([(7, 1, 0), (13, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1"), few):
        kept = toxicity.keep_clean(odd, marks)
        assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ids
        found = toxicity.toxicity(odd, marks).collect()
        assert {r["predicted"] for r in found} == {0} and len({r["score"] for r in found}) == 1


def test_calibration_meets_the_class_share():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=2000)
    label = (rng.random(2000) < 1 / (1 + np.exp(-(2 * raw - 1)))).astype(float)
    slope, offset = calibrate(raw, label, np.ones(2000))
    assert abs(slope - 2) < 0.3 and abs(offset + 1) < 0.3
