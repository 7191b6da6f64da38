"""Near copies of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline as pipeline
from weftgraph.llm import near_copies, simhash

from .conftest import DOCS, ODD, rows_of


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_classes(rows):
    """Least id of the class of each id (ids are unique)."""
    sets = [slow_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * any_:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in label}
    return sorted((rows[i][0], least[x]) for i, x in enumerate(label))


def edited(rng, words, changes):
    """A copy with ``changes`` words replaced, ten words apart at least."""
    out = list(words)
    for place in rng.sample(range(0, len(words) // 10), changes):
        out[place * 10 + 5] = f"new{rng.randrange(10 ** 9)}"
    return out


def made(seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(220)]
        rows += [words, *(edited(rng, words, k) for k in (1, 2, 3, 4, 6, 9))]
    rows += [edited(rng, rows[0], 4) for _ in range(60)]  # a large group, not all of them alike
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_stage_drops_copies_of_likeness_four_fifths(spark):
    rows = made()
    docs = spark.createDataFrame(rows_of(rows), DOCS)
    want = slow_classes(rows)
    assert sorted(map(tuple, near_copies.near_copies(docs).collect())) == want
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted({c for _, c in want})
    assert len(ids) < simhash.keep_first(docs).count()


def test_odd_rows(spark, odd, nothing):
    kept = near_copies.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 5, 7, None} <= set(ids)
    assert not {1, 2, 8} & set(ids)  # no words like 0; a copy of 7
    assert near_copies.keep_first(nothing).count() == 0
    assert near_copies.near_copies(odd).count() == len(ODD)


def test_no_link_is_lost_beside_a_shared_passage(spark):
    """Texts that share a passage (likeness 0.73), planted pairs of 0.82 to 0.85 among them, and a
    group of copies whose edits add up."""
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(170)]

    def own(n):
        return [f"o{rng.randrange(10 ** 9)}" for _ in range(n)]

    rows = [passage + own(31) for _ in range(2000)]
    for k in range(20):
        one = passage + own(60)
        rows += [one, one[:180] + own(15 + 3 * (k % 2)) + one[195 + 3 * (k % 2):]]
    rows.append(own(230))
    rows += [edited(rng, rows[-1], 3) for _ in range(300)]
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = dict(map(tuple, near_copies.near_copies(
        spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()))
    assert all(got[i] == i for i in range(2000))
    assert all(got[2001 + 2 * k] == got[2000 + 2 * k] == 2000 + 2 * k for k in range(20))
    assert dict(slow_classes(texts[2040:])) == {i: got[i] for i in range(2040, len(texts))}


def test_rounds_of_few_edges_take_few_tasks_and_leave_one_table(spark):
    """Each task of a shuffle leaves files; on check_h they passed the disk before the data did."""
    from pathlib import Path

    from weftgraph.llm import components as C
    from weftgraph.staging import stage_root

    wide = spark.range(40).repartition(64)
    assert C.few_tasks(wide, 40).rdd.getNumPartitions() == 1
    assert C.few_tasks(wide, 3 * C.TASK_ROWS).rdd.getNumPartitions() == 3
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found = {(r["u"], r["v"]) for r in C.stars(chain, "chain").collect()}
    assert found == {(i, 0) for i in range(1, 41)}
    root = Path("/" + stage_root(spark).split(":", 1)[-1].lstrip("/"))
    assert len(list(root.glob("chain-*"))) == 1
