"""Elias-Fano tries and bigram scores."""

import math
import zlib
from collections import Counter

import numpy as np

from weftgraph.llm import lm_scoring as lm
from weftgraph.llm.ngram_trie import EliasFano, Trie, dequantise, quantise

from .conftest import ODD


def test_elias_fano_gives_values_and_successors():
    rng = np.random.default_rng(0)
    for universe in (1, 2, 77, 10**6, 1 << 33):
        for n in (0, 1, 6, 400):
            values = np.sort(rng.integers(0, universe, n))
            opened = EliasFano.opened([p.view(np.uint8) for p in EliasFano.encode(values, universe)])
            assert n == 0 or (opened.get(np.arange(n)) == values).all()
            asked = rng.integers(0, universe, 200)
            assert (opened.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_answers_exactly():
    rng = np.random.default_rng(1)
    universe = 500
    key = np.unique(rng.integers(0, 60, 3000) * 7 * universe + rng.integers(0, universe, 3000))
    context, word, p = key // universe, key % universe, rng.random(len(key))
    weight = rng.random(len(np.unique(context)))
    trie = Trie.mapped(Trie.build(context, word, p, weight, universe))
    asked = np.concatenate([key, rng.integers(0, universe * universe, 3000)])
    place = trie.context(asked // universe)
    known = dict(zip(key.tolist(), quantise(p).tolist()))
    assert trie.successor(place, asked % universe).tolist() == [known.get(k, 0)
                                                               for k in asked.tolist()]
    assert ((place >= 0) == np.isin(asked // universe, context)).all()


def test_codes_keep_probabilities():
    p = np.array([0.0, 1.0, 0.5, 1e-9, 0.123])
    assert np.allclose(dequantise(quantise(p)), p, rtol=0.005)
    assert quantise(p)[0] == 0


def slow_scores(rows):
    toks = [(i, lm.tokens(t)) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words, pairs = Counter(), Counter()
    for (_, x), h in zip(toks, held):
        if not h:
            words.update(x)
            pairs.update(zip([b"", *x], x))
    n, v = sum(words.values()), len(words)
    ones, twos = (sum(c == k for c in words.values()) for k in (1, 2))
    d1 = ones / (ones + 2 * twos) if ones else 0.5
    after = Counter(a for a, _ in pairs)

    def word(w):
        return max(words[w] - d1, 0) / n + d1 * v / n / (v + 1) if n else 1.0

    def pair(a, w):
        if not words[a]:
            return word(w)
        return max(pairs[a, w] - lm.DISCOUNT, 0) / words[a] \
            + lm.DISCOUNT * after[a] / words[a] * word(w)

    return sorted((str(i), h, len(x), sum(words[w] > 0 for w in x), n,
                   sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x),
                   sum(math.log10(pair(a, w)) for a, w in zip([b"", *x], x)))
                  for (i, x), h in zip(toks, held))


def check(found, rows):
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  r["base_score"], r["score"]) for r in found)
    for a, b in zip(got, slow_scores(rows), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-6)
        assert abs(a[6] - b[6]) <= 0.003 * a[2]  # one step of the codes a token


def test_scores_equal_brute_force(odd, nothing):
    check(lm.score(odd).collect(), ODD)
    check(lm.score(odd, block_chars=40).collect(), ODD)  # nearly every text is a block
    assert lm.score(nothing).count() == 0


def test_without_training_texts(spark, odd):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "some words here") for i in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"])
            for r in lm.score(docs).collect()} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one():
    counts = {"a": 4, "b": 2, "c": 1, "d": 1}
    total = lm.Totals(sum(counts.values()), len(counts), 0.5, 4)
    p = total.word(np.array([*counts.values(), 0]))
    assert math.isclose(p.sum(), 1.0)


def test_stored_tries_hold_all_pairs(spark, odd):
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = lm.blocks(odd, shards, 50_000)
    numbered = lm.stage(lm.number_words(table), "test-words")
    total = lm.totals(numbered, shards)
    refs = table.where("refs IS NOT NULL").select("block", "refs")
    stored = [Trie.mapped(bytes(r["trie"])) for r in
              lm.tries(lm.bigrams(refs, numbered, total)).collect()]
    pairs = set()
    for i, t in ODD:
        if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2):
            pairs |= set(zip([b"", *lm.tokens(t)], lm.tokens(t)))
    assert sum(t.successors.n for t in stored) == len(pairs)
