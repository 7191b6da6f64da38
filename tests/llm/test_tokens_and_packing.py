"""Byte-pair ids through distinct words, and best-fit packing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import bpe, packing
from weftgraph.llm.tokens import opened, paths

from .conftest import ODD


@pytest.fixture(scope="module")
def exact():
    return opened(paths()).exact


def plain_ids(exact, text):
    return exact.encode(text or "", add_special_tokens=False).ids


def test_ids_and_decoded_texts_equal_the_library(odd, nothing, exact):
    for block in (1, 10_000, bpe.BLOCK_CHARS):
        got = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["decoded"])
                     for r in bpe.encode_decode(odd, block_chars=block).collect())
        want = []
        for i, text in ODD:
            ids = plain_ids(exact, text)
            want.append((str(i), len(ids), np.array(ids, "<u4").tobytes(),
                         exact.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want)
    assert bpe.encode_decode(nothing).count() == 0


def test_words_cut_where_no_merge_crosses(exact):
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n\t'sé1. 　\x1c<") for _ in range(rng.randrange(25)))
        cut = bpe.words(text)
        assert "".join(map(bpe.spelled, cut)) == text
        assert [i for w in cut for i in plain_ids(exact, bpe.spelled(w))] == plain_ids(exact, text)


def test_quick_path_equals_the_library(exact):
    for text in ("don't I'LL it's", "naïve été", "a  b\r\n\tc", "x" * 5000, "漢字 ²③", "a<|endoftext|>"):
        assert opened(paths()).ids(text) == plain_ids(exact, text)


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        rooms.append((min(fits) if fits else capacity) - n)
        if fits:
            rooms.remove(min(fits))
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(80))]
        plan = packing.best_fit(Counter(lengths), capacity)
        filled = {}
        for n, count in Counter(lengths).items():
            for s, at in zip(*plan.place(np.full(count, n), np.arange(count))):
                filled.setdefault(int(s), []).append((int(at), n))
        for parts in filled.values():
            parts.sort()
            assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts[:-1])]))
        assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == \
            slow_best_fit(lengths, capacity)
        assert set(filled) == set(range(plan.sequences))


def test_tightest_room_is_found_by_the_tree():
    rooms = packing.Rooms(30)
    for r in (4, 9, 30):
        rooms.add(r, 1)
    assert [rooms.tightest(n) for n in (1, 4, 5, 9, 10, 30)] == [4, 4, 9, 9, 30, 30]
    rooms.add(30, -1)
    assert rooms.tightest(10) is None


def test_pieces_and_places(odd, nothing, exact):
    capacity = 64
    rows = packing.pack(odd, capacity=capacity).collect()
    want = Counter()
    for i, text in ODD:
        ids = np.array([*plain_ids(exact, text), 0], "<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), capacity)):
            want[(str(i), k, a, n, zlib.crc32(ids[a:a + n].tobytes()))] += 1
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in rows) == want
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts[:-1])]))
        assert sum(n for _, n in parts) <= capacity
    assert len(filled) == len(slow_best_fit([r["length"] for r in rows], capacity))
    assert packing.pack(nothing).count() == 0


def test_cuts():
    assert packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(2049) == [(0, 1), (1, 2048)]
    assert packing.cuts(4096) == [(0, 2048), (2048, 2048)]


def test_digest_of_the_query(spark, exact):
    from weftgraph.llm import queries

    row = queries.QUERIES["op6_bpe"](spark, "/root/testdata/sf0.001").where("doc_id = 7").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(
        "doc_id = 7").first()["text"]
    ids = np.array(plain_ids(exact, text), "<u4").tobytes()
    assert row["ids_sha256"] == hashlib.sha256(ids).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
