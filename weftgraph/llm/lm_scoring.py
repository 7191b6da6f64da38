"""Log-probabilities of texts under a bigram model held in Elias-Fano tries.

Tokens are the words of a text with A-Z lowered, then one end; the end also stands before the first
word.  Texts form blocks of bounded size that know their distinct words and bigrams.  Words meet by
hash, where they are numbered and counted over all training texts; bigrams meet by context, where
their training counts add up to a trie (``ngram_trie``) that answers the blocks that asked.  A context
said more often than an average shard has tokens is split over several shards by its successors.

Probabilities interpolate absolute discounting: ``(n(c,w) - D) / n(c) + D N1(c) / n(c) * p(w)`` with
``p(w)`` discounted likewise towards one unknown word beside the V known ones.  The trie stores the
first term and the weight, quantised to 16 bits; the model learns from every text not held out.

Defined results: a null text counts as empty; an empty text is its end alone; without training texts
every probability is 1; repeated rows get equal scores; an empty table gives no rows; a null id is
never held out; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import stage_root

from .common import bounded, held_out, stage, texts
from .ngram_trie import Trie, dequantise
from .packs import planes, squeeze, unplanes, unsqueeze

MODULUS, REMAINDER = 7, 2
#: Absolute discount of bigrams; that of words is estimated from the words said once and twice.
DISCOUNT = 0.75
BLOCK_CHARS = 12_000_000
END = b""
BLOCKS = "block string, shard int, words binary, refs binary"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _block(name: str, ids: list, held: list[bool], rows: list[list[bytes]],
           shards: int) -> Iterator[dict]:
    """One block: distinct words by shard with their training counts, and every text's ranks."""
    count: Counter[bytes] = Counter()
    for row in rows:
        count.update(row)
    order = sorted(count, key=count.get, reverse=True)
    rank = dict(zip(order, range(len(order))))
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    ranks = np.fromiter((r for row in rows for r in map(rank.__getitem__, row)), np.int64,
                        int(size.sum()))
    learn = np.repeat(~np.array(held, bool), size)
    trained = np.bincount(ranks[learn], minlength=len(order))
    shard = np.fromiter((zlib.crc32(w) % shards for w in order), np.int64, len(order))
    yield {"block": name, "shard": None, "words": None, "refs": squeeze(
        np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], bool),
        np.array(held, bool), size.astype("<u4"), planes(ranks), planes(shard))}
    by_shard = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
    for s, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            part = [order[i] for i in by_shard[a:b].tolist()]
            yield {"block": name, "shard": s, "refs": None, "words": squeeze(
                planes(np.fromiter(map(len, part), "<u4", len(part))), b"".join(part),
                planes(trained[by_shard[a:b]]))}


def blocks(docs: DataFrame, shards: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The texts as written blocks, bucketed so that a block stays where it is."""
    spark = docs.sparkSession
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("words", pa.binary()),
                            ("refs", pa.binary())])
        prefix, number = TaskContext.get().partitionId(), 0
        ids, held, rows, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in _block(f"{prefix}-{number}", ids, held, rows, shards):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, aside, text in zip(batch.column("doc_id").to_pylist(),
                                        batch.column("held_out").to_pylist(), texts(batch)):
                ids.append(doc)
                held.append(aside)
                rows.append(tokens(text))
                size += len(text or "") + 1
                if size >= block_chars:
                    yield from out()
                    ids, held, rows, size, number = [], [], [], 0, number + 1
        if ids:
            yield from out()

    name = f"lm_blocks_{uuid.uuid4().hex}"
    (docs.select(F.col("doc_id").cast("long"), held_out(MODULUS, REMAINDER).alias("held_out"), "text")
     .mapInArrow(run, BLOCKS).write.bucketBy(shards, "block")
     .option("path", f"{stage_root(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


NUMBERED = ("block string, shard int, ids binary, tokens bigint, types bigint, ones bigint, "
            "twos bigint")


def number_words(table: DataFrame) -> DataFrame:
    """Each block's words with their place in the shard and their training count everywhere.

    A row without a block carries the shard's totals.
    """
    schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("ids", pa.binary()),
                        *((c, pa.int64()) for c in ("tokens", "types", "ones", "twos"))])

    def run(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        found, counts = [], []
        for value in rows.column("words").to_pylist():
            sizes, joined, count = unsqueeze(value)
            ends = np.cumsum(unplanes(sizes)).tolist()
            found.append(np.fromiter(
                (place.setdefault(joined[a:b], len(place)) for a, b in zip([0, *ends], ends)),
                np.int64, len(ends)))
            counts.append(unplanes(count))
        total = np.bincount(np.concatenate(found), weights=np.concatenate(counts),
                            minlength=len(place)).astype(np.int64)
        shard, none = rows.column("shard").to_pylist(), [None] * len(found)
        return pa.table({
            "block": [*rows.column("block").to_pylist(), None], "shard": [*shard, shard[0]],
            "ids": [*(squeeze(planes(f, "<u8"), planes(total[f], "<u8")) for f in found), None],
            "tokens": [*none, int(total.sum())], "types": [*none, int((total > 0).sum())],
            "ones": [*none, int((total == 1).sum())], "twos": [*none, int((total == 2).sum())],
        }, schema=schema)

    return table.where("words IS NOT NULL").select("block", "shard", "words").groupBy(
        "shard").applyInArrow(run, NUMBERED)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct words, the discount of words, and the number of shards."""

    tokens: int
    types: int
    discount: float
    shards: int

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by their training count."""
        if not self.tokens:
            return np.ones(len(count))
        spare = self.discount * self.types / self.tokens / (self.types + 1)
        return np.maximum(count - self.discount, 0) / self.tokens + spare


def totals(numbered: DataFrame, shards: int) -> Totals:
    row = numbered.where("block IS NULL").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "ones", "twos"))
    ).first()
    ones, twos = row["ones"], row["twos"]
    return Totals(row["tokens"], row["types"], ones / (ones + 2 * twos) if ones else 0.5, shards)


class Block:
    """A block with its words' numbers: distinct bigrams in the order in which shards see them."""

    def __init__(self, refs: bytes, ids: list[tuple[int, bytes]], total: Totals):
        doc, known, held, size, ranks, shard = unsqueeze(refs)
        self.doc, self.known = np.frombuffer(doc, "<i8"), np.frombuffer(known, bool)
        self.held, self.size = np.frombuffer(held, bool), np.frombuffer(size, "<u4").astype(np.int64)
        self.ranks, shard = unplanes(ranks).astype(np.int64), unplanes(shard).astype(np.int64)
        parts = [unsqueeze(v) for _, v in sorted(ids)]
        place = np.concatenate([unplanes(p[0], "<u8") for p in parts])
        count = np.concatenate([unplanes(p[1], "<u8") for p in parts])
        by_shard = np.argsort(shard, kind="stable")
        self.count = np.empty(len(shard), np.int64)
        self.word = np.empty(len(shard), np.int64)
        self.count[by_shard] = count
        self.word[by_shard] = place.astype(np.int64) * total.shards + shard[by_shard]
        # The end closes every text; it also stands before the first word.
        start = np.cumsum(self.size) - self.size
        before = np.empty_like(self.ranks)
        before[1:] = self.ranks[:-1]
        before[start] = self.ranks[start + self.size - 1]
        self.start = start
        n = np.int64(len(shard))
        key, self.of_token = np.unique(before * n + self.ranks, return_inverse=True)
        self.context, self.follower = key // n, key % n
        # A context with more tokens than an average shard is split by its successors.
        share = -(-self.count * total.shards // max(total.tokens, 1))
        parts_of = np.clip(share, 1, total.shards)[self.context]
        mixed = (self.word[self.follower].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 >> np.uint64(33)).astype(np.int64)
        home = (self.word[self.context].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
                >> np.uint64(33)).astype(np.int64)
        self.shard = (home + mixed % parts_of) % total.shards
        self.order = np.lexsort((self.word[self.follower], self.word[self.context], self.shard))

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its bigrams in order, where each context begins among them)."""
        shard = self.shard[self.order]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = self.order[a:b]
            context = self.context[own]
            yield int(shard[a]), own, np.flatnonzero(
                np.concatenate([[True], context[1:] != context[:-1]]))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """Per shard: contexts, their counts and numbers of successors; successors and how often
        the block's training texts have them."""
        learn = np.repeat(~self.held, self.size)
        seen = np.bincount(self.of_token[learn], minlength=len(self.context))
        for shard, own, begin in self.asked():
            context = self.context[own[begin]]
            yield shard, squeeze(
                planes(self.word[context], "<u8"), planes(self.count[context], "<u8"),
                planes(np.diff(np.append(begin, len(own)))),
                planes(self.word[self.follower[own]], "<u8"), planes(seen[own]))

    def scores(self, answers: dict[int, bytes], total: Totals) -> pa.Table:
        code = np.zeros(len(self.context), "<u2")
        weight = np.zeros(len(self.word))
        for shard, own, begin in self.asked():
            backoff, codes = unsqueeze(answers[shard])
            code[own] = unplanes(codes, "<u2")
            # A split context has part of its weight in each of its shards.
            np.add.at(weight, self.context[own[begin]], dequantise(unplanes(backoff, "<u2")))
        word = total.word(self.count)
        known = self.count > 0
        p = np.where(known[self.context],
                     dequantise(code) + weight[self.context] * word[self.follower],
                     word[self.follower])
        base = np.log10((self.count + 1) / (total.tokens + total.types + 1))
        add = lambda x: np.add.reduceat(x, self.start)
        n = len(self.doc)
        return pa.table({
            "doc_id": pa.array(self.doc, pa.int64(), mask=~self.known),
            "held_out": pa.array(self.held), "n_tokens": pa.array(self.size),
            "n_known": pa.array(add(known[self.ranks].astype(np.int64))),
            "train_tokens": pa.array(np.full(n, total.tokens, np.int64)),
            "base_score": pa.array(add(base[self.ranks])),
            "score": pa.array(add(np.log10(p)[self.of_token]))})


def _open(refs: pa.Table, found: pa.Table, total: Totals) -> Block:
    ids = [(s, v) for s, v in zip(found.column("shard").to_pylist(),
                                  found.column("ids").to_pylist()) if v is not None]
    return Block(refs.column("refs").to_pylist()[0], ids, total)


def bigrams(refs: DataFrame, numbered: DataFrame, total: Totals) -> DataFrame:
    """Each block's distinct bigrams, as one row per shard that holds some of their contexts."""
    schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("pairs", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_open(left, right, total).questions())
        name = left.column("block").to_pylist()[0]
        return pa.table({"block": [name] * len(rows), "shard": [r[0] for r in rows],
                         "pairs": [r[1] for r in rows]}, schema=schema)

    ids = numbered.where("block IS NOT NULL").select("block", "shard", "ids")
    return refs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        run, "block string, shard int, pairs binary")


def _parsed(values: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    kinds = ("<u8", "<u8", "<u4", "<u8", "<u4")
    return [tuple(unplanes(a, k).astype(np.int64) for a, k in zip(unsqueeze(v), kinds))
            for v in values]


def build_trie(asked: list[tuple[np.ndarray, ...]], discount: float = DISCOUNT) -> bytes:
    """The trie of one shard: counts of all blocks' bigrams, discounted and quantised."""
    context = np.concatenate([np.repeat(a[0], a[2]) for a in asked])
    times = np.concatenate([np.repeat(a[1], a[2]) for a in asked])
    word, n = (np.concatenate([a[i] for a in asked]) for i in (3, 4))
    some = n > 0  # bigrams of held-out texts only ask
    context, times, word, n = (x[some] for x in (context, times, word, n))
    order = np.lexsort((word, context))
    context, times, word, n = (x[order] for x in (context, times, word, n))
    new = np.ones(len(word), bool)
    new[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first) if len(first) else n
    context, times, word = context[first], times[first], word[first]
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) \
        if len(context) else np.zeros(0, np.int64)
    followers = np.diff(np.append(begin, len(context)))
    universe = int(max(word.max(), context.max())) + 1 if len(word) else 1
    return Trie.build(context, word, (n - discount) / np.maximum(times, 1),
                      discount * followers / np.maximum(times[begin], 1), universe)


def tries(pairs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """shard, trie: the model itself, to store or to load elsewhere."""

    def run(rows: pa.Table) -> pa.Table:
        data = build_trie(_parsed(rows.column("pairs").to_pylist()), discount)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
                         "trie": pa.array([data], pa.binary())})

    return pairs.groupBy("shard").applyInArrow(run, "shard int, trie binary")


def answers(pairs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Each shard's trie, memory-mapped, answers the blocks' questions in their order."""

    def run(rows: pa.Table) -> pa.Table:
        asked = _parsed(rows.column("pairs").to_pylist())
        trie = Trie.mapped(build_trie(asked, discount))
        out = []
        for context, _, followers, word, _ in asked:
            inside = context < trie.universe
            at = np.full(len(context), -1, np.int64)
            at[inside] = trie.context(context[inside])
            backoff = np.zeros(len(context), "<u2")
            backoff[at >= 0] = trie.backoff[at[at >= 0]]
            place = np.where(word < trie.universe, np.repeat(at, followers), -1)
            out.append(squeeze(planes(backoff, "<u2"), planes(trie.successor(place, word), "<u2")))
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"),
                         "answer": pa.array(out, pa.binary())})

    return pairs.groupBy("shard").applyInArrow(run, "block string, shard int, answer binary")


def score(docs: DataFrame, block_chars: int = BLOCK_CHARS, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = blocks(docs, shards, block_chars)
    refs = table.where("refs IS NOT NULL").select("block", "refs")
    numbered = stage(number_words(table), "lm-words")
    total = totals(numbered, shards)
    replies = answers(bigrams(refs, numbered, total), discount)
    found = numbered.where("block IS NOT NULL").select(
        "block", "shard", "ids", F.lit(None).cast("binary").alias("answer")).unionByName(
        replies.select("block", "shard", F.lit(None).cast("binary").alias("ids"), "answer"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replied = {s: v for s, v in zip(right.column("shard").to_pylist(),
                                        right.column("answer").to_pylist()) if v is not None}
        return _open(left, right, total).scores(replied, total)

    return refs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
