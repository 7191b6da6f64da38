"""Ranked lexical search: the best documents of each item by weighted, length-damped term counts.

An index block is one row for up to BLOCK_DOCS documents: a dictionary of its terms, the postings of
each term (document numbers and counts) and the documents' ids and lengths, packed and compressed.
Blocks know nothing of the items; the document frequencies of the terms that items ask for are sums
over the blocks' dictionaries, joined to the terms of the items.

Presence-mask grouping: for an item and a block, a bitmap operation per term sets that term's bit in
the mask of each document that holds it.  Documents of one mask form a group.  No member can score
more than the sum, over the mask's terms, of weight times the term's largest damped count in the
block.  Groups are evaluated by descending bound until the next bound is below the K-th best score
known; a task keeps the best K of each item over all of its blocks, so later blocks start with that
threshold.  Equal bounds go on, since ties are settled by id.  Nothing is cut without that proof.

The items are cut into parts of PART_ITEMS, so a task holds one part at a time however many items
there are; every block meets every part (a stated query set against all rows), dealt by part and cell
so that no part's work lies in one task.  A task reports at most K documents an item, and the last
cut runs twice, first per item and a share of the reports.

Defined results: a null text has no terms and is not counted in N; an item without terms has no
rows; rows of one item id (null is an id) are one item with the terms of all of them; a null doc_id
comes last among equal scores; repeated rows are separate documents; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.staging import release

from .common import bounded, stage, texts
from .packs import squeeze, unsqueeze

K = 50
BLOCK_DOCS, BLOCK_BYTES = 4096, 12 << 20
#: Items and bytes of terms of a part, which a task holds at a time; index blocks of a cell.
PART_ITEMS, PART_BYTES, CELL_BLOCKS = 512, 1 << 20, 16
#: Documents a group step evaluates at least; the step doubles while bounds allow.
STEP = 64
SHARES = 32
SCALE = 1_000_000_000
#: Bytes that separate terms become spaces, A-Z become a-z, bytes over 0x7F stay as they are.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
INDEX = "docs long, terms long, dictionary array<string>, counts array<int>, postings binary"
NULL_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters and digits (ASCII) and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class Block:
    """Postings of some documents under construction."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc: int | None, text: str | None) -> None:
        words = terms(text)
        if not words:
            return
        count, number = Counter(words), self.number
        self.found.append(np.fromiter((number.setdefault(w, len(number)) for w in count),
                                      np.int64, len(count)))
        self.counts.append(np.fromiter(count.values(), np.int64, len(count)))
        self.ids.append(doc)
        self.lengths.append(len(words))
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def row(self) -> dict:
        """The block as a row of INDEX; postings stand by term, then by document."""
        term = np.concatenate(self.found)
        doc = np.repeat(np.arange(len(self.ids)), [len(f) for f in self.found])
        order = np.argsort(term, kind="stable")
        ids = np.array([NULL_ID if i is None else i for i in self.ids], "<i8")
        known = np.array([i is not None for i in self.ids], np.uint8)
        return {"docs": len(self.ids), "terms": sum(self.lengths),
                "dictionary": [w.decode("utf-8", "surrogatepass") for w in self.number],
                "counts": np.bincount(term, minlength=len(self.number)),
                "postings": squeeze(ids, known, np.array(self.lengths, "<i8"),
                                    doc[order].astype("<u2"),
                                    np.concatenate(self.counts)[order].astype("<u4"))}


def index(docs: DataFrame) -> DataFrame:
    """Index blocks of all documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block.row()], schema=kind)

        kind = pa.schema([("docs", pa.int64()), ("terms", pa.int64()),
                          ("dictionary", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())),
                          ("postings", pa.binary())])
        block = Block()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                block.add(doc, text)
                if block.full():
                    yield out(block)
                    block = Block()
        if block.ids:
            yield out(block)

    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return items.select(F.col("item_id").cast("long"), F.explode(found).alias("term")).where(
        "term != ''").distinct()


def weights(wanted: DataFrame, blocks: DataFrame, docs: int) -> DataFrame:
    """item_id, term, w of the terms that some of the ``docs`` documents with a term holds."""
    counts = blocks.select(F.explode(F.arrays_zip("dictionary", "counts")).alias("t")).select(
        F.col("t.dictionary").alias("term"), F.col("t.counts").alias("c"))
    held = counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.sum("c").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return wanted.join(held.select("term", weight.alias("w")), "term")


def item_parts(weighted: DataFrame, items: int = PART_ITEMS, size: int = PART_BYTES) -> tuple:
    """(table of part and items, number of parts): a row holds about ``items`` items whose terms
    take about ``size`` bytes; a single part holds no more than that."""
    each = stage(weighted.groupBy("item_id").agg(
        F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")), "lexical-items")
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)
    whole = each.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()
    parts = max(-(-whole["n"] // items), -(-whole["b"] // size), 1)
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")
    return each.groupBy(part.alias("part")).agg(
        F.collect_list(F.struct("item_id", "terms", "weights")).alias("items")), parts


class Best:
    """The K best (score, id, known, item) of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint8)

    def least(self) -> int:
        """Least score that may still enter."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        keep = score >= self.least()
        score = np.concatenate([self.score, score[keep]])
        ids = np.concatenate([self.id, ids[keep]])
        known = np.concatenate([self.known, known[keep]])
        order = np.lexsort((ids, 1 - known, -score))[:self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]


class Postings:
    """An index block opened for search."""

    def __init__(self, dictionary: list[str], counts: np.ndarray, postings: bytes,
                 total_docs: int, total_terms: int):
        self.number = {w: i for i, w in enumerate(dictionary)}
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids, known, lengths, doc, tf = unsqueeze(postings)
        self.ids, self.known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8)
        length = np.frombuffer(lengths, "<i8")
        damp = 20 * (50 + (50 * length * total_docs) // total_terms)
        self.doc = np.frombuffer(doc, "<u2").astype(np.int64)
        tf = np.frombuffer(tf, "<u4").astype(np.int64)
        #: Damped count of every posting.
        self.gain = (SCALE * tf) // (1000 * tf + damp[self.doc])

    def search(self, words: list[str], weight: list[int], best: Best) -> None:
        """Adds to ``best`` what this block has for an item."""
        held = sorted((i, w) for i, w in ((self.number.get(t), w) for t, w in zip(words, weight))
                      if i is not None and w > 0)
        if not held:
            return
        lists = [slice(self.ends[i], self.ends[i + 1]) for i, _ in held]
        bound = np.array([w * int(self.gain[s].max()) for (_, w), s in zip(held, lists)], np.int64)
        if int(bound.sum()) < best.least():
            return
        masks = np.zeros((-(-len(held) // 64), len(self.ids)), np.uint64)
        for j, s in enumerate(lists):
            masks[j >> 6, self.doc[s]] |= np.uint64(1 << (j & 63))
        some = np.flatnonzero(masks.any(0))
        distinct, group = np.unique(masks[:, some], axis=1, return_inverse=True) \
            if len(masks) > 1 else np.unique(masks[0, some], return_inverse=True)
        distinct, group = distinct.reshape(len(masks), -1), group.ravel()
        most = np.zeros(distinct.shape[1], np.int64)
        for j, b in enumerate(bound):
            most += b * ((distinct[j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        order = np.argsort(-most, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        members = some[np.argsort(place[group], kind="stable")]
        until = np.cumsum(np.bincount(group, minlength=len(order))[order])
        at, step = 0, STEP
        while at < len(order) and most[order[at]] >= best.least():
            allowed = int(np.searchsorted(-most[order], -best.least(), "right"))
            first = int(until[at - 1]) if at else 0
            end = min(max(int(np.searchsorted(until, first + step, "left")) + 1, at + 1), allowed)
            docs = np.sort(members[first:int(until[end - 1])])
            score = np.zeros(len(docs), np.int64)
            for j, ((_, w), s) in enumerate(zip(held, lists)):
                has = np.flatnonzero(masks[j >> 6, docs] >> np.uint64(j & 63) & np.uint64(1))
                score[has] += w * self.gain[s][np.searchsorted(self.doc[s], docs[has])]
            best.add(score, self.ids[docs], self.known[docs])
            at, step = end, 2 * step


def reports(met: DataFrame, docs: int, length: int, k: int = K) -> DataFrame:
    """item_id, doc_id, score: the best ``k`` documents of each item that each task has seen, for
    index blocks that have ``met`` parts (``meet``) of a corpus of ``docs`` and ``length`` terms."""
    def rows(items: dict) -> Iterator[pa.RecordBatch]:
        some = [(i, top) for i, (_, _, top) in items.items() if len(top.score)]
        if some:
            known = np.concatenate([t.known for _, t in some]).astype(bool)
            yield pa.RecordBatch.from_pydict({
                "item_id": pa.array(chain.from_iterable([i] * len(t.id) for i, t in some),
                                    pa.int64()),
                "doc_id": pa.array(np.concatenate([t.id for _, t in some]), pa.int64(),
                                   mask=~known),
                "score": pa.array(np.concatenate([t.score for _, t in some]), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("part")[row].as_py() != part:
                    yield from rows(items)
                    part = batch.column("part")[row].as_py()
                    items = {i["item_id"]: (i["terms"], i["weights"], Best(k))
                             for i in batch.column("items")[row].as_py()}
                block = Postings(batch.column("dictionary")[row].values.to_pylist(),
                                 batch.column("counts")[row].values.to_numpy(),
                                 batch.column("postings")[row].as_py(), docs, length)
                for words, weight, top in items.values():
                    block.search(words, weight, top)
        yield from rows(items)

    bounded(met.sparkSession)
    return met.select("part", "items", "dictionary", "counts", "postings").mapInArrow(
        run, "item_id long, doc_id long, score long")


def meet(blocks: DataFrame, parts: DataFrame, number: int, cells: int) -> DataFrame:
    """Every block with every one of ``number`` parts, each task's rows part by part.

    A single part is bounded by PART_ITEMS and PART_BYTES, so it is broadcast.  Of several, a copy
    goes to each of ``cells``, and a block lies in one cell: that grows with the blocks, so it is
    shuffled.
    """
    if number == 1:
        return blocks.withColumn("part", F.lit(0)).join(F.broadcast(parts), "part")
    cell = F.pmod(F.xxhash64("postings"), F.lit(cells)).cast("int").alias("cell")
    dealt = blocks.select("*", cell, F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("part"))
    copies = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return dealt.join(copies.hint("merge"), ["part", "cell"]).sortWithinPartitions("part")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    blocks = stage(index(docs), "lexical-index")
    size = blocks.agg(F.count("*").alias("blocks"), *(
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms"))).first()
    parts, number = item_parts(weights(item_terms(items), blocks, size["docs"]))
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(-(-size["blocks"] // CELL_BLOCKS), min(size["blocks"], tasks), 1)
    met = meet(blocks, stage(parts, "lexical-parts"), number, cells)
    seen = stage(reports(met, size["docs"], size["terms"], k), "lexical-found")
    release(blocks)
    return top(seen, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k).select(
        "item_id", "rank", "doc_id", "score")


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank, cut per share of the rows first, so that no
    task sees all rows of a key."""
    share = rows.withColumn("__share", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)))
    some = Window.partitionBy(*keys, "__share").orderBy(*order)
    every = Window.partitionBy(*keys).orderBy(*order)
    cut = share.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k).drop(
        "__share")
