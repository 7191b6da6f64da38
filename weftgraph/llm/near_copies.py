"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, exactly.

Shingles are put in one order for all texts, rare ones first.  Two sets x, y with |x| >= |y| and
similarity 4/5 share at least 4/5 |x| and 8/9 |y| of their shingles, so the first fifth of x and the first
ninth of y have one in common (prefix filter); shingles found in one text only are never listed.  A
passage that many texts share comes last in all of them, so it brings no two of them together unless
they are nearly all passage.

The order is by the number of texts that hold a shingle, counted over all texts: blocks of texts send
their sorted 32-bit hashes, packed, to the range of hashes they lie in; a range sums them and sends each
block a byte a hash back.  A hash shared by chance only moves a shingle in the order.

The texts that have a shingle early form its bucket.  Round by round, the shortest members of a bucket
that holds several classes meet its other members, one in the first round and twice as many in the
next, until every member has met all others of other classes or the bucket has one class.  A group of n
like texts costs n pairs; a pair is only left out if it is of one class already or if the places of the
shingle in both sets rule the likeness out.  Pairs are confirmed on the whole sets of 64-bit shingle
hashes; classes are the connected components.

Defined results: case of A-Z is ignored; a text of fewer than five words is one shingle; texts without
words (null ones too) are one class; equal texts are one class; a class of null ids only has a null
component_id; repeated rows are rows of one class; an empty table gives no rows; extra columns are
ignored, and kept by ``keep_first``.

The pipeline's stage links texts by SimHash (``simhash``) first; the classes of ``keep_alike`` are those of
its links and of the exact ones together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.staging import release

from .common import bounded, stage
from .components import few_tasks, stars
from .packs import planes, squeeze, unplanes, unsqueeze
from . import simhash
from .simhash import first_rows, text_hash

SHINGLE = 5
SEED = 42
#: Shingles of a range of hashes, about; pairs of one hub that a task confirms, about.
RANGE, CELL = 1 << 22, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
WORDS = "[^\\x20\\x09-\\x0D]"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ each[i:i + n]) * _BASE
        out ^= out >> np.uint64(29)
    return np.unique((out * _MIX) ^ (out >> np.uint64(32)))


def prefix(n: int) -> int:
    """Shingles of a set of ``n`` of which a set no longer, but like it, has one among its own."""
    return n - (4 * n + 4) // 5 + 1


def unit() -> Column:
    """Key of a text; 0 for all texts without words."""
    words = F.coalesce(F.col("text"), F.lit("")).rlike(WORDS)
    return F.when(words, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def high(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def text_blocks(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """block, fps, texts: the different texts with words, packed, a batch a block."""
    first = rows.where("fp != 0").select("fp", "doc_id", "text_hash").groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    needed = first.select(F.coalesce("f.doc_id", F.lit(0)).alias("__id"),
                          F.col("f.text_hash").alias("__text"), "fp")
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"),
                        text_hash().alias("__text"), "text").join(needed, ["__id", "__text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            once = {k: t for k, t in zip(batch.column("fp").to_pylist(),
                                         batch.column("text").to_pylist())}
            number += 1
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()),
                "fps": pa.array([list(once)], pa.list_(pa.int64())),
                "texts": pa.array([squeeze(*(t.encode("utf-8", "surrogatepass")
                                             for t in once.values()))], pa.binary())})

    bounded(docs.sparkSession)
    return found.select("fp", "text").mapInArrow(run, "block long, fps array<long>, texts binary")


def sets_of(texts: bytes) -> list[np.ndarray]:
    return [shingles(t.decode("utf-8", "surrogatepass")) for t in unsqueeze(texts)]


def counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """block and ranks: for each range of hashes that a block has, a byte for each of its different
    32-bit hashes; 0 if one text holds it, else it grows with the number of texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(),
                                    batch.column("texts").to_pylist()):
                held = [np.unique(high(s)) for s in sets_of(texts)]
                hashes, count = np.unique(np.concatenate(held), return_counts=True)
                at = hashes.astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
                some, begin = np.unique(at, return_index=True)
                ends = [*begin[1:].tolist(), len(hashes)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(some.astype(np.int32)),
                    "block": pa.array(np.full(len(some), block, np.int64)),
                    "hashes": pa.array([
                        squeeze(planes(np.diff(hashes[a:b], prepend=np.uint32(0))),
                                planes(count[a:b], "<u2"))
                        for a, b in zip(begin.tolist(), ends)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [unsqueeze(h) for h in table.column("hashes").to_pylist()]
        hashes = [np.cumsum(unplanes(d), dtype=np.uint32) for d, _ in parts]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate([unplanes(c, "<u2") for _, c in parts]))
        rank = np.minimum(np.ceil(4 * np.log2(total)), 255).astype(np.uint8)[place]
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        return pa.table({
            "part": table.column("part"), "block": table.column("block"),
            "ranks": pa.array([squeeze(r) for r in np.split(rank, ends)], pa.binary())})

    bounded(blocks.sparkSession)
    sent = blocks.mapInArrow(send, "part int, block long, hashes binary")
    return sent.groupBy("part").applyInArrow(add, "part int, block long, ranks binary").groupBy(
        "block").agg(F.sort_array(F.collect_list(F.struct("part", "ranks"))).alias("ranks"))


def prefixes(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """fp, n, tokens, places, shingles of the texts with shared shingles in their prefix: those
    shingles, their places in the order, and the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("fp", pa.int64()), ("n", pa.int32()),
                          ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
                          ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            for row in range(batch.num_rows):
                fps = batch.column("fps")[row].as_py()
                sets = sets_of(batch.column("texts")[row].as_py())
                hashes = np.unique(high(np.concatenate(sets)))
                rank = np.concatenate([
                    np.frombuffer(unsqueeze(r["ranks"])[0], np.uint8)
                    for r in batch.column("ranks")[row].as_py()])
                out = []
                for fp, s in zip(fps, sets):
                    mine = rank[np.searchsorted(hashes, high(s))]
                    order = np.lexsort((s, mine))[:prefix(len(s))]
                    places = np.flatnonzero(mine[order])
                    if len(places):
                        out.append({"fp": fp, "n": len(s), "places": places,
                                    "tokens": s[order[places]].view(np.int64),
                                    "shingles": s.view(np.int64)})
                yield pa.RecordBatch.from_pylist(out, kind)

    bounded(blocks.sparkSession)
    return blocks.join(ranks, "block").select("fps", "texts", "ranks").mapInArrow(
        run, "fp long, n int, tokens array<long>, places array<int>, shingles array<long>")


def buckets(found: DataFrame) -> DataFrame:
    """token, fp, n, place and hub (may a longer text be like this one by it?) of the shingles that
    two prefixes share."""
    rows = found.select("fp", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(
        F.col("t.tokens").alias("token"), "fp", "n", F.col("t.places").alias("place"))
    hub = 9 * (F.col("n") - F.col("place")) >= 8 * F.col("n")
    rows = rows.withColumn("hub", hub)
    useful = rows.groupBy("token").agg(F.count("*").alias("c"), F.bool_or("hub").alias("h")).where(
        "c > 1 AND h").select("token")
    return rows.join(useful, "token")


def meetings(live: DataFrame, done: int, until: int) -> DataFrame:
    """Distinct pairs (u, v) of different classes: hubs number ``done`` + 1 to ``until`` of each
    bucket, by length, and longer members that the places of their shingle allow."""
    turn = Window.partitionBy("token").orderBy("n", "fp")
    hubs = (live.where("hub").withColumn("turn", F.row_number().over(turn))
            .where(F.col("turn") <= until).where(F.col("turn") > done)
            .select("token", F.col("fp").alias("u"), F.col("n").alias("u_n"),
                    F.col("place").alias("u_place"), F.col("root").alias("u_root")))
    both = F.least(F.col("u_n") - F.col("u_place"), F.col("n") - F.col("place"))
    longer = (F.col("n") > F.col("u_n")) | ((F.col("n") == F.col("u_n")) & (F.col("fp") > F.col("u")))
    return live.join(hubs, "token").where(longer & (F.col("root") != F.col("u_root")) & (
        9 * both >= 4 * (F.col("n") + F.col("u_n")))).select(
        "u", F.col("fp").alias("v")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of likeness 4/5 or more; a hub's set goes once to each CELL of its pairs."""
    number = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("v"), F.col("cells")).cast("int")
    ask = pairs.join(number, "u").select("u", "v", cell.alias("cell")).join(
        sets.toDF("v", "b"), "v")
    hubs = sets.toDF("u", "a").join(number, "u").select(
        "u", "a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    both = F.size(F.array_intersect("a", "b"))
    return ask.join(hubs, ["u", "cell"]).withColumn("both", both).where(
        9 * F.col("both") >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def links(found: DataFrame) -> DataFrame:
    """fp, root of every member of a class of two texts or more but the root (``stars``)."""
    sets = found.select("fp", "shingles")
    rows = stage(buckets(found), "near-buckets")
    roots = stage(rows.select("fp", F.col("fp").alias("root")).limit(0), "near-roots")
    done, until = 0, 1
    while True:
        now = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        mixed = now.groupBy("token").agg(
            F.min("root").alias("a"), F.max("root").alias("b"),
            F.count_if("hub").alias("hubs")).where(
            (F.col("a") != F.col("b")) & (F.col("hubs") > done)).select("token")
        live = stage(now.join(mixed, "token"), "near-live")
        n = live.count()
        if not n:
            release(live, rows)
            return roots
        pairs = stage(meetings(few_tasks(live, n), done, until), "near-pairs")
        new = stage(confirmed(few_tasks(pairs, pairs.count()), sets), "near-links")
        if not new.isEmpty():
            last = roots
            roots = stars(last.toDF("u", "v").union(new))
            roots = stage(roots.toDF("fp", "root"), "near-roots")
            release(last)
        release(live, pairs, new)
        done, until = until, 2 * until + 1


def simhash_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) of every text of a SimHash class but its least key, and that key."""
    prints = stage(simhash.fingerprints(docs), "near-fingerprints")
    found = simhash.components(prints).select(F.col("fp").alias("print"), "component_fp")
    of_text = rows.groupBy("text_hash").agg(F.first("fp").alias("fp"))
    texts_of = prints.groupBy("text_hash").agg(F.first("fp").alias("print"))
    members = stage(of_text.join(texts_of, "text_hash").join(found, "print").select(
        "component_fp", "fp").distinct(), "near-alike")
    least = members.groupBy("component_fp").agg(F.min("fp").alias("v"))
    return members.join(least, "component_fp").where("fp != v").select(F.col("fp").alias("u"), "v")


def classes(docs: DataFrame, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``fp, component_id, component_hash`` of the texts of ``rows`` (doc_id, text_hash, fp), linked
    by likeness and by the pairs of texts of ``more`` (u, v)."""
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    blocks = stage(text_blocks(docs, rows), "near-texts")
    ranks = stage(counted(blocks, max(-(-size // (6 * RANGE)), 1)), "near-ranks")
    found = stage(prefixes(blocks, ranks), "near-prefixes")
    release(blocks, ranks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    linked = links(found)
    if more is not None:
        linked = stars(linked.toDF("u", "v").union(more)).toDF("fp", "root")
    known = rows.groupBy("fp").agg(first.alias("first")).join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    release(found)
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    return known.select("fp", "root").join(least, "root").select(
        "fp", F.col("first.doc_id").alias("component_id"),
        F.col("first.text_hash").alias("component_hash"))


def keys(docs: DataFrame) -> DataFrame:
    """Staged doc_id, text_hash, fp and size in bytes of every row."""
    return stage(docs.select(
        F.col("doc_id").cast("long"), text_hash().alias("text_hash"), unit().alias("fp"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "near-keys")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the least id of its class) of every row."""
    rows = keys(docs)
    return rows.join(classes(docs, rows), "fp").select("doc_id", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of least id, with all its columns."""
    return first_rows(docs, classes(docs, keys(docs)))


def keep_alike(docs: DataFrame) -> DataFrame:
    """As ``keep_first``, of the classes that SimHash links and exact likeness make together."""
    rows = keys(docs)
    return first_rows(docs, classes(docs, rows, simhash_links(docs, rows)))
