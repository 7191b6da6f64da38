"""SimHash fingerprints and exact links within a Hamming radius, by vantage-point trees.

Fingerprints are made distinct, then dealt to shards by a vantage-point tree: at each node a
fingerprint goes left if its distance to the vantage point is at most the threshold.  The tree is
fitted on a bounded sample; every fingerprint is dealt.  By the triangle inequality two fingerprints
within the radius differ by at most the radius in their distance to any point, so a fingerprint
visits just the shards on the other side of boundaries it overlaps.  Of two partners, the one
farther left visits the other.  Within a shard the same rule prunes a local search.

A shard reports a spanning forest of its links, never all pairs: a dense ball of n fingerprints
gives n - 1 edges.  Edges of all shards meet in a distributed component search.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link
like any other; repeated rows are separate rows of one class; a class of null ids only has a null
component_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage, texts
from .components import stars

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints a shard should hold; the sample a tree is fitted on; most shards.
SHARD_SIZE, SAMPLE, SHARDS = 1500, 65_536, 4096
#: Largest block that is compared pair by pair inside a shard.
BLOCK = 512
_PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins, ends = (ends - size).tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    n, ones = len(ends), np.zeros(64, np.int64)
    for i in range(0, n, _PIECE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begins[i:i + _PIECE],
                                                                ends[i:i + _PIECE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(
            0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def text_hash() -> Column:
    return F.xxhash64("text", F.col("doc_id").isNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the whole text and of whether the id is null) and fp (as signed 64-bit)
    of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": fp}

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return map_batches(rows, run, "doc_id long, text_hash long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Node:
    """Inner node, or a leaf (``left`` is None) with its shard number."""

    point: np.uint64 = np.uint64(0)
    most: int = 0
    left: "Node | None" = None
    right: "Node | None" = None
    shard: int = -1


def split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Vantage point and threshold with the fewest points near the boundary, sides kept even."""
    best = None
    picks = points[rng.integers(0, len(points), 12)]
    for point in (*picks, *(~picks[:4])):
        count = np.bincount(distance(points, point), minlength=65)[:65]
        upto = np.cumsum(count)
        for most in range(64):
            share = upto[most] / len(points)
            if 0.2 <= share <= 0.8:
                near = count[max(most - radius + 1, 0):most + radius + 1].sum() / len(points)
                # Work grows with visits and with the larger side.
                cost = (1 + near) * (share ** 2 + (1 - share) ** 2)
                if best is None or cost < best[0]:
                    best = (cost, point, most)
    return None if best is None else (best[1], best[2])


def grow(sample: np.ndarray, shards: int, radius: int = RADIUS) -> Node:
    """A vantage-point tree of up to ``shards`` leaves over a sample of fingerprints."""
    rng, number = np.random.default_rng(7), iter(range(1 << 30))

    def build(points: np.ndarray, leaves: int) -> Node:
        found = split(points, radius, rng) if leaves > 1 and len(points) >= 8 else None
        if found is None:
            return Node(shard=next(number))
        point, most = found
        near = distance(points, point) <= most
        part = min(max(round(leaves * near.mean()), 1), leaves - 1)
        return Node(point, most, build(points[near], part), build(points[~near], leaves - part))

    return build(sample, shards)


def deal(node: Node, fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices at home there, indices that visit) for all fingerprints of a batch."""
    out = []

    def walk(at: Node, home: np.ndarray, guest: np.ndarray) -> None:
        if not len(home) and not len(guest):
            return
        if at.left is None:
            out.append((at.shard, home, guest))
            return
        dh = distance(fp[home], at.point).astype(np.int64)
        dg = distance(fp[guest], at.point).astype(np.int64)
        left = dh <= at.most
        walk(at.left, home[left], guest[dg <= at.most + radius])
        over = home[left & (dh > at.most - radius)]
        walk(at.right, home[~left], np.concatenate([guest[dg > at.most - radius], over]))

    walk(node, np.arange(len(fp)), np.zeros(0, np.int64))
    return out


class Forest:
    """Labels of points, merged by links; a label is the least index of its class."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the classes of each pair (a[i], b[i])."""
        x, y = self.label[a], self.label[b]
        keys, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
        u, v = inverse[:len(x)], inverse[len(x):]
        root = np.arange(len(keys))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            while True:
                jumped = new[new]
                if (jumped == new).all():
                    break
                new = jumped
            if (new == root).all():
                break
            root = new
        rename = np.arange(len(self.label))
        rename[keys] = keys[root]
        self.label = rename[self.label]


def link(fp: np.ndarray, n_home: int, radius: int = RADIUS) -> np.ndarray:
    """Labels of the classes linked inside a shard; guests (from ``n_home`` on) meet homes only.

    Splits by vantage points until at most BLOCK homes are left; those are compared with the
    guests the triangle inequality leaves, pairs already in one class excepted.
    """
    forest, rng = Forest(len(fp)), np.random.default_rng(11)

    def search(home: np.ndarray, other: np.ndarray) -> None:
        if not len(home) or not len(other):
            return
        found = split(fp[home], radius, rng) if len(home) > BLOCK else None
        if found is not None:
            point, most = found
            dh, do = (distance(fp[x], point).astype(np.int64) for x in (home, other))
            search(home[dh <= most], other[do <= most + radius])
            search(home[dh > most], other[do > most - radius])
            return
        for i in range(0, len(home), BLOCK):
            h = home[i:i + BLOCK]
            for j in range(0, len(other), 4096):
                o = other[j:j + 4096]
                near = distance(fp[h][:, None], fp[o][None, :]) <= radius
                near &= forest.label[h][:, None] != forest.label[o][None, :]
                a, b = np.nonzero(near)
                if len(a):
                    forest.merge(h[a], o[b])

    search(np.arange(n_home), np.arange(len(fp)))
    return forest.label


def edges(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE,
          sample: int = SAMPLE) -> DataFrame:
    """Spanning edges (u, v) between different fingerprints of ``distinct`` (column fp)."""
    n = distinct.count()
    shards = int(min(max(-(-n // shard_size), 1), SHARDS))
    points = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp")).limit(
        min(sample, 64 * shards)).collect()], np.int64).view(np.uint64)
    tree = grow(points, shards, radius) if len(points) else Node(shard=0)

    def route(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        parts = deal(tree, fp, radius)
        index = [x for _, home, guest in parts for x in (home, guest)]
        return {
            "shard": np.repeat([s for s, _, _ in parts for _ in (0, 1)], [len(x) for x in index]),
            "home": np.repeat([k for _ in parts for k in (True, False)], [len(x) for x in index]),
            "fp": fp[np.concatenate(index)].view(np.int64) if index else fp.view(np.int64)}

    def join(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        fp = np.concatenate([np.sort(fp[home]), np.sort(fp[~home])])
        label = link(fp, int(home.sum()), radius)
        member = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.table({"u": signed[member], "v": signed[label[member]]})

    dealt = map_batches(distinct.select("fp"), route, "shard int, home boolean, fp long")
    return dealt.groupBy("shard").applyInArrow(join, "u long, v long")


def components(rows: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``fp, component_id, component_hash, component_fp``: the row each fingerprint's class keeps
    (least id, nulls last, then least hash) for ``rows`` (doc_id, text_hash, fp)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "fp"))
    distinct = stage(rows.groupBy("fp").agg(first.alias("first")), "fingerprints")
    linked = stars(edges(distinct, radius, shard_size))
    known = distinct.join(linked.toDF("fp", "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    return known.select("fp", "root").join(least, "root").select(
        "fp", F.col("first.doc_id").alias("component_id"),
        F.col("first.text_hash").alias("component_hash"), F.col("first.fp").alias("component_fp"))


def hexed(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_duplicates(docs: DataFrame, radius: int = RADIUS,
                    shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    rows = stage(fingerprints(docs), "simhash")
    classes = components(rows, radius, shard_size)
    return rows.join(classes, "fp").select("doc_id", hexed("fp").alias("fingerprint"),
                                           "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each class, the one of least id, with all its columns."""
    rows = stage(fingerprints(docs), "simhash")
    return first_rows(docs, components(rows, radius))


def first_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The row that each class (component_id, component_hash) keeps, with all its columns."""
    kept = classes.select(
        F.coalesce("component_id", F.lit(0)).alias("__id"),
        F.col("component_hash").alias("__text")).distinct()
    # Ids are nearly unique, so the texts move once, by id; the key has no nulls, so that the join
    # and the window deal rows out alike.
    found = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(
        "__text", text_hash()).join(kept, ["__id", "__text"], "left_semi")
    again = Window.partitionBy("__id", "__text").orderBy("__text")
    return found.withColumn("__n", F.row_number().over(again)).where("__n = 1").select(*docs.columns)
