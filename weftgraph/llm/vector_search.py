"""Exact top-k search by inner product with multi-resolution segment statistics.

Components become the integers floor(SCALE * x).  At a resolution a vector is cut into segments of
near-equal length; of each segment the mean and the deviation are kept.  As
``|q - x|^2 = |q|^2 + |x|^2 - 2 q.x``, a lower bound of the distance is an upper bound of the inner
product; by the Cauchy-Schwarz inequality on the centred segments it is
``sum over segments of length * (mean_q * mean_x + dev_q * dev_x)``, one short inner product of
statistics.  Resolutions go from one segment to half as many as there are components; a candidate
whose bound is below the query's k-th best known score is gone, and exact scores are computed for
those that survive all resolutions.  Bounds carry a margin for rounding, scores are exact integers.

The queries are a stated set, met with all rows in cells: candidates lie in groups of about GROUP
rows, queries in chunks of about CHUNK, and a cell is one group and one chunk.  First each chunk
meets one group; the k-th best score there is the threshold that all its cells start with.  A cell
reports at most k rows a query, all of them at the threshold or over it.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part;
vectors meet vectors of the same length, empty ones with score 0; rows are told apart by their place,
so a repeated row is a candidate of its twin; null ids are no queries, and come last among equal
scores; components and scores beyond 64 bits are cut to that range; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import release

from .common import bounded, stage
from .lexical import top
from .packs import squeeze, unsqueeze

K = 20
EVERY = 20
SCALE = 64.0
#: Rows of a group of candidates and of a chunk of queries.
GROUP, CHUNK = 8192, 512
#: Rows and bytes of a stored block of vectors.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: Candidates of best bound that are scored first where no threshold is known, times k.
PROBE = 4
#: Pairs that are scored at a time; from one pair in DENSE on, all are scored as one product.
PIECE, DENSE = 1 << 14, 32
NULL_ID = np.iinfo(np.int64).max
LIMIT = np.iinfo(np.int64)
BLOCK = "block long, size int, n int, vectors binary"
QUERY = "block long, size int, n int, places binary, vectors binary"
FOUND = "block long, place int, query_id long, vec_id long, score long"


def bounds_of(size: int, segments: int) -> np.ndarray:
    """Begins and the end of near-equal segments."""
    return np.arange(segments + 1) * size // segments


def resolutions(size: int) -> list[int]:
    """Numbers of segments from 1 on, doubling, at most half the components."""
    return [1 << k for k in range(max(size // 2, 1).bit_length()) if 1 << k <= max(size // 2, 1)] \
        if size else []


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, both times the root of its length, side by side."""
    at = bounds_of(x.shape[1], segments)
    length = np.diff(at)
    total = np.add.reduceat(x, at[:-1], axis=1)
    mean = total / length
    centred = x - np.repeat(mean, length, axis=1)
    spread = np.add.reduceat(centred * centred, at[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(spread)], axis=1)


class Vectors:
    """Integer vectors of one length with their ids and statistics."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray):
        self.ids, self.known, self.x, self.wide = ids, known, x, x.astype(np.float64)
        self.norm = np.sqrt((self.wide * self.wide).sum(1))
        self.most = float(np.abs(self.wide).max(initial=0))
        #: Single precision where squares of norms are far from its limits.
        self.kind = np.float32 if self.norm.max(initial=0) < 1e6 else np.float64
        self.levels = [statistics(self.wide, s).astype(self.kind) for s in resolutions(x.shape[1])]


def exact(asked: Vectors, held: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), as integers."""
    out = np.empty(len(i), np.int64)
    reach = asked.most * held.most * max(asked.x.shape[1], 1)
    if reach < 2.0 ** 53 and DENSE * len(i) > len(asked.ids) * len(held.ids):
        return (asked.wide @ held.wide.T)[i, j].astype(np.int64)
    for at in range(0, len(i), PIECE):
        a, b = i[at:at + PIECE], j[at:at + PIECE]
        if reach < 2.0 ** 53:
            out[at:at + PIECE] = np.einsum("nd,nd->n", asked.wide[a], held.wide[b])
        elif reach < 2.0 ** 62:
            out[at:at + PIECE] = (asked.x[a] * held.x[b]).sum(1)
        else:
            out[at:at + PIECE] = [
                min(max(sum(s * t for s, t in zip(x, y)), LIMIT.min), LIMIT.max)
                for x, y in zip(asked.x[a].tolist(), held.x[b].tolist())]
    return out


def margins(asked: Vectors, held: Vectors) -> np.ndarray:
    """What rounding may take from a bound, for each query."""
    kind = np.float64 if np.float64 in (asked.kind, held.kind) else np.float32
    worst = 8 * max(asked.x.shape[1], 1) * float(np.finfo(kind).eps)
    return 1e-6 + worst * asked.norm * held.norm.max(initial=0)


def best_of(asked: Vectors, held: Vectors, own: np.ndarray, least: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) and scores: the ``k`` best rows of each query, its row ``own`` (if not
    negative) excepted, with scores from ``least`` on; LIMIT.min stands for no threshold."""
    n, m = len(asked.ids), len(held.ids)
    alive = np.ones((n, m), bool)
    alive[np.flatnonzero(own >= 0), own[own >= 0]] = False
    fresh = np.flatnonzero(least == LIMIT.min)
    width = PROBE * k
    if len(fresh) and m > width + 1 and held.levels:
        bound = asked.levels[-1][fresh] @ held.levels[-1].T
        bound[~alive[fresh]] = -np.inf
        probe = np.argpartition(-bound, width, axis=1)[:, :width]
        score = exact(asked, held, np.repeat(fresh, width), probe.ravel()).reshape(-1, width)
        least = least.copy()
        least[fresh] = np.partition(score, -k, axis=1)[:, -k]
    floor = np.where(least == LIMIT.min, -np.inf, least.astype(np.float64)) - margins(asked, held)
    rows, columns = np.arange(n), np.arange(m)
    for mine, theirs in zip(asked.levels, held.levels):
        alive &= mine[rows] @ theirs[columns].T >= floor[rows, None]
        keep, left = alive.any(1), alive.any(0)
        if keep.sum() * left.sum() < 0.8 * alive.size:
            rows, columns, alive = rows[keep], columns[left], alive[np.ix_(keep, left)]
    at = np.flatnonzero(alive)
    i, j = rows[at // len(columns)], columns[at % len(columns)]
    score = exact(asked, held, i, j)
    good = score >= least[i]
    i, j, score = i[good], j[good], score[good]
    order = np.lexsort((held.ids[j], 1 - held.known[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k]


def packed(ids: list, x: np.ndarray) -> bytes:
    """Ids and components; components take the fewest bytes that hold them."""
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            break
    known = np.array([i is not None for i in ids], np.uint8)
    return squeeze(np.array([NULL_ID if i is None else i for i in ids], "<i8"), known,
                   kind.encode(), x.astype(kind))


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, known, kind, x = unsqueeze(data)
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(known, np.uint8), np.frombuffer(
        x, np.dtype(kind.decode())).astype(np.int64).reshape(len(ids), size)


def whole_numbers(vector: list, scale: float) -> list[int] | None:
    """floor(scale * x) of every component, cut to 64 bits; None if the vector takes no part."""
    if vector is None or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    inside = np.abs(x) < 2.0 ** 62
    return np.where(inside, x, 0).astype(np.int64).tolist() if inside.all() else [
        int(min(max(v, LIMIT.min), LIMIT.max)) for v in x.tolist()]


def blocks(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Stored blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kind = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("n", pa.int32()),
                          ("vectors", pa.binary())])
        open_blocks: dict[int, tuple[list, list]] = {}

        def out(size: int) -> pa.RecordBatch:
            nonlocal number
            ids, x = open_blocks.pop(size)
            number += 1
            return pa.RecordBatch.from_pylist([{
                "block": number, "size": size, "n": len(ids),
                "vectors": packed(ids, np.array(x, np.int64).reshape(len(ids), size))}], kind)

        for batch in batches:
            for i, vector in zip(batch.column("vec_id").to_pylist(),
                                 batch.column("embedding").to_pylist()):
                x = whole_numbers(vector, scale)
                if x is None:
                    continue
                ids, rows = open_blocks.setdefault(len(x), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) >= BLOCK_ROWS or 8 * len(x) * len(ids) >= BLOCK_BYTES:
                    yield out(len(x))
        for size in list(open_blocks):
            yield out(size)

    bounded(rows.sparkSession)
    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, BLOCK)


def queries(stored: DataFrame, every: int = EVERY) -> DataFrame:
    """The rows whose id is divisible by ``every``, by block, with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, x = unpacked(row["vectors"], row["size"])
                places = np.flatnonzero((known == 1) & (ids % every == 0))
                if len(places):
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([row["block"]], pa.int64()),
                        "size": pa.array([row["size"]], pa.int32()),
                        "n": pa.array([len(places)], pa.int32()),
                        "places": pa.array([places.astype("<i4").tobytes()], pa.binary()),
                        "vectors": pa.array([packed(ids[places].tolist(), x[places])],
                                            pa.binary())})

    return stored.mapInArrow(run, QUERY)


def met(asked: DataFrame, stored: DataFrame, k: int = K) -> DataFrame:
    """FOUND rows of every cell (size, chunk, grp) of query blocks, with thresholds as packed
    64-bit numbers, and candidate blocks."""

    kind = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()),
                      ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows(ask: dict, held: list[tuple[int, Vectors]]) -> Iterator[pa.RecordBatch]:
        asked = Vectors(*unpacked(ask["vectors"], ask["size"]))
        places = np.frombuffer(ask["places"], "<i4").astype(np.int64)
        least = np.frombuffer(ask["least"], "<i8") if ask["least"] else np.full(
            len(places), LIMIT.min)
        known = np.full((len(places), k), LIMIT.min)
        for block, vectors in held:
            own = places if block == ask["block"] else np.full(len(places), -1)
            i, j, score = best_of(asked, vectors, own, least, k)
            # The k-th best of the blocks so far is the threshold of the next.
            more = np.full((len(places), 2 * k), LIMIT.min)
            more[:, :k] = known
            more[i, k + np.arange(len(i)) - np.searchsorted(i, i)] = score
            known = np.partition(more, k, axis=1)[:, k:]
            least = np.maximum(least, known.min(1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i), ask["block"])), pa.array(places[i].astype(np.int32)),
                pa.array(asked.ids[i]), pa.array(vectors.ids[j], mask=vectors.known[j] == 0),
                pa.array(score)], schema=kind)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(b["block"], Vectors(*unpacked(b["vectors"], b["size"])))
                for b in right.to_pylist()]
        out = [batch for ask in left.to_pylist() for batch in rows(ask, held)]
        return pa.Table.from_batches(out, kind).combine_chunks()

    keys = ["size", "chunk", "grp"]
    return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(cell, FOUND)


def thresholds(asked: DataFrame, seen: DataFrame, k: int = K) -> DataFrame:
    """``asked`` with least, the k-th best score that each query of a block has ``seen``."""
    kth = seen.groupBy("block", "place").agg(
        F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    packed_up = kth.groupBy("block").agg(F.collect_list(F.struct("place", "least")).alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for places, kth in zip(batch.column("places").to_pylist(),
                                   batch.column("kth").to_pylist()):
                at = {r["place"]: r["least"] for r in kth or []}
                least.append(np.array([at.get(p, LIMIT.min) for p in np.frombuffer(
                    places, "<i4").tolist()], "<i8").tobytes())
            yield batch.drop_columns(["kth"]).append_column("least", pa.array(least, pa.binary()))

    return asked.drop("least").join(packed_up, "block", "left").select(
        *[c for c in asked.columns if c != "least"], "kth").mapInArrow(
        run, f"{QUERY}, chunk int, least binary")


def search(rows: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE,
           group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each query."""
    stored = stage(blocks(rows, scale), "vector-blocks")
    asked = stage(queries(stored, every), "vector-queries")
    count = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    groups = max(-(-stored.agg(count).first()["n"] // group), 1)
    chunks = max(-(-asked.agg(count).first()["n"] // chunk), 1)

    def dealt(number: int, seed: int):
        return F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(number)).cast("int")

    stored = stored.withColumn("grp", dealt(groups, 1))
    asked = asked.withColumn("chunk", dealt(chunks, 2)).withColumn(
        "least", F.lit(None).cast("binary"))
    # One group a chunk, the first of its size that holds anything.
    first = stored.select("size", F.col("grp").alias("__grp")).distinct().groupBy("size").agg(
        F.sort_array(F.collect_set("__grp")).alias("groups"))
    start = asked.join(first, "size").withColumn(
        "grp", F.element_at("groups", F.col("chunk") % F.size("groups") + 1)).drop("groups")
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    spread = stored.withColumn("chunk", every_chunk)
    seen = stage(met(start, spread, k), "vector-seen")
    best = top(seen, ["block", "place"], [F.desc("score"), F.asc_nulls_last("vec_id")], k)
    known = stage(thresholds(asked, best, k), "vector-thresholds")
    found = stage(met(known.withColumn("grp", every_group), spread, k), "vector-found")
    release(seen)
    return top(found, ["block", "place"], [F.desc("score"), F.asc_nulls_last("vec_id")], k).select(
        "query_id", "rank", "vec_id", "score")
