"""Documents packed into sequences of bounded length by best-fit decreasing.

Only longer documents are cut, into full pieces with the short one first.  Pieces are placed from
the longest to the shortest, each into the open sequence with the least room that still fits; a
segment tree over remaining capacities finds that room in logarithmic time.  The order of pieces of
one length does not matter, so the plan needs only the number of pieces per length: at most
``capacity`` counts reach the driver, whatever the input, and all sequences with the same room are
handled as runs of consecutive numbers.  Tasks then rank the pieces of each length in parallel
and look their places up in the plan.

Defined results: a null text counts as empty; an empty document is the closing id alone (one
piece of length 1); repeated rows are packed as often as they stand there; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stage, texts
from .tokens import opened, paths

CAPACITY = 2048
END = 0
CELL_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than full."""
    if n <= capacity:
        return [(0, n)]
    short = n % capacity
    starts = ([0] if short else []) + list(range(short, n, capacity))
    return [(s, short if s == 0 and short else capacity) for s in starts]


def pieces(docs: DataFrame, files: tuple[str, str] | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    files = files or paths()

    def run(batch: pa.RecordBatch) -> dict:
        encode = opened(files).ids
        out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            ids = np.array(encode(text or "") + [END], "<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                row = (doc, k, start, length, zlib.crc32(ids[start:start + length].tobytes()))
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


class Rooms:
    """Counts of open sequences by remaining capacity, as a segment tree of sums."""

    def __init__(self, capacity: int):
        self.half = 1 << (capacity + 1).bit_length()
        self.sums = [0] * (2 * self.half)

    def add(self, room: int, count: int) -> None:
        i = room + self.half
        while i:
            self.sums[i] += count
            i >>= 1

    def count(self, room: int) -> int:
        return self.sums[room + self.half]

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` with an open sequence."""
        i = least + self.half
        while not self.sums[i]:
            while i & 1:  # right children have no sibling to the right
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.half:
            i <<= 1
            if not self.sums[i]:
                i += 1
        return i - self.half


@dataclass(frozen=True)
class Plan:
    """Runs: ``count`` pieces of ``length`` from rank ``first`` on go to sequences from
    ``sequence`` on, one each, at ``offset``; sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << np.int64(48)
        i = np.searchsorted(self.length * wide + self.first, length * wide + rank, "right") - 1
        return self.sequence[i] + rank - self.first[i], self.offset[i]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over ``counts`` (pieces per length), by runs of equal steps."""
    rooms, open_runs = Rooms(capacity), {}
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0

    def take(room: int, count: int) -> list[tuple[int, int]]:
        queue, out = open_runs[room], []
        rooms.add(room, -count)
        while count:
            at, n = queue.popleft()
            if n > count:
                queue.appendleft((at + count, n - count))
                n = count
            out.append((at, n))
            count -= n
        return out

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, open_now = capacity, -(-left // (capacity // length))
            else:
                open_now = rooms.count(room)
            each = room // length  # the fullest sequence stays the tightest until nothing fits
            whole = min(open_now, left // each)
            for number, per in ((whole, each), (1 if whole < open_now else 0, left - whole * each)):
                if not number or not 0 < per <= each:
                    continue
                if room == capacity:
                    got, sequences = [(sequences, number)], sequences + number
                else:
                    got = take(room, number)
                for at, n in got:
                    for k in range(per):
                        runs.append((length, rank, at, capacity - room + k * length))
                        rank += n
                    rest = room - per * length
                    open_runs.setdefault(rest, deque()).append((at, n))
                    rooms.add(rest, n)
                left -= number * per
                if per < each:
                    break
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def pack(docs: DataFrame, files: tuple[str, str] | None = None,
         capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cut = stage(pieces(docs, files, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = best_fit(counts, capacity)
    # Pieces of one length are ranked in cells, so a common length is not one sorted group.
    cells = max(1, sum(counts.values()) // CELL_ROWS)
    tie = ["doc_id", "piece", "ids_crc32", "start"]
    cut = cut.withColumn("cell", F.pmod(F.xxhash64(*tie), F.lit(cells)).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "cell").agg(F.count("*").alias("n")).select(
        "length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy(*tie)))
    ranked = ranked.join(bases, ["length", "cell"]).select(
        *(c.split()[0] for c in PIECES.split(", ")),
        (F.col("base") + F.col("rank") - 1).cast("long").alias("rank"))

    def place(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = plan.place(length, rank) if len(rank) else (rank, rank)
        return {**{n: batch.column(n) for n in batch.schema.names},
                "sequence_id": sequence, "offset": offset}

    return map_batches(ranked, place, PIECES + ", sequence_id long, offset long")
