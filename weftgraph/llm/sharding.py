"""Shards by fixed virtual slots, in DataFrame functions only.

A record's id hashes to one of ``slots`` virtual slots; the number of slots never changes.  Bytes
are summed per slot, and a versioned slot-to-shard map says where each slot lives: version 0 deals
slots out in equal runs, every later version lists only the slots that moved to level the bytes.
The map has ``slots`` rows a version at most, whatever the input; it alone is planned on the driver.

Defined results: a null text has no bytes (size 1) and crc32 0; a null id is placed by its text;
repeated ids share a slot; an empty table gives no rows and the version 0 map; extra columns are
ignored.  Law: ``bytes`` (sizes near equal), so ``grown_shard`` is null.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.staging import stage_as_is as stage

SLOTS = 4096
SHARDS = 8
#: Rows ranked together at most, on average; more rows make more cells.
CELL_ROWS = 20_000


def virtual_slot(slots: int = SLOTS) -> Column:
    """Slot of a record: the hash of its id, of its text where the id is null."""
    return F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))),
                  F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The narrow part of each record: doc_id, size, text_crc32, virtual_slot."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        virtual_slot(slots).alias("virtual_slot"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: equal runs of slots."""
    return [s * shards // slots for s in range(slots)]


def rebalance(weights: list[int], owner: list[int], shards: int = SHARDS) -> dict[int, int]:
    """Slots to move, with their new shard, so that shard weights come near each other.

    Takes the fullest and the emptiest shard; moves the slot, or exchanges the two slots, whose
    weight difference is nearest to half the gap; stops when nothing narrows the gap.
    """
    now, loads = list(owner), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(now):
        loads[shard] += weights[slot]
        held[shard].append((weights[slot], slot))
    for part in held:
        part.sort()
    for _ in range(4 * len(owner)):
        full, empty = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[full] - loads[empty]
        best: tuple[float, int, int, int] | None = None  # distance to gap / 2, weight, give, take
        for w, slot in [(0, -1), *held[empty]]:
            i = bisect_left(held[full], (w + gap / 2, -1))
            for v, other in held[full][max(i - 1, 0):i + 1]:
                if 0 < v - w < gap:
                    found = (abs(v - w - gap / 2), v - w, other, slot)
                    best = min(best, found) if best else found
        if best is None:
            break
        _, moved, give, take = best
        for slot, a, b in ((give, full, empty), (take, empty, full)):
            if slot >= 0:
                held[a].remove((weights[slot], slot))
                insort(held[b], (weights[slot], slot))
                now[slot] = b
        loads[full] -= moved
        loads[empty] += moved
        if gap <= 1:
            break
    return {s: n for s, (o, n) in enumerate(zip(owner, now)) if o != n}


def grow(owner: list[int], weights: list[int], shards: int) -> dict[int, int]:
    """Edits that fill one more shard (number ``shards``) from the others and move nothing else."""
    loads = [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        loads[shard] += weights[slot]
    target, edits = sum(loads) / (shards + 1), {}
    for slot in sorted(range(len(owner)), key=lambda s: -weights[s]):
        shard = owner[slot]
        if loads[shard] - weights[slot] >= target * 0.999 and \
                loads[shards] + weights[slot] <= target * 1.001:
            edits[slot] = shards
            loads[shard] -= weights[slot]
            loads[shards] += weights[slot]
    return edits


def map_versions(spark: SparkSession, versions: list[dict[int, int]]) -> DataFrame:
    """The map as a stored table (version, virtual_slot, shard); later versions list edits only."""
    out = None
    for number, edits in enumerate(versions):
        # One text literal per version, cut by Spark: no Python rows.
        pairs = F.split(F.lit(",".join(f"{s}:{n}" for s, n in sorted(edits.items()))), ",")
        part = spark.range(1).select(F.explode(pairs).alias("p")).where("p != ''").select(
            F.lit(number).alias("version"),
            F.split("p", ":")[0].cast("int").alias("virtual_slot"),
            F.split("p", ":")[1].cast("int").alias("shard"))
        out = part if out is None else out.union(part)
    return stage(out.coalesce(1), "slot-map")


def current(versions: DataFrame, version: int | None = None) -> DataFrame:
    """The map as of ``version`` (the last one by default): virtual_slot, shard."""
    known = versions if version is None else versions.where(F.col("version") <= version)
    return known.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard and its place there (``slot``, gapless from 0)."""
    spark = docs.sparkSession
    rows = stage(records(docs, slots), "shard-records")
    weights, total = [0] * slots, 0
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"),
                                              F.count("*").alias("n")).collect():
        weights[r["virtual_slot"]] = r["b"]
        total += r["n"]
    owner = first_map(slots, shards)
    versions = map_versions(spark, [dict(enumerate(owner)), rebalance(weights, owner, shards)])
    # Broadcast of a table with exactly ``slots`` rows.
    placed = rows.join(F.broadcast(current(versions)), "virtual_slot")
    cells = max(1, total // (slots * CELL_ROWS))
    placed = placed.withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int"))
    key = ["shard", "virtual_slot", "cell"]
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = placed.groupBy(*key).agg(F.count("*").alias("n")).select(
        *key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("place", F.row_number().over(inside))
    return ranked.join(bases, key).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
