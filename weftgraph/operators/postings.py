"""An n-gram index over the texts of functions: gap-coded posting lists, rarest lists first.

Texts (names, qualified names, paths in lower case) are indexed once each, however many functions
share them.  The texts of a scope are dealt by hash to blocks of about BLOCK texts and numbered
inside their block; a posting list holds the places of one gram in one block.  So a frequent gram
is many lists, and a lookup never needs more than a few lists of one block together.

Grams are one, two and three characters long.  A query of three characters or more meets the
lists of its RAREST least frequent trigrams; shorter queries are a gram themselves.  What the
lists leave is decided by ``contains``, so the answer does not depend on the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import SCOPE
from ..staging import stage

#: Longest gram, and posting lists met for a query.
WIDTH, RAREST = 3, 3
#: Texts of a block, on average.
BLOCK = 16384
#: What a match carries: the function's id and what functions are ordered by.
NODE = ["id", "name", "file_path"]


class GramIndex(NamedTuple):
    owners: DataFrame  # scope, id, name, file_path, text: the texts of every function
    texts: DataFrame  # scope, block, place, text
    lists: DataFrame  # scope, gram, block, n, gaps


def _grams(text: Column) -> list[Column]:
    """All grams of one, two and three characters of a query, with repeats and null ends."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    levels = [letters]
    for width in range(2, WIDTH + 1):
        levels.append(F.zip_with(levels[-1], F.slice(letters, width, F.length(text)),
                                 lambda gram, letter: F.concat(gram, letter)))
    return levels


def encode(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte offsets of ascending lists: seven bits a byte, the high bit goes on."""
    gaps = np.diff(values, prepend=0)
    first = offsets[:-1][np.diff(offsets) > 0]
    gaps[first] = values[first]
    size = 1 + sum((gaps >> 7 * i > 0).astype(np.int64) for i in range(1, 5))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)
    for i in range(5):
        has = size > i
        more = (size[has] > i + 1).astype(np.uint8) << 7
        out[ends[:-1][has] + i] = (gaps[has] >> 7 * i & 127).astype(np.uint8) | more
    return out, ends[offsets]


def decode(blob: bytes) -> np.ndarray:
    """The ascending list that ``encode`` wrote."""
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(raw < 128)[:-1] + 1])
    nth = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << 7 * nth, starts))


def _block_lists(texts: list[str], places: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, bytes, np.ndarray]]:
    """(grams, lengths, bytes, byte offsets) of the posting lists of one block, a width at a time.

    ``places`` ascend.  A gram is a number of 21 bits a letter, so a block is sorted, never grouped.
    """
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, left = np.repeat(places, sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    for width in range(1, WIDTH + 1):
        starts = np.flatnonzero(left >= width)
        if not len(starts):
            return
        key = np.zeros(len(starts), np.int64)
        for i in range(width):
            key = key << 21 | letters[starts + i]
        order = np.argsort(key, kind="stable")
        key, values = key[order], owner[starts[order]]
        new = np.append(True, (key[1:] != key[:-1]) | (values[1:] != values[:-1]))
        key, values = key[new], values[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        grams = ["".join(chr(k >> 21 * i & 0x1FFFFF) for i in reversed(range(width)))
                 for k in key[first].tolist()]
        offsets = np.append(first, len(key))
        out, ends = encode(values, offsets)
        yield grams, np.diff(offsets), out, ends


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of rows sorted by scope, block and place; a block lies in one task."""
    key, texts, places = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        for grams, n, out, ends in _block_lists(texts, np.array(places, np.int64)):
            gaps = pa.Array.from_buffers(pa.binary(), len(grams), [
                None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            rest = [pa.array([v] * len(grams), pa.string()) for v in key[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(grams, pa.string()), pa.array([key[-1]] * len(grams), pa.int64()),
                 pa.array(n, pa.int64()), gaps], [*SCOPE, "gram", "block", "n", "gaps"])

    for batch in batches:
        # Bytes that are no UTF-8 have no grams that a query could ask for.
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        keys = zip(*(batch.column(c).to_pylist() for c in (*SCOPE, "block")))
        for at, text, place in zip(keys, raw, batch.column("place").to_pylist()):
            if at != key:
                yield from done() if texts else ()
                key, texts, places = at, [], []
            texts.append(text.decode("utf-8", "replace"))
            places.append(place)
    yield from done() if texts else ()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = []
        for lists in batch.column("lists").to_pylist():
            common = decode(lists[0])
            for blob in lists[1:]:
                common = np.intersect1d(common, decode(blob), assume_unique=True)
            places.append(common)
        rest = [batch.column(c) for c in (*SCOPE, "q", "block")]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(places, pa.list_(pa.int64()))], [*SCOPE, "q", "block", "place"])


def gram_index(nodes: DataFrame) -> GramIndex:
    """The written index of all functions; null texts have no grams."""
    fields = [F.lower(c) for c in ("name", "qualified_name", "file_path")]
    owners = stage(
        nodes.filter(F.col("kind") == "function").select(
            *SCOPE, *NODE, F.explode(F.array_distinct(F.array(*fields))).alias("text")
        ).filter(F.col("text") != ""), "gram-owners")
    texts = owners.select(*SCOPE, "text").distinct()
    blocks = texts.groupBy(*SCOPE).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    inside = Window.partitionBy(*SCOPE, "block").orderBy("text")
    # Grams cost far more than the texts that have them: few bytes are dealt to many tasks.
    spark = nodes.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = stage(
        texts.join(blocks, SCOPE)
        .withColumn("block", F.pmod(F.xxhash64("text"), F.col("blocks"))).drop("blocks")
        .repartition(tasks, *SCOPE, "block")
        .withColumn("place", F.row_number().over(inside).cast("bigint")), "gram-texts")
    rows = numbered.select(*SCOPE, "block", "place", "text").repartition(
        tasks, *SCOPE, "block").sortWithinPartitions(*SCOPE, "block", "place")
    scope = ", ".join(f"{c} string" for c in SCOPE)
    lists = rows.mapInArrow(_coded, f"{scope}, gram string, block bigint, n bigint, gaps binary")
    return GramIndex(owners, numbered, stage(lists, "gram-lists"))


def matches(index: GramIndex, asked: DataFrame) -> DataFrame:
    """Distinct (scope, id, name, file_path, q) of functions with a text that contains ``q``.

    ``asked``: distinct (scope, q) in lower case, not empty.  A query with a gram that no text has
    is done at once; the lists of the others meet block by block.
    """
    size = F.length("q")
    own = F.when(size < WIDTH, F.array("q")).otherwise(
        F.array_distinct(F.array_compact(_grams(F.col("q"))[-1])))
    grams = asked.select(*SCOPE, "q", own.alias("grams")).select(
        *SCOPE, "q", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    wanted = grams.select(*SCOPE, "gram").distinct()
    known = index.lists.select(*SCOPE, "gram", "n").join(
        wanted, [*SCOPE, "gram"], "left_semi").groupBy(*SCOPE, "gram").agg(
        F.sum("n").alias("total"))
    rarest = grams.join(known, [*SCOPE, "gram"]).groupBy(*SCOPE, "q", "need").agg(
        F.sort_array(F.collect_list(F.struct("total", "gram"))).alias("found")
    ).filter(F.size("found") == F.col("need")).select(
        *SCOPE, "q", F.least("need", F.lit(RAREST)).alias("need"),
        F.explode(F.slice("found", 1, RAREST)).alias("pick"))
    met = rarest.select(*SCOPE, "q", "need", F.col("pick.gram").alias("gram")).join(
        index.lists.select(*SCOPE, "gram", "block", "gaps"), [*SCOPE, "gram"]
    ).groupBy(*SCOPE, "q", "need", "block").agg(
        F.array_sort(F.collect_list("gaps"), lambda a, b: F.length(a) - F.length(b))
        .alias("lists")
    ).filter(F.size("lists") == F.col("need")).select(*SCOPE, "q", "block", "lists")
    scope = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in SCOPE)
    places = met.mapInArrow(
        _met, f"{scope}, q string, block bigint, place array<bigint>"
    ).withColumn("place", F.explode("place"))
    # A place takes a byte in a list and a row here, so estimates of its size are far too low to broadcast.
    found = places.hint("merge").join(index.texts, [*SCOPE, "block", "place"]).filter(
        F.col("text").contains(F.col("q"))).select(*SCOPE, "text", "q")
    return found.join(index.owners, [*SCOPE, "text"]).select(
        *SCOPE, *NODE, "q").distinct()
