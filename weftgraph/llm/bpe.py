"""Byte-level BPE through a table of distinct words.

A text is cut before every single space that stands between other characters; no merge crosses such
a cut, so the ids of a text are the ids of its words in order.  Texts form blocks of bounded size.
A block knows its distinct words and, for every document, their positions (as ranks by frequency).
Words meet by hash, each distinct word is encoded once, and its ids join back to the blocks by rank.
Decoding joins ids to the vocabulary's pieces, a table of fixed size.

The blocks are written once, bucketed by block, so only words and their ids move between tasks.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty
text; repeated rows give equal rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import stage_root

from .common import bounded, texts
from .packs import planes, squeeze, unplanes, unsqueeze
from .tokens import opened, paths

#: Characters of text in a block, about; a longer document is a block of its own.
BLOCK_CHARS = 12_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile("[\x0b\x0c\r\x1c-\x1f\t\x85\xa0  -     　]")
BLOCKS = "block string, shard int, words binary, refs binary"


def words(text: str) -> list[str]:
    """The words of a text; all but the first stand for themselves after a space.

    The first is marked by a leading space, which no other word can have.
    """
    if ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
            or _ODD.search(text)):
        found = _CUT.split(text)
    else:
        found = text.split(" ")
    found[0] = " " + found[0]
    return found


def spelled(word: str) -> str:
    return word[1:] if word[:1] == " " else " " + word


def _block(name: str, ids: list[int | None], rows: list[list[str]], shards: int) -> Iterator[dict]:
    """Rows of one block: its words by shard, in rank order, and the ranks of every document."""
    count: Counter[str] = Counter()
    for row in rows:
        count.update(row)
    order = sorted(count, key=count.get, reverse=True)
    rank = dict(zip(order, range(len(order))))
    data = [w.encode("utf-8", "surrogatepass") for w in order]
    shard = np.fromiter((zlib.crc32(w) % shards for w in data), "<u4", len(data))
    refs = np.fromiter((r for row in rows for r in map(rank.__getitem__, row)), "<u4",
                       sum(map(len, rows)))
    known = np.array([i is not None for i in ids], bool)
    yield {"block": name, "shard": None, "words": None, "refs": squeeze(
        np.array([i or 0 for i in ids], "<i8"), known, np.array([len(r) for r in rows], "<u4"),
        planes(refs), planes(shard), np.array([shards], "<u4"))}
    by_shard = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards)).tolist()
    for s, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            part = [data[i] for i in by_shard[a:b].tolist()]
            yield {"block": name, "shard": s, "refs": None, "words": squeeze(
                planes(np.fromiter(map(len, part), "<u4", len(part))), b"".join(part))}


def blocks(docs: DataFrame, shards: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents as written blocks, bucketed so that a block stays where it is."""
    spark = docs.sparkSession
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("words", pa.binary()),
                            ("refs", pa.binary())])
        # The name is unique in the one table that is written; readers see committed tasks only.
        prefix, number = TaskContext.get().partitionId(), 0
        ids, rows, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in _block(f"{prefix}-{number}", ids, rows, shards):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids.append(doc)
                rows.append(words(text or ""))
                size += len(text or "") + 1
                if size >= block_chars:
                    yield from out()
                    ids, rows, size, number = [], [], 0, number + 1
        if ids:
            yield from out()

    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)
     .write.bucketBy(shards, "block").option("path", f"{stage_root(spark)}/{name}")
     .saveAsTable(name))
    return spark.table(name)


def encode_words(table: DataFrame, shards: int, files: tuple[str, str]) -> DataFrame:
    """The ids of each block's words, by shard.  A task encodes each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(files)
        kind = "<u2" if len(encoder.pieces) <= 1 << 16 else "<u4"
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for value in batch.column("words").to_pylist():
                sizes, joined = unsqueeze(value)
                ends, at, found = np.cumsum(unplanes(sizes)).tolist(), 0, []
                for end in ends:
                    word = joined[at:end]
                    at = end
                    ids = known.get(word)
                    if ids is None:
                        text = spelled(word.decode("utf-8", "surrogatepass"))
                        ids = known[word] = np.array(encoder.ids(text), kind).tobytes()
                    found.append(ids)
                out.append(squeeze(planes(np.fromiter(map(len, found), "<u4", len(found))),
                                   b"".join(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("shard"), pa.array(out, pa.binary())],
                names=["block", "shard", "ids"])

    moved = table.where("words IS NOT NULL").select("block", "shard", "words")
    return moved.repartition(shards, "shard").mapInArrow(run, "block string, shard int, ids binary")


def _spread(ids: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Bytes of the pieces of ``ids`` one after the other."""
    n = size[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(first[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]


def _documents(refs: bytes, ids: list[tuple[int, bytes]], files: tuple[str, str]) -> pa.Table:
    """Documents of one block from its refs and the ids of its words."""
    doc, known, count, ranks, shard, shards = unsqueeze(refs)
    pieces = opened(files).pieces
    kind = "<u2" if len(pieces) <= 1 << 16 else "<u4"
    shard = unplanes(shard)
    sizes, joined = [], []
    for _, value in sorted(ids):
        a, b = unsqueeze(value)
        sizes.append(unplanes(a))
        joined.append(b)
    size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    data = b"".join(joined)
    ends = np.cumsum(size)
    place = np.empty(len(shard), np.int64)  # ranks in shard order, as their ids arrive
    place[np.argsort(shard, kind="stable")] = np.arange(len(shard))
    cut = [data[a:b] for a, b in zip((ends - size)[place].tolist(), ends[place].tolist())]
    # Decoded words: the id-to-piece join on the distinct words of the block.
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first, flat = np.cumsum(length) - length, np.frombuffer(b"".join(pieces), np.uint8)
    every = np.frombuffer(data, kind)
    raw = _spread(every, first, length, flat).tobytes()
    upto = np.concatenate([[0], np.cumsum(length[every])])
    width = np.dtype(kind).itemsize
    spelt = [raw[a:b] for a, b in zip(upto[((ends - size) // width)[place]].tolist(),
                                      upto[(ends // width)[place]].tolist())]
    ranks, at = unplanes(ranks).tolist(), 0
    n_tokens, packed, text = [], [], []
    for n in np.frombuffer(count, "<u4").tolist():
        row = ranks[at:at + n]
        at += n
        own = np.frombuffer(b"".join(map(cut.__getitem__, row)), kind)
        n_tokens.append(len(own))
        packed.append(own.astype("<u4").tobytes())
        text.append(b"".join(map(spelt.__getitem__, row)).decode("utf-8", "replace"))
    known = np.frombuffer(known, bool)
    return pa.table({"doc_id": pa.array(np.frombuffer(doc, "<i8"), pa.int64(), mask=~known),
                     "n_tokens": pa.array(n_tokens, pa.int64()),
                     "ids": pa.array(packed, pa.binary()), "decoded": pa.array(text, pa.string())})


def encode_decode(docs: DataFrame, files: tuple[str, str] | None = None,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of every row."""
    spark, files = docs.sparkSession, files or paths()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = blocks(docs, shards, block_chars)
    found = encode_words(table, shards, files)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        refs = [x for x in left.column("refs").to_pylist() if x is not None]
        return _documents(refs[0], list(zip(right.column("shard").to_pylist(),
                                            right.column("ids").to_pylist())), files)

    refs = table.where("refs IS NOT NULL").select("block", "refs")
    return refs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        join, "doc_id long, n_tokens long, ids binary, decoded string")
