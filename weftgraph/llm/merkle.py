"""Merkle manifest of a table: a hash tree per group, a tree over the groups, a proof per row.

Rows are ranked inside their group; ``fanout`` consecutive nodes hash to their parent until one is
left.  A level is a set of window columns, not a table: the hash of node ``j`` of level ``k`` stands
on the row of its first leaf, ``j * fanout**k``, so siblings are ``lag`` and ``lead`` at fixed offsets,
masked by the node's slot and the length of its run, and rows that are first children hash the
parent.  LEVELS levels share one partitioning by (group, block of ``fanout**LEVELS`` ranks) and one
sort; no offset leaves its block.  The tops of the blocks are the leaves of the next round, so a
table of n rows takes log(n) / (LEVELS * log(fanout)) rounds, and a group holding a third of all rows
is as many tasks as it has blocks.

Blocks are hashed twice: bottom-up for their tops alone, which are staged, and once more for the
proofs, which join the path of their block's top (one row for ``fanout**LEVELS``) where the blocks
already lie, so no proof is ever shuffled.

Ranks come from a range partitioning of the staged leaves (group, order, leaf, row), a count per
partition and group, and the running sums of those counts.

Defined results: a null field hashes as ``-``; null groups are one group, the first; rows of equal
order value are ranked by leaf, null order values first; equal rows are leaves of their own; an empty
text is ``0:``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.staging import release

from .common import id_crc, stage

FANOUT = 3
#: Levels hashed on one partitioning; a block holds FANOUT ** LEVELS nodes.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range partition when leaves are ranked.
PART_ROWS = 50_000
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**values: Column) -> Column:
    """Leaf of a row of ``documents`` with some of its fields replaced."""
    return digest(*(field(values.get(name, F.col(name))) for name in FIELDS))


def group_key(group: str) -> Column:
    """Never null, in the order of the groups: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[Column], rows_a_part: int = PART_ROWS) -> DataFrame:
    """Staged ``rows`` (with column grp) plus pos, the rank from 0 in its group, and n, its size."""
    parts = max(-(-rows.count() // rows_a_part), 1)
    keys = ["grp", *order, "__row"]
    dealt = (rows.withColumn("__row", F.monotonically_increasing_id())
             .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
             .withColumn("__part", F.spark_partition_id())
             .withColumn("__at", F.monotonically_increasing_id()).drop("__row"))
    dealt = stage(dealt, "merkle-dealt")  # the places are fixed once they are written
    runs = dealt.groupBy("grp", "__part").agg(F.min("__at").alias("__first"),
                                              F.count("*").alias("__n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "__part", "__first", F.sum("__n").over(whole).alias("n"),
                       F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = dealt.join(runs, ["grp", "__part"]).withColumn(
        "pos", F.col("__at") - F.col("__first") + F.col("__before")).drop(
        "__part", "__at", "__first", "__before")
    out = stage(out, "merkle-leaves")
    release(dealt)
    return out


def above(n: Column, size: int) -> Column:
    """Nodes that cover ``n`` nodes by ``size`` each."""
    return F.floor((n + (size - 1)) / F.lit(size)) if size > 1 else n


def climbed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (grp, pos, n, hash) plus block, path (siblings left and right, a struct a level on
    which more than one node is left) and, on the first row of a block, top."""
    size = fanout ** levels
    block = F.floor(F.col("pos") / F.lit(size))
    out = nodes.withColumn("block", block).withColumn("__h0", F.col("hash"))
    window = Window.partitionBy("grp", "block").orderBy("pos")
    for k in range(levels):
        step, h = fanout ** k, F.col(f"__h{k}")
        node = F.floor(F.col("pos") / F.lit(step))
        slot = node % fanout
        left_over = above(F.col("n"), step)
        run = F.least(F.lit(fanout), left_over - (node - slot))
        own = (F.col("pos") % step == 0) & (left_over > 1)
        before = [F.when(slot >= d, F.lag(h, d * step).over(window))
                  for d in range(fanout - 1, 0, -1)]
        after = [F.when(slot + d < run, F.lead(h, d * step).over(window))
                 for d in range(1, fanout)]
        side = F.struct(F.concat_ws("", *before).alias("left"),
                        F.concat_ws("", *after).alias("right"))
        out = out.withColumn(f"__s{k}", F.when(own, side))
        parent = F.when(left_over > 1, digest(h, F.col(f"__s{k}.right"))).otherwise(h)
        first = F.col("pos") % (step * fanout) == 0
        out = out.withColumn(f"__h{k + 1}", F.when(first, parent))
    held = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [F.last(f"__s{k}", ignorenulls=True).over(held) for k in range(levels)]
    return out.withColumn("path", F.array_compact(F.array(*sides)).cast(PATH)).select(
        *nodes.columns, "block", "path", F.col(f"__h{levels}").alias("top"))


def climb(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The node tables (grp, pos, n, hash) of the rounds: ``leaves``, then the staged tops of the
    blocks of the table before, until every group has one node."""
    size, rounds = fanout ** levels, [leaves]
    while (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        tops = climbed(rounds[-1].select("grp", "pos", "n", "hash"), fanout, levels)
        rounds.append(stage(tops.where(F.col("pos") % size == 0).select(
            "grp", F.col("block").alias("pos"), above(F.col("n"), size).alias("n"),
            F.col("top").alias("hash")), "merkle-round"))
    return rounds


def descend(rounds: list[DataFrame], top: DataFrame, fanout: int = FANOUT,
            levels: int = LEVELS) -> DataFrame:
    """The rows of the first round with their path, from the leaf up, put before the path of
    their group in ``top`` (grp, pos, path and what else it carries along)."""
    if len(rounds) == 1:
        return rounds[0].join(top, ["grp", "pos"])
    carried = [c for c in top.columns if c not in ("grp", "pos")]
    for number in range(len(rounds) - 2, -1, -1):
        over = top.withColumnsRenamed({"pos": "block", "path": "__over"})
        top = climbed(rounds[number], fanout, levels).join(over, ["grp", "block"]).withColumn(
            "path", F.concat("path", "__over"))
        if number:
            top = stage(top.select("grp", "pos", *carried), "merkle-paths")
    return top


def manifest(rows: DataFrame, group: str, order: list[Column], leaf: Column,
             keep: dict[str, Column], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``rows``: the columns of ``keep``, leaf, subroot (root of the group's
    tree), root (of the tree over the subroots) and path (siblings from the leaf to the root)."""
    base = stage(rows.select(*(c.alias(k) for k, c in keep.items()), leaf.alias("hash"),
                             group_key(group).alias("grp")), "merkle-hashed")
    rounds = climb(ranked(base, [*order, F.col("hash")]), fanout, levels)
    release(base)
    names = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    over = climb(ranked(names, [F.col("name")]), fanout, levels)
    whole = over[-1].select("grp", "pos", F.array().cast(PATH).alias("path"),
                            F.col("hash").alias("root"))
    whole = stage(descend(over, whole, fanout, levels).select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path",
        F.col("hash").alias("subroot"), "root"), "merkle-roots")
    return descend(rounds, whole, fanout, levels).select(
        *keep, F.col("hash").alias("leaf"), "subroot", "root", "path")


def proof(path: str = "path") -> Column:
    """All sibling hashes of a path put together, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, F.col(leaf), lambda h, p: digest(p["left"], h, p["right"]))


def tampered_text() -> Column:
    """The text without line feeds where 2 divides the crc32 of the id, else unchanged."""
    return F.when(id_crc() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def checked(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Every document with its leaf, roots and proof, and whether its tampered form still
    verifies against them."""
    ids = F.col("doc_id").cast("long")
    found = manifest(docs, "source", [F.col("doc_id")], leaf_of(),
                     {"doc_id": ids, "tampered": leaf_of(text=tampered_text())}, fanout, levels)
    return found.withColumn("folded_root", folded("tampered")).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
