"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a written table, so lineage stays short and a lost executor costs one round; the one
before is deleted.  Rounds grow with the logarithm of the longest path, not with its length.  A round
takes as many tasks as its edges need: each task leaves files of its own in each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.staging import release

from .common import stage

#: Rows of a small table that a task takes, about.
TASK_ROWS = 1 << 18


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of about TASK_ROWS of its (at most) ``rows`` rows, never in more than it has."""
    return df.coalesce(max(-(-rows // TASK_ROWS), 1))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def stars(edges: DataFrame, name: str = "star") -> DataFrame:
    """``u, v`` edges to one row (u, v) per non-root member ``u`` with ``v`` the least of its
    component; self-loops are ignored, an empty table stays empty."""
    now = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"),
                                             F.least("u", "v").alias("v")).distinct(), name)
    seen = _digest(now)
    while seen[0]:
        n = 2 * seen[0]
        # Large star: neighbours above a node join the least of its neighbourhood.
        both = few_tasks(now.union(now.select("v", "u").toDF("u", "v")), n)
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
        large = few_tasks(large.where("u != v").distinct(), n)
        # Small star: a node and its lower neighbours join the least of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        before, now = now, stage(few_tasks(small.where("u != v"), n).distinct(), name)
        last, seen = seen, _digest(now)
        release(before)
        if seen == last:
            break
    return now
