"""Distinct callers and callees of every folder from mergeable sketches.

Each file gets one HyperLogLog sketch of the functions that call into it and one of those it calls, with
exact counts of calls.  Sketches are merged up the path tree level by level: a round reads the sketches of
one depth, adds them to their folders and writes those, so a call is hashed once however deep its file
lies, and no set of callers is gathered.  ``exact_rollup`` counts the same by distinct rows, to measure
the error or where it is not wanted.

Functions without a file belong to the root folder.  Relations without a source or target, or whose end
in the folder is no known node, take no part; repeated relations count once as callers and as often as they
stand as calls, repeated nodes once.  Empty graphs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ancestors
from ..schemas import SCOPE
from ..staging import stage

ROOT = "."
#: Bits of the sketch size; the standard error of an estimate is about 0.83 / sqrt(2 ** LG).
LG = 12
#: Relative error that estimates keep to in nearly all cases: four standard errors.
BOUND = 4 * 0.83 / 2 ** (LG / 2)
#: Column of the end of a relation that is counted, by the end that names the folder.
_ENDS = {"callers": ("target_id", "source_id"), "callees": ("source_id", "target_id")}


def _calls(nodes: DataFrame, relations: DataFrame, what: str) -> DataFrame:
    """(scope, path, other): one row per call, at the file of its end."""
    here, there = _ENDS[what]
    places = nodes.select(*SCOPE, F.col("id").alias(here),
                          F.coalesce("file_path", F.lit(ROOT)).alias("path")).distinct()
    calls = relations.filter((F.col("type") == "calls") & F.col("source_id").isNotNull()
                             & F.col("target_id").isNotNull())
    return calls.select(*SCOPE, here, F.col(there).alias("other")).join(places, [*SCOPE, here]).select(
        *SCOPE, "path", "other")


def _depth(path: Column) -> Column:
    return F.when(path == ROOT, 0).otherwise(F.size(F.split(path, "/"))).cast("int")


def file_sketches(nodes: DataFrame, relations: DataFrame, what: str, lg: int = LG) -> DataFrame:
    """(scope, path, depth, calls, sketch) of every file that has ``what`` (callers or callees)."""
    return _calls(nodes, relations, what).groupBy(*SCOPE, "path").agg(
        F.count(F.lit(1)).alias("calls"), F.hll_sketch_agg("other", lg).alias("sketch")).withColumn(
        "depth", _depth(F.col("path")))


def rollup(files: DataFrame) -> DataFrame:
    """(scope, path, depth, calls, sketch) of every file and folder, the root included.

    One written round per depth, deepest first; a level holds the sketches of its own files and the
    merged ones of the folders below."""
    files = stage(files, "sketch-files", ["depth"])
    deepest = files.agg(F.max("depth")).first()[0]
    columns = [*SCOPE, "path", "depth", "calls", "sketch"]
    out, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = files.filter(F.col("depth") == depth).select(*columns)
        if below is not None:
            up = F.when(F.lit(depth) == 0, F.lit(ROOT)).otherwise(
                F.regexp_replace("path", r"/[^/]*$", ""))
            level = level.unionByName(below.withColumn("path", up).withColumn(
                "depth", F.lit(depth).cast("int")))
        below = stage(level.groupBy(*SCOPE, "path", "depth").agg(
            F.sum("calls").alias("calls"), F.hll_union_agg("sketch").alias("sketch")).select(*columns),
            f"sketch-level-{depth}")
        out = below if out is None else out.unionByName(below)
    return files.select(*columns) if out is None else out


def folder_sketch_rollup(nodes: DataFrame, relations: DataFrame, lg: int = LG) -> DataFrame:
    """(scope, path, depth, calls_in, callers, calls_out, callees): calls into and out of every file and
    folder (exact) and the estimated numbers of distinct functions at their other ends."""
    keys = [*SCOPE, "path", "depth"]
    zero = F.lit(0).cast("long")
    side = lambda what, calls: rollup(file_sketches(nodes, relations, what, lg)).select(
        *keys, F.col("calls").alias(calls), F.hll_sketch_estimate("sketch").alias(what))
    both = side("callers", "calls_in").join(side("callees", "calls_out"), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(c, zero).alias(c) for c in (
        "calls_in", "callers", "calls_out", "callees")])


def exact_rollup(nodes: DataFrame, relations: DataFrame, what: str) -> DataFrame:
    """(scope, path, exact): distinct callers or callees of every file and folder, counted.

    Each call is repeated for every folder above its file and made distinct before it is counted, so no
    folder's functions are gathered in one task."""
    calls = _calls(nodes, relations, what).distinct()
    folders = F.when(F.col("path") == ROOT, F.array(F.lit(ROOT))).otherwise(
        F.array_prepend(ancestors("path"), F.lit(ROOT)))
    return calls.withColumn("path", F.explode(folders)).distinct().groupBy(*SCOPE, "path").agg(
        F.count(F.lit(1)).alias("exact"))


def within(estimate: Column, exact: Column, bound: float = BOUND) -> Column:
    """Does an estimate keep to the stated error (small counts: to one)?"""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * bound)
