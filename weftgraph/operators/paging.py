"""Bounded pages and budgets per request.

A page never ranks a whole hot group in one task: ``row_number() <= literal`` lets Spark keep
only the first rows of each group before the shuffle (WindowGroupLimit), and totals come from a
separate aggregate that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import PAGE_LIMIT, PAGE_MAX


def check_page(offset: int, limit: int, max_limit: int = PAGE_MAX) -> None:
    for value, low, high in ((offset, 0, 2**53 - 1), (limit, 1, max_limit)):
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError("query bounds must be integers within the supported range")


def check_budget(value: int, low: int, high: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"budget must be an integer in {low}..{high}")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str = "position") -> DataFrame:
    """First ``n`` rows per key group in a total order, with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )


def totals(df: DataFrame, keys: list[str], name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def page(df: DataFrame, keys: list[str], order: list[Column], offset: int = 0,
         limit: int = PAGE_LIMIT, max_limit: int = PAGE_MAX) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of every key group plus the group's ``total``."""
    check_page(offset, limit, max_limit)
    rows = top_n(df, keys, order, offset + limit).filter(F.col("position") > offset)
    return rows.join(totals(df, keys), keys)


def page_wrap(df: DataFrame, keys: list[str], order: list[Column], offset: int = 0,
              limit: int = PAGE_LIMIT) -> DataFrame:
    """The generic page wrapper: truncated when anything lies before or after the page."""
    flag = (F.lit(offset) > 0) | (F.col("total") > offset + limit)
    return page(df, keys, order, offset, limit).withColumn("truncated", flag)


def prefix_ranks(df: DataFrame, keys: list[str], coarse: Column, order: list[Column],
                 rank: str = "position") -> DataFrame:
    """Full 1-based ranks of groups of any size, without one task per group.

    ``coarse`` is a monotone function of the sort order.  Rows are ranked inside each
    (group, coarse) cell and shifted by the counts of the cells before it, so the work of a hot
    group is spread over its cells; only the small table of cell counts is ranked per group.
    """
    cells = df.withColumn("_cell", coarse)
    counts = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = counts.select(
        *keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    ranked = cells.withColumn("_in", F.row_number().over(inside))
    return (
        ranked.join(shift, [*keys, "_cell"])
        .withColumn(rank, (F.col("_in") + F.col("_shift")).cast("bigint"))
        .drop("_cell", "_in", "_shift")
    )


def expand_copies(counted: DataFrame, copies: str, nth: str, block: int = 10000,
                  spread_all: bool = True) -> DataFrame:
    """One row per copy, numbered 1..copies.

    Copies are cut into blocks that are spread over tasks before they are expanded, so a pile of
    copies is not written by a single task.  Without ``spread_all`` only piles of several blocks
    are moved (``counted`` is then read twice: an aggregate's shuffle is reused).
    """
    spark = counted.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col(copies)
    one, size = F.lit(1).cast("bigint"), F.lit(block).cast("bigint")
    piles = counted.filter(n >= 1) if spread_all else counted.filter(n > block)
    blocks = piles.withColumn("_from", F.explode(F.sequence(one, n, size)))
    spread = blocks.repartition(tasks, *counted.columns, "_from").withColumn(
        nth, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (size - 1), n)))
    ).drop("_from")
    if spread_all:
        return spread
    few = counted.filter(n.between(1, block))
    return few.withColumn(nth, F.explode(F.sequence(one, n))).unionByName(spread)
