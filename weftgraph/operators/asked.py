"""Rows that a set of asked keys may concern, found before anything is shuffled.

A join of a whole snapshot with the few ids that plans name moves every node or relation.  ``Asked``
keeps one bit per hashed key, so each task drops nearly all rows that cannot match where it reads them;
the join that follows decides.  Keys never get lost, a chance hit only moves a row too many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import stage

#: Bits at most (2 million words of 64 bits): more keys than a few million let more rows pass.
MOST_BITS = 1 << 27


class Asked:
    """Keys of a frame (all its columns, read twice), as bits of a table of bounded size."""

    def __init__(self, keys: DataFrame):
        wanted, self.bits = 8 * keys.count(), 64
        while self.bits < min(wanted, MOST_BITS):
            self.bits *= 2
        bit = F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))"))
        self.words = stage(
            keys.select(self._bit(keys.columns).alias("_bit"))
            .groupBy(F.shiftright("_bit", 6).alias("_word")).agg(bit.alias("_marks")), "asked")

    def _bit(self, columns):
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def among(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` without most of those whose ``columns`` (in the order of the keys) were not asked.

        Join or aggregate what is left; the optimizer pushes a semi or anti join *of* it below this.
        """
        marked = rows.withColumn("_bit", self._bit(columns)).withColumn(
            "_word", F.shiftright("_bit", 6))
        return marked.join(F.broadcast(self.words), "_word").filter(
            F.getbit("_marks", F.col("_bit").bitwiseAND(63)) == 1).select(*rows.columns)
