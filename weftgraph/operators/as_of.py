"""What was in force at a time: as-of joins over logs of events, for any number of questions at once.

Questions and events of a key are united and walked in order of time inside cells (a key and a span of
time), so a key with a third of all events is many tasks; a small table of cell ends carries the last
value, or the sum so far, into each cell.  Before that, events of one moment are combined to one row and
questions of one moment are asked once.  Spans are chosen from one aggregate so that a cell holds about
``per_cell`` rows of an evenly filled table.

An event at the very time of a question counts.  Of events at one moment the greatest ``tie`` holds.
Null keys are a key like any other; events without a time never hold, questions without one get nothing
(null values, zero sums).  Repeated questions are all answered, repeated events change nothing for ``last_as_of``
and count as often as they stand for ``sums_as_of``.  Empty tables give empty answers or unanswered questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

#: Rows of an evenly filled cell.
PER_CELL = 10_000


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _span(moments: DataFrame, per_cell: int) -> int:
    """Length of a cell in microseconds, from the number of moments and their range."""
    r = moments.agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi")).first()
    return max(1, (r["hi"] - r["lo"]) // max(1, r["n"] // per_cell) + 1) if r["n"] else 1


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on equal ``names``, null being equal to null; the columns of the left stay."""
    renamed = right.withColumnsRenamed({n: f"_{n}_" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_{n}_")) for n in names]
    return left.join(renamed, on, how).drop(*[f"_{n}_" for n in names])


def _walk(asks: DataFrame, events: DataFrame, keys: list[str], inside, carried, per_cell: int) -> DataFrame:
    """``asks`` (keys, _t) with the columns ``inside`` a cell and ``carried`` into it.

    ``events`` has (keys, _t, _e); ``inside(window)`` and ``carried(window)`` are the running value of _e
    over the cell's rows and over the ends of earlier cells, which ``carried.end`` aggregates."""
    rows = events.unionByName(asks.withColumn("_e", F.lit(None)).select(*events.columns).withColumn(
        "_ask", F.lit(True)), allowMissingColumns=True).withColumn(
        "_ask", F.coalesce("_ask", F.lit(False)))
    rows = rows.withColumn("_cell", F.floor(F.col("_t") / _span(rows, per_cell)))
    cell = [*keys, "_cell"]
    ends = rows.filter(~F.col("_ask")).groupBy(*cell).agg(carried[0].alias("_end"))
    all_cells = rows.select(*cell).distinct()
    ends = _same(all_cells, ends, cell, "left")
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", carried[1](F.col("_end")).over(before)).drop("_end")
    here = Window.partitionBy(*cell).orderBy("_t", "_ask").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    walked = rows.withColumn("_here", inside(F.col("_e")).over(here)).filter("_ask")
    return _same(walked.drop("_e", "_ask"), ends, cell, "left").drop("_cell")


def _ask(questions: DataFrame, keys: list[str], time: str) -> tuple[DataFrame, DataFrame]:
    timed = questions.withColumn("_t", _micros(F.col(time)))
    return timed, timed.filter(F.col("_t").isNotNull()).select(*keys, "_t").distinct()


def last_as_of(questions: DataFrame, events: DataFrame, keys: list[str], time: str, tie: str,
               values: list[str], per_cell: int = PER_CELL) -> DataFrame:
    """``questions`` (keys, ``time``, ...) with the ``values`` of the last event of their key at or
    before their time; null where there is none.  ``events`` has (keys, ``time``, ``tie``, values)."""
    timed, asks = _ask(questions, keys, time)
    held = events.withColumn("_t", _micros(F.col(time))).filter(F.col("_t").isNotNull()).groupBy(
        *keys, "_t").agg(F.max_by(F.struct(*values), F.col(tie)).alias("_e"))
    last = lambda c: F.last(c, ignorenulls=True)
    answers = _walk(asks, held, keys, last, (F.max_by("_e", "_t"), last), per_cell).select(
        *keys, "_t", F.coalesce("_here", "_before").alias("_v"))
    return _same(timed, answers, [*keys, "_t"], "left").select(
        *questions.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def sums_as_of(questions: DataFrame, events: DataFrame, keys: list[str], time: str, sums: list[str],
               per_cell: int = PER_CELL) -> DataFrame:
    """``questions`` with the sums of the numbers ``sums`` (null: 0) over all events of their key at or
    before their time, as decimals of 38 digits; 0 where there is none."""
    wide = "decimal(38,0)"
    out = questions
    timed, asks = _ask(questions, keys, time)
    held = events.withColumn("_t", _micros(F.col(time))).filter(F.col("_t").isNotNull())
    zero = F.lit(0).cast(wide)
    total = lambda c: F.sum(c)
    timed_columns = timed.columns
    for name in sums:
        moments = held.groupBy(*keys, "_t").agg(
            F.sum(F.coalesce(F.col(name).cast(wide), zero)).cast(wide).alias("_e"))
        answers = _walk(asks, moments, keys, total, (F.sum("_e"), total), per_cell).select(
            *keys, "_t", (F.coalesce("_here", zero) + F.coalesce("_before", zero)).cast(wide).alias(name))
        timed = _same(timed, answers, [*keys, "_t"], "left").withColumn(name, F.coalesce(name, zero))
        timed_columns = [*timed_columns, name]
    return timed.select(*out.columns, *sums)


def changes_of(log: DataFrame, record: list[str], time: str, tie: str, content: str,
               deleted: str, per_cell: int = PER_CELL) -> DataFrame:
    """A log of record versions as what each moment of a record adds: (``record``, time, number, words)
    where sums over ``number`` count the records in force and sums over ``words`` are an order-free
    digest of them.  The last version of a moment counts; a deleted one is not in force.

    The version before is the one as of a microsecond earlier, so a record with very many versions is
    walked in cells as well."""
    words = F.conv(F.substring(F.md5(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in record], F.coalesce(F.col(content), F.lit("")))), 1, 15),
        16, 10).cast("decimal(38,0)")
    state = F.when(F.col(deleted), F.struct(F.lit(0).cast("decimal(38,0)").alias("number"),
                                            F.lit(0).cast("decimal(38,0)").alias("words"))).otherwise(
        F.struct(F.lit(1).cast("decimal(38,0)").alias("number"), words.alias("words")))
    versions = log.filter(F.col(time).isNotNull()).withColumn("_s", state).groupBy(*record, time).agg(
        F.max_by("_s", F.col(tie)).alias("_s"))
    versions = stage(versions.withColumn("_at", F.col(time)), "as-of-versions")
    asked = versions.withColumn(time, F.col(time) - F.expr("INTERVAL 1 MICROSECOND"))
    earlier = versions.select(*record, time, F.lit(0).alias("_tie"), F.col("_s").alias("_p"))
    pairs = last_as_of(asked, earlier, record, time, "_tie", ["_p"], per_cell)
    delta = lambda c: F.col(f"_s.{c}") - F.coalesce(
        F.col(f"_p.{c}"), F.lit(0).cast("decimal(38,0)"))
    return pairs.select(*record, F.col("_at").alias(time), delta("number").alias("number"),
                        delta("words").alias("words"))


def plan_state_as_of(questions: DataFrame, plans: DataFrame, notes: DataFrame, policies: DataFrame,
                     per_cell: int = PER_CELL) -> DataFrame:
    """``questions`` (project_id, plan_id, at, ...), such as approvals and publishes, with what was in
    force then: ``plan_event`` and ``plan_content`` of the plan, and of the project's notes and policies
    their number and a digest that is equal exactly for equal sets (but for collisions).

    ``plans`` has (plan_id, at, event_id, content), the logs (project_id, id, at, event_id, content,
    deleted)."""
    plan = plans.select("plan_id", "at", "event_id", F.col("event_id").alias("plan_event"),
                        F.col("content").alias("plan_content"))
    out = last_as_of(questions, plan, ["plan_id"], "at", "event_id", ["plan_event", "plan_content"],
                     per_cell)
    for name, log in (("notes", notes), ("policies", policies)):
        moves = changes_of(log, ["project_id", "id"], "at", "event_id", "content", "deleted",
                           per_cell).select(
            "project_id", "at", F.col("number").alias(name), F.col("words").alias(f"{name}_digest"))
        out = sums_as_of(out, moves, ["project_id"], "at", [name, f"{name}_digest"], per_cell)
        out = out.withColumn(name, F.col(name).cast("bigint")).withColumn(
            f"{name}_digest", F.col(f"{name}_digest").cast("string"))
    return out
