"""Structured Streaming around the batch operators.

Sinks and checkpoints live in the shared stage folder; triggers are ``availableNow`` so that a
stream over files ends when its input is consumed, and runs on with any other trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..staging import stage_root


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over parquet files that match ``path``, with the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run(stream: DataFrame, base: str, mode: str = "append"):
    """Run a stream into the parquet table ``base``/data until its input is consumed; its query."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/data")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream into a parquet table until its input is consumed and read the table back."""
    spark = stream.sparkSession
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    run(stream, base, mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_each_batch(stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame],
                   schema) -> DataFrame:
    """Apply a batch operator to every micro-batch; a batch written twice is written once.

    Each batch owns one folder, overwritten when the batch is replayed after a failure.
    """
    spark = stream.sparkSession
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/data").drop("batch")


def snapshot_facts(lines: DataFrame) -> DataFrame:
    """Call facts of arriving lines: stateless, so an append sink of any size works."""
    flag = F.col("l_returnflag")
    return lines.select(
        F.concat(F.lit("function:o"), F.col("l_orderkey").cast("string")).alias("source_id"),
        F.when(flag == "N", F.concat(F.lit("function:s"), F.col("l_suppkey").cast("string"),
                                     F.lit("p"), F.col("l_partkey").cast("string")))
        .when(flag == "R", F.concat(F.lit("external:p"), F.col("l_partkey").cast("string")))
        .alias("target_id"),
        F.when(flag == "N", "resolved").when(flag == "R", "external").otherwise("unresolved")
        .alias("resolution"),
        F.col("l_linenumber").cast("bigint").alias("line"),
    )


def dedupe_mutations(requests: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """One request per mutation id within the watermark delay."""
    timed = requests.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def change_rate(events: DataFrame, time: str, delay: str, window: Column, *keys: str) -> DataFrame:
    """Counts per time window and keys; later rows than the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("changes")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("start"),
             F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "changes")


REFRESH = ("project_id string, first_second bigint, last_second bigint, due_second bigint, "
           "changes bigint")
OPEN = ("first bigint, last bigint, changes bigint, waiting array<struct<second: bigint, n: bigint>>")


def _per_second(batches):
    """Changes of an Arrow batch as one row a project and second, before they are shuffled."""
    for batch in batches:
        yield batch.groupby(["project_id", "at"], as_index=False).agg(changes=("changes", "sum"))


def debounce(changes: DataFrame, time: str, delay: str, quiet: int, longest: int) -> DataFrame:
    """Refreshes (project_id, first_at, last_at, refresh_at, changes) of a stream of changes.

    Changes of a project wait together until none came for ``quiet`` seconds, but never longer than
    ``longest`` seconds after the first of them; the refresh is due at the earlier of both, and a change
    at or after that starts the next one.  Times count in whole seconds.

    Tasks combine changes to one row a project and second before the shuffle, so a project with a third
    of all changes is no larger than any busy one.  The state of a project is its open refresh and the
    seconds that the watermark has not passed yet (bounded by ``delay``); those are folded in order of
    time, so the result does not depend on how rows fall into batches.  One timer a project wakes it at
    the next second to fold or when its refresh is due.  Rows later than ``delay`` are dropped, and
    ``late_rows`` counts them, combined ones once; rows without project or time take no part."""
    import pandas as pd

    columns = [f.split()[0] for f in REFRESH.split(", ")]

    def due(first: int, last: int) -> int:
        return min(last + quiet, first + longest)

    def step(key, batches, state):
        first, last, count, waiting = state.get if state.exists else (None, None, 0, [])
        seconds = {}
        for second, n in waiting:
            seconds[second] = n
        for b in batches:
            for second, n in zip(b["second"].tolist(), b["changes"].tolist()):
                seconds[second] = seconds.get(second, 0) + n
        now, out = state.getCurrentWatermarkMs(), []

        def fire():
            out.append((key[0], first, last, due(first, last), count))

        for second in sorted(t for t in seconds if (t + 1) * 1000 <= now):
            if first is not None and second >= due(first, last):
                fire()
                first, count = None, 0
            first = second if first is None else first
            last, count = second, count + seconds.pop(second)
        if first is not None and due(first, last) * 1000 <= now:
            fire()
            first, last, count = None, None, 0
        if first is None and not seconds:
            state.remove()
        else:
            state.update((first, last, count, sorted(seconds.items())))
            wake = [(min(seconds) + 1)] if seconds else []
            state.setTimeoutTimestamp(1000 * min(wake + ([due(first, last)] if first is not None else [])))
        yield pd.DataFrame(out, columns=columns)

    at = F.date_trunc("second", F.col(time).cast("timestamp"))
    rows = changes.filter(F.col("project_id").isNotNull() & F.col(time).isNotNull()).select(
        F.col("project_id").cast("string").alias("project_id"), at.alias("at"),
        F.lit(1).cast("long").alias("changes"))
    combined = rows.mapInPandas(_per_second, rows.schema).withWatermark("at", delay)
    fired = combined.withColumn("second", F.unix_timestamp("at")).groupBy(
        "project_id").applyInPandasWithState(step, REFRESH, OPEN, "append", "EventTimeTimeout")
    moment = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return fired.select(
        "project_id", moment("first_second").alias("first_at"), moment("last_second").alias("last_at"),
        moment("due_second").alias("refresh_at"), "changes")


def late_rows(query) -> int:
    """Rows that the stateful operators of a finished streaming query dropped as late."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for op in progress["stateOperators"])


def approval_join(changes: DataFrame, approvals: DataFrame, delay: str, within: str) -> DataFrame:
    """(plan_id, revision, change_id, changed_at, approval_id, approved_at): each change of a plan with
    the approvals of its revision that come at most ``within`` after it; without one, null, and such a
    row comes out once the watermarks say that no approval can follow.

    ``changes`` (plan_id, revision, change_id, changed_at) and ``approvals`` (plan_id, revision,
    approval_id, approved_at) are streams, both up to ``delay`` out of order; state is kept for
    ``within`` and ``delay`` only.  A change with a null plan or revision matches nothing; rows without
    a time take no part; repeated rows give repeated rows."""
    left = changes.select("plan_id", "revision", "change_id",
                          F.col("changed_at").cast("timestamp").alias("changed_at"))
    right = approvals.select(F.col("plan_id").alias("of_plan"), F.col("revision").alias("of_revision"),
                             "approval_id", F.col("approved_at").cast("timestamp").alias("approved_at"))
    left = left.filter(F.col("changed_at").isNotNull()).withWatermark("changed_at", delay)
    right = right.filter(F.col("approved_at").isNotNull()).withWatermark("approved_at", delay)
    meets = (F.col("plan_id") == F.col("of_plan")) & (F.col("revision") == F.col("of_revision")) & (
        F.col("approved_at") >= F.col("changed_at")) & (
        F.col("approved_at") <= F.col("changed_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, meets, "left_outer").select(
        "plan_id", "revision", "change_id", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"),
        "approval_id", F.col("approved_at").cast("timestamp_ntz").alias("approved_at"))


MERGE_EVERY = 32  # batches between whole copies of the state


def revision_cas(stream: DataFrame, current: DataFrame, name: str = "cas") -> DataFrame:
    """Outcomes (id, seq, outcome, revision) of a revision-checked change stream.

    Every micro-batch runs the batch operator against the records its changes name, so a record with
    very many changes is aggregated, never gathered.  The state is a log: a batch appends the records
    it changed, and every MERGE_EVERY batches a whole copy, from which later ones read on.  What a
    batch wrote is overwritten when it is replayed.  Refused changes are emitted, never dropped.
    """
    from ..knowledge.annotations import apply_changes

    spark = stream.sparkSession
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    fields = ["id", "revision", "text", "target_id", "deleted"]
    first = current.select(*fields[:-1], F.lit(False).alias("deleted"))
    first.write.parquet(f"{base}/state/version=-1")
    schema = StructType([*first.schema, StructField("version", LongType())])

    def log(batch_id: int) -> DataFrame:
        whole = batch_id - 1 - batch_id % MERGE_EVERY  # the last whole copy before this batch
        return spark.read.schema(schema).parquet(f"{base}/state").filter(
            (F.col("version") >= whole) & (F.col("version") < batch_id))

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max_by(F.struct(*fields[1:]), "version").alias("r")).select(
            "id", "r.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.select("id").distinct()
        before = latest(log(batch_id).join(named, "id", "left_semi"))
        # Deleted records stay in the log as such: later changes of them are refused.
        state, history, refused = apply_changes(
            before.filter(~F.col("deleted")).drop("deleted"), batch)
        out = history.select("id", "seq", F.lit("applied").alias("outcome"), "revision")
        out.unionByName(refused.select(
            "id", "seq", F.lit("conflict").alias("outcome"), F.col("expected").alias("revision"))
        ).write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")
        rows = state.join(history.select("id").distinct(), "id", "left_semi").select(*fields)
        if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
            changed = rows.withColumn("version", F.lit(batch_id).cast("bigint"))
            rows = latest(log(batch_id).unionByName(changed))
        rows.write.mode("overwrite").parquet(f"{base}/state/version={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(CAS_OUT).parquet(f"{base}/data").drop("batch")


CAS_OUT = "id string, seq bigint, outcome string, revision bigint"
