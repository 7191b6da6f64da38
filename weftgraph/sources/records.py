"""Keyed records as an append-only change log: current view, batches, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["kind", "id"]


def records_current(log: DataFrame) -> DataFrame:
    """Live value per (kind, id) with the position of its insertion.

    ``log``: kind, id, seq, action (put|delete), value.  An update keeps the original place; a
    record deleted and put again is inserted anew.  Only aggregates per key, no sorted groups.
    """
    last_delete = log.filter(F.col("action") == "delete").groupBy(*KEY).agg(
        F.max("seq").alias("deleted_at"))
    alive = log.filter(F.col("action") == "put").join(last_delete, KEY, "left").filter(
        F.col("deleted_at").isNull() | (F.col("seq") > F.col("deleted_at")))
    return alive.groupBy(*KEY).agg(
        F.min("seq").alias("position"), F.max_by("value", "seq").alias("value"),
        F.max("seq").alias("changed_at"))


def records_apply(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a batch of changes; compaction is ``records_current`` of the result."""
    return log.unionByName(batch)


def freeze_legacy_registry(log: DataFrame, approvals: DataFrame) -> DataFrame:
    """Migration: the log in its order plus one frozen registry row per existing approval id."""
    frozen = approvals.select(
        F.lit("legacy-approval").alias("kind"), "id", F.lit(0).cast("bigint").alias("seq"),
        F.lit("put").alias("action"), F.lit("frozen").alias("value"))
    return log.unionByName(frozen)


def load_snapshot(requests: DataFrame, projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current snapshot of each requested project, or NOT_FOUND."""
    pointer = projects.select("project_id", F.col("current_snapshot_id").alias("snapshot_id"))
    owned = snapshots.select("project_id", "snapshot_id", "content_hash")
    return requests.join(pointer, "project_id", "left").join(
        owned, ["project_id", "snapshot_id"], "left").select(
        *requests.columns, "snapshot_id", "content_hash",
        F.when(F.col("content_hash").isNull(), "NOT_FOUND").otherwise("ok").alias("status"))


def publish_snapshot(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-if-absent of immutable snapshots: inserted, unchanged or collision.

    A batch that repeats an id keeps its earliest row; a repeat with another hash collides.
    """
    keys = ["project_id", "snapshot_id"]
    known = existing.select(*keys, F.col("content_hash").alias("known_hash"))
    first = incoming.groupBy(*keys).agg(
        F.min_by("content_hash", "seq").alias("first_hash"), F.min("seq").alias("first_seq"))
    rows = incoming.join(known, keys, "left").join(first, keys)
    expected = F.coalesce("known_hash", "first_hash")
    return rows.select(
        *keys, "seq", "content_hash",
        F.when(F.col("content_hash") != expected, "collision")
        .when(F.col("known_hash").isNotNull() | (F.col("seq") > F.col("first_seq")), "unchanged")
        .otherwise("inserted").alias("outcome"))


def project_pointers(outcomes: DataFrame) -> DataFrame:
    """Pointer rows after a publish: the last accepted snapshot of each project."""
    ok = outcomes.filter(F.col("outcome") != "collision")
    return ok.groupBy("project_id").agg(
        F.max_by("snapshot_id", "seq").alias("current_snapshot_id"))
