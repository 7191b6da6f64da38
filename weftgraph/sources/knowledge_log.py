"""The given events and customers read as notes, their changes, approvals and structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import table
from .plan_log import _once, _s
from .star_graph import PAIR, PROJECT, customer_files, publish


def _note_events(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("note:u"), _s("user_id"), F.lit(":"),
                 F.floor(k / 10).cast("string")).alias("id"),
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
    )


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """One note per user and tens group; its first event decides text and binding."""
    return _once(spark, sf, "notes", lambda: _notes(spark, sf))


def _notes(spark, sf) -> DataFrame:
    row = F.struct("event_id", "ts", "user_id", "event_type", "value", "k")
    first = _note_events(spark, sf).groupBy("id").agg(
        F.min_by(row, "event_id").alias("f"), F.max_by(row, "event_id").alias("l")
    )
    homes = table(spark, sf, "orders").join(
        customer_files(spark, sf).select("c_custkey", "file_path"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).select(F.col("o_orderkey").alias("event_id"), F.col("file_path").alias("home"),
             _s("o_custkey").alias("cust"))
    facts = publish(spark, sf, PAIR, ("calls",))[1].filter(
        (F.col("snapshot_id") == "base") & (F.col("type") == "calls")
    ).groupBy("source_id").agg(F.min("id").alias("first_call"))
    rows = first.select(
        "id", "f.*", F.col("l.event_type").alias("last_type"), F.col("l.ts").alias("last_ts")
    ).join(homes, "event_id", "left").withColumn(
        "own", F.concat(F.lit("function:o"), _s("event_id"))
    ).join(facts.withColumnRenamed("source_id", "own"), "own", "left")
    kind = F.col("event_type")
    bound = kind != "signup"
    target_kind = F.when(
        (F.col("k") >= 70) & F.col("first_call").isNotNull(), "relation").otherwise("node")
    target = (
        F.when((F.col("k") >= 70) & F.col("first_call").isNotNull(), F.col("first_call"))
        .when((F.col("k") < 10) & F.col("cust").isNotNull(),
              F.concat(F.lit("file:c"), F.col("cust")))
        .otherwise(F.col("own"))
    )
    return rows.select(
        F.when(F.col("value") > 200, "other").otherwise(PROJECT).alias("project_id"), "id",
        F.lit(1).cast("bigint").alias("revision"),
        F.concat(F.lit("note "), _s("k")).alias("text"),
        F.concat(F.lit("user "), _s("user_id")).alias("author"),
        F.when(F.col("value") < 20, "agent").otherwise("user").alias("source"),
        (F.col("k") >= 50).alias("is_constraint"),
        F.when(bound, F.when(kind == "error", "orphan").otherwise("bound")).alias("binding_state"),
        F.when(bound, target_kind).alias("target_kind"), F.when(bound, target).alias("target_id"),
        F.when(bound, "base").alias("selected_snapshot_id"),
        F.when(bound, F.concat(F.lit("o"), _s("event_id"))).alias("last_label"),
        F.when(bound, F.coalesce("home", F.lit("gone/x.py"))).alias("last_path"),
        F.when(bound & (target_kind == "node"),
               F.when((F.col("k") < 10) & F.col("cust").isNotNull(), "file")
               .otherwise("function")).alias("last_node_kind"),
        F.when(kind == "error", "base").alias("orphaned_at"),
        F.col("ts").alias("created_at"), F.col("last_ts").alias("updated_at"),
        F.when(F.col("last_type") == "error", F.col("last_ts")).alias("deleted_at"),
        F.col("event_id").alias("created_seq"),
    )


def note_changes(spark: SparkSession, sf: str) -> DataFrame:
    """All later events of a note as revision-checked changes, ordered by ``seq``."""
    first = notes(spark, sf).select("id", "created_seq")
    action = (
        F.when(F.col("event_type").isin("signup", "click"), "edit")
        .when(F.col("event_type") == "purchase", "bind")
        .when(F.col("event_type") == "view", "detach").otherwise("delete")
    )
    return _note_events(spark, sf).join(first, "id").filter(
        F.col("event_id") > F.col("created_seq")
    ).select(
        "id", F.col("event_id").alias("seq"), action.alias("action"),
        (F.floor(F.col("value") / 40) + 1).alias("expected"),
        F.when(action == "edit", F.concat(F.lit("note "), _s("k"))).alias("text"),
        F.when(action == "bind", F.concat(F.lit("function:o"), _s("event_id"))).alias("target_id"),
        F.col("ts").alias("at"),
    )


def approvals(spark: SparkSession, sf: str, plans: DataFrame, knowledge_hash: DataFrame) -> DataFrame:
    """View events as approvals of the user's plan, some damaged, stale or without context.

    ``plans`` carries ``semantic_hash``; ``knowledge_hash`` one row per project.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        F.concat(F.lit("app:"), _s("event_id")).alias("id"),
        F.concat(F.lit("plan:"), _s("user_id")).alias("plan_id"),
        F.least(F.floor(k / 10) + 1, F.lit(5)).alias("revision"), F.date_trunc("day", "ts").alias("approved_at"),
        F.col("event_id").alias("insertion"), "value", k.alias("k"),
    )
    mine = plans.select("plan_id", "project_id", "semantic_hash", "baseline_snapshot_id",
                        "baseline_content_hash")
    rows = rows.join(mine, "plan_id").join(knowledge_hash, "project_id", "left")
    return rows.select(
        "id", "plan_id", "project_id", "revision", "approved_at", "insertion",
        F.when(F.col("value") < 100, F.col("semantic_hash")).otherwise("bad")
        .alias("semantic_hash"),
        "baseline_snapshot_id", "baseline_content_hash",
        (F.col("k") >= 20).alias("has_context"),
        F.when(F.col("k") >= 20, F.when(F.col("value") < 60, F.col("knowledge_hash"))
               .otherwise("old")).alias("knowledge_hash"),
        # The frozen copy of the plan: damaged copies disagree about the revision.
        F.when((F.col("value") > 80) & (F.col("value") < 100), F.col("revision") + 1)
        .otherwise(F.col("revision")).alias("frozen_revision"),
        F.col("semantic_hash").alias("frozen_hash"),
        # The hash of the stored context: one range of contexts was altered afterwards.
        F.when(F.col("k") >= 20, F.when(F.col("value") < 50, F.col("knowledge_hash"))
               .when(F.col("value") >= 60, "old").otherwise("altered")).alias("context_hash"),
        (F.col("k") < 15).alias("in_registry"),
    )


def structure_files(spark: SparkSession, sf: str) -> DataFrame:
    """One structure document per customer; the market segment decides its damage."""
    key, nation = _s("c_custkey"), _s("c_nationkey")
    segment = F.col("c_mktsegment")
    folder = lambda path, purpose: F.concat(
        F.lit('{"path":"'), path, F.lit('","purpose":"'), purpose,
        F.lit('","allowed":["b","a","b"],"note":1}'))
    second = (
        F.when(segment == "MACHINERY", F.concat(F.lit("../n"), nation))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("./src//c"), key))
        .otherwise(F.concat(F.lit("lib/n"), nation))
    )
    version = F.when(segment == "FURNITURE", "2").otherwise("1")
    twice = F.when(segment == "AUTOMOBILE", F.lit('"folders":[],')).otherwise("")
    rules = F.when(segment == "FURNITURE", F.lit('{}')).otherwise(F.concat(
        F.lit('[{"from":"src/**","mustNotImport":["lib","lib","app"],"reason":"c'), key,
        F.lit('"}]')))
    legacy = F.concat(
        F.lit('{"schemaVersion":1,"legacyPathPolicies":[{"id":"pol:n'), nation,
        F.lit('","pathPrefix":"lib/","purpose":"p","forbiddenDependencies":["z/","a"]}]}'))
    text = F.concat(
        F.lit('{"schemaVersion":'), version, F.lit(","), twice, F.lit('"folders":['),
        folder(F.concat(F.lit("src/c"), key, F.lit("/")), F.col("c_name")), F.lit(","),
        folder(second, F.lit("shared")), F.lit('],"dependencyRules":'), rules,
        F.lit(',"x-graph":'), legacy, F.lit("}"),
    )
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), key).alias("project_id"), text.alias("text"),
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
    )
