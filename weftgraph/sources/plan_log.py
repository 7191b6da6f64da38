"""The given event stream read as plans, ordered edit operations, approvals and policies.

Each user keeps one plan; every event is one operation, in time order.  Operations refer to
order functions, planned functions and relations, some of them missing, repeated or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.paging import prefix_ranks
from ..staging import stage, table
from .star_graph import PAIR, PROJECT, customer_files, publish

_KEPT: dict[tuple, DataFrame] = {}


def _once(spark, sf, name, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = stage(build(), name)
    return _KEPT[key]


def _s(name):
    return F.col(name).cast("string")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their plan and zero-based position; ranked per plan and hour, so that a plan
    holding much of the log is not ranked in one task."""
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("plan:"), _s("user_id")).alias("plan_id"), "event_id", "ts", "user_id",
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ranked = prefix_ranks(
        rows, ["plan_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "rank"
    )
    return ranked.withColumn("op_index", F.col("rank") - 1).drop("rank")


def plan_operations(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "plan-operations", lambda: _plan_operations(spark, sf))


def _plan_operations(spark, sf) -> DataFrame:
    homes = table(spark, sf, "orders").join(
        customer_files(spark, sf).select("c_custkey", "file_path"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).select(F.col("o_orderkey").alias("event_id"), F.col("file_path").alias("home"))
    facts = publish(spark, sf, PAIR, ("calls",))[1].filter(
        (F.col("snapshot_id") == "base") & (F.col("type") == "calls")
    ).groupBy("source_id").agg(
        F.min("id").alias("first_call"),
        F.min(F.when(F.col("resolution") == "resolved", F.col("target_id"))).alias("first_target"),
    )
    fn_event = F.concat(F.lit("function:o"), _s("event_id"))
    rows = (
        events(spark, sf).join(homes, "event_id", "left")
        .withColumn("own", fn_event)
        .join(facts.withColumnRenamed("source_id", "own"), "own", "left")
    )
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    own, fn_k = F.col("own"), F.concat(F.lit("function:o"), _s("k"))
    shared_temp = F.concat_ws(":", F.lit("temp"), F.concat(F.lit("u"), _s("user_id")), _s("k"))
    shared_rel = F.concat_ws(":", F.lit("rel"), F.concat(F.lit("u"), _s("user_id")), _s("k"))
    near = F.when(value < 25, fn_k).otherwise(own)
    removes_node = (kind == "error") & (value < 60)
    removes_edge = (kind == "error") & (value >= 60)
    add, move, rel, note = (kind == t for t in ("signup", "click", "purchase", "view"))
    return rows.select(
        F.lit(PROJECT).alias("project_id"), F.lit("base").alias("snapshot_id"),
        "plan_id", "op_index", "ts",
        F.when(add, "add_function").when(move, "move_function").when(rel, "add_relation")
        .when(removes_node, "remove_function").when(removes_edge, "remove_relation")
        .otherwise("annotate").alias("kind"),
        F.when(add, F.when(k < 8, own).when(k < 30, shared_temp)
               .otherwise(F.concat(F.lit("temp:"), _s("event_id")))).alias("temp_id"),
        F.when(add, F.when(k < 30, F.concat(F.lit("new"), _s("k")))
               .otherwise(F.concat(F.lit("o"), _s("event_id")))).alias("name"),
        F.when(add, F.when((k >= 30) & F.col("home").isNotNull(), F.col("home")).otherwise(
            F.concat(F.lit("r1/./x/../new"), _s("k"), F.lit(".py"))))
        .when(move, F.when((k < 40) & F.col("home").isNotNull(),
                           F.concat(F.lit("./"), F.col("home")))
              .otherwise(F.concat(F.lit("moved/m"), _s("k"), F.lit(".py")))).alias("file_path"),
        F.when(add & (k >= 60), "python").alias("language"),
        F.lit(None).cast("string").alias("signature"),
        F.when(move | removes_node, near).alias("node_id"),
        F.when(removes_edge, F.when(k < 20, shared_rel).otherwise(
            F.coalesce("first_call", F.concat(F.lit("missing:"), _s("event_id")))))
        .when(rel, F.when(k < 15, shared_rel).otherwise(
            F.concat(F.lit("rel:"), _s("event_id")))).alias("relation_id"),
        F.when(rel, F.when(k < 30, shared_temp).otherwise(own)).alias("source_id"),
        F.when(rel, F.when(k < 40, F.concat(F.lit("external:p"), _s("k")))
               .when(k < 60, fn_k).when(k < 70, F.concat(F.lit("file:c"), _s("k")))
               .otherwise(F.coalesce("first_target", F.concat(F.lit("missing:"), _s("k")))))
        .when(note, F.when(k < 30, shared_rel).otherwise(own)).alias("target_id"),
        F.when(note, F.concat(F.lit("note "), _s("k"))).alias("text"),
    )


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per user; the first event's type decides a foreign project or an old baseline."""
    first = F.min_by("event_type", F.struct("ts", "event_id"))
    return _once(spark, sf, "plans", lambda: table(spark, sf, "events").groupBy("user_id").agg(
        first.alias("first"), F.countDistinct("event_type").alias("revision"),
        F.max("ts").alias("updated_at"),
    ).select(
        F.when(F.col("first") == "error", "other").otherwise(PROJECT).alias("project_id"),
        F.concat(F.lit("plan:"), _s("user_id")).alias("id"), "revision",
        F.concat(F.lit("Plan "), _s("user_id")).alias("title"),
        F.when(F.col("first") == "signup", "").otherwise(F.col("first")).alias("description"),
        F.lit("base").alias("baseline_snapshot_id"),
        F.when(F.col("first") == "view", "hash-old").otherwise("hash-base")
        .alias("baseline_content_hash"), "updated_at",
    ))


def policies(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's folder must not depend on its own region; each region has a broken policy."""
    nations = table(spark, sf, "nation").select(
        F.lit(PROJECT).alias("project_id"),
        F.concat(F.lit("pol:n"), _s("n_nationkey")).alias("id"),
        F.concat(F.lit("r"), _s("n_regionkey"), F.lit("\\n"), _s("n_nationkey"), F.lit("/"))
        .alias("path_prefix"),
        F.col("n_name").alias("purpose"),
        F.array(F.concat(F.lit("r"), _s("n_regionkey"), F.lit("/")), F.lit("pkg:1"),
                F.lit("moved")).alias("forbidden"),
    )
    regions = table(spark, sf, "region").select(
        F.lit(PROJECT).alias("project_id"),
        F.concat(F.lit("pol:r"), _s("r_regionkey")).alias("id"),
        F.concat(F.lit("../r"), _s("r_regionkey")).alias("path_prefix"),
        F.col("r_name").alias("purpose"), F.array(F.lit("lib")).alias("forbidden"),
    )
    return nations.unionByName(regions)
