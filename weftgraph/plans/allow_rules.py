"""Allowed and forbidden references with reasoned exceptions, by longest prefix at both ends.

A rule names a folder (or file) for the source and one for the target; ``.`` is everything.  Of the
rules that hold for a reference the most specific decides: most path segments in both prefixes
together, then in the source prefix.  Among equally specific ones an exception goes first; an allowing
and a forbidding one without an exception are a conflict, which is reported and treated as forbidden.
An exception needs a reason.

References collapse to pairs of paths first.  A pair meets rules by equality on its exploded ancestors,
source side first (only prefixes that some rule has go on), so the work grows with depth, never with
pairs times rules; ``.`` would be a hot key, so rules are copied to SALTS and pairs dealt over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ancestors, normalize_repo_path
from ..schemas import SCOPE

KINDS = ("allow", "forbid", "exception")
ROOT = "."
SALTS = 32


def rule_issues(rules: DataFrame) -> DataFrame:
    """(project_id, rule_id, code): rules that do not take part."""
    bad = lambda c: F.col(c).isNull() | (
        (F.col(c) != ROOT) & ~normalize_repo_path(c).eqNullSafe(F.col(c)))
    code = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "UNKNOWN_KIND")
        .when(bad("source_prefix"), "INVALID_SOURCE_PREFIX")
        .when(bad("target_prefix"), "INVALID_TARGET_PREFIX")
        .when((F.col("kind") == "exception") & (F.trim(F.coalesce("reason", F.lit(""))) == ""),
              "MISSING_REASON"))
    return rules.select("project_id", "rule_id", code.alias("code")).filter(F.col("code").isNotNull())


def _depth(column: str) -> Column:
    return F.when(F.col(column) == ROOT, 0).otherwise(F.size(F.split(column, "/")))


def _above(column: str) -> Column:
    return F.array_prepend(ancestors(column), F.lit(ROOT))


def path_pairs(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scope, source_path, target_path, references, evidence) of resolved references between files."""
    where = nodes.filter(F.col("file_path").isNotNull()).select(
        *SCOPE, F.col("id").alias("target_id"), F.col("file_path").alias("target_path"))
    return relations.filter(
        (F.col("resolution") == "resolved") & (F.col("type") != "contains")).join(
        where, [*SCOPE, "target_id"]).groupBy(
        *SCOPE, F.col("evidence_path").alias("source_path"), "target_path").agg(
        F.count(F.lit(1)).alias("references"), F.min("id").alias("evidence"))


def decide(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """``pairs`` with verdict (allowed, forbidden, excepted, conflict, unruled), rule_id, other_id
    (the allowing rule of a conflict) and reason."""
    valid = rules.join(rule_issues(rules), ["project_id", "rule_id"], "left_anti")
    one = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("rule_id", "reason")))
    at = ["project_id", "source_prefix", "target_prefix"]
    # One row for each pair of prefixes, whatever the number of rules there.
    merged = valid.groupBy(*at).agg(*(one(k).alias(k) for k in KINDS)).withColumn(
        "spec", F.struct((_depth("source_prefix") + _depth("target_prefix")).alias("both"),
                         _depth("source_prefix").alias("source")))
    copies = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    starts = copies.select("project_id", "source_prefix", "salt").distinct()
    key = [*SCOPE, "source_path", "target_path"]
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    sources = pairs.select(*key, salt.alias("salt"), F.explode(_above("source_path")).alias(
        "source_prefix")).join(starts, ["project_id", "source_prefix", "salt"], "left_semi")
    met = sources.withColumn("target_prefix", F.explode(_above("target_path"))).join(
        copies, [*at, "salt"])
    best = met.groupBy(*key).agg(F.max_by(F.struct(*KINDS), "spec").alias("r"))
    r = F.col("r")
    both = r["allow"].isNotNull() & r["forbid"].isNotNull()
    verdict = (F.when(r.isNull(), "unruled").when(r["exception"].isNotNull(), "excepted")
               .when(both, "conflict").when(r["forbid"].isNotNull(), "forbidden")
               .otherwise("allowed"))
    rule = F.coalesce(r["exception"], r["forbid"], r["allow"])
    return pairs.join(best, key, "left").select(
        *pairs.columns, verdict.alias("verdict"), rule["rule_id"].alias("rule_id"),
        F.when((F.col("r.exception").isNull()) & both, r["allow"]["rule_id"]).alias("other_id"),
        rule["reason"].alias("reason"))
