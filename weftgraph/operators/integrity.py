"""Whole-snapshot checks: layout admission and referential integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import NODE_KINDS, RELATION_TYPES, RESOLUTIONS, SCOPE

# Fixed admission limits of the layout view.
LAYOUT_NODES, LAYOUT_RELATIONS, LAYOUT_BYTES = 5000, 20000, 8388608


def json_byte_size(value: Column) -> Column:
    """UTF-8 size of a JSON rendering (null fields omitted)."""
    return F.octet_length(F.to_json(value))


def _array_bytes(total: Column, count: Column) -> Column:
    return total + F.greatest(count - 1, F.lit(0)) + 2


def layout_target(nodes: DataFrame, relations: DataFrame, max_nodes: int = LAYOUT_NODES,
                  max_relations: int = LAYOUT_RELATIONS,
                  max_bytes: int = LAYOUT_BYTES) -> DataFrame:
    """Counts by kind and admission status per snapshot, in one pass over each table."""
    node_json = json_byte_size(F.struct("id", "kind", F.col("parent_id").alias("parentId")))
    by_kind = nodes.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("nodes"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in NODE_KINDS],
        F.sum(node_json).alias("node_bytes"),
    )
    # targetId is nullable, not optional: it is rendered even when null.
    edge_json = json_byte_size(
        F.struct("id", F.col("source_id").alias("sourceId"),
                 F.coalesce("target_id", F.lit("")).alias("targetId"), "type", "resolution")
    ) + F.when(F.col("target_id").isNull(), 2).otherwise(0)
    edges = relations.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("relations"), F.sum(edge_json).alias("edge_bytes")
    )
    both = by_kind.join(edges, SCOPE, "left").na.fill(0)
    size = _array_bytes(F.col("node_bytes"), F.col("nodes")) + _array_bytes(
        F.col("edge_bytes"), F.col("relations")
    )
    reason = (
        F.when(F.col("nodes") > max_nodes, "node_budget")
        .when(F.col("relations") > max_relations, "relation_budget")
        .when(size > max_bytes, "byte_budget")
    )
    return both.select(
        *SCOPE, "nodes", "relations", *NODE_KINDS, size.alias("fact_bytes"),
        F.when(reason.isNull(), "ready").otherwise("rejected").alias("status"),
        reason.alias("reason"),
    )


def integrity_check(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Issue rows (scope, code, id, detail); an empty result means the snapshot is sound."""

    def issue(df, code, ident, detail=F.lit(None).cast("string")):
        return df.select(*SCOPE, F.lit(code).alias("code"), ident.alias("id"),
                         detail.cast("string").alias("detail"))

    col = F.col
    ids = nodes.select(*SCOPE, col("id").alias("end")).distinct()
    node_counts = nodes.groupBy(*SCOPE, "id").agg(F.count(F.lit(1)).alias("n"))
    rel_counts = relations.groupBy(*SCOPE, "id").agg(F.count(F.lit(1)).alias("n"))
    blank = lambda c: c.isNull() | (F.length(F.trim(c)) == 0)
    parts = [
        issue(node_counts.filter(col("n") > 1), "DUPLICATE_NODE", col("id"), col("n")),
        issue(nodes.filter(blank(col("id"))), "BLANK_NODE_ID", col("id"), col("name")),
        issue(nodes.filter(~col("kind").isin(*NODE_KINDS)), "BAD_KIND", col("id"), col("kind")),
        issue(
            nodes.filter(col("parent_id").isNotNull()).withColumn("end", col("parent_id"))
            .join(ids, [*SCOPE, "end"], "left_anti"),
            "UNKNOWN_PARENT", col("id"), col("parent_id"),
        ),
        issue(rel_counts.filter(col("n") > 1), "DUPLICATE_RELATION", col("id"), col("n")),
        issue(relations.filter(blank(col("id"))), "BLANK_RELATION_ID", col("id")),
        issue(
            relations.filter(~col("type").isin(*RELATION_TYPES)
                             | ~col("resolution").isin(*RESOLUTIONS)),
            "BAD_RELATION_ENUM", col("id"), F.concat_ws("/", "type", "resolution"),
        ),
    ]
    for side in ("source_id", "target_id"):
        ends = relations.filter(col(side).isNotNull()).withColumn("end", col(side))
        parts.append(issue(ends.join(ids, [*SCOPE, "end"], "left_anti"), "DANGLING_ENDPOINT",
                           col("id"), col(side)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
