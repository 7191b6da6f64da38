"""Ordered listings, substring search and scope listings over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ENTRYPOINT_CAP, NODE_BUDGET, NODE_BUDGET_MAX, SCOPE, SCOPE_EDGE_CAP
from .paging import check_budget, page, top_n, totals
from .postings import NODE, GramIndex, gram_index, matches


def node_order() -> list[Column]:
    return [F.col("name"), F.coalesce(F.col("file_path"), F.lit("")), F.col("id")]


def relation_order() -> list[Column]:
    return [F.col("id")]


def normalize_query(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _found(nodes: DataFrame, requests: DataFrame, index: GramIndex | None) -> DataFrame:
    """(scope, id, name, file_path, q) of all matches: narrow rows."""
    asked = requests.select(*SCOPE, normalize_query(F.col("q")).alias("q")).distinct()
    some = matches(index or gram_index(nodes), asked.filter(F.col("q") != ""))
    every = nodes.filter(F.col("kind") == "function").select(*SCOPE, *NODE).join(
        asked.filter(F.col("q") == ""), SCOPE)
    return some.unionByName(every)


def search_matches(nodes: DataFrame, requests: DataFrame,
                   index: GramIndex | None = None) -> DataFrame:
    """(q, node) matches for distinct normalized queries: q is a substring of a field.

    Queries meet posting lists (``postings``), not functions; the index of the nodes is built when
    none is given.  The empty query matches every function.
    """
    functions = nodes.filter(F.col("kind") == "function")
    found = _found(nodes, requests, index).select(*SCOPE, "id", "q")
    return functions.join(found, [*SCOPE, "id"])


def search_functions(nodes: DataFrame, requests: DataFrame, offset: int = 0,
                     limit: int = 50, index: GramIndex | None = None) -> DataFrame:
    """Page of functions for each request ``(project_id, snapshot_id, request_id, q)``.

    Matches are paged as narrow rows; whole nodes are read for the rows of the pages only.
    """
    found = page(_found(nodes, requests, index), [*SCOPE, "q"], node_order(), offset, limit)
    asked = requests.select(*SCOPE, "request_id", normalize_query(F.col("q")).alias("q"))
    functions = nodes.filter(F.col("kind") == "function")
    return asked.join(found.drop("name", "file_path"), [*SCOPE, "q"]).join(
        functions, [*SCOPE, "id"])


def entrypoints(nodes: DataFrame, cap: int = ENTRYPOINT_CAP) -> DataFrame:
    """Exported functions; a Python function only when its parent is a file."""
    exported = nodes.filter((F.col("kind") == "function") & F.col("exported"))
    files = nodes.filter(F.col("kind") == "file").select(
        *SCOPE, F.col("id").alias("parent_id"), F.lit(True).alias("in_file")
    )
    eligible = exported.join(files, [*SCOPE, "parent_id"], "left").filter(
        (F.coalesce(F.col("language"), F.lit("")) != "python") | F.col("in_file")
    )
    return top_n(eligible, SCOPE, node_order(), cap).join(totals(eligible, SCOPE), SCOPE)


def _children(nodes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Child rows with the parent's id, and their total order."""
    if kind == "folder":
        rows = nodes.filter(F.col("kind").isin("file", "folder")).withColumn(
            "sort_key", F.coalesce("file_path", F.lit(""))
        ).withColumnRenamed("parent_id", "root_id")
        return rows.filter(F.col("root_id").isNotNull())
    rows = nodes.filter(F.col("kind") == "function").withColumn(
        "sort_key", F.coalesce("qualified_name", "name")
    )
    files = nodes.filter(F.col("kind") == "file").select(
        *SCOPE, "file_path", F.col("id").alias("root_id")
    )
    return rows.drop("parent_id").join(files, [*SCOPE, "file_path"])


def navigation_scope(nodes: DataFrame, requests: DataFrame,
                     budget: int = NODE_BUDGET) -> DataFrame:
    """Scope listings for requests ``(project_id, snapshot_id, path, kind)``.

    One row per listed node (the root first), plus ``missing`` rows for unknown paths.
    ``truncated`` tells that root and children exceed the budget.
    """
    check_budget(budget, 1, NODE_BUDGET_MAX)
    is_top = F.col("parent_id").isNull() & (
        F.col("file_path").isNull() | (F.col("file_path") == ".")
    )
    roots = nodes.filter(F.col("kind").isin("folder", "file")).select(
        *SCOPE, "kind", F.when(is_top, ".").otherwise(F.col("file_path")).alias("path"),
        F.col("id").alias("root_id"),
    )
    # Canonical repository-relative paths only: no empty, dot, backslash, colon or NUL segment.
    canonical = (F.col("path") == ".") | ~F.col("path").rlike(
        r"(^|/)(\.{0,2})(/|$)|[\\:\x00]"
    )
    asked = requests.select(*SCOPE, "path", "kind").distinct().filter(canonical)
    found = asked.join(roots, [*SCOPE, "path", "kind"], "left")
    rows = None
    for kind in ("folder", "file"):
        children = _children(nodes, kind).select(*SCOPE, "root_id", "id", "sort_key")
        first = top_n(children, [*SCOPE, "root_id"], [F.col("sort_key"), F.col("id")],
                      NODE_BUDGET_MAX)
        count = totals(children, [*SCOPE, "root_id"])
        wanted = found.filter((F.col("kind") == kind) & F.col("root_id").isNotNull())
        part = (
            wanted.join(first.filter(F.col("position") < budget), [*SCOPE, "root_id"])
            .join(count, [*SCOPE, "root_id"])
        )
        self_rows = (
            wanted.join(count, [*SCOPE, "root_id"], "left")
            .withColumn("total", F.coalesce("total", F.lit(0)))
            .withColumn("id", F.col("root_id"))
            .withColumn("position", F.lit(0).cast("bigint"))
        )
        both = part.drop("sort_key").unionByName(self_rows)
        rows = both if rows is None else rows.unionByName(both)
    listed = rows.select(
        *SCOPE, "path", "kind", "root_id", "id", "position",
        (F.col("total") + 1 > budget).alias("truncated"), F.lit(False).alias("missing"),
    )
    missing = found.filter(F.col("root_id").isNull()).select(
        *SCOPE, "path", "kind", "root_id", F.lit(None).cast("string").alias("id"),
        F.lit(0).cast("bigint").alias("position"), F.lit(False).alias("truncated"),
        (F.col("path") != ".").alias("missing"),
    )
    return listed.unionByName(missing)


def scope_edges(listing: DataFrame, relations: DataFrame, cap: int = SCOPE_EDGE_CAP) -> DataFrame:
    """Contains-relations inside each listing, at most ``cap`` per scope in emission order."""
    contains = relations.filter((F.col("type") == "contains") & F.col("target_id").isNotNull())
    members = listing.filter(~F.col("missing")).select(*SCOPE, "root_id", "kind", "id")
    # Attach by target: a node has one container, so a hub source never fans out.
    edges = contains.select(
        *SCOPE, F.col("target_id").alias("id"), "source_id",
        F.col("id").alias("relation_id"), "ordinal",
    ).join(members, [*SCOPE, "id"])
    sources = members.select(*SCOPE, "root_id", F.col("id").alias("source_id"))
    allowed = edges.filter(
        (F.col("kind") == "file") | (F.col("source_id") == F.col("root_id"))
    ).join(sources, [*SCOPE, "root_id", "source_id"], "left_semi")
    keys = [*SCOPE, "root_id"]
    return top_n(allowed, keys, [F.col("ordinal"), F.col("relation_id")], cap).join(
        totals(allowed, keys, "edge_total"), keys
    )
