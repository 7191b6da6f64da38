"""The given star schema read as a code graph (nodes, relations, coverage, snapshots).

regions and nations are folders, customers and suppliers are files, orders and supplied parts
are functions, parts are externals, line items are calls and customer/supplier pairs imports.
``scopes`` chooses the snapshots: one full snapshot, or the pair ``base`` / ``cur`` in which
some orders have not been created yet and others are already gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.paging import expand_copies
from ..staging import stage, table

PROJECT = "shop"
FULL = ("full",)
PAIR = ("base", "cur")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    relations: DataFrame
    coverage: DataFrame | None = None
    snapshots: DataFrame | None = None
    diagnostics: DataFrame | None = None


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def _id(prefix: str, *cols: str) -> Column:
    return F.concat(F.lit(prefix), *[_s(c) for c in cols])


def _every_scope(df: DataFrame, scopes) -> DataFrame:
    """Repeat scope-independent facts for each snapshot (a literal array, not a join)."""
    return df.withColumn("snapshot_id", F.explode(F.array(*[F.lit(s) for s in scopes])))


def _in_all(df: DataFrame, scopes) -> DataFrame:
    """Scope-independent facts: rows that all snapshots hold."""
    return df.withColumn("snapshots", F.lit("_".join(scopes)))


def _told_apart(held: DataFrame, scopes) -> DataFrame:
    """Rows with the names of the snapshots that hold them (``snapshots``) as rows of each snapshot.

    A branch a snapshot: a filter on ``snapshot_id`` drops the others, and the rest prunes partitions.
    """
    columns = ["snapshot_id" if c == "snapshots" else c for c in held.columns]
    out = None
    for s in scopes:
        names = [s, "_".join(scopes)]
        rows = held.filter(F.col("snapshots").isin(*names)).withColumn(
            "snapshot_id", F.lit(s)).select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def _tags() -> Column:
    """The snapshots of ``PAIR`` that hold an order."""
    urgent_open = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    low_done = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return F.array_compact(
        F.array(F.when(~urgent_open, F.lit("base")), F.when(~low_done, F.lit("cur")))
    )


def tagged_orders(spark: SparkSession, sf: str, scopes) -> DataFrame:
    orders = table(spark, sf, "orders")
    if scopes == FULL:
        return _in_all(orders, scopes)
    return orders.withColumn("snapshots", F.array_join(_tags(), "_")).filter("snapshots <> ''")


def _held_orders(spark, sf) -> DataFrame:
    """One row per order key: how often each snapshot of ``PAIR`` holds it."""
    return table(spark, sf, "orders").groupBy("o_orderkey").agg(*[
        F.count_if(F.array_contains(_tags(), s)).alias(s) for s in PAIR])


def _held_scopes(held: dict[str, Column]) -> Column:
    """Names of the snapshots whose condition holds."""
    return F.concat_ws("_", *[F.when(c, F.lit(s)) for s, c in held.items()]).alias("snapshots")


def _directories(spark, sf):
    return table(spark, sf, "nation").select(
        "n_nationkey",
        F.concat(F.lit("r"), _s("n_regionkey"), F.lit("/n"), _s("n_nationkey")).alias("dir"),
    )


def customer_files(spark, sf) -> DataFrame:
    name = F.concat(F.lit("c"), _s("c_custkey"), F.lit(".py"))
    return (
        table(spark, sf, "customer")
        .join(_directories(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            _id("file:c", "c_custkey").alias("id"),
            name.alias("name"),
            F.concat("dir", F.lit("/"), name).alias("file_path"),
            _id("folder:n", "c_nationkey").alias("parent_id"),
            F.lit("python").alias("language"),
        )
    )


def supplier_files(spark, sf) -> DataFrame:
    name = F.concat(F.lit("s"), _s("s_suppkey"), F.lit(".ts"))
    return (
        table(spark, sf, "supplier")
        .join(_directories(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "s_suppkey",
            _id("file:s", "s_suppkey").alias("id"),
            name.alias("name"),
            F.concat("dir", F.lit("/"), name).alias("file_path"),
            _id("folder:n", "s_nationkey").alias("parent_id"),
            F.lit("typescript").alias("language"),
        )
    )


def _node(df: DataFrame, kind: str, **cols) -> DataFrame:
    def c(name, typ="string"):
        return cols.get(name, F.lit(None)).cast(typ).alias(name)

    return df.select(
        F.lit(PROJECT).alias("project_id"),
        "snapshots",
        cols["id"].alias("id"),
        F.lit(kind).alias("kind"),
        c("name"), c("qualified_name"), c("file_path"), c("parent_id"), c("language"),
        c("signature"), c("start_line", "bigint"), c("end_line", "bigint"),
        c("exported", "boolean"),
    )


def nodes(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    return _told_apart(held_nodes(spark, sf, scopes), scopes)


def held_nodes(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    """Each node once, with the snapshots that hold it."""
    col = F.col
    root = _node(
        _in_all(spark.range(1), scopes), "folder",
        id=F.lit("folder:."), name=F.lit("."),
    )
    regions = _node(
        _in_all(table(spark, sf, "region"), scopes), "folder",
        id=_id("folder:r", "r_regionkey"), name=_id("r", "r_regionkey"),
        file_path=_id("r", "r_regionkey"), parent_id=F.lit("folder:."),
    )
    nations = _node(
        _in_all(table(spark, sf, "nation"), scopes), "folder",
        id=_id("folder:n", "n_nationkey"), name=_id("n", "n_nationkey"),
        file_path=F.concat(F.lit("r"), _s("n_regionkey"), F.lit("/n"), _s("n_nationkey")),
        parent_id=_id("folder:r", "n_regionkey"),
    )
    files = customer_files(spark, sf).drop("c_custkey").unionByName(
        supplier_files(spark, sf).drop("s_suppkey")
    )
    files = _node(
        _in_all(files, scopes), "file",
        id=col("id"), name=col("name"), file_path=col("file_path"),
        parent_id=col("parent_id"), language=col("language"),
    )
    orders = tagged_orders(spark, sf, scopes).join(
        customer_files(spark, sf).select("c_custkey", "file_path"),
        col("o_custkey") == col("c_custkey"),
    )
    orders = _node(
        orders, "function",
        id=_id("function:o", "o_orderkey"), name=col("o_orderpriority"),
        qualified_name=_id("o", "o_orderkey"), file_path=col("file_path"),
        parent_id=_id("file:c", "o_custkey"), language=F.lit("python"),
        signature=F.concat(F.lit("("), col("o_orderstatus"), F.lit(")")),
        start_line=F.dayofmonth("o_orderdate"), end_line=F.dayofmonth("o_orderdate") + 10,
        exported=col("o_orderstatus") == "F",
    )
    offers = (
        offers_of(spark, sf, scopes)
        .join(table(spark, sf, "part"), col("l_partkey") == col("p_partkey"))
        .join(
            supplier_files(spark, sf).select("s_suppkey", "file_path"),
            col("l_suppkey") == col("s_suppkey"),
        )
    )
    offers = _node(
        offers, "function",
        id=F.concat(F.lit("function:s"), _s("l_suppkey"), F.lit("p"), _s("l_partkey")),
        name=col("p_name"),
        qualified_name=F.concat(F.lit("s"), _s("l_suppkey"), F.lit("p"), _s("l_partkey")),
        file_path=col("file_path"), parent_id=_id("file:s", "l_suppkey"),
        language=F.lit("typescript"),
        signature=F.concat(F.lit("("), col("p_brand"), F.lit(")")),
        start_line=col("p_size"), end_line=col("p_size") + 10, exported=col("p_size") > 25,
    )
    externals = _node(
        _in_all(table(spark, sf, "part"), scopes), "external",
        id=_id("external:p", "p_partkey"), name=_id("pkg:", "p_partkey"),
    )
    return (
        root.unionByName(regions).unionByName(nations).unionByName(files)
        .unionByName(orders).unionByName(offers).unionByName(externals)
    )


def offers_of(spark, sf, scopes=FULL) -> DataFrame:
    """Supplied parts with the snapshots that hold them.  Lines meet orders by their keys alone and
    collapse to one row per offer."""
    lines = table(spark, sf, "lineitem")
    if scopes == FULL:
        return _in_all(lines.select("l_suppkey", "l_partkey").distinct(), scopes)
    offers = lines.select("l_orderkey", "l_suppkey", "l_partkey").join(
        _held_orders(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy("l_suppkey", "l_partkey").agg(*[F.bool_or(F.col(s) > 0).alias(s) for s in PAIR])
    return offers.select(
        _held_scopes({s: F.col(s) for s in PAIR}), "l_suppkey", "l_partkey"
    ).filter("snapshots <> ''")


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint").cast("string")


def calls(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    return _told_apart(held_calls(spark, sf, scopes), scopes)


def held_calls(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    """One call per line item, with the snapshots that hold it.

    Copies of a line collapse to a count first (combined map-side), so a hot group of copies is
    one shuffled row; the ordinal that keeps repeated calls distinct is expanded afterwards.  Lines
    are moved as numbers and a digest, once for all snapshots; strings are made where they are written,
    and after the copies are counted five bytes of the digest are left, which the id holds.
    """
    detail = F.concat_ws(
        "|", _cents("l_quantity"), _cents("l_extendedprice"), _cents("l_discount"),
        _cents("l_tax"), "l_returnflag", "l_linestatus",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    lines = (
        table(spark, sf, "lineitem")
        .select(*keys, F.unhex(F.md5(detail)).alias("detail"))
        .groupBy(*keys, "detail").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("detail", F.substring("detail", 1, 5))
    )
    lines = expand_copies(lines, "copies", "copy", spread_all=False)
    where = table(spark, sf, "orders").join(
        customer_files(spark, sf).select("c_custkey", "file_path"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).select("o_orderkey", "file_path")
    at_order = F.col("l_orderkey") == F.col("o_orderkey")
    if scopes == FULL:
        lines = _in_all(lines.join(where, at_order), scopes)
    else:
        # An order key that a snapshot holds n times makes n calls of each line; snapshots that hold
        # it equally often hold the same calls.
        def held(names, n):
            return F.struct(F.lit(names).alias("snapshots"), F.col(n).alias("times"))

        times = F.when(F.col("base") == F.col("cur"), F.array(held("base_cur", "base"))).otherwise(
            F.array(*[held(s, s) for s in PAIR]))
        lines = lines.join(where.join(_held_orders(spark, sf), "o_orderkey"), at_order).select(
            *keys, "detail", "copy", "file_path", F.inline(times)
        ).filter(F.col("times") > 0).withColumn(
            "nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
        ).withColumn("copy", (F.col("copy") - 1) * F.col("times") + F.col("nth"))
    flag = F.col("l_returnflag")
    call_id = F.concat_ws(
        ":", F.lit("call"), _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
        _s("l_suppkey"), F.lower(F.hex("detail")), _s("copy"),
    )
    return lines.select(
        F.lit(PROJECT).alias("project_id"), "snapshots",
        call_id.alias("ordinal"), call_id.alias("id"), F.lit("calls").alias("type"),
        _id("function:o", "l_orderkey").alias("source_id"),
        F.when(flag == "N", F.concat(F.lit("function:s"), _s("l_suppkey"), F.lit("p"),
                                     _s("l_partkey")))
        .when(flag == "R", _id("external:p", "l_partkey")).alias("target_id"),
        F.when(flag == "N", "resolved").when(flag == "R", "external")
        .otherwise("unresolved").alias("resolution"),
        F.col("file_path").alias("evidence_path"),
        F.col("l_linenumber").cast("bigint").alias("evidence_line"),
        F.col("l_linestatus").alias("evidence_text"),
    )


def imports(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    """File imports: customer to supplier for finished orders, supplier to customer for open ones."""
    return _told_apart(held_imports(spark, sf, scopes), scopes)


def held_imports(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    """Each import once, with the snapshots that hold it."""
    # One row per order status and pair before the join with files, which combines map-side.
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select(
        "o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    at_order = F.col("l_orderkey") == F.col("o_orderkey")
    pair = ["o_custkey", "l_suppkey", "o_orderstatus"]
    if scopes == FULL:
        pairs = _in_all(lines.join(orders, at_order).select(*pair).distinct(), scopes)
    else:
        pairs = lines.join(orders.join(_held_orders(spark, sf), "o_orderkey"), at_order).groupBy(
            *pair).agg(*[F.bool_or(F.col(s) > 0).alias(s) for s in PAIR]).select(
            *pair, _held_scopes({s: F.col(s) for s in PAIR})).filter("snapshots <> ''")
    cust, supp = _id("file:c", "o_custkey"), _id("file:s", "l_suppkey")
    forward = F.col("o_orderstatus") == "F"
    rows = pairs.select(
        "snapshots",
        F.when(forward, cust).otherwise(supp).alias("source_id"),
        F.when(forward, supp).otherwise(cust).alias("target_id"),
    )
    rel_id = F.concat(F.lit("import:"), F.col("source_id"), F.lit(">"), F.col("target_id"))
    files = customer_files(spark, sf).select("id", "file_path").unionByName(
        supplier_files(spark, sf).select("id", "file_path")
    )
    rows = rows.join(files, F.col("source_id") == F.col("id")).drop("id")
    return rows.select(
        F.lit(PROJECT).alias("project_id"), "snapshots",
        rel_id.alias("ordinal"), rel_id.alias("id"), F.lit("imports").alias("type"),
        "source_id", "target_id", F.lit("resolved").alias("resolution"),
        F.col("file_path").alias("evidence_path"),
        F.lit(1).cast("bigint").alias("evidence_line"), F.lit("import").alias("evidence_text"),
    )


def contains(all_nodes: DataFrame) -> DataFrame:
    rel_id = F.concat(F.lit("contains:"), F.col("id"))
    return all_nodes.filter(F.col("parent_id").isNotNull()).select(
        "project_id", "snapshot_id", rel_id.alias("ordinal"), rel_id.alias("id"),
        F.lit("contains").alias("type"), F.col("parent_id").alias("source_id"),
        F.col("id").alias("target_id"), F.lit("resolved").alias("resolution"),
        F.coalesce("file_path", "name").alias("evidence_path"),
        F.coalesce("start_line", F.lit(1).cast("bigint")).alias("evidence_line"),
        F.lit("contains").alias("evidence_text"),
    )


def star_graph(spark: SparkSession, sf: str, scopes=FULL,
               types=("calls", "imports", "contains")) -> Graph:
    """The published graph tables, restricted to the requested relation types."""
    all_nodes, relations = publish(spark, sf, scopes, types)
    return Graph(all_nodes, relations, coverage(spark, sf, scopes), snapshots(spark, scopes),
                 diagnostics(spark, sf, scopes))


def graph_nodes(spark: SparkSession, sf: str, scopes=FULL) -> DataFrame:
    return publish(spark, sf, scopes, ())[0]


_PUBLISHED: dict[tuple, DataFrame] = {}


def _once(spark, sf, scopes, name, build, partition_by) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, scopes, name)
    if key not in _PUBLISHED:
        _PUBLISHED[key] = stage(build(spark, sf, scopes), name, partition_by)
    return _PUBLISHED[key]


def publish(spark: SparkSession, sf: str, scopes=FULL,
            types=("calls", "imports", "contains")) -> tuple[DataFrame, DataFrame]:
    """Index the star tables once per application into node and relation tables.

    Facts are immutable, so every query of the application reads the same written tables, each
    written when it is first asked for.  A fact is written once, in the partition of the snapshots
    that hold it; containment is read off the nodes.  Scope and type filters of the queries become
    partition pruning.
    """
    all_nodes = _told_apart(
        _once(spark, sf, scopes, "nodes", held_nodes, ["snapshots", "kind"]), scopes)
    relations = contains(all_nodes)
    columns = relations.columns
    if "contains" not in types:
        relations = relations.limit(0)
    for kind, build in (("imports", held_imports), ("calls", held_calls)):
        if kind in types:
            # Here a relation's ordinal is its id; its type and both are written once.
            written = _once(
                spark, sf, scopes, kind,
                lambda *a, build=build: build(*a).drop("ordinal", "type"), ["snapshots"])
            facts = _told_apart(written, scopes).withColumn("ordinal", F.col("id")).withColumn(
                "type", F.lit(kind)).select(*columns)
            relations = facts.unionByName(relations)
    return all_nodes, relations


def coverage(spark: SparkSession, sf: str, scopes=PAIR) -> DataFrame:
    """Listed files per snapshot; nation 0 could not be read in ``cur``."""
    files = customer_files(spark, sf).select("file_path", "parent_id").unionByName(
        supplier_files(spark, sf).select("file_path", "parent_id")
    )
    listed = _every_scope(files, scopes).select(
        F.lit(PROJECT).alias("project_id"), "snapshot_id",
        F.when((F.col("parent_id") == "folder:n0") & (F.col("snapshot_id") == "cur"),
               "unavailable").otherwise("file").alias("role"),
        F.col("file_path").alias("path"),
    )
    excluded = _every_scope(
        table(spark, sf, "nation").filter(F.col("n_nationkey") == 7), scopes
    ).filter(F.col("snapshot_id") == "cur").select(
        F.lit(PROJECT).alias("project_id"), "snapshot_id", F.lit("excluded").alias("role"),
        F.concat(F.lit("r"), _s("n_regionkey"), F.lit("/n"), _s("n_nationkey")).alias("path"),
    )
    return listed.unionByName(excluded)


def snapshots(spark: SparkSession, scopes=PAIR) -> DataFrame:
    return _every_scope(spark.range(1), scopes).select(
        F.lit(PROJECT).alias("project_id"), "snapshot_id",
        F.concat(F.lit("hash-"), F.col("snapshot_id")).alias("content_hash"),
        F.lit(True).alias("capture_complete"), F.lit(True).alias("availability_recorded"),
    )


def diagnostics(spark: SparkSession, sf: str, scopes=PAIR) -> DataFrame:
    """Suppliers with a negative balance failed to parse."""
    broken = supplier_files(spark, sf).join(
        table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0).select("s_suppkey"),
        "s_suppkey",
    )
    return _every_scope(broken, scopes).select(
        F.lit(PROJECT).alias("project_id"), "snapshot_id", "file_path",
        F.lit("parse failure").alias("message"),
    )
