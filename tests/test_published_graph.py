"""The published graph and the Python modules of a small made star schema."""

import datetime as dt

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.compare import compare_frames
from weftgraph.operators.paging import expand_copies
from weftgraph.sources import star_graph as S

catalog.load()
DAY = dt.datetime(1998, 2, 6)
STATUS, PRIORITY = "FOP", ("1-URGENT", "5-LOW", "3-MEDIUM")


def tables():
    orders = [(i, i % 4, STATUS[i % 3], 10.0, DAY, PRIORITY[i // 3 % 3]) for i in range(18)]
    lines = [(i % 19, i % 5, i % 3, i % 2 + 1, 1.0 + i % 2, 5.0, 0.01, 0.02, "NRA"[i % 3], "O", DAY)
             for i in range(60)]
    return {
        "region": ("r_regionkey long, r_name string", [(0, "A"), (1, "B")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long",
                   [(0, "N0", 0), (1, "N1", 1), (7, "N7", 1)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long, c_acctbal double, "
                     "c_mktsegment string",
                     [(0, "C0", 0, 5.0, "FURNITURE"), (1, "C1", 1, -5.0, "MACHINERY"),
                      (2, "C2", 7, 5.0, "BUILDING"), (3, "C3", 1, 9.0, "BUILDING")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double",
                     [(0, "S0", 0, 1.0), (1, "S1", 1, -1.0), (2, "S2", 7, 1.0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size long, "
                 "p_retailprice double",
                 [(i, f"part {i}", f"Brand#{i}", "T", 20 + i, 1.0) for i in range(5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp, o_orderpriority string", orders),
        # Lines of an order come twice and seven times.
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                     "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     lines + lines[:7] + lines[:1] * 5),
    }


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("small"))
    for name, (schema, rows) in tables().items():
        spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    return out


def statement(small, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in tables():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet/*.parquet'")
    return con.execute(sql).fetchdf()


@pytest.mark.parametrize("key", ["module_table", "link_imports", "link_calls", "build_nodes",
                                 "build_edges", "type_only_exclude"])
def test_python_modules_and_link_modules_are_apart(spark, small, key):
    got = catalog.QUERIES[key](spark, small).toPandas()
    assert len(got) and compare_frames(got, statement(small, catalog.ORACLES[key])) == ""


@pytest.mark.parametrize("scopes", [S.FULL, S.PAIR])
def test_published_rows_are_those_of_the_statement(spark, small, scopes):
    from weftgraph.catalog.prelude import with_graph

    nodes, relations = S.publish(spark, small, scopes)
    for got, name, columns in (
            (nodes, "nodes", "snapshot_id, id, kind, name, file_path, parent_id, exported"),
            (relations, "relations", "snapshot_id, id, type, source_id, target_id, resolution, "
                                     "evidence_path, evidence_line, evidence_text")):
        want = statement(small, with_graph(f"SELECT {columns} FROM {name}", pair=scopes == S.PAIR))
        assert compare_frames(got.select(*columns.split(", ")).toPandas(), want) == ""
    assert relations.filter("ordinal = id").count() == relations.count()


def test_lines_are_moved_as_numbers_once_for_all_snapshots(spark, small):
    """Strings made of a line are not shuffled, and its snapshots are told apart after the joins."""
    plan = S.calls(spark, small, S.PAIR)._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(x for x in plan.splitlines() if "Aggregate [l_orderkey" in x)
    assert "snapshot_id" not in grouped and "unhex" in plan


def test_written_relations_are_compressed_and_hold_an_id_once(spark, small):
    for frame in S.publish(spark, small, S.PAIR):
        path = frame.inputFiles()[0].split(":", 1)[1]
        part = pq.ParquetFile("/" + path.lstrip("/"))
        assert "ordinal" not in part.schema.names
        assert part.metadata.row_group(0).column(0).compression == "ZSTD"
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_only_piles_are_moved(spark):
    counted = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0), ("d", 10)], "k string, n long")
    rows = expand_copies(counted, "n", "i", block=10, spread_all=False)
    assert {r["k"]: sorted(r["l"]) for r in rows.groupBy("k").agg(
        F.collect_list("i").alias("l")).collect()} == {
            "a": list(range(1, 26)), "b": [1, 2, 3], "d": list(range(1, 11))}


def test_a_fact_is_written_once_and_only_when_asked_for(spark, small, monkeypatch):
    """Snapshots share what both hold, containment is read off the nodes, other types wait."""
    written = {}

    def counted(df, name, partition_by=None, real=S.stage):
        written[name] = real(df, name, partition_by)
        return written[name]

    monkeypatch.setattr(S, "_PUBLISHED", {})
    monkeypatch.setattr(S, "stage", counted)
    nodes, relations = S.publish(spark, small, S.PAIR, ("calls", "contains"))
    assert set(written) == {"nodes", "calls"}
    assert {r["type"] for r in relations.select("type").distinct().collect()} == {"calls", "contains"}
    for held, rows in ((written["nodes"], nodes), (written["calls"], relations.filter("type = 'calls'"))):
        assert held.count() == rows.select("id").distinct().count() < rows.count()
    S.publish(spark, small, S.PAIR)
    assert set(written) == {"nodes", "calls", "imports"}
    plan = relations.filter("snapshot_id = 'cur'")._jdf.queryExecution().optimizedPlan().toString()
    assert "cur AS" in plan and "base AS" not in plan
