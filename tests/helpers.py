"""Small hand-written graphs as DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F

P, S = "p1", "s1"
NODE = ("project_id string, snapshot_id string, id string, kind string, name string, "
        "qualified_name string, file_path string, parent_id string, language string, "
        "signature string, start_line bigint, exported boolean")
REL = ("project_id string, snapshot_id string, ordinal string, id string, type string, "
       "source_id string, target_id string, resolution string, evidence_path string, "
       "evidence_line bigint, evidence_text string")
OP = ("project_id string, snapshot_id string, plan_id string, op_index bigint, kind string, "
      "temp_id string, name string, file_path string, language string, signature string, "
      "node_id string, relation_id string, source_id string, target_id string, text string")


def node(id, kind="function", name=None, path=None, parent=None, q=None, lang=None, exported=False,
         sig=None, line=1, scope=(P, S)):
    return (*scope, id, kind, name or id, q, path, parent, lang, sig, line, exported)


def rel(id, source, target, type="calls", resolution=None, scope=(P, S), order=None):
    resolution = resolution or ("resolved" if target else "unresolved")
    return (*scope, order or id, id, type, source, target, resolution, "src/a.ts", 1, "x")


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


def relations(spark, rows):
    return spark.createDataFrame(rows, REL)


def ops(spark, rows, plan="plan1", scope=(P, S)):
    names = [f.split()[0] for f in OP.split(", ")]
    full = [{**dict.fromkeys(names), "project_id": scope[0], "snapshot_id": scope[1],
             "plan_id": plan, "op_index": i, **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], OP)


def requests(spark, ids, scope=(P, S), column="node_id"):
    return spark.createDataFrame(
        [(*scope, i, i) for i in ids],
        f"project_id string, snapshot_id string, request_id string, {column} string")


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def coverage(spark, rows, scope=(P, S)):
    return spark.createDataFrame([(*scope, *r) for r in rows],
                                 "project_id string, snapshot_id string, role string, path string")


def diagnostics(spark, paths, scope=(P, S)):
    return spark.createDataFrame(
        [(*scope, p, "broken") for p in paths],
        "project_id string, snapshot_id string, file_path string, message string")


def snapshots(spark, complete=True, recorded=True, scope=(P, S), content="hash1"):
    return spark.createDataFrame(
        [(*scope, content, complete, recorded)],
        "project_id string, snapshot_id string, content_hash string, capture_complete boolean, "
        "availability_recorded boolean")


def shuffled(df, seed=7):
    return df.orderBy(F.rand(seed))
