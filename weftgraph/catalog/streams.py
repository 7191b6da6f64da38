"""Streaming twins of batch operators, run over the given tables' files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..knowledge import annotations as A
from ..sources import knowledge_log as K
from ..staging import stage_root
from ..streaming import streams as T
from .knowledge import _CHANGES, _recursive, with_notes
from .plans import _load
from .registry import query


def _events(spark, sf):
    return T.stream_table(spark, f"{sf}/event[s].parquet")


@query("stream_snapshot_facts", """
SELECT 'function:o' || l_orderkey AS source_id, CASE l_returnflag WHEN 'N' THEN 'function:s' ||
    l_suppkey || 'p' || l_partkey WHEN 'R' THEN 'external:p' || l_partkey END AS target_id,
  CASE l_returnflag WHEN 'N' THEN 'resolved' WHEN 'R' THEN 'external' ELSE 'unresolved' END
    AS resolution, CAST(l_linenumber AS BIGINT) AS line FROM lineitem""")
def stream_snapshot_facts(spark, sf):
    lines = T.stream_table(spark, f"{sf}/lineite[m].parquet")
    return T.run_to_table(T.snapshot_facts(lines), "stream-facts")


@query("stream_dedupe_mutations", """
SELECT DISTINCT 'p' || user_id AS project_id, CAST(floor(value) AS BIGINT) AS mutation_id
FROM events""")
def stream_dedupe_mutations(spark, sf):
    rows = _events(spark, sf).select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"),
        F.floor("value").alias("mutation_id"), "ts")
    kept = T.dedupe_mutations(rows, "ts", "1 day", ["project_id", "mutation_id"])
    return T.run_to_table(kept, "stream-mutations").drop("ts")


_RATE = """
WITH g AS (SELECT {start} AS start, event_type, count(*) AS changes FROM {rows} GROUP BY 1, 2)
SELECT start, start + INTERVAL {size} AS "end", event_type, changes FROM g
WHERE start + INTERVAL {size} <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query("stream_change_rate", _RATE.format(
    start="date_trunc('day', ts)", rows="events", size="1 DAY"))
def stream_change_rate(spark, sf):
    """Tumbling days; only windows closed by the watermark are final."""
    rate = T.change_rate(_events(spark, sf), "ts", "1 hour", F.window("ts", "1 day"), "event_type")
    return T.run_to_table(rate, "stream-rate")


@query("stream_change_rate_sliding", _RATE.format(
    start="date_trunc('day', ts) - INTERVAL 1 DAY * back",
    rows="events, (VALUES (0), (1)) t(back)", size="2 DAY"))
def stream_change_rate_sliding(spark, sf):
    rate = T.change_rate(
        _events(spark, sf), "ts", "1 hour", F.window("ts", "2 days", "1 day"), "event_type")
    return T.run_to_table(rate, "stream-sliding")


@query("stream_change_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
    + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM g),
w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS changes
      FROM s GROUP BY user_id, sess)
SELECT * FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_change_sessions(spark, sf):
    """Sessions of a user's changes with a gap of six hours."""
    rate = T.change_rate(
        _events(spark, sf), "ts", "1 hour", F.session_window("ts", "6 hours"), "user_id")
    return T.run_to_table(rate, "stream-sessions")


@query("watch_refresh_debounce", """
WITH RECURSIVE s AS (SELECT 'p' || user_id AS project_id, CAST(floor(epoch(ts)) AS BIGINT) AS t,
    count(*) AS n FROM events GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY t) AS rn FROM s),
w AS (SELECT project_id, rn, t AS f, t AS l, n, CAST(0 AS BIGINT) AS g FROM o WHERE rn = 1
  UNION ALL SELECT o.project_id, o.rn,
    CASE WHEN o.t >= least(l + 43200, f + 129600) THEN o.t ELSE f END, o.t,
    CASE WHEN o.t >= least(l + 43200, f + 129600) THEN o.n ELSE w.n + o.n END,
    CASE WHEN o.t >= least(l + 43200, f + 129600) THEN g + 1 ELSE g END
  FROM w JOIN o ON o.project_id = w.project_id AND o.rn = w.rn + 1),
r AS (SELECT project_id, max(f) AS f, max(l) AS l, CAST(max(n) AS BIGINT) AS n FROM w
      GROUP BY project_id, g)
SELECT project_id, make_timestamp(f * 1000000) AS first_at, make_timestamp(l * 1000000) AS last_at,
  make_timestamp(least(l + 43200, f + 129600) * 1000000) AS refresh_at, n AS changes FROM r
WHERE make_timestamp(least(l + 43200, f + 129600) * 1000000)
  <= (SELECT date_trunc('second', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def watch_refresh_debounce(spark, sf):
    """Users as projects: quiet for 12 hours, waiting for 36 at most."""
    rows = _events(spark, sf).select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"), "ts")
    return T.run_to_table(T.debounce(rows, "ts", "1 hour", 12 * 3600, 36 * 3600), "stream-refresh")


@query("stream_approval_join", """
WITH c AS (SELECT 'p' || user_id AS plan_id, CAST(floor(value / 5) AS BIGINT) AS revision,
    event_id AS change_id, ts AS changed_at FROM events WHERE event_type <> 'purchase'),
a AS (SELECT 'p' || user_id AS plan_id, CAST(floor(value / 5) AS BIGINT) AS revision,
    event_id AS approval_id, ts AS approved_at FROM events WHERE event_type = 'purchase'),
m AS (SELECT c.*, approval_id, approved_at FROM c LEFT JOIN a ON a.plan_id = c.plan_id
    AND a.revision = c.revision AND approved_at BETWEEN changed_at AND changed_at + INTERVAL 5 DAY)
SELECT plan_id, revision, change_id, changed_at, approval_id,
  CAST(floor(epoch(approved_at)) - floor(epoch(changed_at)) AS BIGINT) AS waited
FROM m WHERE approval_id IS NOT NULL OR changed_at + INTERVAL 5 DAY < least(
  (SELECT max(changed_at) FROM c), (SELECT max(approved_at) FROM a)) - INTERVAL 1 HOUR""")
def stream_approval_join(spark, sf):
    """Users as plans: purchases approve a revision that other events wrote up to five days before."""
    rows = _events(spark, sf).select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("plan_id"),
        F.floor(F.col("value") / 5).alias("revision"), "event_id", "ts", "event_type")
    bought = F.col("event_type") == "purchase"
    changes = rows.filter(~bought).withColumnsRenamed({"event_id": "change_id", "ts": "changed_at"})
    approvals = rows.filter(bought).withColumnsRenamed(
        {"event_id": "approval_id", "ts": "approved_at"})
    joined = T.run_to_table(T.approval_join(changes, approvals, "1 hour", "5 DAYS"), "stream-approvals")
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return joined.withColumn("waited", second("approved_at") - second("changed_at")).drop("approved_at")


@query("stream_revision_cas", _recursive(with_notes(_CHANGES + """
SELECT id, seq, 'applied' AS outcome, revision FROM st WHERE action <> 'create' AND NOT noop
UNION ALL SELECT id, seq, 'conflict', expected FROM ch
  WHERE (id, seq) NOT IN (SELECT (id, seq) FROM st)""")))
def stream_revision_cas(spark, sf):
    path = f"{stage_root(spark)}/cas-input-{uuid.uuid4().hex}"
    K.note_changes(spark, sf).write.parquet(path)
    return T.revision_cas(T.stream_table(spark, path), K.notes(spark, sf))


@query("stream_reconcile", with_notes("""
SELECT id, revision + 1 AS revision, 'orphan' AS binding_state, 'cur' AS orphaned_at, target_id
FROM resolved WHERE deleted_at IS NULL AND binding_state = 'bound' AND status = 'orphan'"""))
def stream_reconcile(spark, sf):
    """Notes arrive as a stream and are reconciled with the current snapshot batch by batch."""
    c = _load(spark, sf)
    g, cur = c.graph, F.col("snapshot_id") == "cur"
    path = f"{stage_root(spark)}/notes-input-{uuid.uuid4().hex}"
    K.notes(spark, sf).repartition(4, "id").write.parquet(path)
    stream = T.stream_table(spark, path, files_per_trigger=2)

    def step(batch):
        resolved = A.resolve_annotations(
            batch, "cur", g.nodes.filter(cur), g.relations.filter(cur), g.coverage.filter(cur),
            g.diagnostics.filter(cur), g.snapshots.filter(cur))
        return A.reconcile_annotations(resolved).select(
            "id", "revision", "binding_state", "orphaned_at", "target_id")

    schema = step(K.notes(spark, sf)).schema
    return T.run_each_batch(stream, "stream-reconcile", step, schema)
