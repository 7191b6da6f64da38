"""Notes, approvals, plan status, structure files and records over the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.ids import policy_canonical
from ..functions.paths import normalize_structure_path
from ..knowledge import annotations as A
from ..knowledge import structure as X
from ..operators.paging import page
from ..plans import state as S
from ..plans import status as T
from ..schemas import SCOPE
from ..sources import knowledge_log as K
from ..sources import plan_log as L
from ..sources import records as D
from ..staging import stage, table
from .plan_prelude import with_plans
from .plans import RULE_SQL, SUMMARY, _load, issue_summary
from .registry import query


def _mixed(parts: str) -> str:
    """SQL twin of the order-free digest: count and sums of four 60-bit words of row hashes."""
    words = " || ':' || ".join(
        f"CAST(sum(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)"
        for i in range(4))
    return f"sha256(CAST(count(*) AS VARCHAR) || ':' || {words}) {parts}"


NOTE_CTES = r"""
nev AS (SELECT 'note:u' || user_id || ':' || CAST(floor(k / 10) AS BIGINT) AS id, event_id, ts,
          user_id, event_type, value, k FROM ev),
nf AS (SELECT id, min(event_id) AS f, max(event_id) AS l FROM nev GROUP BY id),
notes0 AS (SELECT n.id, a.event_id, a.ts, a.user_id, a.event_type, a.value, a.k,
    b.event_type AS last_type, b.ts AS last_ts, file_path AS home, o_custkey AS cust, first_call,
    'function:o' || a.event_id AS own
  FROM nf n JOIN nev a ON a.event_id = n.f JOIN nev b ON b.event_id = n.l
  LEFT JOIN orders ON o_orderkey = a.event_id LEFT JOIN files0 ON files0.id = 'file:c' || o_custkey
  LEFT JOIN firstcall ON source_id = 'function:o' || a.event_id),
notes AS MATERIALIZED (SELECT CASE WHEN value > 200 THEN 'other' ELSE 'shop' END AS project_id, id,
    CAST(1 AS BIGINT) AS revision, 'note ' || k AS text, 'user ' || user_id AS author,
    CASE WHEN value < 20 THEN 'agent' ELSE 'user' END AS source, k >= 50 AS is_constraint,
    CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'orphan' ELSE 'bound' END
      AS binding_state,
    CASE WHEN event_type <> 'signup' THEN CASE WHEN k >= 70 AND first_call IS NOT NULL
      THEN 'relation' ELSE 'node' END END AS target_kind,
    CASE WHEN event_type <> 'signup' THEN CASE WHEN k >= 70 AND first_call IS NOT NULL
      THEN first_call WHEN k < 10 AND cust IS NOT NULL THEN 'file:c' || cust ELSE own END END
      AS target_id,
    CASE WHEN event_type <> 'signup' THEN 'base' END AS selected_snapshot_id,
    CASE WHEN event_type <> 'signup' THEN 'o' || event_id END AS last_label,
    CASE WHEN event_type <> 'signup' THEN coalesce(home, 'gone/x.py') END AS last_path,
    CASE WHEN event_type <> 'signup' AND NOT (k >= 70 AND first_call IS NOT NULL) THEN
      CASE WHEN k < 10 AND cust IS NOT NULL THEN 'file' ELSE 'function' END END AS last_node_kind,
    CASE WHEN event_type = 'error' THEN 'base' END AS orphaned_at, ts AS created_at,
    CASE WHEN last_type = 'error' THEN last_ts END AS deleted_at, event_id AS created_seq
  FROM notes0),
ngaps AS MATERIALIZED (
  SELECT file_path AS gap FROM files0 WHERE parent_id = 'folder:n0'
  UNION SELECT dir FROM dirs WHERE n_nationkey = 7
  UNION SELECT f.file_path FROM files0 f JOIN supplier s ON f.id = 'file:s' || s_suppkey
    WHERE s_acctbal < 0),
curfacts AS MATERIALIZED (SELECT id, 'node' AS k FROM nodes WHERE snapshot_id = 'cur'
    AND kind <> 'external' UNION ALL SELECT id, 'relation' FROM relations
    WHERE snapshot_id = 'cur'),
resolved AS MATERIALIZED (SELECT n.*, CASE WHEN binding_state IS NULL THEN 'unbound'
    WHEN binding_state = 'orphan' THEN 'orphan' WHEN project_id <> 'shop' THEN 'unknown'
    WHEN EXISTS (SELECT 1 FROM ngaps g WHERE g.gap = last_path
      OR starts_with(last_path, g.gap || '/') OR starts_with(g.gap, last_path || '/'))
      THEN 'unknown'
    WHEN EXISTS (SELECT 1 FROM curfacts c WHERE c.id = target_id AND c.k = target_kind)
      THEN 'bound' ELSE 'orphan' END AS status FROM notes n),
nrows AS (SELECT project_id, sha256(CAST(to_json([id, project_id, text, author, source,
    CAST(is_constraint AS VARCHAR), coalesce(target_kind, ''), coalesce(target_id, ''),
    coalesce(selected_snapshot_id, ''), coalesce(last_label, ''), coalesce(last_path, ''),
    coalesce(last_node_kind, ''), coalesce(binding_state, ''), coalesce(orphaned_at, '')])
    AS VARCHAR)) AS h FROM notes WHERE deleted_at IS NULL),
khash AS MATERIALIZED (SELECT project_id, sha256('annotation-review-v1|' || project_id || '|base|'
    || d) AS knowledge_hash FROM (SELECT project_id, """ + _mixed("AS d FROM nrows") + r"""
    GROUP BY project_id)),
oprows AS (SELECT plan_id, sha256(CAST(to_json([CAST(op_index AS VARCHAR), kind,
    temp_id, name, file_path, language, signature, description, node_id, relation_id, type,
    source_id, target_id, text]) AS VARCHAR)) AS h FROM ops),
shash AS MATERIALIZED (SELECT p.*, CASE WHEN first = 'signup' THEN '' ELSE first END
    AS description, sha256(CAST(to_json([p.plan_id, project_id, title,
      CASE WHEN first = 'signup' THEN '' ELSE first END, 'base', baseline_content_hash, d])
      AS VARCHAR)) AS semantic_hash
  FROM plans p JOIN (SELECT plan_id, """ + _mixed("AS d FROM oprows") + r""" GROUP BY plan_id) o
    ON o.plan_id = p.plan_id),
app AS MATERIALIZED (SELECT 'app:' || event_id AS id, e.plan_id, s.project_id,
    CAST(least(floor(k / 10) + 1, 5) AS BIGINT) AS revision,
    date_trunc('day', ts) AS approved_at, event_id AS insertion,
    CASE WHEN value < 100 THEN semantic_hash ELSE 'bad' END AS semantic_hash,
    k >= 20 AS has_context,
    CASE WHEN k >= 20 THEN CASE WHEN value < 60 THEN knowledge_hash ELSE 'old' END END
      AS knowledge_hash,
    CAST(least(floor(k / 10) + 1, 5) AS BIGINT)
      + CASE WHEN value > 80 AND value < 100 THEN 1 ELSE 0 END AS frozen_revision,
    semantic_hash AS frozen_hash,
    CASE WHEN k >= 20 THEN CASE WHEN value < 50 THEN knowledge_hash WHEN value >= 60 THEN 'old'
      ELSE 'altered' END END AS context_hash, k < 15 AS in_registry
  FROM ev e JOIN shash s ON s.plan_id = e.plan_id LEFT JOIN khash h ON h.project_id = s.project_id
  WHERE event_type = 'view'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id
    ORDER BY revision DESC, approved_at DESC, insertion DESC) AS rn FROM app) WHERE rn = 1),
guarded AS MATERIALIZED (SELECT * EXCLUDE (rn), CASE
    WHEN frozen_revision <> revision OR frozen_hash <> semantic_hash THEN 'invalid'
    WHEN NOT has_context THEN CASE WHEN in_registry THEN 'legacy' ELSE 'invalid' END
    WHEN context_hash IS NOT DISTINCT FROM knowledge_hash THEN 'v1' ELSE 'invalid' END
    AS context_status FROM newest),
matched AS MATERIALIZED (SELECT g.*, g.has_context AND coalesce(g.knowledge_hash
    = h.knowledge_hash, false) AS knowledge_matches
  FROM guarded g LEFT JOIN khash h ON h.project_id = g.project_id),
""" + SUMMARY.strip() + r""",
errs AS MATERIALIZED (SELECT plan_id FROM summary WHERE errors > 0),
pstat0 AS (SELECT s.*, m.revision AS arev, m.semantic_hash AS ahash, context_status,
    knowledge_matches, e.plan_id IS NOT NULL OR coalesce(context_status = 'invalid', false)
      AS has_error,
    NOT (s.project_id = 'shop' AND baseline_content_hash = 'hash-base') AS stale
  FROM shash s LEFT JOIN matched m ON m.plan_id = s.plan_id
  LEFT JOIN errs e ON e.plan_id = s.plan_id),
pstat AS MATERIALIZED (SELECT *, coalesce(NOT stale AND context_status = 'v1' AND knowledge_matches
    AND arev = revision AND ahash = semantic_hash, false) AND NOT has_error AS valid FROM pstat0),
pst AS MATERIALIZED (SELECT *, CASE WHEN stale THEN 'stale' WHEN valid THEN 'approved'
    ELSE 'draft' END AS status FROM pstat)
"""


# What is reviewed: every third user is careful and keeps only additions of new functions to known
# files; operations say more than in the plain log; the registry has no policy that the base breaks.
REVIEW_OPS = """
ops AS MATERIALIZED (SELECT *, CASE WHEN kind = 'add_function' AND op_index % 2 = 0
      THEN 'def ' || name || '(x)' END AS signature,
    CASE op_index % 7 WHEN 0 THEN 'about ' || op_index WHEN 1 THEN '' END AS description,
    CASE WHEN kind = 'add_relation' THEN ['calls', 'must_call', 'must_reuse'][
      CAST(op_index % 3 AS INT) + 1] END AS type
  FROM ops0 WHERE CAST(substring(plan_id, 6) AS BIGINT) % 3 <> 0 OR (kind = 'add_function'
    AND temp_id LIKE 'temp:%' AND temp_id NOT LIKE 'temp:u%' AND file_path NOT LIKE 'r1/./%'))"""


def with_notes(body: str) -> str:
    text = body.strip()
    sep = "\n" if text[:6].upper() == "SELECT" else ",\n"
    broken = RULE_SQL["rule_invalid_policy_path"]
    sql = with_plans(NOTE_CTES.strip() + sep + text)
    for old, new in (
        ("ops AS MATERIALIZED (\n  SELECT", "ops0 AS MATERIALIZED (\n  SELECT"),
        ("\nplans AS (SELECT 'plan:'", REVIEW_OPS + ",\nplans AS (SELECT 'plan:'"),
        ("'r' || n_regionkey AS region", "'none' AS region"),
        (broken, broken.replace("'shop'", "'other'")),
    ):
        assert old in sql, old
        sql = sql.replace(old, new, 1)
    return sql.replace("'pkg:1", "'none")


def _review(spark, sf):
    c = _load(spark, sf)
    i, kind = F.col("op_index"), F.col("kind")
    careful = F.col("plan_id").substr(6, 20).cast("bigint") % 3 == 0
    temp, path = F.col("temp_id"), F.col("file_path")
    plain = ((kind == "add_function") & temp.startswith("temp:") & ~temp.startswith("temp:u")
             & ~path.startswith("r1/./"))
    types = F.array(*[F.lit(t) for t in ("calls", "must_call", "must_reuse")])
    c.ops = c.ops.filter(~careful | plain).withColumns({
        "signature": F.when((kind == "add_function") & (i % 2 == 0),
                            F.concat(F.lit("def "), "name", F.lit("(x)"))),
        "description": F.when(i % 7 == 0, F.concat(F.lit("about "), i.cast("string")))
        .when(i % 7 == 1, ""),
        "type": F.when(kind == "add_relation", F.get(types, (i % 3).cast("int"))),
    })
    c.state = lru_cache(lambda: S.plan_state(c.ops, c.nodes))
    region = F.col("id").startswith("pol:r")
    c.policies = c.policies.withColumn(
        "project_id", F.when(region, "other").otherwise(F.col("project_id"))).withColumn(
        "forbidden", F.when(region, F.col("forbidden")).otherwise(
            F.array(F.lit("none"), F.lit("moved"))))
    return c


def _resolved(spark, sf):
    c = _load(spark, sf)
    g, cur = c.graph, F.col("snapshot_id") == "cur"
    return A.resolve_annotations(
        K.notes(spark, sf), "cur", g.nodes.filter(cur), g.relations.filter(cur),
        g.coverage.filter(cur), g.diagnostics.filter(cur), g.snapshots.filter(cur),
    )


# ---- notes ----------------------------------------------------------------------------------------
@query("resolve_annotations", with_notes("SELECT id, project_id, status FROM resolved"))
def resolve_annotations(spark, sf):
    return _resolved(spark, sf).select("id", "project_id", "status")


@query("reconcile_annotations", with_notes("""
SELECT id, revision + 1 AS revision, 'orphan' AS binding_state, 'cur' AS orphaned_at, target_id
FROM resolved WHERE deleted_at IS NULL AND binding_state = 'bound' AND status = 'orphan'"""))
def reconcile_annotations(spark, sf):
    return A.reconcile_annotations(_resolved(spark, sf)).select(
        "id", "revision", "binding_state", "orphaned_at", "target_id")


@query("annotation_capture_unavailable", with_notes("""
p AS (SELECT DISTINCT file_path AS path FROM nodes WHERE file_path IS NOT NULL
      AND snapshot_id = 'cur')
SELECT path, bool_or(g.gap = path OR starts_with(path, g.gap || '/')
  OR starts_with(g.gap, path || '/')) AS unavailable FROM p, ngaps g GROUP BY path"""))
def annotation_capture_unavailable(spark, sf):
    c = _load(spark, sf)
    g, cur = c.graph, F.col("snapshot_id") == "cur"
    paths = g.nodes.filter(cur & F.col("file_path").isNotNull()).select(
        *SCOPE, F.col("file_path").alias("path"))
    return A.capture_unavailable(
        paths, g.coverage.filter(cur), g.diagnostics.filter(cur), g.snapshots.filter(cur)
    ).drop(*SCOPE)


@query("unavailable_paths", with_notes("SELECT gap AS path FROM ngaps"))
def unavailable_paths(spark, sf):
    from ..plans.verify import capture_gaps

    c = _load(spark, sf)
    cur = F.col("snapshot_id") == "cur"
    return capture_gaps(c.graph.coverage.filter(cur), c.graph.diagnostics.filter(cur)).select(
        "path").distinct()


@query("select_target", with_notes("""
sel AS (SELECT id, target_kind, target_id, CASE WHEN is_constraint THEN 'base' ELSE 'cur' END AS ss
        FROM notes WHERE target_id IS NOT NULL AND project_id = 'shop'),
facts AS (SELECT id, 'node' AS k, coalesce(qualified_name, name) AS label,
    coalesce(file_path, CASE WHEN kind IN ('file', 'folder') THEN name END) AS path,
    kind AS node_kind FROM nodes WHERE snapshot_id = 'cur' AND kind <> 'external'
  UNION ALL SELECT id, 'relation', type || ': ' || source_id || ' → ' ||
    coalesce(target_id, 'unknown'), evidence_path, NULL FROM relations
    WHERE snapshot_id = 'cur'),
j AS (SELECT s.*, f.id AS fid, label, path, node_kind, CASE WHEN ss <> 'cur'
    THEN 'SNAPSHOT_CHANGED' WHEN f.id IS NULL THEN 'NOT_A_FACT'
    WHEN EXISTS (SELECT 1 FROM ngaps g WHERE g.gap = path OR starts_with(path, g.gap || '/')
      OR starts_with(g.gap, path || '/')) THEN 'CAPTURE_UNAVAILABLE' END AS problem
  FROM sel s LEFT JOIN facts f ON f.id = s.target_id AND f.k = s.target_kind)
SELECT id, problem, CASE WHEN problem IS NULL THEN label END AS label,
  CASE WHEN problem IS NULL THEN path END AS path,
  CASE WHEN problem IS NULL THEN node_kind END AS node_kind FROM j"""))
def select_target(spark, sf):
    """Re-bind every note's target in the current snapshot; constraints still name the old one."""
    c = _load(spark, sf)
    g, cur = c.graph, F.col("snapshot_id") == "cur"
    wanted = K.notes(spark, sf).filter(
        F.col("target_id").isNotNull() & (F.col("project_id") == "shop")
    ).select("project_id", F.lit("cur").alias("snapshot_id"), "id", "target_kind", "target_id",
             F.when(F.col("is_constraint"), "base").otherwise("cur").alias("selected_snapshot_id"))
    return A.select_target(
        wanted, g.nodes.filter(cur), g.relations.filter(cur), g.coverage.filter(cur),
        g.diagnostics.filter(cur), g.snapshots.filter(cur),
    ).select("id", "problem", "label", "path", "node_kind")


@query("annotation_list", with_notes("""
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS position,
        count(*) OVER (PARTITION BY project_id) AS total FROM resolved
      WHERE deleted_at IS NULL AND status = 'orphan')
SELECT project_id, id, position, total, total > 100 AS truncated FROM r WHERE position <= 100"""))
def annotation_list(spark, sf):
    return A.annotation_list(_resolved(spark, sf), "orphan", 0, 100).select(
        "project_id", "id", "position", "total", "truncated")


@query("order_annotations", with_notes(
    "SELECT id, created_at FROM notes WHERE deleted_at IS NULL ORDER BY created_at, id"))
def order_annotations(spark, sf):
    return K.notes(spark, sf).filter(F.col("deleted_at").isNull()).orderBy(
        *A.annotation_order()).select("id", "created_at")


@query("stored_note_check", with_notes("""
SELECT id, 'source' AS field FROM notes WHERE source = 'agent'
UNION ALL SELECT id, 'project_id' FROM notes WHERE project_id = 'other'
UNION ALL SELECT id, 'orphan' FROM notes WHERE binding_state = 'orphan' AND is_constraint"""))
def stored_note_check(spark, sf):
    """Notes of an unknown project, with a foreign source or an orphan without its snapshot."""
    damaged = K.notes(spark, sf).withColumn(
        "source", F.when(F.col("source") == "agent", "robot").otherwise(F.col("source"))
    ).withColumn("orphaned_at", F.when(~F.col("is_constraint"), F.col("orphaned_at")))
    projects = _load(spark, sf, ()).snapshots.select("project_id")
    return A.stored_note_check(damaged, projects)


_CHANGES = """
ch AS MATERIALIZED (SELECT n.id, event_id AS seq, CASE WHEN event_type IN ('signup', 'click')
    THEN 'edit' WHEN event_type = 'purchase' THEN 'bind' WHEN event_type = 'view' THEN 'detach'
    ELSE 'delete' END AS action, CAST(floor(value / 40) + 1 AS BIGINT) AS expected,
    'note ' || k AS new_text, 'function:o' || event_id AS new_target
  FROM nev e JOIN notes n ON n.id = e.id WHERE event_id > created_seq),
st AS (
  SELECT id, revision, text, target_id, CAST(-1 AS BIGINT) AS seq, 'create' AS action,
    false AS noop FROM notes
  UNION ALL
  SELECT q.id, CASE WHEN noop2 THEN rev ELSE rev + 1 END, CASE act WHEN 'edit' THEN new_text
      ELSE old_text END, CASE act WHEN 'bind' THEN new_target WHEN 'detach' THEN NULL
      ELSE old_target END, cseq, act, noop2
  FROM (SELECT s.id, s.revision AS rev, s.text AS old_text, s.target_id AS old_target,
      c.seq AS cseq, c.action AS act, c.new_text, c.new_target,
      (c.action = 'edit' AND c.new_text = s.text) OR (c.action = 'bind'
        AND s.target_id IS NOT NULL AND c.new_target = s.target_id)
      OR (c.action = 'detach' AND s.target_id IS NULL) AS noop2,
      row_number() OVER (PARTITION BY s.id ORDER BY c.seq) AS nth
    FROM st s JOIN ch c ON c.id = s.id AND c.seq > s.seq AND c.expected = s.revision
    WHERE s.action <> 'delete') q WHERE nth = 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _applied(spark, sf):
    return A.apply_changes(K.notes(spark, sf), K.note_changes(spark, sf))


@query("annotation_apply_changes", _recursive(with_notes(_CHANGES + """
SELECT id, seq, 'applied' AS outcome, revision, text, target_id FROM st
  WHERE action <> 'create' AND NOT noop
UNION ALL SELECT id, seq, 'conflict', expected, NULL, NULL FROM ch
  WHERE (id, seq) NOT IN (SELECT (id, seq) FROM st)""")))
def annotation_apply_changes(spark, sf):
    _, history, conflicts = _applied(spark, sf)
    none = F.lit(None).cast("string")
    return history.select(
        "id", "seq", F.lit("applied").alias("outcome"), "revision", "text", "target_id"
    ).unionByName(conflicts.select(
        "id", "seq", F.lit("conflict").alias("outcome"), F.col("expected").alias("revision"),
        none.alias("text"), none.alias("target_id")))


@query("annotation_history", _recursive(with_notes(_CHANGES + """,
h AS (SELECT id, revision, seq, action FROM st WHERE NOT noop),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, seq DESC) AS position,
        count(*) OVER (PARTITION BY id) AS total FROM h)
SELECT id, revision, action, position, total, total > 2 AS truncated FROM r WHERE position <= 2""")))
def annotation_history(spark, sf):
    _, history, _ = _applied(spark, sf)
    created = K.notes(spark, sf).select(
        "id", "revision", F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("action"))
    rows = history.select("id", "revision", "seq", "action").unionByName(created)
    return A.annotation_history(rows, 0, 2).select(
        "id", "revision", "action", "position", "total", "truncated")


@query("current_revision", _recursive(with_notes(_CHANGES + """
SELECT id, arg_max(revision, seq) AS revision, arg_max(action = 'delete', seq) AS deleted
FROM st GROUP BY id""")))
def current_revision(spark, sf):
    return _applied(spark, sf)[0].select("id", "revision", "deleted")


@query("knowledge_hash", with_notes("SELECT project_id, knowledge_hash FROM khash"))
def knowledge_hash(spark, sf):
    return A.knowledge_hash(K.notes(spark, sf), "base")


# ---- approvals and status ---------------------------------------------------------------------------
def _hashed(spark, sf):
    c = _review(spark, sf)
    return c, T.semantic_hash(c.plans, c.ops)


def _approvals(spark, sf):
    c, plans = _hashed(spark, sf)
    knowledge = A.knowledge_hash(K.notes(spark, sf), "base")
    return c, plans, knowledge, K.approvals(spark, sf, plans, knowledge)


def _status(spark, sf):
    """Statuses with the errors of all rules."""
    c, plans, knowledge, approvals = _approvals(spark, sf)
    guarded = T.approval_guard(T.latest_approval(approvals))
    matched = T.knowledge_match(guarded, knowledge)
    return c, T.plan_status(plans, matched, c.snapshots, issue_summary(c)), guarded, knowledge


@query("semantic_plan_hash", with_notes("SELECT plan_id, semantic_hash FROM shash"))
def semantic_plan_hash(spark, sf):
    return _hashed(spark, sf)[1].select("plan_id", "semantic_hash")


@query("latest_approval", with_notes(
    "SELECT plan_id, id, revision, approved_at, insertion FROM newest"))
def latest_approval(spark, sf):
    return T.latest_approval(_approvals(spark, sf)[3]).select(
        "plan_id", "id", "revision", "approved_at", "insertion")


@query("approval_guard", with_notes("SELECT plan_id, id, context_status FROM guarded"))
def approval_guard(spark, sf):
    return T.approval_guard(T.latest_approval(_approvals(spark, sf)[3])).select(
        "plan_id", "id", "context_status")


@query("legacy_approval_check", with_notes("""
SELECT id, plan_id, in_registry AS accepted FROM app WHERE NOT has_context"""))
def legacy_approval_check(spark, sf):
    approvals = _approvals(spark, sf)[3]
    registry = approvals.filter("in_registry").select("id")
    contexts = approvals.filter("has_context").select("id")
    return T.legacy_approval_check(approvals, registry, contexts)


@query("knowledge_match", with_notes("SELECT plan_id, knowledge_matches FROM matched"))
def knowledge_match(spark, sf):
    _, _, knowledge, approvals = _approvals(spark, sf)
    guarded = T.approval_guard(T.latest_approval(approvals))
    return T.knowledge_match(guarded, knowledge).select("plan_id", "knowledge_matches")


@query("plan_status", with_notes("SELECT plan_id, status, valid, has_error FROM pst"))
def plan_status(spark, sf):
    return _status(spark, sf)[1].select("plan_id", "status", "valid", "has_error")


@query("pending_plans", with_notes("""
SELECT plan_id, status, status <> 'stale' AND NOT has_error AS can_approve FROM pst
WHERE NOT valid"""))
def pending_plans(spark, sf):
    return T.pending_plans(_status(spark, sf)[1]).select("plan_id", "status", "can_approve")


@query("approve_plans", with_notes("""
req AS (SELECT plan_id, CAST(5 AS BIGINT) AS expected_revision FROM plans
        UNION ALL SELECT 'plan:none:' || user_id, 1 FROM (SELECT DISTINCT user_id FROM events)),
j AS (SELECT r.plan_id, expected_revision, CASE WHEN status IS NULL THEN 'NOT_FOUND'
    WHEN revision <> expected_revision THEN 'REVISION_CONFLICT' WHEN status = 'stale'
    THEN 'BASELINE_CONFLICT' WHEN has_error THEN 'VALIDATION_FAILED' ELSE 'approved' END AS outcome,
    semantic_hash, h.knowledge_hash
  FROM req r LEFT JOIN pst p ON p.plan_id = r.plan_id
  LEFT JOIN khash h ON h.project_id = p.project_id)
SELECT plan_id, expected_revision, outcome,
  CASE outcome WHEN 'approved' THEN semantic_hash END AS semantic_hash,
  CASE outcome WHEN 'approved' THEN knowledge_hash END AS review_hash FROM j"""))
def approve_plans(spark, sf):
    _, status, _, knowledge = _status(spark, sf)
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    asked = users.select(F.concat(F.lit("plan:"), "u").alias("plan_id"),
                         F.lit(5).cast("bigint").alias("expected_revision")).unionByName(
        users.select(F.concat(F.lit("plan:none:"), "u").alias("plan_id"),
                     F.lit(1).cast("bigint").alias("expected_revision")))
    return T.approve_plans(status, asked, knowledge)


@query("invalidate_plans", _recursive(with_notes(_CHANGES + """
SELECT project_id, plan_id, revision + 1 AS revision, 'draft' AS status FROM plans
WHERE project_id IN (SELECT project_id FROM notes JOIN st USING (id) WHERE st.action <> 'create'
  AND NOT noop)""")))
def invalidate_plans(spark, sf):
    _, history, _ = _applied(spark, sf)
    changed = K.notes(spark, sf).join(history.select("id").distinct(), "id", "left_semi")
    return T.invalidate_plans(L.plans(spark, sf).withColumnRenamed("id", "plan_id"), changed)


@query("plan_apply_changes", with_notes("""
c AS (SELECT plan_id, event_id AS seq, CAST(floor(value / 10) + 1 AS BIGINT) AS er,
        CASE WHEN k < 30 THEN 'base' WHEN k < 40 THEN 'cur' END AS es FROM ev
      WHERE event_type = 'click'),
j AS (SELECT c.*, CASE WHEN er <> revision THEN 'REVISION_CONFLICT'
    WHEN es IS NOT NULL AND (project_id <> 'shop' OR es <> 'base') THEN 'SNAPSHOT_CHANGED'
    WHEN es IS NOT NULL AND baseline_content_hash <> 'hash-base' THEN 'BASELINE_CONFLICT' END
    AS code, revision, title FROM c JOIN plans USING (plan_id)),
w AS (SELECT plan_id, min(seq) AS seq FROM j WHERE code IS NULL GROUP BY plan_id)
SELECT j.plan_id, j.seq, CASE WHEN w.seq IS NOT NULL THEN 'applied'
  ELSE coalesce(code, 'REVISION_CONFLICT') END AS outcome,
  CASE WHEN w.seq IS NOT NULL THEN revision + 1 END AS revision
FROM j LEFT JOIN w ON w.plan_id = j.plan_id AND w.seq = j.seq"""))
def plan_apply_changes(spark, sf):
    c = _load(spark, sf)
    changes = L.events(spark, sf).filter(F.col("event_type") == "click").select(
        "plan_id", F.col("event_id").alias("seq"),
        (F.floor(F.col("value") / 10) + 1).alias("expected_revision"),
        F.when(F.col("k") < 30, "base").when(F.col("k") < 40, "cur").alias("expected_snapshot_id"),
        F.lit(None).cast("string").alias("new_title"),
    )
    applied, refused = T.plan_apply_changes(
        c.plans.drop("snapshot_id"), changes, c.snapshots)
    return applied.select("plan_id", "seq", F.lit("applied").alias("outcome"), "revision").unionByName(
        refused.select("plan_id", "seq", F.col("code").alias("outcome"),
                       F.lit(None).cast("bigint").alias("revision")))


@query("export_plan", with_notes("""
h AS (SELECT p.plan_id, ['# ' || title, 'Current revision: ' || p.revision,
    'Current valid: ' || valid, 'Approved revision: ' || coalesce(CAST(g.revision AS VARCHAR),
    'none'), 'Semantic SHA-256: ' || coalesce(g.semantic_hash, 'none'),
    'Annotation review: ' || coalesce(g.context_status, 'none'),
    'Knowledge SHA-256: ' || coalesce(g.knowledge_hash, 'unrecorded'), description] AS t
  FROM pst p LEFT JOIN guarded g ON g.plan_id = p.plan_id)
SELECT plan_id, CAST(unnest(generate_series(0, 7)) AS BIGINT) AS line, unnest(t) AS text FROM h
UNION ALL SELECT plan_id, op_index + 8, CAST(to_json([kind, temp_id, name, file_path, language,
  signature, description, node_id, relation_id, type, source_id, target_id, text]) AS VARCHAR)
FROM ops"""))
def export_plan(spark, sf):
    c, status, guarded, _ = _status(spark, sf)
    return T.export_plan(status, guarded, c.ops)


@query("ownership_intent_match", with_notes("""
i AS (SELECT e.plan_id, e.event_id, 'function:o' || event_id AS source_id,
        CAST(floor(k / 10) + 1 AS BIGINT) AS revision FROM ev e WHERE event_type = 'view')
SELECT event_id, coalesce(p.plan_id IS NOT NULL AND p.project_id = 'shop', false)
  AND NOT EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = i.plan_id AND o.node_id = i.source_id
    AND o.kind = 'remove_function')
  AND (EXISTS (SELECT 1 FROM bn WHERE bn.id = i.source_id AND kind = 'function')
    OR EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = i.plan_id AND o.temp_id = i.source_id))
  AS current
FROM i LEFT JOIN plans p ON p.plan_id = i.plan_id AND p.revision = i.revision"""))
def ownership_intent_match(spark, sf):
    c = _review(spark, sf)
    intents = L.events(spark, sf).filter(F.col("event_type") == "view").select(
        F.lit("shop").alias("project_id"), F.lit("base").alias("snapshot_id"), "plan_id",
        (F.floor(F.col("k") / 10) + 1).alias("revision"), "event_id",
        F.concat(F.lit("function:o"), F.col("event_id").cast("string")).alias("source_id"))
    functions = c.nodes.filter(F.col("kind") == "function")
    return T.ownership_intent_match(intents, c.plans, c.ops, functions).select(
        "event_id", "current")


# ---- structure files ------------------------------------------------------------------------------
_FILES = """
WITH s AS (SELECT 'c' || c_custkey AS project_id, c_custkey, c_nationkey, c_mktsegment AS seg,
             c_name, c_acctbal FROM customer)"""
_GOOD = "seg NOT IN ('AUTOMOBILE')"


@query("structure_validate", _FILES + """
SELECT project_id, '' AS pointer, 'duplicate_key' AS kind FROM s WHERE seg = 'AUTOMOBILE'
UNION ALL SELECT project_id, '/schemaVersion', 'version' FROM s WHERE seg = 'FURNITURE'
UNION ALL SELECT project_id, '/dependencyRules', 'type' FROM s WHERE seg = 'FURNITURE'
UNION ALL SELECT project_id, '/folders/1/path', 'path' FROM s WHERE seg = 'MACHINERY'
UNION ALL SELECT project_id, '/folders/1/path', 'duplicate_path' FROM s WHERE seg = 'HOUSEHOLD'""")
def structure_validate(spark, sf):
    return X.structure_validate(K.structure_files(spark, sf))


@query("structure_canonical", _FILES + """,
f AS (SELECT *, CAST(to_json(['src/c' || c_custkey, '["a","b"]', NULL,
    '{"note":1,"purpose":"' || c_name || '"}']) AS VARCHAR) AS f1,
  CAST(to_json([CASE seg WHEN 'MACHINERY' THEN NULL WHEN 'HOUSEHOLD' THEN 'src/c' || c_custkey
      ELSE 'lib/n' || c_nationkey END, '["a","b"]', NULL, '{"note":1,"purpose":"shared"}'])
    AS VARCHAR) AS f2,
  CASE WHEN seg = 'FURNITURE' THEN '' ELSE CAST(to_json(['src/**', '["app","lib"]',
    '{"reason":"c' || c_custkey || '"}']) AS VARCHAR) END AS r,
  '{"schemaVersion":' || CASE WHEN seg = 'FURNITURE' THEN '2' ELSE '1' END
    || ',"x-graph":{"legacyPathPolicies":[{"forbiddenDependencies":["z/","a"],"id":"pol:n'
    || c_nationkey || '","pathPrefix":"lib/","purpose":"p"}],"schemaVersion":1}}' AS others
  FROM s WHERE seg <> 'AUTOMOBILE')
SELECT project_id, sha256(concat_ws(chr(10) || '--' || chr(10), least(f1, f2) || chr(10)
  || greatest(f1, f2), r, others)) AS semantic_digest FROM f""")
def structure_canonical(spark, sf):
    return X.structure_canonical(K.structure_files(spark, sf))


@query("policy_canonical", """
SELECT 'pol:n' || n_nationkey AS id, sha256(CAST(to_json(['pol:n' || n_nationkey,
  'r' || n_regionkey || '/n' || n_nationkey, n_name]) AS VARCHAR) || ',' || CAST(to_json(
  list_sort(['r' || n_regionkey, 'pkg:1', 'moved'])) AS VARCHAR)) AS digest FROM nation
UNION ALL SELECT 'pol:r' || r_regionkey, NULL FROM region""")
def policy_canonical_query(spark, sf):
    return L.policies(spark, sf).select("id", F.sha2(_canonical(), 256).alias("digest"))


def _canonical():
    prefix = normalize_structure_path("path_prefix")
    targets = F.transform("forbidden", lambda t: normalize_structure_path(t))
    return F.when(prefix.isNotNull(), policy_canonical("id", prefix, "purpose", targets))


@query("structure_apply", _FILES + """,
g AS (SELECT *, 'src/c' || c_custkey AS mine, 'lib/n' || c_nationkey AS lib FROM s),
o AS (SELECT project_id, 'new/' || c_custkey AS path, NULL AS previous_path, 'added' AS outcome,
        'new/' || c_custkey AS new_path FROM g
  UNION ALL SELECT project_id, mine || '/', NULL, 'TARGET_EXISTS', NULL FROM g
  UNION ALL SELECT project_id, 'moved', './' || mine, 'updated', 'moved' FROM g
  UNION ALL SELECT project_id, lib, mine, 'TARGET_EXISTS', NULL FROM g
  UNION ALL SELECT project_id, mine, mine, 'updated', mine FROM g
  UNION ALL SELECT project_id, 'x', 'nowhere', 'SOURCE_MISSING', NULL FROM g
  UNION ALL SELECT project_id, '../x', NULL, 'INVALID_PATH', NULL FROM g)
SELECT project_id, path, previous_path,
  CASE WHEN seg = 'BUILDING' THEN outcome ELSE 'DOCUMENT_INVALID' END AS outcome,
  CASE WHEN seg = 'BUILDING' THEN new_path END AS new_path FROM o JOIN s USING (project_id)""")
def structure_apply(spark, sf):
    files = K.structure_files(spark, sf)
    parsed = X.parse_structure(files)
    current = X.folders(parsed).select("project_id", "path", F.to_json("f").alias("body"))
    mine = F.concat(F.lit("src/"), "project_id")
    lib = F.concat(F.lit("lib/n"), F.col("c_nationkey").cast("string"))
    row = lambda p, q: F.struct(p.alias("path"), q.cast("string").alias("previous_path"))
    key = F.col("c_custkey").cast("string")
    ops = files.select("project_id", F.explode(F.array(
        row(F.concat(F.lit("new/"), key), F.lit(None)), row(F.concat(mine, F.lit("/")), F.lit(None)),
        row(F.lit("moved"), F.concat(F.lit("./"), mine)), row(lib, mine), row(mine, mine),
        row(F.lit("x"), F.lit("nowhere")), row(F.lit("../x"), F.lit(None)),
    )).alias("o")).select("project_id", "o.*")
    return X.structure_apply(current, ops, X.structure_validate(files)).select(
        "project_id", "path", "previous_path", "outcome", "new_path")


def _file_policies(spark, sf):
    parsed = X.parse_structure(K.structure_files(spark, sf)).filter(F.col("doc").isNotNull())
    return X.project_policies(parsed)


_POL = _FILES + """,
fp AS (SELECT project_id, 'structure-folder:' || substring(sha256(CAST(to_json(['structure-folder',
      project_id, p]) AS VARCHAR)), 1, 32) AS id, p AS path_prefix, purpose
    FROM (SELECT project_id, 'src/c' || c_custkey AS p, c_name AS purpose FROM s
          WHERE seg <> 'AUTOMOBILE'
      UNION ALL SELECT project_id, CASE seg WHEN 'HOUSEHOLD' THEN 'src/c' || c_custkey
          ELSE 'lib/n' || c_nationkey END, 'shared' FROM s
          WHERE seg NOT IN ('AUTOMOBILE', 'MACHINERY')
      UNION ALL SELECT project_id, NULL, 'shared' FROM s WHERE seg = 'MACHINERY')
  UNION ALL SELECT project_id, 'pol:n' || c_nationkey, 'lib', 'p' FROM s WHERE seg <> 'AUTOMOBILE'),
sp AS (SELECT 'c' || c_custkey AS project_id, 'pol:n' || n_nationkey AS id, n_name AS purpose
       FROM customer JOIN nation ON n_nationkey = c_nationkey
       UNION ALL SELECT 'c' || c_custkey, 'pol:r' || n_regionkey, n_name
       FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query("structure_project_policies", _POL + """
SELECT project_id, id, path_prefix, purpose, count(*) OVER (PARTITION BY project_id, id) > 1
  AS clash FROM fp""")
def structure_project_policies(spark, sf):
    return _file_policies(spark, sf).select("project_id", "id", "path_prefix", "purpose", "clash")


def _stored(spark, sf):
    """Stored policies of every customer project: its nation's and its region's."""
    rows = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ids = F.explode(F.array(
        F.concat(F.lit("pol:n"), F.col("n_nationkey").cast("string")),
        F.concat(F.lit("pol:r"), F.col("n_regionkey").cast("string"))))
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("project_id"),
                       ids.alias("id"), F.col("n_name").alias("purpose"))


@query("policy_union", _POL + """
SELECT project_id, id, purpose, 'file' AS origin FROM fp
UNION ALL SELECT project_id, id, purpose, 'stored' FROM sp
WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.project_id = sp.project_id AND fp.id = sp.id)""")
def policy_union(spark, sf):
    return X.policy_union(_file_policies(spark, sf).select("project_id", "id", "purpose"),
                          _stored(spark, sf))


@query("legacy_pending_count", _POL + """
SELECT project_id, count(*) AS pending FROM sp
WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.project_id = sp.project_id AND fp.id = sp.id)
GROUP BY project_id""")
def legacy_pending_count(spark, sf):
    return X.legacy_pending_count(_file_policies(spark, sf), _stored(spark, sf))


@query("nearest_owner_conflicts", _POL + """
SELECT id, count(DISTINCT project_id) AS projects FROM (SELECT id, project_id FROM fp
  UNION ALL SELECT id, project_id FROM sp) GROUP BY id HAVING count(DISTINCT project_id) > 1""")
def nearest_owner_conflicts(spark, sf):
    return X.owner_conflicts(_file_policies(spark, sf), _stored(spark, sf))


def _previous_state(spark, sf):
    """Earlier state of half of the projects (those with a positive balance)."""
    files = K.structure_files(spark, sf)
    seen = F.when(F.col("c_acctbal") > 5000, F.sha2("text", 256)).otherwise("old-digest")
    return files.filter(F.col("c_acctbal") > 0).select(
        "project_id", F.lit("ready").alias("status"), seen.alias("file_digest"),
        F.lit("old-semantic").alias("semantic_digest"), F.lit(3).cast("bigint").alias("revision"),
        F.lit("old-semantic").alias("last_good"))


def _transition(spark, sf):
    files = K.structure_files(spark, sf)
    observed = files.select("project_id", F.when(
        F.col("c_nationkey") != 3, F.sha2("text", 256)).alias("file_digest"))
    clashes = _file_policies(spark, sf).filter("clash")
    return X.status_transition(
        observed, _previous_state(spark, sf), X.structure_validate(files),
        X.structure_canonical(files), clashes)


@query("structure_status_transition", _FILES + """,
o AS (SELECT *, c_nationkey = 3 AS missing, c_acctbal > 0 AS had, c_acctbal > 5000 AS same FROM s),
t AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN seg <> 'BUILDING' THEN 'invalid'
    ELSE 'ready' END AS status, CASE WHEN had THEN missing OR NOT same ELSE NOT missing END
    AS changed FROM o),
u AS (SELECT *, changed OR NOT had OR status <> 'ready' AS audited FROM t)
SELECT project_id, status, CASE WHEN had THEN 3 ELSE 0 END + CASE WHEN changed THEN 1 ELSE 0 END
  AS revision, audited, audited AND (had OR status = 'ready' OR (changed AND status = 'invalid'))
  AS invalidates_plans, CASE status WHEN 'invalid' THEN 'failed' ELSE 'committed' END AS outcome
FROM u""")
def structure_status_transition(spark, sf):
    return _transition(spark, sf).select(
        "project_id", "status", F.col("revision").cast("bigint").alias("revision"), "audited",
        "invalidates_plans", "outcome")


@query("idempotent_mutations", """
WITH r AS (SELECT 'p' || user_id AS project_id, CAST(floor(value) AS BIGINT) AS mutation_id,
             event_id AS seq, event_type AS request_hash FROM events),
k AS (SELECT 'p' || user_id AS project_id, CAST(floor(value) AS BIGINT) AS mutation_id,
        arg_min(event_type, event_id) AS rh, CASE WHEN min(event_id) > 300 THEN 'no_op'
        ELSE 'conflicted' END AS ro FROM events WHERE value < 20 GROUP BY 1, 2),
w AS (SELECT *, first_value(request_hash) OVER p AS oh, min(seq) OVER p AS os FROM r
      WINDOW p AS (PARTITION BY project_id, mutation_id ORDER BY seq ROWS BETWEEN
        UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT w.project_id, w.mutation_id, seq, CASE WHEN rh IS NOT NULL AND rh <> request_hash
  THEN 'conflict' WHEN ro = 'no_op' THEN 'done' WHEN ro IS NOT NULL THEN 'ended'
  WHEN request_hash <> oh THEN 'conflict' WHEN seq > os THEN 'done' ELSE 'new' END AS outcome
FROM w LEFT JOIN k ON k.project_id = w.project_id AND k.mutation_id = w.mutation_id""")
def idempotent_mutations(spark, sf):
    rows = _mutations(spark, sf)
    receipts = rows.filter(F.col("value") < 20).groupBy("project_id", "mutation_id").agg(
        F.min_by("request_hash", "seq").alias("request_hash"),
        F.when(F.min("seq") > 300, "no_op").otherwise("conflicted").alias("outcome"))
    return X.idempotent_mutations(rows.drop("value", "ts"), receipts)


def _mutations(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"),
        F.floor("value").alias("mutation_id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("request_hash"), "value", "ts")


@query("structure_cas", _FILES + """
SELECT project_id, CASE WHEN c_acctbal > 0 AND seg <> 'BUILDING' THEN 'accepted' ELSE 'conflict' END
  AS outcome FROM s""")
def structure_cas(spark, sf):
    """Every project writes what it saw; one segment saw an older revision."""
    state = _previous_state(spark, sf)
    asked = K.structure_files(spark, sf).select(
        "project_id",
        F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(3).alias("expected_revision"),
        F.when(F.col("c_acctbal") > 5000, F.sha2("text", 256)).otherwise("old-digest")
        .alias("expected_digest"))
    return X.structure_cas(asked, state).select("project_id", "outcome")


@query("intent_outcome", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'conflicted'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'retry' WHEN o_orderstatus = 'F' THEN 'committed'
  WHEN o_orderstatus = 'O' THEN 'aborted' ELSE 'conflicted' END AS outcome FROM orders""")
def intent_outcome(spark, sf):
    """Every order as a pending write from status O to F of its own project."""
    rows = table(spark, sf, "orders").withColumn("project_id", F.col("o_orderkey").cast("string"))
    intents = rows.select(
        "project_id", "o_orderkey", F.lit("O").alias("before_digest"),
        F.lit("F").alias("after_digest"),
        F.when(F.col("o_orderpriority") == "5-LOW", "conflicted").otherwise("prepared")
        .alias("phase"))
    seen = rows.select("project_id", F.col("o_orderstatus").alias("observed_digest"),
                       (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("readable"))
    return X.intent_outcome(intents, seen).select("o_orderkey", "outcome")


@query("legacy_migration", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'kept' WHEN c_mktsegment = 'BUILDING' THEN 'deleted'
  ELSE 'conflict' END AS action FROM customer""")
def legacy_migration(spark, sf):
    rows = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    stored = rows.select(key.alias("project_id"), key.alias("id"), "c_custkey",
                         F.concat_ws("|", "c_name", F.lit("BUILDING")).alias("canonical"))
    migrated = rows.filter(F.col("c_acctbal") >= 0).select(
        key.alias("project_id"), key.alias("id"),
        F.concat_ws("|", "c_name", "c_mktsegment").alias("canonical"))
    return X.legacy_migration(stored, migrated).select(
        F.col("id").cast("bigint").alias("c_custkey"), "action")


@query("audit_page", """
SELECT project_id, id, position, total FROM (SELECT 'p' || user_id AS project_id,
  'audit:' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY
    date_trunc('day', ts) DESC, 'audit:' || event_id DESC) AS position,
  count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE position <= 20""")
def audit_page(spark, sf):
    audits = table(spark, sf, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"),
        F.concat(F.lit("audit:"), F.col("event_id").cast("string")).alias("id"),
        F.date_trunc("day", "ts").alias("validated_at"))
    return X.audit_page(audits).select("project_id", "id", "position", "total")


@query("structure_file_read", """
SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE sha256(text) END AS file_digest,
  CASE WHEN lang <> 'fr' THEN CAST(strlen(text) AS BIGINT) END AS bytes,
  CASE WHEN lang = 'fr' THEN 'missing' WHEN strlen(text) > 4096 THEN 'invalid' ELSE 'read' END
  AS state FROM documents""")
def structure_file_read(spark, sf):
    """Every document as a project's file; one language has no file."""
    files = table(spark, sf, "documents").select(
        F.col("doc_id").alias("project_id"),
        F.when(F.col("lang") != "fr", F.encode("text", "UTF-8")).alias("content"))
    return X.structure_file_read(files, 4096).select(
        F.col("project_id").alias("doc_id"), "file_digest",
        F.col("bytes").cast("bigint").alias("bytes"), "state")


# ---- records and snapshots ------------------------------------------------------------------------
def _record_log(spark, sf):
    """Events as a change log: errors delete the user's record of a ten group, others put it."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.concat(F.lit("kind"), F.floor(k / 25).cast("string")).alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"),
                 F.floor(k / 10).cast("string")).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("action"),
        F.col("event_type").alias("value"))


_LOG = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
log AS (SELECT 'kind' || CAST(floor(k / 25) AS BIGINT) AS kind,
    'u' || user_id || ':' || CAST(floor(k / 10) AS BIGINT) AS id, event_id AS seq,
    event_type = 'error' AS del, event_type AS value FROM e),
d AS (SELECT kind, id, max(seq) FILTER (WHERE del) AS ds FROM log GROUP BY 1, 2),
cur AS (SELECT l.kind, l.id, min(seq) AS position, arg_max(value, seq) AS value
  FROM log l JOIN d USING (kind, id) WHERE NOT del AND (ds IS NULL OR seq > ds) GROUP BY 1, 2)"""


@query("records_current", _LOG + "\nSELECT * FROM cur")
def records_current(spark, sf):
    return D.records_current(_record_log(spark, sf)).drop("changed_at")


@query("records_apply", _LOG + """,
b AS (SELECT kind, id, CASE value WHEN 'click' THEN NULL ELSE 'v2:' || value END AS value,
        position FROM cur)
SELECT kind, id, position, value FROM b WHERE value IS NOT NULL""")
def records_apply(spark, sf):
    """A second batch deletes every record that says click and rewrites the others."""
    log = _record_log(spark, sf)
    now = D.records_current(log)
    gone = F.col("value") == "click"
    batch = now.select(
        "kind", "id", (F.col("changed_at") + 10**12).alias("seq"),
        F.when(gone, "delete").otherwise("put").alias("action"),
        F.concat(F.lit("v2:"), "value").alias("value"))
    return D.records_current(D.records_apply(log, batch)).drop("changed_at")


@query("freeze_legacy_registry", _LOG + """
SELECT kind, id, position, value FROM cur
UNION ALL SELECT 'legacy-approval', 'app:' || event_id, 0, 'frozen' FROM events
  WHERE event_type = 'view'""")
def freeze_legacy_registry(spark, sf):
    approvals = table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        F.concat(F.lit("app:"), F.col("event_id").cast("string")).alias("id"))
    return D.records_current(
        D.freeze_legacy_registry(_record_log(spark, sf), approvals)).drop("changed_at")


_PUB = """
WITH i AS (SELECT 'p' || o_custkey AS project_id, 'd' || strftime(o_orderdate, '%Y%m') AS
    snapshot_id, o_orderkey AS seq, o_orderstatus AS content_hash FROM orders),
x AS (SELECT DISTINCT 'p' || c_custkey AS project_id, 'd199801' AS snapshot_id,
    'F' AS content_hash FROM customer),
f AS (SELECT project_id, snapshot_id, arg_min(content_hash, seq) AS fh, min(seq) AS fs FROM i
      GROUP BY 1, 2),
r AS (SELECT i.*, CASE WHEN i.content_hash <> coalesce(x.content_hash, fh) THEN 'collision'
    WHEN x.content_hash IS NOT NULL OR seq > fs THEN 'unchanged' ELSE 'inserted' END AS outcome
  FROM i JOIN f USING (project_id, snapshot_id) LEFT JOIN x ON x.project_id = i.project_id
    AND x.snapshot_id = i.snapshot_id)"""


def _published(spark, sf):
    """Orders as snapshots of their customer's project, one id per month."""
    incoming = table(spark, sf, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project_id"),
        F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMM")).alias("snapshot_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("content_hash"))
    existing = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project_id"),
        F.lit("d199801").alias("snapshot_id"), F.lit("F").alias("content_hash"))
    return existing, incoming, D.publish_snapshot(existing, incoming)


@query("publish_snapshot", _PUB + """
SELECT project_id, snapshot_id, seq, content_hash, outcome FROM r""")
def publish_snapshot(spark, sf):
    return _published(spark, sf)[2]


@query("load_snapshot", _PUB + """,
p AS (SELECT project_id, arg_max(snapshot_id, seq) AS snapshot_id FROM r
      WHERE outcome <> 'collision' GROUP BY 1),
q AS (SELECT 'p' || c_custkey AS project_id FROM customer),
a AS (SELECT project_id, snapshot_id, content_hash FROM r WHERE outcome = 'inserted'
      UNION ALL SELECT * FROM x)
SELECT q.project_id, p.snapshot_id, a.content_hash, CASE WHEN a.content_hash IS NULL
  THEN 'NOT_FOUND' ELSE 'ok' END AS status
FROM q LEFT JOIN p USING (project_id) LEFT JOIN a ON a.project_id = p.project_id
  AND a.snapshot_id = p.snapshot_id""")
def load_snapshot(spark, sf):
    existing, _, outcomes = _published(spark, sf)
    stored = existing.unionByName(outcomes.filter(F.col("outcome") == "inserted").select(
        "project_id", "snapshot_id", "content_hash"))
    asked = existing.select("project_id")
    return D.load_snapshot(asked, D.project_pointers(outcomes), stored)
