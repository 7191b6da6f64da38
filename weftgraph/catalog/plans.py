"""Plan overlay, rules and verification over the plan log and the snapshot pair."""

from __future__ import annotations

from functools import lru_cache
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..plans import rules as R
from ..plans import state as S
from ..plans import verify as V
from ..schemas import RELATION_TYPES, SCOPE
from ..sources import plan_log as L
from ..sources.star_graph import PAIR, Graph, coverage, diagnostics, snapshots, star_graph
from ..staging import stage, table
from .plan_prelude import forbids, with_plans, with_verify
from .registry import query


def _load(spark, sf, types=RELATION_TYPES):
    g = star_graph(spark, sf, PAIR, types)
    base = F.col("snapshot_id") == "base"
    plans = L.plans(spark, sf).withColumnRenamed("id", "plan_id").withColumn(
        "snapshot_id", F.lit("base")
    )
    nodes, ops = g.nodes.filter(base), L.plan_operations(spark, sf)
    return SimpleNamespace(
        graph=g, nodes=nodes, relations=g.relations.filter(base), ops=ops, plans=plans,
        state=lru_cache(lambda: S.plan_state(ops, nodes)), policies=L.policies(spark, sf),
        snapshots=g.snapshots.filter(base),
    )


def _out(issues):
    return issues.select("plan_id", "op_index", "severity", "code", "message")


def _sql_issue(code, message, body, index="op_index", severity="error"):
    return (f"SELECT o.plan_id, CAST({index} AS BIGINT) AS op_index, '{severity}' AS severity, "
            f"'{code}' AS code, {message} AS message {body}")


RULE_SQL = {
    "rule_project_mismatch": _sql_issue(
        "PROJECT_MISMATCH", "'plan of another project than the snapshot'",
        "FROM plans o WHERE project_id <> 'shop'", "NULL"),
    "rule_baseline_mismatch": _sql_issue(
        "BASELINE_MISMATCH", "'plan made on another baseline'",
        "FROM plans o WHERE baseline_content_hash <> 'hash-base'", "NULL"),
    "rule_duplicate_node": _sql_issue(
        "DUPLICATE_NODE", "'id ' || temp_id || ' is taken'",
        """FROM ops o WHERE kind = 'add_function' AND NOT EXISTS (SELECT 1 FROM added a
           WHERE a.plan_id = o.plan_id AND a.id = o.temp_id AND a.op_index = o.op_index)"""),
    "rule_invalid_function": _sql_issue(
        "INVALID_FUNCTION", "'no function ' || node_id",
        """FROM ops o WHERE kind IN ('move_function', 'remove_function') AND NOT EXISTS (
           SELECT 1 FROM known k WHERE k.plan_id = o.plan_id AND k.id = o.node_id
           AND k.kind = 'function')"""),
    "rule_invalid_relation": _sql_issue(
        "INVALID_RELATION", "'no relation ' || relation_id",
        """FROM ops o WHERE kind = 'remove_relation' AND NOT EXISTS (SELECT 1 FROM br
           WHERE br.id = o.relation_id)"""),
    "rule_duplicate_removal": _sql_issue(
        "DUPLICATE_REMOVAL", "'function ' || node_id || ' removed again'",
        """FROM ops o JOIN gone g ON g.plan_id = o.plan_id AND g.id = o.node_id
           WHERE o.kind = 'remove_function' AND o.op_index > removed_at""", "o.op_index")
    + " UNION ALL " + _sql_issue(
        "DUPLICATE_REMOVAL", "'relation ' || relation_id || ' removed again'",
        """FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, relation_id
             ORDER BY op_index) AS nth FROM ops WHERE kind = 'remove_relation') o WHERE nth > 1"""),
    "rule_removed_function": _sql_issue(
        "REMOVED_FUNCTION", "'function ' || node_id || ' moves although it is removed'",
        """FROM ops o JOIN gone g ON g.plan_id = o.plan_id AND g.id = o.node_id
           WHERE o.kind = 'move_function'""", "o.op_index"),
    "rule_invalid_target": _sql_issue(
        "INVALID_TARGET", "'nothing to annotate at ' || target_id",
        """FROM ops o WHERE kind = 'annotate'
           AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.plan_id = o.plan_id
                           AND a.id = o.target_id)
           AND NOT ((EXISTS (SELECT 1 FROM br WHERE br.id = o.target_id)
             OR EXISTS (SELECT 1 FROM ops x WHERE x.plan_id = o.plan_id
                 AND x.kind = 'add_relation' AND x.relation_id = o.target_id
                 AND x.op_index < o.op_index))
             AND NOT EXISTS (SELECT 1 FROM ops x WHERE x.plan_id = o.plan_id
                 AND x.kind = 'remove_relation' AND x.relation_id = o.target_id))"""),
    "rule_duplicate_relation": _sql_issue(
        "DUPLICATE_RELATION", "'relation id ' || relation_id || ' is taken'",
        """FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, relation_id
             ORDER BY op_index) AS nth FROM ops WHERE kind = 'add_relation') o
           WHERE nth > 1 OR relation_id IN (SELECT id FROM br)"""),
    "rule_invalid_endpoint": _sql_issue(
        "INVALID_ENDPOINT", "'a call needs a function and a callable'",
        """FROM ops o LEFT JOIN alive s ON s.plan_id = o.plan_id AND s.id = o.source_id
           LEFT JOIN alive t ON t.plan_id = o.plan_id AND t.id = o.target_id
           WHERE o.kind = 'add_relation' AND NOT (coalesce(s.kind, '') = 'function'
             AND coalesce(t.kind, '') IN ('function', 'external'))""", "o.op_index"),
    "rule_compatibility_unknown": _sql_issue(
        "COMPATIBILITY_UNKNOWN", "'a reader must judge whether the call fits'",
        """FROM ops o JOIN alive s ON s.plan_id = o.plan_id AND s.id = o.source_id
           JOIN alive t ON t.plan_id = o.plan_id AND t.id = o.target_id
           WHERE o.kind = 'add_relation' AND s.kind = 'function'
             AND t.kind IN ('function', 'external')""", "o.op_index", "warning"),
    "rule_invalid_policy_path": _sql_issue(
        "INVALID_POLICY_PATH", "'policy pol:r' || r_regionkey || ' names a path outside the tree'",
        "FROM plans o, region WHERE project_id = 'shop'", "NULL"),
    "rule_forbidden_planned": _sql_issue(
        "FORBIDDEN_DEPENDENCY", "'forbidden by policy ' || policy_id",
        f"""FROM ops o JOIN plans pl ON pl.plan_id = o.plan_id AND pl.project_id = 'shop'
           JOIN alive s ON s.plan_id = o.plan_id AND s.id = o.source_id
           JOIN alive t ON t.plan_id = o.plan_id AND t.id = o.target_id
           JOIN pols p ON s.path = p.prefix OR starts_with(s.path, p.prefix || '/')
           WHERE o.kind = 'add_relation' AND s.kind = 'function'
             AND t.kind IN ('function', 'external')
             AND {forbids('coalesce(t.path, t.name)')}""", "o.op_index"),
}

_VIOLATIONS = f"""
viol AS MATERIALIZED (SELECT r.id AS relation_id, p.policy_id, r.source_id, r.target_id FROM br r
    JOIN bn s ON s.id = r.source_id JOIN bn t ON t.id = r.target_id
    JOIN pols p ON s.file_path = p.prefix OR starts_with(s.file_path, p.prefix || '/')
    WHERE r.type <> 'contains' AND {forbids('coalesce(t.file_path, t.name)')}),
dropped AS (SELECT DISTINCT plan_id, relation_id FROM ops WHERE kind = 'remove_relation'),
changed AS (SELECT plan_id, id FROM moved UNION SELECT plan_id, id FROM gone),
near0 AS (SELECT plan_id, r.id FROM br r JOIN changed c ON c.id = r.source_id
            WHERE type <> 'contains' AND target_id IS NOT NULL
          UNION SELECT plan_id, r.id FROM br r JOIN changed c ON c.id = r.target_id
            WHERE type <> 'contains'
          UNION SELECT plan_id, r.id FROM br r JOIN dropped d ON d.relation_id = r.id
            WHERE type <> 'contains' AND target_id IS NOT NULL),
near1 AS MATERIALIZED (SELECT n.plan_id, pl.project_id, r.id AS relation_id, r.source_id,
    r.target_id
  FROM near0 n JOIN br r ON r.id = n.id JOIN plans pl ON pl.plan_id = n.plan_id),
ends AS MATERIALIZED (SELECT q.plan_id, q.id, CASE WHEN n.kind = 'function' AND m.path IS NOT NULL
      THEN m.path ELSE n.file_path END AS path, n.name
  FROM (SELECT plan_id, source_id AS id FROM near1 UNION SELECT plan_id, target_id FROM near1) q
  JOIN bn n ON n.id = q.id LEFT JOIN moved m ON m.plan_id = q.plan_id AND m.id = q.id
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.plan_id = q.plan_id AND g.id = q.id)),
nowv AS MATERIALIZED (SELECT n.plan_id, n.relation_id, p.policy_id FROM near1 n
  JOIN ends s ON s.plan_id = n.plan_id AND s.id = n.source_id
  JOIN ends t ON t.plan_id = n.plan_id AND t.id = n.target_id
  JOIN pols p ON s.path = p.prefix OR starts_with(s.path, p.prefix || '/')
  WHERE n.project_id = 'shop' AND {forbids('coalesce(t.path, t.name)')}
    AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.plan_id = n.plan_id
      AND d.relation_id = n.relation_id)),
befv AS MATERIALIZED (SELECT n.plan_id, v.relation_id, v.policy_id FROM near1 n
  JOIN viol v ON v.relation_id = n.relation_id WHERE n.project_id = 'shop'),
forb AS MATERIALIZED (SELECT CAST(NULL AS VARCHAR) AS plan_id, relation_id, policy_id,
    'baseline' AS change FROM viol
  UNION ALL SELECT plan_id, relation_id, policy_id, 'cleared' FROM
    (SELECT * FROM befv EXCEPT SELECT * FROM nowv)
  UNION ALL SELECT plan_id, relation_id, policy_id, 'introduced' FROM
    (SELECT * FROM nowv EXCEPT SELECT * FROM befv))"""

_RULES = {
    "rule_project_mismatch": lambda c: R.rule_project_mismatch(c.plans, c.snapshots),
    "rule_baseline_mismatch": lambda c: R.rule_baseline_mismatch(c.plans, c.snapshots),
    "rule_duplicate_node": lambda c: R.rule_duplicate_node(c.state()),
    "rule_invalid_function": lambda c: R.rule_invalid_function(c.state()),
    "rule_invalid_relation": lambda c: R.rule_invalid_relation(c.ops, c.relations),
    "rule_duplicate_removal": lambda c: R.rule_duplicate_removal(c.state()),
    "rule_removed_function": lambda c: R.rule_removed_function(c.state()),
    "rule_invalid_target": lambda c: R.rule_invalid_target(c.state(), c.relations),
    "rule_duplicate_relation": lambda c: R.rule_duplicate_relation(c.ops, c.relations),
    "rule_invalid_endpoint": lambda c: R.rule_invalid_endpoint(c.state()),
    "rule_compatibility_unknown": lambda c: R.rule_compatibility_unknown(c.state()),
    "rule_invalid_policy_path": lambda c: R.rule_invalid_policy_path(c.plans, c.policies),
    "rule_forbidden_planned": lambda c: R.rule_forbidden_planned(
        c.plans, c.state(), c.policies),
}


_BY_RELATION = ("rule_invalid_relation", "rule_invalid_target", "rule_duplicate_relation")


def _register_rule(key, rule):
    types = RELATION_TYPES if key in _BY_RELATION else ()

    @query(key, with_plans(RULE_SQL[key]))
    def run(spark, sf):
        return _out(rule(_load(spark, sf, types)))


for _key, _rule in _RULES.items():
    _register_rule(_key, _rule)


def _forbidden(c):
    return R.rule_forbidden_existing(c.plans, c.state(), c.relations, c.policies)


@query("rule_forbidden_existing", with_plans(_VIOLATIONS + "\nSELECT * FROM forb"))
def rule_forbidden_existing(spark, sf):
    return _forbidden(_load(spark, sf)).drop(*SCOPE)


_ALL = _VIOLATIONS + ",\nissues AS (" + " UNION ALL ".join(RULE_SQL.values()) + """
  UNION ALL SELECT plan_id, NULL, 'error', 'FORBIDDEN_DEPENDENCY', 'present relation ' ||
    relation_id || ' is forbidden by policy ' || policy_id FROM forb
    WHERE change = 'introduced')"""


def _validate(c, forbidden=None):
    return R.validate_plan(c.plans, c.state(), c.relations, c.snapshots, c.policies, forbidden)


@query("validate_plan", with_plans(_ALL + "\nSELECT * FROM issues"))
def validate_plan(spark, sf):
    return _out(_validate(_load(spark, sf)))


SUMMARY = _ALL + """,
issue_counts AS (SELECT plan_id, count(*) FILTER (WHERE severity = 'error') AS e,
        count(*) FILTER (WHERE severity = 'warning') AS w FROM issues GROUP BY plan_id),
clearings AS (SELECT plan_id, count(*) AS cleared FROM forb WHERE change = 'cleared'
        GROUP BY plan_id),
summary AS MATERIALIZED (SELECT p.plan_id, coalesce(w, 0) AS warnings, coalesce(e, 0)
        + CASE project_id WHEN 'shop' THEN (SELECT count(*) FROM viol) ELSE 0 END
        - coalesce(cleared, 0) AS errors
      FROM plans p LEFT JOIN issue_counts USING (plan_id) LEFT JOIN clearings USING (plan_id))"""


def issue_summary(c):
    """Errors and warnings per plan from all rules."""
    forbidden = stage(_forbidden(c), "forbidden")
    return R.plan_issue_summary(c.plans, _validate(c, forbidden), forbidden)


@query("plan_issue_summary", with_plans(
    SUMMARY + "\nSELECT *, errors > 0 AS has_error FROM summary"))
def plan_issue_summary(spark, sf):
    return issue_summary(_load(spark, sf))


@query("schema_issues", with_plans("""
SELECT plan_id, CAST(NULL AS BIGINT) AS op_index, 'error' AS severity, 'INVALID_INPUT' AS code,
  'title' AS message FROM plans WHERE first = 'signup'
UNION ALL SELECT plan_id, op_index, 'error', 'INVALID_INPUT',
  'operations.' || op_index || '.file_path' FROM ops WHERE kind = 'move_function'
  AND file_path LIKE 'moved/%'
UNION ALL SELECT plan_id, op_index, 'error', 'INVALID_INPUT',
  'operations.' || op_index || '.kind' FROM ops WHERE kind = 'annotate'"""))
def schema_issues(spark, sf):
    """A damaged log: blank titles, escaping move targets and an operation kind nobody knows."""
    c = _load(spark, sf)
    plans = c.plans.withColumn("title", F.when(F.col("description") == "", " ").otherwise(
        F.col("title")))
    ops = c.ops.withColumn("kind", F.when(F.col("kind") == "annotate", "comment").otherwise(
        F.col("kind"))).withColumn(
        "file_path", F.when(F.col("file_path").startswith("moved/"),
                            F.concat(F.lit("../"), "file_path")).otherwise(F.col("file_path")))
    return _out(R.schema_issues(plans, ops))


# ---- planned state ------------------------------------------------------------------------------
@query("effective_path", with_plans("""
t AS (SELECT DISTINCT plan_id, coalesce(node_id, temp_id) AS id FROM ops
      WHERE coalesce(node_id, temp_id) IS NOT NULL),
a AS (SELECT plan_id, temp_id AS id, arg_min(file_path, op_index) AS p FROM ops
      WHERE kind = 'add_function' GROUP BY 1, 2),
m AS (SELECT plan_id, node_id AS id, arg_max(file_path, op_index) AS p FROM ops
      WHERE kind = 'move_function' GROUP BY 1, 2)
SELECT t.plan_id, t.id, coalesce(m.p, a.p, n.file_path) AS planned_path FROM t
LEFT JOIN a ON a.plan_id = t.plan_id AND a.id = t.id
LEFT JOIN m ON m.plan_id = t.plan_id AND m.id = t.id LEFT JOIN bn n ON n.id = t.id"""))
def effective_path(spark, sf):
    c = _load(spark, sf)
    return S.effective_path(c.ops, c.nodes).drop(*SCOPE)


_DEST = """
dest AS (SELECT plan_id, coalesce(temp_id, node_id) AS id, arg_max(file_path, op_index) AS target
  FROM ops o WHERE kind IN ('add_function', 'move_function') GROUP BY 1, 2),
dest2 AS (SELECT * FROM dest d WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.plan_id = d.plan_id
  AND o.kind = 'remove_function' AND o.node_id = d.id))"""


@query("planned_scope", with_plans(_DEST + """,
req AS (SELECT plan_id, '.' AS path, 'folder' AS kind FROM plans
  UNION ALL SELECT plan_id, 'moved', 'folder' FROM plans
  UNION ALL SELECT plan_id, 'mov', 'folder' FROM plans
  UNION ALL SELECT DISTINCT plan_id, target, 'file' FROM dest)
SELECT d.plan_id, r.path, r.kind AS scope_kind, d.id, d.target FROM dest2 d JOIN req r
  ON r.plan_id = d.plan_id AND CASE r.kind WHEN 'file' THEN d.target = r.path
    ELSE r.path = '.' OR starts_with(d.target, r.path || '/') END"""))
def planned_scope(spark, sf):
    c = _load(spark, sf)
    plan = c.plans.select(F.lit("shop").alias("project_id"), "snapshot_id", "plan_id")
    folders = plan.withColumn("path", F.explode(F.array(
        F.lit("."), F.lit("moved"), F.lit("mov")))).withColumn("kind", F.lit("folder"))
    files = S.of_kind(c.ops, "add_function", "move_function").groupBy(
        *S.PLAN, F.coalesce("temp_id", "node_id").alias("id")
    ).agg(F.max_by("file_path", "op_index").alias("path")).select(
        *S.PLAN, "path", F.lit("file").alias("kind")).distinct()
    return S.planned_scope(c.ops, folders.unionByName(files)).select(
        "plan_id", "path", "scope_kind", "id", "target"
    )


@query("duplicate_removal", with_plans("""
SELECT plan_id, relation_id, node_id, op_index, nth FROM (SELECT *, row_number() OVER (
    PARTITION BY plan_id, kind, coalesce(node_id, relation_id) ORDER BY op_index) AS nth FROM ops
  WHERE kind IN ('remove_function', 'remove_relation')) WHERE nth > 1"""))
def duplicate_removal(spark, sf):
    from ..operators.paging import prefix_ranks

    gone = S.of_kind(L.plan_operations(spark, sf), "remove_function", "remove_relation")
    # Positions inside one (plan, target) group are counted per block of operation indexes.
    block = F.floor(F.col("op_index") / 4096)
    ranked = prefix_ranks(
        gone.withColumn("what", F.coalesce("node_id", "relation_id")),
        ["plan_id", "kind", "what"], block, [F.col("op_index")], "nth",
    )
    return ranked.filter(F.col("nth") > 1).select(
        "plan_id", "relation_id", "node_id", "op_index", "nth"
    )


# ---- verification ---------------------------------------------------------------------------------
def _verification(spark, sf):
    c = _load(spark, sf)
    cur = F.col("snapshot_id") == "cur"
    return V.Verification(
        scope=("shop", "cur"), ops=c.ops, baseline_nodes=c.nodes, baseline_relations=c.relations,
        nodes=c.graph.nodes.filter(cur), relations=c.graph.relations.filter(cur),
        coverage=c.graph.coverage.filter(cur), diagnostics=c.graph.diagnostics.filter(cur),
        snapshots=c.graph.snapshots.filter(cur),
    )


def _register_verdict(key):
    @query(key, with_verify(f"SELECT * FROM {key.replace('verify', 'v')}"))
    def run(spark, sf):
        return getattr(_verification(spark, sf), key)()


for _key in ("verify_add", "verify_move", "verify_remove", "verify_relation", "verify_annotate"):
    _register_verdict(_key)


@query("bind_symbol", with_verify("""
SELECT plan_id, id, enforce, removing, n, found_id, found_at, uncertain FROM bound"""))
def bind_symbol(spark, sf):
    return _verification(spark, sf).bindings.select(
        "plan_id", "id", "enforce", "removing", "n", "found_id", "found_at", "uncertain"
    )


@query("capture_incomplete", with_verify("""
f AS (SELECT DISTINCT file_path AS path, s.search_all FROM cn,
        (VALUES (true), (false)) s(search_all) WHERE kind = 'file'),
g AS (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'javascript' END AS family FROM f)
SELECT f.path, f.search_all, bool_or(f.path = g.path OR starts_with(f.path, g.path || '/')
  OR (f.search_all AND g.source <> 'excluded' AND (g.family = 'unknown' OR g.family = f.family)))
  AS incomplete FROM g f, gaps2 g GROUP BY 1, 2"""))
def capture_incomplete(spark, sf):
    v = _verification(spark, sf)
    files = v.nodes.filter(F.col("kind") == "file").select(
        *SCOPE, F.col("file_path").alias("path"),
        F.explode(F.array(F.lit(True), F.lit(False))).alias("search_all"),
    )
    return V.capture_incomplete(files, v.coverage, v.diagnostics, v.snapshots).drop(*SCOPE)


@query("relation_check", with_verify("""
SELECT plan_id, op_index, rem AS removing, fnd AS found, ot IS NOT NULL AS open_ends FROM rc2"""))
def relation_check(spark, sf):
    return _verification(spark, sf).relation_check().select(
        "plan_id", "op_index", F.col("removing_rel").alias("removing"),
        F.col("found_n").alias("found"), F.col("open_n").isNotNull().alias("open_ends"),
    )


@query("verification_evidence", with_verify("""
SELECT plan_id, op_index, 'found' AS step, t AS evidence FROM rc3 JOIN evi e ON e.source_id = sid
  AND e.target_id = tgt AND e.type = rtype AND (e.resolution = 'resolved'
    OR (e.resolution = 'external' AND tk = 'external')) WHERE step = 3
UNION ALL SELECT plan_id, op_index, 'open', t FROM rc3 JOIN evi e ON e.source_id = sid
  AND e.type = rtype AND e.resolution = 'unresolved' WHERE step = 4"""))
def verification_evidence(spark, sf):
    return _verification(spark, sf).relation_evidence()


@query("verify_plan", with_verify("SELECT * FROM report"))
def verify_plan(spark, sf):
    return _verification(spark, sf).report()


@query("verification_rollup", with_verify(
    "SELECT plan_id, status, count(*) AS items FROM report GROUP BY 1, 2"))
def verification_rollup(spark, sf):
    return V.verification_rollup(_verification(spark, sf).report())
