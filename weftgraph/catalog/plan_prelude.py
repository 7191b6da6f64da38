"""SQL text of the plan log, following the graph prelude in its snapshot-pair form."""

from __future__ import annotations

from .prelude import prelude

PLAN_CTES = r"""
ev AS (SELECT 'plan:' || user_id AS plan_id, event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS op_index
       FROM events),
firstcall AS (SELECT source_id, min(id) AS first_call,
         min(CASE resolution WHEN 'resolved' THEN target_id END) AS first_target
       FROM calls WHERE snapshot_id = 'base' GROUP BY source_id),
ev2 AS (SELECT ev.*, 'function:o' || event_id AS own, 'function:o' || k AS fk,
         'temp:u' || user_id || ':' || k AS stemp, 'rel:u' || user_id || ':' || k AS srel,
         CASE WHEN value < 25 THEN 'function:o' || k ELSE 'function:o' || event_id END AS near,
         file_path AS home, first_call, first_target
       FROM ev LEFT JOIN orders ON o_orderkey = event_id
       LEFT JOIN files0 ON files0.id = 'file:c' || o_custkey
       LEFT JOIN firstcall ON source_id = 'function:o' || event_id),
ops AS MATERIALIZED (
  SELECT plan_id, op_index, 'add_function' AS kind,
    CASE WHEN k < 8 THEN own WHEN k < 30 THEN stemp ELSE 'temp:' || event_id END AS temp_id,
    CASE WHEN k < 30 THEN 'new' || k ELSE 'o' || event_id END AS name,
    CASE WHEN k >= 30 AND home IS NOT NULL THEN home ELSE 'r1/./x/../new' || k || '.py' END
      AS file_path,
    CASE WHEN k >= 60 THEN 'python' END AS language, CAST(NULL AS VARCHAR) AS node_id,
    CAST(NULL AS VARCHAR) AS relation_id, CAST(NULL AS VARCHAR) AS source_id,
    CAST(NULL AS VARCHAR) AS target_id, CAST(NULL AS VARCHAR) AS text
  FROM ev2 WHERE event_type = 'signup'
  UNION ALL SELECT plan_id, op_index, 'move_function', NULL, NULL,
    CASE WHEN k < 40 AND home IS NOT NULL THEN './' || home ELSE 'moved/m' || k || '.py' END,
    NULL, near, NULL, NULL, NULL, NULL FROM ev2 WHERE event_type = 'click'
  UNION ALL SELECT plan_id, op_index, 'add_relation', NULL, NULL, NULL, NULL, NULL,
    CASE WHEN k < 15 THEN srel ELSE 'rel:' || event_id END,
    CASE WHEN k < 30 THEN stemp ELSE own END,
    CASE WHEN k < 40 THEN 'external:p' || k WHEN k < 60 THEN fk WHEN k < 70 THEN 'file:c' || k
      ELSE coalesce(first_target, 'missing:' || k) END, NULL FROM ev2
    WHERE event_type = 'purchase'
  UNION ALL SELECT plan_id, op_index, 'remove_function', NULL, NULL, NULL, NULL, near, NULL, NULL,
    NULL, NULL FROM ev2 WHERE event_type = 'error' AND value < 60
  UNION ALL SELECT plan_id, op_index, 'remove_relation', NULL, NULL, NULL, NULL, NULL,
    CASE WHEN k < 20 THEN srel ELSE coalesce(first_call, 'missing:' || event_id) END, NULL, NULL,
    NULL FROM ev2 WHERE event_type = 'error' AND value >= 60
  UNION ALL SELECT plan_id, op_index, 'annotate', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN k < 30 THEN srel ELSE own END, 'note ' || k FROM ev2 WHERE event_type = 'view'),
plans AS (SELECT 'plan:' || user_id AS plan_id, count(DISTINCT event_type) AS revision,
    'Plan ' || user_id AS title, arg_min(event_type, (ts, event_id)) AS first,
    max(ts) AS updated_at,
    CASE WHEN arg_min(event_type, (ts, event_id)) = 'error' THEN 'other' ELSE 'shop' END
      AS project_id,
    CASE WHEN arg_min(event_type, (ts, event_id)) = 'view' THEN 'hash-old' ELSE 'hash-base' END
      AS baseline_content_hash
  FROM events GROUP BY user_id),
normops AS MATERIALIZED (SELECT *, CASE WHEN file_path LIKE 'r1/./x/../new%'
      THEN replace(file_path, './x/../', '') WHEN file_path LIKE './%' THEN substring(file_path, 3)
      ELSE file_path END AS path FROM ops),
bn AS MATERIALIZED (SELECT * FROM nodes WHERE snapshot_id = 'base'),
br AS MATERIALIZED (SELECT * FROM relations WHERE snapshot_id = 'base'),
added AS MATERIALIZED (SELECT plan_id, temp_id AS id, arg_min(name, op_index) AS name,
      arg_min(path, op_index) AS path, min(op_index) AS op_index FROM normops
    WHERE kind = 'add_function' AND temp_id NOT IN (SELECT id FROM bn) GROUP BY plan_id, temp_id),
moved AS MATERIALIZED (SELECT plan_id, node_id AS id, arg_max(path, op_index) AS path FROM normops
    WHERE kind = 'move_function' GROUP BY plan_id, node_id),
refs AS (SELECT plan_id, node_id AS id FROM ops UNION SELECT plan_id, source_id FROM ops
    UNION SELECT plan_id, target_id FROM ops),
known AS MATERIALIZED (SELECT r.plan_id, r.id, coalesce(n.kind, CASE WHEN a.id IS NOT NULL
      THEN 'function' END) AS kind, coalesce(n.name, a.name) AS name,
      coalesce(n.file_path, a.path) AS path
    FROM refs r LEFT JOIN bn n ON n.id = r.id LEFT JOIN added a ON a.plan_id = r.plan_id
      AND a.id = r.id WHERE n.id IS NOT NULL OR a.id IS NOT NULL),
gone AS MATERIALIZED (SELECT o.plan_id, o.node_id AS id, min(op_index) AS removed_at FROM ops o
    JOIN known k ON k.plan_id = o.plan_id AND k.id = o.node_id AND k.kind = 'function'
    WHERE o.kind = 'remove_function' GROUP BY o.plan_id, o.node_id),
alive AS MATERIALIZED (SELECT k.plan_id, k.id, k.kind, k.name,
      CASE WHEN k.kind = 'function' AND m.path IS NOT NULL THEN m.path ELSE k.path END AS path
    FROM known k LEFT JOIN moved m ON m.plan_id = k.plan_id AND m.id = k.id
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.plan_id = k.plan_id AND g.id = k.id)),
pols AS MATERIALIZED (SELECT 'pol:n' || n_nationkey AS policy_id,
      'r' || n_regionkey || '/n' || n_nationkey AS prefix, 'r' || n_regionkey AS region
    FROM nation)
"""


def with_plans(body: str) -> str:
    text = body.strip()
    sep = "\n" if text[:6].upper() == "SELECT" else ",\n"
    return "WITH " + prelude(pair=True) + ",\n" + PLAN_CTES.strip() + sep + text


# target keys forbidden by a nation's policy: own region, the package pkg:1, the folder moved
FORBIDS = """({t} = {p}.region OR starts_with({t}, {p}.region || '/') OR {t} = 'pkg:1'
  OR starts_with({t}, 'pkg:1/') OR {t} = 'moved' OR starts_with({t}, 'moved/'))"""


def forbids(target: str, pol: str = "p") -> str:
    return FORBIDS.format(t=target, p=pol)


VERIFY_CTES = r"""
cn AS MATERIALIZED (SELECT * FROM nodes WHERE snapshot_id = 'cur'),
cr AS MATERIALIZED (SELECT * FROM relations WHERE snapshot_id = 'cur'),
adds AS MATERIALIZED (SELECT plan_id, temp_id AS id, arg_max(name, op_index) AS name,
    arg_max(path, op_index) AS path, arg_max({'l': language}, op_index).l AS language
  FROM normops WHERE kind = 'add_function' GROUP BY 1, 2),
gaps AS MATERIALIZED (
  SELECT file_path AS path, 'unavailable' AS source FROM files0 WHERE parent_id = 'folder:n0'
  UNION SELECT dir, 'excluded' FROM dirs WHERE n_nationkey = 7
  UNION SELECT f.file_path, 'diagnostic' FROM files0 f JOIN supplier s
    ON f.id = 'file:s' || s_suppkey WHERE s_acctbal < 0),
gaps2 AS MATERIALIZED (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts'
  THEN 'javascript' ELSE 'unknown' END AS family FROM gaps),
vrefs AS MATERIALIZED (
  SELECT plan_id, temp_id AS id, true AS enforce, false AS removing FROM ops
    WHERE kind = 'add_function'
  UNION SELECT plan_id, node_id, true, false FROM ops WHERE kind = 'move_function'
  UNION SELECT plan_id, node_id, false, false FROM ops WHERE kind = 'move_function'
  UNION SELECT plan_id, node_id, false, true FROM ops WHERE kind = 'remove_function'
  UNION SELECT plan_id, source_id, true, false FROM ops WHERE kind = 'add_relation'
  UNION SELECT plan_id, target_id, true, false FROM ops WHERE kind = 'add_relation'
  UNION SELECT plan_id, r.source_id, false, false FROM ops o JOIN br r ON r.id = o.relation_id
    WHERE o.kind = 'remove_relation'
  UNION SELECT plan_id, r.target_id, false, false FROM ops o JOIN br r ON r.id = o.relation_id
    WHERE o.kind = 'remove_relation' AND r.target_id IS NOT NULL),
labels_ AS (SELECT id, file_path, name AS label, language FROM cn WHERE kind = 'function'
  UNION SELECT id, file_path, qualified_name, language FROM cn WHERE kind = 'function'),
ba AS (SELECT r.*, coalesce(CASE WHEN r.enforce THEN m.path END, a.path) AS path, a.name,
    a.language FROM vrefs r JOIN adds a ON a.plan_id = r.plan_id AND a.id = r.id
  LEFT JOIN moved m ON m.plan_id = r.plan_id AND m.id = r.id),
bb AS (SELECT r.*, n.kind, coalesce(n.qualified_name, n.name) AS symbol,
    coalesce(n.language, '') AS lang, n.file_path, n.id IS NOT NULL AS known,
    CASE WHEN r.enforce THEN m.path END AS to_path
  FROM vrefs r LEFT JOIN bn n ON n.id = r.id LEFT JOIN moved m ON m.plan_id = r.plan_id
    AND m.id = r.id WHERE NOT EXISTS (SELECT 1 FROM adds a WHERE a.plan_id = r.plan_id
    AND a.id = r.id)),
hits AS (
  SELECT plan_id, ba.id, enforce, removing, path, false AS search_all, true AS known,
    l.id AS found_id
  FROM ba LEFT JOIN labels_ l ON l.file_path = ba.path AND l.label = ba.name
    AND (ba.language IS NULL OR ba.language = l.language)
  UNION ALL SELECT plan_id, b.id, enforce, removing, to_path, false, true, c.id FROM bb b
    LEFT JOIN cn c ON c.kind = b.kind AND coalesce(c.qualified_name, c.name) = b.symbol
      AND coalesce(c.language, '') = b.lang AND c.file_path = b.to_path
    WHERE known AND to_path IS NOT NULL
  UNION ALL SELECT plan_id, b.id, enforce, removing, b.file_path, x.id IS NULL, true,
      coalesce(x.id, c.id)
    FROM bb b LEFT JOIN cn x ON x.id = b.id
    LEFT JOIN cn c ON x.id IS NULL AND c.kind = b.kind
      AND coalesce(c.qualified_name, c.name) = b.symbol AND coalesce(c.language, '') = b.lang
    WHERE known AND to_path IS NULL
  UNION ALL SELECT plan_id, id, enforce, removing, NULL, false, false, NULL FROM bb
    WHERE NOT known),
grouped AS MATERIALIZED (SELECT plan_id, id, enforce, removing, coalesce(path, '') AS path,
    search_all, known, count(DISTINCT found_id) AS n, min(found_id) AS found_id
  FROM hits GROUP BY ALL),
pairs AS (SELECT DISTINCT path, search_all FROM grouped UNION
  SELECT DISTINCT coalesce(a.path, n.file_path), false FROM ops o
    LEFT JOIN adds a ON a.plan_id = o.plan_id AND a.id = o.node_id
    LEFT JOIN bn n ON n.id = o.node_id WHERE o.kind = 'move_function'),
fam AS (SELECT *, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts'
  THEN 'javascript' ELSE 'unknown' END AS family FROM pairs WHERE path IS NOT NULL),
inc AS MATERIALIZED (SELECT f.path, f.search_all,
    bool_or(f.path = g.path OR starts_with(f.path, g.path || '/')
      OR (f.search_all AND f.path <> '' AND g.source = 'unavailable'
          AND (g.family = 'unknown' OR g.family = f.family))
      OR (f.search_all AND f.path <> '' AND g.source = 'diagnostic'
          AND (g.family = 'unknown' OR f.family = 'unknown' OR g.family = f.family)))
    AS incomplete FROM fam f, gaps2 g GROUP BY 1, 2),
bound AS MATERIALIZED (SELECT g.plan_id, g.id, enforce, removing, n, g.found_id,
    c.kind AS found_kind,
    coalesce(c.file_path, c.name) || ':' || coalesce(c.start_line, 1) AS found_at,
    NOT known OR n > 1 OR (g.search_all AND n > 0 AND NOT removing)
      OR coalesce(incomplete, false) AS uncertain
  FROM grouped g LEFT JOIN inc i ON i.path = g.path AND i.search_all = g.search_all
  LEFT JOIN cn c ON c.id = g.found_id),
be AS (SELECT * FROM bound WHERE enforce AND NOT removing),
bo AS (SELECT * FROM bound WHERE NOT enforce AND NOT removing),
v_add AS (SELECT o.plan_id, o.op_index, CASE WHEN uncertain THEN 'unknown' WHEN n > 0
    THEN 'satisfied' ELSE 'unmet' END AS status, CASE WHEN uncertain
    THEN 'function not bound for certain' WHEN n > 0
    THEN 'found at the planned path' ELSE 'not at the planned path' END
    AS message, CASE WHEN NOT uncertain AND n > 0 THEN found_at END AS evidence
  FROM ops o JOIN be b ON b.plan_id = o.plan_id AND b.id = o.temp_id
  WHERE o.kind = 'add_function'),
mv0 AS (SELECT o.plan_id, o.op_index, t.uncertain, t.n, t.found_at, q.n AS old_n,
    a.id IS NOT NULL AS was_added, coalesce(a.path, n.file_path) AS opath, o.path AS npath,
    c.id IS NOT NULL AND n.id IS NOT NULL AS still
  FROM normops o JOIN be t ON t.plan_id = o.plan_id AND t.id = o.node_id
  JOIN bo q ON q.plan_id = o.plan_id AND q.id = o.node_id
  LEFT JOIN adds a ON a.plan_id = o.plan_id AND a.id = o.node_id
  LEFT JOIN bn n ON n.id = o.node_id LEFT JOIN cn c ON c.id = o.node_id
  WHERE o.kind = 'move_function'),
mv1 AS (SELECT m.*, opath IS DISTINCT FROM npath AS changed, coalesce(i.incomplete, false) AS hid
  FROM mv0 m LEFT JOIN inc i ON i.path = m.opath AND NOT i.search_all),
mv2 AS (SELECT *, changed AND CASE WHEN was_added THEN old_n > 0 ELSE still END AS old,
  uncertain OR (changed AND hid) AS unk FROM mv1),
v_move AS (SELECT plan_id, op_index, CASE WHEN unk THEN 'unknown' WHEN n > 0 AND NOT old
    THEN 'satisfied' ELSE 'unmet' END AS status, CASE WHEN unk
    THEN 'moved function not bound for certain' WHEN n > 0 AND NOT old
    THEN 'moved as planned'
    ELSE 'move not seen' END AS message,
    CASE WHEN NOT unk THEN found_at END AS evidence FROM mv2),
v_remove AS (SELECT o.plan_id, o.op_index, CASE WHEN uncertain THEN 'unknown' WHEN n > 0
    THEN 'unmet' ELSE 'satisfied' END AS status, CASE WHEN uncertain
    THEN 'removal cannot be told' WHEN n > 0
    THEN 'function still there' ELSE 'function gone' END
    AS message, CASE WHEN NOT uncertain THEN found_at END AS evidence
  FROM ops o JOIN bound b ON b.plan_id = o.plan_id AND b.id = o.node_id AND removing
  WHERE o.kind = 'remove_function'),
rc0 AS (SELECT plan_id, op_index, source_id AS fid, target_id AS tid, 'calls' AS rtype,
    'resolved' AS bres, false AS rem FROM ops WHERE kind = 'add_relation'
  UNION ALL SELECT o.plan_id, o.op_index, r.source_id, r.target_id, r.type, r.resolution, true
    FROM ops o LEFT JOIN br r ON r.id = o.relation_id WHERE o.kind = 'remove_relation'),
rc1 AS (SELECT r.*, s.n AS sn, s.uncertain AS su, s.found_id AS sid, s.found_at AS sat,
    t.n AS tn, t.uncertain AS tu, t.found_id AS tgt, t.found_kind AS tk
  FROM rc0 r LEFT JOIN bound s ON s.plan_id = r.plan_id AND s.id = r.fid
    AND s.enforce = (NOT rem) AND NOT s.removing
  LEFT JOIN bound t ON t.plan_id = r.plan_id AND t.id = r.tid AND t.enforce = (NOT rem)
    AND NOT t.removing),
evi AS (SELECT source_id, target_id, type, resolution, evidence_path || ':' || evidence_line ||
    ' ' || evidence_text AS t FROM cr),
f1 AS (SELECT source_id, target_id, type, count(*) FILTER (WHERE resolution = 'resolved') AS rn,
    count(*) FILTER (WHERE resolution = 'external') AS en,
    min(t) FILTER (WHERE resolution <> 'unresolved') AS ft FROM evi
  WHERE target_id IS NOT NULL GROUP BY 1, 2, 3),
f2 AS (SELECT source_id, type, min(t) AS ot FROM evi WHERE resolution = 'unresolved'
  GROUP BY 1, 2),
rc2 AS (SELECT r.*, coalesce(rn, 0) + CASE WHEN tk = 'external' THEN coalesce(en, 0) ELSE 0 END
    AS fnd, ft, ot
  FROM rc1 r LEFT JOIN f1 ON f1.source_id = sid AND f1.target_id = tgt AND f1.type = rtype
  LEFT JOIN f2 ON f2.source_id = sid AND f2.type = rtype),
rc3 AS (SELECT *, CASE WHEN rem AND (tid IS NULL OR coalesce(bres, 'unresolved') = 'unresolved')
    THEN 0 WHEN su OR tu THEN 1 WHEN sn = 0 OR tn = 0 THEN 2 WHEN fnd > 0 THEN 3
    WHEN ot IS NOT NULL THEN 4 ELSE 5 END AS step FROM rc2),
v_relation AS (SELECT plan_id, op_index, CASE WHEN step IN (0, 1, 4) THEN 'unknown'
    WHEN (step = 3) <> rem THEN 'satisfied' ELSE 'unmet' END AS status,
    CASE step WHEN 0 THEN 'baseline relation without known ends'
      WHEN 1 THEN 'an end is not bound for certain'
      WHEN 2 THEN 'an end is gone'
      WHEN 3 THEN CASE WHEN rem THEN 'relation still there'
        ELSE 'relation found' END
      WHEN 4 THEN 'open calls may hide the relation'
      ELSE CASE WHEN rem THEN 'relation gone'
        ELSE 'no such call' END END AS message,
    CASE step WHEN 3 THEN ft WHEN 4 THEN ot WHEN 5 THEN sat END AS evidence FROM rc3),
v_annotate AS (SELECT plan_id, op_index, 'unknown' AS status,
    'for a reader to judge' AS message, CAST(NULL AS VARCHAR) AS evidence
  FROM ops WHERE kind = 'annotate'),
report AS (SELECT * FROM v_add UNION ALL SELECT * FROM v_move UNION ALL SELECT * FROM v_remove
  UNION ALL SELECT * FROM v_relation UNION ALL SELECT * FROM v_annotate)
"""


def with_verify(body: str) -> str:
    text = body.strip()
    sep = "\n" if text[:6].upper() == "SELECT" else ",\n"
    return with_plans(VERIFY_CTES.strip() + sep + text)
