"""Scalar functions over paths, ids and texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as D
from ..functions import paths as P
from ..sources.star_graph import graph_nodes, star_graph
from ..staging import table
from .prelude import with_graph
from .registry import query

def path_inputs(spark, sf):
    """The path part of every page URL in several spellings."""
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_replace("url", r"^https?://[^/]*/|[?#].*$", "").alias("p")
    )
    p = F.col("p")
    forms = {
        "plain": p,
        "dots": F.concat(F.lit("./a/../"), p),
        "escape": F.concat(F.lit("../"), p),
        "deep": F.concat(F.lit("x//y/./../../"), p),
        "absolute": F.concat(F.lit("/"), p),
        "drive": F.concat(F.lit("C:"), p),
        "back": F.replace(F.concat(F.lit("b\\"), p), F.lit("/"), F.lit("\\")),
        "slash": F.concat(p, F.lit("/")),
        "url": F.col("url"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("form"), c.alias("path")) for n, c in forms.items()])
    return pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.form", "r.path")


_INPUTS = r"""
pg AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')
         AS p FROM pages),
inputs AS (
  SELECT page_id, 'plain' AS form, p AS path FROM pg
  UNION ALL SELECT page_id, 'dots', './a/../' || p FROM pg
  UNION ALL SELECT page_id, 'escape', '../' || p FROM pg
  UNION ALL SELECT page_id, 'deep', 'x//y/./../../' || p FROM pg
  UNION ALL SELECT page_id, 'absolute', '/' || p FROM pg
  UNION ALL SELECT page_id, 'drive', 'C:' || p FROM pg
  UNION ALL SELECT page_id, 'back', replace('b\' || p, '/', '\') FROM pg
  UNION ALL SELECT page_id, 'slash', p || '/' FROM pg
  UNION ALL SELECT page_id, 'url', url FROM pg),
sl AS (SELECT *, replace(path, '\', '/') AS s FROM inputs),
folded AS (SELECT *, list_reduce(list_prepend(['^'], list_transform(list_filter(
      string_split(s, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])),
    lambda a, b: CASE WHEN a[1] = '!' THEN a WHEN b[1] <> '..' THEN list_concat(a, b)
      WHEN len(a) = 1 THEN ['!'] ELSE a[1:len(a) - 1] END) AS st FROM sl),
norm AS (SELECT *, CASE WHEN trim(s) = '' OR regexp_matches(s, '^[A-Za-z]:') OR s LIKE '/%'
      OR s LIKE '%/' OR regexp_matches(s, '(^|/)(\.|\.\.)$')
      OR regexp_matches(s, '[\x00-\x1f\x7f]') THEN NULL
    WHEN st[1] = '!' OR len(st) = 1 THEN NULL
    WHEN regexp_matches(st[2], '^[A-Za-z]:') THEN NULL
    ELSE array_to_string(st[2:], '/') END AS normal FROM folded)"""


@query("normalize_repo_path", "WITH " + _INPUTS.strip() + r"""
SELECT page_id, form, normal, CASE WHEN trim(s) = '' THEN 'blank'
  WHEN regexp_matches(s, '^[A-Za-z]:') THEN 'drive' WHEN s LIKE '/%' THEN 'absolute'
  WHEN s LIKE '%/' OR regexp_matches(s, '(^|/)(\.|\.\.)$') THEN 'directory'
  WHEN normal IS NULL THEN 'escapes' END AS problem FROM norm""")
def normalize_repo_path(spark, sf):
    return path_inputs(spark, sf).select(
        "page_id", "form", P.normalize_repo_path("path").alias("normal"),
        P.path_problem("path").alias("problem"),
    )


@query("normalize_structure_path", "WITH " + _INPUTS.strip() + r""",
t AS (SELECT *, regexp_replace(s, '/+$', '') AS q FROM sl),
b AS (SELECT *, s LIKE '/%' OR regexp_matches(q, '^[A-Za-z]:')
        OR list_contains(string_split(q, '/'), '..') AS bad FROM t)
SELECT page_id, form, CASE WHEN NOT bad THEN array_to_string(list_filter(string_split(q, '/'),
    lambda x: x <> '' AND x <> '.'), '/') END AS folder,
  CASE WHEN NOT bad AND trim(q) <> '' THEN q END AS pattern FROM b""")
def normalize_structure_path(spark, sf):
    return path_inputs(spark, sf).select(
        "page_id", "form", P.normalize_structure_path("path").alias("folder"),
        P.normalize_structure_path("path", pattern=True).alias("pattern"),
    )


@query("path_dirname_basename", with_graph(r"""
SELECT id, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '')
  ELSE '.' END AS dir, regexp_extract(file_path, '[^/]*$') AS base
FROM nodes WHERE file_path IS NOT NULL"""))
def path_dirname_basename(spark, sf):
    return graph_nodes(spark, sf).filter(F.col("file_path").isNotNull()).select(
        "id", P.dirname("file_path").alias("dir"), P.basename("file_path").alias("base")
    )


@query("path_ancestors", with_graph("""
p AS (SELECT *, string_split(file_path, '/') AS parts FROM nodes WHERE kind <> 'external'),
s AS (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p WHERE file_path IS NOT NULL),
crumbs AS (
  SELECT id, 0 AS step, '.' AS label, 'folder' AS kind, '.' AS path FROM nodes
  UNION ALL SELECT id, i, parts[i], CASE WHEN i = len(parts) AND kind <> 'folder' THEN 'file'
    ELSE 'folder' END, array_to_string(parts[1:i], '/') FROM s
  UNION ALL SELECT id, len(parts) + 1, qualified_name, 'function', file_path FROM p
    WHERE kind = 'function')
SELECT id, CAST(step AS BIGINT) AS step, label, kind, path FROM crumbs"""))
def path_ancestors(spark, sf):
    rows = graph_nodes(spark, sf).select(
        "id", F.posexplode(P.breadcrumbs("file_path", "kind",
                                         F.coalesce("qualified_name", "name"))).alias("step", "c")
    )
    return rows.select("id", F.col("step").cast("bigint").alias("step"), "c.*")


@query("dir_distance", with_graph(r"""
f AS (SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM nodes WHERE kind = 'file'),
p AS (SELECT i.id, string_split(a.dir, '/') AS x, string_split(b.dir, '/') AS y FROM imports i
      JOIN f a ON a.id = i.source_id JOIN f b ON b.id = i.target_id)
SELECT id, CAST(len(x) + len(y) - 2 * CASE WHEN x[1] <> y[1] THEN 0 WHEN x[2] <> y[2] THEN 1
  ELSE 2 END AS BIGINT) AS distance FROM p"""))
def dir_distance(spark, sf):
    g = star_graph(spark, sf, types=("imports",))
    files = g.nodes.filter(F.col("kind") == "file").select(
        F.col("id").alias("fid"), P.dirname("file_path").alias("dir")
    )
    a = files.select(F.col("fid").alias("source_id"), F.col("dir").alias("a"))
    b = files.select(F.col("fid").alias("target_id"), F.col("dir").alias("b"))
    return g.relations.join(a, "source_id").join(b, "target_id").select(
        "id", P.dir_distance("a", "b").cast("bigint").alias("distance")
    )


@query("path_within", with_graph("""
SELECT f.id AS file_id, d.id AS folder_id FROM nodes f JOIN nodes d
  ON f.file_path = d.file_path OR starts_with(f.file_path, d.file_path || '/')
WHERE f.kind = 'file' AND d.kind = 'folder'"""))
def path_within(spark, sf):
    """Every file within every folder: ancestors are exploded and joined by equality."""
    g_nodes = graph_nodes(spark, sf)
    files = g_nodes.filter(F.col("kind") == "file").select(
        F.col("id").alias("file_id"), F.explode(P.ancestors("file_path")).alias("file_path")
    )
    folders = g_nodes.filter((F.col("kind") == "folder") & F.col("file_path").isNotNull())
    return files.join(folders.select(F.col("id").alias("folder_id"), "file_path"), "file_path") \
        .select("file_id", "folder_id")


@query("path_touches", with_graph("""
p AS MATERIALIZED (SELECT id, coalesce(file_path, '.') AS p FROM nodes),
ends AS MATERIALIZED (SELECT c.id, a.p AS a, b.p AS b FROM contain c JOIN p a ON a.id = c.source_id
  JOIN p b ON b.id = c.target_id)
SELECT id, a = b OR b = '.' OR starts_with(CASE WHEN length(a) < length(b) THEN b ELSE a END,
  CASE WHEN length(a) < length(b) THEN a ELSE b END || '/') AS touches FROM ends""", once=True))
def path_touches(spark, sf):
    g = star_graph(spark, sf, types=("contains",))
    at = F.coalesce("file_path", F.lit("."))
    a = g.nodes.select(F.col("id").alias("source_id"), at.alias("a"))
    b = g.nodes.select(F.col("id").alias("target_id"), at.alias("b"))
    return g.relations.join(a, "source_id").join(b, "target_id").select(
        "id", P.path_touches("a", "b").alias("touches")
    )


@query("language_of", with_graph(r"""
v AS (SELECT id || e AS id, file_path || e AS path FROM nodes,
        (VALUES (''), ('.mts'), ('.JSX'), ('.txt')) t(e) WHERE kind = 'file')
SELECT id, CASE WHEN path LIKE '%.py' THEN 'python'
  WHEN regexp_matches(path, '\.[cm]?tsx?$') THEN 'typescript' ELSE 'javascript' END AS language,
  CASE WHEN regexp_matches(path, '(?i)\.py$') THEN 'python'
  WHEN regexp_matches(path, '(?i)\.[cm]?[jt]sx?$') THEN 'javascript' ELSE 'unknown' END AS family
FROM v"""))
def language_of(spark, sf):
    ends = F.explode(F.array(*[F.lit(e) for e in ("", ".mts", ".JSX", ".txt")]))
    rows = graph_nodes(spark, sf).filter(F.col("kind") == "file").withColumn("e", ends).select(
        F.concat("id", "e").alias("id"), F.concat("file_path", "e").alias("path")
    )
    return rows.select("id", P.language_of("path").alias("language"),
                       P.language_family("path").alias("family"))


@query("supported_suffix", "WITH " + _INPUTS.strip() + r"""
SELECT page_id, form, CASE WHEN NOT regexp_matches(path, '[\\/]$')
    AND regexp_matches(normal, '(?i)\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|py|html)$')
    AND NOT regexp_matches(normal, '(?i)\.html$') THEN normal END AS target,
  coalesce(regexp_matches(normal, '(?i)\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|py)$'), false) AS supported
FROM norm""")
def supported_suffix(spark, sf):
    return path_inputs(spark, sf).select(
        "page_id", "form", P.function_target("path").alias("target"),
        F.coalesce(P.supported_suffix(P.normalize_repo_path("path")), F.lit(False))
        .alias("supported"),
    )


@query("complete_target_path", with_graph(r"""
f AS (SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS dir, replace(name, ' ', '_') AS n,
        signature AS g FROM nodes WHERE kind = 'function')
SELECT id, 'source' AS form, dir || '/' || n || '.ts' AS target FROM f
UNION ALL SELECT id, 'text', NULL FROM f UNION ALL SELECT id, 'blank', NULL FROM f
UNION ALL SELECT id, 'nested', NULL FROM f UNION ALL SELECT id, 'root', g || '.PY' FROM f
UNION ALL SELECT id, 'loose', NULL FROM f"""))
def complete_target_path(spark, sf):
    """Every function's name as a file name in its own folder, in accepted and refused forms."""
    rows = graph_nodes(spark, sf).filter(F.col("kind") == "function").select(
        "id", P.dirname("file_path").alias("dir"), F.replace("name", F.lit(" "), F.lit("_"))
        .alias("n"), F.col("signature").alias("g"),
    )
    def form(name, folder, text):
        return F.struct(F.lit(name).alias("form"), P.complete_target_path(folder, text)
                        .alias("target"))

    n, folder = F.col("n"), F.col("dir")
    forms = F.array(
        form("source", folder, F.concat(n, F.lit(".ts"))),
        form("text", folder, F.concat(n, F.lit(".txt"))),
        form("blank", folder, F.concat(F.lit(" "), n, F.lit(".py"))),
        form("nested", folder, F.concat(F.lit("a/"), n, F.lit(".py"))),
        form("root", F.lit("."), F.concat("g", F.lit(".PY"))),
        form("loose", F.concat(folder, F.lit("/")), F.concat(n, F.lit(".ts"))),
    )
    return rows.select("id", F.explode(forms).alias("r")).select("id", "r.form", "r.target")


@query("reference_target", "WITH " + _INPUTS.strip() + r""",
r AS (SELECT page_id, form, s, path, 'cfg/app/tsconfig.json' AS config,
        regexp_matches(s, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR path = '' OR s LIKE '/%' AS syn,
        s LIKE '%.json' AS js,
        regexp_extract(regexp_replace(s, '/+$', ''), '[^/]*$') AS base FROM sl),
x AS (SELECT *, list_reduce(list_prepend(['^'], list_transform(list_filter(string_split(
      'cfg/app/' || CASE WHEN js THEN s ELSE regexp_replace(s, '/+$', '') || '/tsconfig.json' END,
      '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])),
    lambda a, b: CASE WHEN a[1] = '!' THEN a WHEN b[1] <> '..' THEN list_concat(a, b)
      WHEN len(a) = 1 THEN ['!'] ELSE a[1:len(a) - 1] END) AS st FROM r),
y AS (SELECT *, CASE WHEN syn THEN 'syntax' WHEN NOT js AND base <> '..'
        AND contains(substring(base, 2), '.') THEN 'extension'
        WHEN st[1] = '!' OR len(st) = 1 THEN 'escapes' END AS problem FROM x)
SELECT page_id, form, CASE WHEN problem IS NULL THEN array_to_string(st[2:], '/') END AS path,
  problem FROM y""")
def reference_target(spark, sf):
    return path_inputs(spark, sf).select(
        "page_id", "form",
        P.reference_target(F.lit("cfg/app/tsconfig.json"), "path").alias("t"),
    ).select("page_id", "form", "t.path", "t.problem")


@query("package_request", "WITH " + _INPUTS.strip() + r""",
spec AS (SELECT page_id, form, path FROM inputs UNION ALL
         SELECT page_id, 'scoped', '@scope/' || p FROM pg),
w AS (SELECT *, string_split(path, '/') AS parts, CASE WHEN path LIKE '@%' THEN 2 ELSE 1 END AS k
      FROM spec),
n AS (SELECT *, array_to_string(parts[1:k], '/') AS nm, parts[k + 1:] AS tail FROM w),
v AS (SELECT *, len(list_filter(tail, lambda x: x IN ('', '.', '..') OR lower(x) = 'node_modules'
        OR regexp_matches(x, '[\\%?#:*]'))) = 0 AS ok FROM n
      WHERE NOT (path LIKE '.%' OR path LIKE '/%' OR contains(path, '\'))
        AND regexp_matches(nm, '^(@[a-zA-Z0-9._-]+/)?[a-zA-Z0-9._-]+$') AND nm NOT IN ('.', '..'))
SELECT page_id, form, nm AS name, CASE WHEN ok THEN CASE WHEN len(tail) = 0 THEN '.'
  ELSE './' || array_to_string(tail, '/') END END AS subpath, ok AS valid FROM v""")
def package_request(spark, sf):
    rows = path_inputs(spark, sf)
    scoped = rows.filter(F.col("form") == "plain").select(
        "page_id", F.lit("scoped").alias("form"), F.concat(F.lit("@scope/"), "path").alias("path")
    )
    found = rows.unionByName(scoped).withColumn("r", P.package_request("path"))
    return found.filter(F.col("r").isNotNull()).select("page_id", "form", "r.*")


@query("make_id", with_graph("""
SELECT id, 'call:' || substring(sha256(CAST(to_json(['call', source_id, coalesce(target_id, ''),
  id]) AS VARCHAR)), 1, 32) AS made FROM calls"""))
def make_id(spark, sf):
    return star_graph(spark, sf, types=("calls",)).relations.select(
        "id", D.make_id("call", "source_id", F.coalesce("target_id", F.lit("")), "id").alias("made")
    )


@query("canonical_json", """
SELECT event_id, '{"a":[3,1,2],"k":' || json_extract_string(props, '$.k') || ',"z":{"b":"' ||
  event_type || '","c":null}}' AS canonical FROM events""")
def canonical_json(spark, sf):
    """Key order and spacing of every event's JSON are scrambled, then made canonical."""
    text = F.concat(
        F.lit('{ "z" : {"c":null, "b": "'), F.col("event_type"), F.lit('"}, "k":'),
        F.get_json_object("props", "$.k"), F.lit(', "a":[3, 1,2] }'),
    )
    return table(spark, sf, "events").select("event_id", D.canonical_json(text).alias("canonical"))


@query("json_byte_size", """
SELECT doc_id, CAST(strlen(CAST(to_json({'doc_id': doc_id, 'text': text, 'lang': lang})
  AS VARCHAR)) AS BIGINT) AS bytes,
  strlen(CAST(to_json({'doc_id': doc_id, 'text': text, 'lang': lang}) AS VARCHAR)) > 4096
    AS over_cap FROM documents""")
def json_byte_size(spark, sf):
    from ..operators.integrity import json_byte_size as size

    rows = table(spark, sf, "documents").select(
        "doc_id", size(F.struct("doc_id", "text", "lang")).cast("bigint").alias("bytes")
    )
    return rows.withColumn("over_cap", F.col("bytes") > 4096)


@query("symbol_location", with_graph("""
SELECT id, coalesce(file_path, name) || ':' || coalesce(start_line, 1) AS location FROM nodes"""))
def symbol_location(spark, sf):
    return graph_nodes(spark, sf).select(
        "id", P.symbol_location("file_path", "name", "start_line").alias("location")
    )


@query("evidence_text", with_graph("""
SELECT id, evidence_path || ':' || evidence_line || ' ' || evidence_text AS evidence
FROM relations"""))
def evidence_text(spark, sf):
    return star_graph(spark, sf).relations.select(
        "id", P.evidence_text("evidence_path", "evidence_line", "evidence_text").alias("evidence")
    )


@query("split_qualified", """
WITH q AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type FROM part)
SELECT p_partkey, CAST(unnest(generate_series(0, 2)) AS BIGINT) AS pos,
  unnest([w[1], '<callback:[[80,"' || p_type || '.' || w[2] || '"]]:1>', w[2]]) AS segment
FROM q""")
def split_qualified(spark, sf):
    rows = _qualified(spark, sf).select(
        "p_partkey", F.posexplode(D.split_qualified("q")).alias("pos", "segment")
    )
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def _qualified(spark, sf):
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(w[0], F.lit('.<callback:[[80,"'), "p_type", F.lit("."), w[1], F.lit('"]]:1>.'),
                 w[1]).alias("q"),
    )


@query("display_name", """
WITH q AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_type FROM part)
SELECT p_partkey, w[1] || ' › ' || p_type || '.' || w[2] || '(…) callback › ' || w[2] AS label
FROM q""")
def display_name(spark, sf):
    return _qualified(spark, sf).select("p_partkey", D.display_name("q").alias("label"))
