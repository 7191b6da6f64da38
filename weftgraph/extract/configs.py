"""Nearest owners, workspaces, export maps, aliases and configuration reference graphs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.paths import ancestors, dirname, package_request
from ..operators.paging import top_n, totals
from ..staging import stage

# Fixed limits of configuration graphs.
MAX_PROJECTS, MAX_REFERENCES, MAX_DEPTH = 512, 2048, 16
MAX_CONDITIONS = 2048
#: Keys that are paths or array places are no conditions.
_NO_CONDITION = re.compile(r"\.|(0|[1-9][0-9]*)$")


def nearest_ancestor(files: DataFrame, owners: DataFrame) -> DataFrame:
    """Deepest owner directory above each file: an as-of join on the path tree.

    ``files``: path; ``owners``: dir, owner.  Directories of a file meet owners by equality.
    """
    above = files.select("path").distinct().withColumn("dir", F.explode(F.array_prepend(
        ancestors("path", include_self=False), F.lit("."))))
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))
    return above.join(owners.select("dir", "owner"), "dir").groupBy("path").agg(
        F.max_by(F.struct("owner", "dir"), depth).alias("o")).select(
        "path", "o.owner", F.col("o.dir").alias("owner_dir"))


def module_mode(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """esm / commonjs / unknown per file: suffix first, else the nearest manifest's type.

    ``manifests``: dir, mode (unknown when it could not be read).
    """
    near = nearest_ancestor(files, manifests.select("dir", F.col("mode").alias("owner")))
    path = F.col("path")
    return files.select("path").distinct().join(near, "path", "left").select(
        "path", F.when(path.endswith(".cjs"), "commonjs").when(path.endswith(".mjs"), "esm")
        .when(~path.endswith(".js"), "unknown").otherwise(F.coalesce("owner", F.lit("unknown")))
        .alias("mode"))


def manifest_mode(text) -> Column:
    """Module mode that a manifest text declares."""
    kind = F.get_json_object(text, "$.type")
    valid = F.try_parse_json(text).isNotNull()
    return F.when(~valid, "unknown").when(kind.isNull() | (kind == "commonjs"), "commonjs").when(
        kind == "module", "esm").otherwise("unknown")


def package_boundaries(manifests: DataFrame) -> DataFrame:
    """(dir, path, name, mode, valid): a manifest that does not parse stays an opaque boundary."""
    doc = F.try_parse_json("text")
    valid = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    return manifests.select(
        dirname("path").alias("dir"), "path",
        F.when(valid, F.get_json_object("text", "$.name")).alias("name"),
        F.when(valid, manifest_mode("text")).otherwise("unknown").alias("mode"),
        valid.alias("valid"))


def workspace_members(owners: DataFrame, manifests: DataFrame) -> DataFrame:
    """(owner_dir, dir, name): manifests whose directory matches a workspace pattern of an owner.

    ``*`` stands for one whole segment; the segment count must agree.
    """
    above = manifests.select("dir", "name").withColumn("owner_dir", F.explode(F.array_prepend(
        ancestors("dir", include_self=False), F.lit(".")))).filter(F.col("dir") != ".")
    inner = F.when(F.col("owner_dir") == ".", F.col("dir")).otherwise(
        F.substr("dir", F.length("owner_dir") + 2))
    rows = above.withColumn("segments", F.split(inner, "/")).withColumn(
        "n", F.size("segments"))
    patterns = owners.select(F.col("dir").alias("owner_dir"), F.explode("patterns").alias("pattern")) \
        .withColumn("parts", F.split("pattern", "/")).withColumn("n", F.size("parts"))
    same = F.forall(F.zip_with("parts", "segments", lambda p, s: (p == "*") | (p == s)),
                    lambda ok: ok)
    return rows.join(patterns, ["owner_dir", "n"]).filter(same).select(
        "owner_dir", "dir", "name").distinct()


def workspace_resolve(requests: DataFrame, manifests: DataFrame, owners: DataFrame,
                      members: DataFrame) -> DataFrame:
    """Target package of bare specifiers: self reference, else the registered member.

    ``requests``: path, specifier.  Unknown names are left out; zero or several members and
    unusable consumers are rejected with a reason.
    """
    rows = requests.withColumn("r", package_request("specifier")).filter(
        F.col("r").isNotNull()).select(*requests.columns, "r.name", "r.subpath", "r.valid")
    known = manifests.filter(F.col("name").isNotNull()).select("name").distinct()
    rows = rows.join(known, "name", "left_semi")
    near = nearest_ancestor(requests, manifests.select("dir", F.col("dir").alias("owner"))).select(
        "path", F.col("owner").alias("consumer_dir"))
    boss = nearest_ancestor(requests, owners.select("dir", F.col("dir").alias("owner"))).select(
        "path", F.col("owner").alias("owner_dir"))
    mine = manifests.select(F.col("dir").alias("consumer_dir"), F.col("name").alias("own_name"),
                            F.col("valid").alias("own_valid"))
    belongs = members.select("owner_dir", F.col("dir").alias("consumer_dir"),
                             F.lit(True).alias("registered")).distinct()
    named = members.groupBy("owner_dir", "name").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("dir").alias("candidate_dir"))
    rows = (
        rows.join(near, "path", "left").join(boss, "path", "left").join(mine, "consumer_dir", "left")
        .join(belongs, ["owner_dir", "consumer_dir"], "left")
        .join(named, ["owner_dir", "name"], "left"))
    own = F.coalesce(F.col("own_name") == F.col("name"), F.lit(False))
    inside = F.col("registered").isNotNull() | F.coalesce(
        F.col("consumer_dir") == F.col("owner_dir"), F.lit(False))
    reason = (
        F.when(~F.col("valid"), "invalid subpath")
        .when(~F.coalesce("own_valid", F.lit(False)), "consumer unavailable")
        .when(own, F.lit(None)).when(F.col("owner_dir").isNull(), "no workspace owner")
        .when(~inside, "outside the workspace")
        .when(F.col("candidates").isNull(), "not registered")
        .when(F.col("candidates") > 1, "duplicate name"))
    return rows.withColumn("reason", reason).select(
        *requests.columns, "name", "subpath", "reason", F.when(F.col("reason").isNull(), F.when(
            own, F.col("consumer_dir")).otherwise(F.col("candidate_dir"))).alias("target_dir"))


def _by_prefix(requests: DataFrame, text: str, keys: list[str], patterns: DataFrame,
               pattern: str) -> DataFrame:
    """Requests joined to single-star patterns: every prefix of the text meets the part before
    the star by equality, the part after it is checked afterwards."""
    spread = requests.withColumn("head", F.explode(F.transform(
        F.sequence(F.lit(0), F.length(text)), lambda i: F.substr(text, F.lit(1), i))))
    stars = patterns.filter(F.col(pattern).contains("*")).withColumn(
        "head", F.substring_index(pattern, "*", 1)).withColumn(
        "tail", F.substring_index(pattern, "*", -1))
    return spread.join(stars, [*keys, "head"]).filter(
        F.col(text).endswith(F.col("tail")))


def exports_pattern_select(requests: DataFrame, exports: DataFrame) -> DataFrame:
    """Export entry of each (package, subpath): the exact key, else the wildcard with the longest
    part before its star, then the longest key; the star's text replaces stars in the target.

    ``exports``: package, key, target.
    """
    exact = requests.join(exports.select("package", F.col("key").alias("subpath"), "target"),
                          ["package", "subpath"]).select(
        *requests.columns, F.col("subpath").alias("key"), "target")
    open_ = requests.join(exact.select("package", "subpath"), ["package", "subpath"], "left_anti")
    found = _by_prefix(open_, "subpath", ["package"], exports, "key").filter(
        F.length("subpath") >= F.length("key"))
    best = found.groupBy(*requests.columns).agg(F.max_by(
        F.struct("key", "target", "head", "tail"),
        F.struct(F.length("head").alias("a"), F.length("key").alias("b"),
                 F.col("key").alias("c"))).alias("e")).select(*requests.columns, "e.*")
    middle = F.substr("subpath", F.length("head") + 1,
                      F.length("subpath") - F.length("head") - F.length("tail"))
    wild = best.select(*requests.columns, "key",
                       F.replace("target", F.lit("*"), middle).alias("target"))
    return exact.unionByName(wild)


_ENTRIES = T.ArrayType(T.StructType([
    T.StructField("parent", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("target", T.StringType())]))


@F.pandas_udf(_ENTRIES)
def condition_rows(conditions: pd.Series) -> pd.Series:
    """A condition tree as rows, each entry after its parent and its earlier siblings.

    Kinds: ``object``, ``target`` (a text), ``blocked`` (null) and ``invalid``: anything else, keys
    that are no conditions, entries nested too deep or beyond the budget of one tree.
    """

    def rows(text):
        try:
            todo = [(-1, None, 0, json.loads(text))]
        except (TypeError, ValueError):
            return [{"parent": -1, "name": None, "kind": "invalid", "target": None}]
        out = []
        while todo:
            parent, name, depth, value = todo.pop()
            kind = ("target" if isinstance(value, str) else "blocked" if value is None else
                    "object" if isinstance(value, dict) else "invalid")
            if depth > MAX_DEPTH or len(out) >= MAX_CONDITIONS or kind == "object" and any(
                    _NO_CONDITION.match(k) for k in value):
                kind = "invalid"
            if kind == "object":
                todo += [(len(out), k, depth + 1, v) for k, v in reversed(value.items())]
            out.append({"parent": parent, "name": name, "kind": kind,
                        "target": value if kind == "target" else None})
        return out

    return conditions.map(rows)


def _put(array: Column, place: Column, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == place, value).otherwise(x))


def export_outcomes(rows: Column, mode: Column) -> Column:
    """All targets a condition tree (a column of ``condition_rows``) may give for a request mode.

    ``!none`` stands for no match, ``!blocked`` for an explicit null, ``!invalid`` for bad input;
    conditions other than the mode and ``default`` may or may not hold.  An entry of the mode or
    ``default`` that surely gives something hides its later siblings; read backwards, the rows show
    which entries are sure, read forwards, which ones can be reached.
    """
    size = F.size(rows)
    places = F.sequence(F.lit(0), size - 1)
    foreign = F.when(mode == "import", "require").otherwise("import")
    holds = lambda row: row["name"].isNotNull() & ((row["name"] == "default") | (
        row["name"] == mode))
    no = F.array_repeat(F.lit(False), size)

    def backwards(sure: Column, i: Column) -> Column:
        row = F.get(rows, i)
        # By now an object is sure if one of its entries made it so.
        gives = (row["kind"] != "object") | F.get(sure, i)
        marked = _put(sure, i, gives)
        return F.when(gives & holds(row), _put(marked, row["parent"], F.lit(True))).otherwise(marked)

    sure = F.aggregate(F.reverse(places), no, backwards)

    def forwards(state: Column, i: Column) -> Column:
        row = F.get(rows, i)
        here = (row["parent"] < 0) | (
            F.coalesce(F.get(state["reached"], row["parent"]), F.lit(False))
            & ~F.coalesce(F.get(state["hidden"], row["parent"]), F.lit(False))
            & (row["name"] != foreign))
        hides = here & holds(row) & F.get(sure, i)
        return F.struct(
            _put(state["reached"], i, here).alias("reached"),
            F.when(hides, _put(state["hidden"], row["parent"], F.lit(True))).otherwise(
                state["hidden"]).alias("hidden"))

    reached = F.aggregate(places, F.struct(no.alias("reached"), no.alias("hidden")), forwards,
                          lambda s: s["reached"])
    ends = F.transform(F.filter(places, lambda i: F.get(reached, i) & (
        F.get(rows, i)["kind"] != "object")), lambda i: F.get(rows, i))
    named = F.transform(ends, lambda r: F.when(r["kind"] == "target", r["target"]).otherwise(
        F.concat(F.lit("!"), r["kind"])))
    none = F.when(F.get(sure, F.lit(0)), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("!none")))
    return F.array_sort(F.array_distinct(F.concat(named, none)))


def export_target(directory: Column, outcome: Column) -> Column:
    """Path of an outcome below its package, or null if it names no plain implementation file."""
    inner = F.substr(outcome, F.lit(3))
    plain = (outcome.startswith("./") & ~outcome.rlike(r"[\\%?#:*]")
             & ~F.lower(inner).rlike(r"(^|/)(\.{0,2}|node_modules)(/|$)")
             & inner.rlike(r"\.([cm]?[jt]s|[jt]sx)$") & ~inner.rlike(r"\.d\.[cm]?ts$"))
    return F.when(plain, F.when(directory == ".", inner).otherwise(
        F.concat_ws("/", directory, inner)))


def exports_condition_converge(requests: DataFrame, sources: DataFrame,
                               packages: DataFrame | None = None) -> DataFrame:
    """Whether all outcomes of all request modes give one captured file of the package itself.

    ``requests``: request_id, dir, conditions (JSON), mode - one row per mode; ``sources``: path;
    ``packages``: dir of every manifest (those of the requests if not given).
    """
    rows = requests.withColumn("entries", condition_rows("conditions")).withColumn(
        "outcome", F.explode(export_outcomes(F.col("entries"), F.col("mode")))).drop("entries")
    rows = rows.withColumn("path", export_target(F.col("dir"), F.col("outcome")))
    owners = (requests if packages is None else packages).select(
        "dir", F.col("dir").alias("owner")).distinct()
    captured = sources.select("path").distinct()
    nearest = nearest_ancestor(captured, owners).select("path", "owner")
    owned = captured.join(nearest, "path", "left").select("path", "owner", F.lit(True).alias("found"))
    rows = rows.join(owned, "path", "left")
    fits = F.coalesce(F.col("found") & (F.col("owner") == F.col("dir")), F.lit(False))
    per = rows.groupBy("request_id").agg(
        F.min("path").alias("low"), F.max("path").alias("high"),
        F.bool_and(fits).alias("all_captured"),
        F.bool_or(F.col("outcome").startswith("!")).alias("blocked"))
    reason = (
        F.when(F.col("blocked"), "blocked, invalid or unmatched")
        .when(~F.col("all_captured"), "not a captured file")
        .when(F.col("low") != F.col("high"), "does not converge"))
    return per.select("request_id", F.when(reason.isNull(), F.col("low")).alias("target"),
                      reason.alias("reason"))


def alias_match(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests that a configured path alias covers (config, specifier, pattern)."""
    exact = requests.join(aliases.filter(~F.col("pattern").contains("*")).select(
        "config", F.col("pattern").alias("specifier")), ["config", "specifier"], "left_semi")
    wild = _by_prefix(requests, "specifier", ["config"], aliases, "pattern").filter(
        F.length("specifier") >= F.length("pattern") - 1)
    return exact.select(*requests.columns).unionByName(
        wild.select(*requests.columns)).distinct()


# ---- configuration graphs -----------------------------------------------------------------------------
def config_extends_closure(configs: DataFrame, extends: DataFrame,
                           max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, path, depth, problem): configurations reached by extends edges.

    ``configs``: path; ``extends``: path, target.  Missing targets, cycles and chains deeper than
    ``max_depth`` are problems instead of members.
    """
    known = configs.select(F.col("path").alias("target"), F.lit(True).alias("known"))
    edges = stage(extends.select("path", "target").distinct().join(known, "target", "left"),
                  "extends")
    walk = configs.select(F.col("path").alias("root"), "path", F.array("path").alias("chain"))
    none = F.lit(None).cast("string")
    out = walk.select("root", "path", F.lit(0).cast("bigint").alias("depth"), none.alias("problem"))
    for depth in range(1, max_depth + 2):
        step = stage(walk.join(edges, "path"), f"extends-{depth}")
        if step.isEmpty():
            break
        cyclic = F.array_contains("chain", F.col("target"))
        problem = (
            F.when(cyclic, "cycle").when(F.col("known").isNull(), "missing")
            .when(F.lit(depth > max_depth), "depth"))
        out = out.unionByName(step.select(
            "root", F.col("target").alias("path"), F.lit(depth).cast("bigint").alias("depth"),
            problem.alias("problem")))
        walk = step.filter(problem.isNull()).select(
            "root", F.col("target").alias("path"),
            F.array_append("chain", F.col("target")).alias("chain"))
    return out.groupBy("root", "path", "problem").agg(F.min("depth").alias("depth"))


def config_closure_valid(projects: DataFrame, references: DataFrame,
                         max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, valid): own-valid and every reference resolved into a valid closure.

    V0 is empty and V(k) holds the own-valid projects whose references all lead into V(k-1); the
    answer is V(max_depth), so cycles and deeper chains fall out by themselves.  ``references``:
    path, target (null or unknown targets never resolve).
    """
    own = stage(projects.filter("own_valid").select("path"), "config-own")
    edges = stage(references.select("path", F.coalesce("target", F.lit("")).alias("target"))
                  .distinct(), "config-edges")
    valid, size = own.limit(0), 0
    for k in range(max_depth):
        broken = edges.join(valid.select(F.col("path").alias("target")), "target", "left_anti")
        valid = stage(own.join(broken.select("path").distinct(), "path", "left_anti"),
                      f"config-valid-{k}")
        now = valid.count()
        if k and now == size:
            break
        size = now
    return projects.join(valid.withColumn("v", F.lit(True)), "path", "left").select(
        "path", F.col("v").isNotNull().alias("valid"))


def config_reference_graph(projects: DataFrame, references: DataFrame, components: DataFrame,
                           closure: DataFrame, max_projects: int = MAX_PROJECTS) -> DataFrame:
    """Status of every reference edge: invalid, cycle, budget, unavailable or resolved.

    ``projects``: workspace, path, own_valid; ``references``: workspace, path, raw, target,
    problem; ``components``: id, component over the reference edges.  An edge closes a cycle when
    it leads back to the first path of its component.
    """
    kept = top_n(projects, ["workspace"], [F.col("path")], max_projects).select(
        F.col("path").alias("target"), F.lit(True).alias("within"))
    all_targets = projects.select(F.col("path").alias("target"),
                                  F.col("own_valid").alias("t_valid"))
    ends = lambda name: components.select(F.col("id").alias(name), F.col("component")
                                          .alias(f"{name}_c"))
    closed = closure.select(F.col("path").alias("target"), F.col("valid").alias("t_closed"))
    rows = (
        references.join(all_targets, "target", "left").join(kept, "target", "left")
        .join(ends("path"), "path", "left").join(ends("target"), "target", "left")
        .join(closed, "target", "left"))
    back = (F.col("path") == F.col("target")) | (
        (F.col("path_c") == F.col("target_c")) & (F.col("target") == F.col("target_c")))
    status = (
        F.when(F.col("problem").isNotNull(), "invalid")
        .when(F.coalesce(back, F.lit(False)), "cycle")
        .when(F.col("t_valid").isNull(), "unavailable")
        .when(F.col("within").isNull(), "budget")
        .when(~F.coalesce(F.col("t_valid") & F.col("t_closed"), F.lit(False)), "invalid")
        .otherwise("resolved"))
    return rows.select(*references.columns, status.alias("status"))


def config_reachable(roots: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, path, depth): projects reachable from each root, minimum depth, at most 16 levels.

    ``edges`` leave out budget and cycle references.
    """
    reached = stage(roots.select("root", F.col("root").alias("path"), F.lit(1).alias("depth")),
                    "reach-1")
    frontier = reached
    for depth in range(2, max_depth + 1):
        step = stage(
            frontier.join(edges.select("path", "target"), "path")
            .select("root", F.col("target").alias("path")).distinct()
            .join(reached.select("root", "path"), ["root", "path"], "left_anti")
            .withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if step.isEmpty():
            break
        reached, frontier = reached.unionByName(step), step
    return reached


def config_scope_assign(files: DataFrame, anchors: DataFrame, reachable: DataFrame,
                        membership: DataFrame, closure: DataFrame) -> DataFrame:
    """Configuration of each file: resolved, ambiguous, invalid or unconfigured.

    ``anchors``: path, anchor (nearest configuration or null) and anchor_ok; ``membership``:
    config, path.
    """
    found = (
        anchors.filter(F.col("anchor").isNotNull())
        .join(reachable.select(F.col("root").alias("anchor"), F.col("path").alias("config")),
              "anchor")
        .join(membership.select("config", "path"), ["config", "path"])
        .join(closure.select(F.col("path").alias("config"), "valid"), "config", "left"))
    counts = found.groupBy("path").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("valid").alias("n_valid"),
        F.min(F.when(F.col("valid"), F.col("config"))).alias("config"))
    rows = files.select("path").join(anchors, "path", "left").join(counts, "path", "left")
    n = F.coalesce("n_valid", F.lit(0))
    status = (
        F.when(F.col("anchor").isNull(), "unconfigured").when(n == 1, "resolved")
        .when(n > 1, "ambiguous")
        .when((F.coalesce("members", F.lit(0)) > 0) | ~F.col("anchor_ok"), "invalid")
        .otherwise("unconfigured"))
    return rows.select("path", status.alias("status"),
                       F.when(status == "resolved", F.col("config")).alias("config"))


def scope_status_counts(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes by status with their total; the parts always sum to it."""
    names = ["resolved", "unconfigured", "ambiguous", "invalid"]
    return scopes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in names])


def config_graph_view(workspace: str, listing: DataFrame, order: list[str], cap: int,
                      max_path: int = 2048) -> DataFrame:
    """First ``cap`` rows of one collection per workspace and whether rows were left out."""
    shown = listing.filter(F.length(order[0]) <= max_path)
    rows = top_n(shown, [workspace], [F.col(c) for c in order], cap)
    sizes = totals(listing, [workspace], "observed")
    kept = totals(rows, [workspace], "returned")
    return rows.join(sizes, workspace).join(kept, workspace).withColumn(
        "truncated", F.col("observed") > F.col("returned"))


def scope_can_resolve(pairs: DataFrame, scopes: DataFrame) -> DataFrame:
    """May a call resolve across two files: never from or into a broken scope, always within a
    file or a configuration, otherwise only with an import as proof."""
    rows = pairs
    for side in ("source", "target"):
        rows = rows.join(scopes.select(
            F.col("path").alias(side), F.col("status").alias(f"{side}_status"),
            F.col("config").alias(f"{side}_config")), side, "left")
    broken = F.coalesce("source_status", F.lit("unconfigured")).isin("invalid", "ambiguous") | \
        F.coalesce("target_status", F.lit("unconfigured")).isin("invalid", "ambiguous")
    same = (F.col("source") == F.col("target")) | F.coalesce(
        F.col("source_config") == F.col("target_config"), F.lit(False))
    return rows.select(*pairs.columns, F.when(broken, False).when(same, True).otherwise(
        F.col("proof")).alias("allowed"))
