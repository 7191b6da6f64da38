"""Linking extracted facts across files by joins: modules, imports, call chains, the graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import digest, make_id, unordered_digest
from ..functions.paths import ancestors, basename, dirname, language_of
from ..operators.paging import expand_copies
from ..staging import stage


def module_name(path: Column) -> Column:
    """Module of a Python path: no suffix, dots for slashes, no ``src`` prefix or ``__init__``."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(F.regexp_replace(dotted, r"^src\.", ""), r"(^|\.)__init__$", "")


def module_table(files: DataFrame) -> DataFrame:
    """(project_id, module, path); of two files for one module the last path wins."""
    return files.groupBy("project_id", module_name(F.col("path")).alias("module")).agg(
        F.max("path").alias("path"))


def relative_module(path: Column, name: Column, level: Column) -> Column:
    """Absolute module of ``from <dots><name> import``; too many dots are invalid."""
    own = module_name(path)
    all_parts = F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, r"\."))
    package = F.when(path.endswith("/__init__.py"), F.size(all_parts)).otherwise(
        F.greatest(F.size(all_parts) - 1, F.lit(0)))
    left = package - (level - 1)
    kept = F.slice(all_parts, F.lit(1), F.greatest(left, F.lit(0)))
    tail = F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array(name))
    return (
        F.when(level == 0, F.coalesce(name, F.lit("")))
        .when(left < 0, "<invalid-relative>")
        .otherwise(F.array_join(F.concat(kept, tail), "."))
    )


def link_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Target of each import: the module's file, else the submodule's; missing relative modules
    are unresolved, missing absolute ones external."""
    direct = modules.select("project_id", "module", F.col("path").alias("module_path"))
    sub = modules.select("project_id", F.col("module").alias("submodule"),
                         F.col("path").alias("sub_path"))
    rows = imports.withColumn("submodule", F.concat_ws(
        ".", "module", F.coalesce("member", F.lit("")))).join(
        direct, ["project_id", "module"], "left").join(sub, ["project_id", "submodule"], "left")
    target = F.coalesce("module_path", "sub_path")
    return rows.select(
        *imports.columns, target.alias("target_path"),
        F.when(target.isNotNull(), "resolved").when(F.col("relative"), "unresolved")
        .otherwise("external").alias("resolution"))


def link_calls(calls: DataFrame, modules: DataFrame, bindings: DataFrame) -> DataFrame:
    """Follow symbolic call targets through re-exports to a declaration.

    ``calls``: call_id and the symbolic target; each round all open calls take one step along
    (module, name).  A state seen before on the same chain ends it (cyclic re-exports).
    """
    here = modules.select("project_id", F.col("module").alias("at_module"),
                          F.col("path").alias("at_path"))
    sub = modules.select("project_id", F.col("module").alias("submodule"),
                         F.lit(True).alias("has_sub"))
    names = bindings.select(
        "project_id", F.col("path").alias("at_path"), F.col("parent").alias("in_scope"),
        F.col("name").alias("first"), F.col("kind").alias("b_kind"),
        F.col("qualified").alias("b_qualified"), F.col("module").alias("b_module"),
        F.col("member").alias("b_member"), F.col("relative").alias("b_relative"))
    none = F.lit(None).cast("string")
    done = calls.filter(F.col("kind") != "import").select(
        "project_id", "call_id",
        F.when(F.col("kind") == "node", F.col("path")).alias("target_path"),
        F.when(F.col("kind") == "node", F.col("qualified")).alias("target_name"),
        F.when(F.col("kind") == "external", F.col("name")).alias("external"))
    state = calls.filter(F.col("kind") == "import").select(
        "project_id", "call_id", F.col("module").alias("at_module"), F.col("attrs").alias("parts"),
        "relative", F.lit("").alias("in_scope"), none.alias("class_path"),
        F.array().cast("array<string>").alias("seen"))
    for n in count():
        state = stage(state, f"link-{n}")
        if state.isEmpty():
            return done
        key = F.to_json(F.array("at_module", "in_scope", F.array_join("parts", "."),
                                F.coalesce("class_path", F.lit(""))))
        rows = state.withColumn("key", key).filter(~F.array_contains("seen", F.col("key")))
        looped = state.withColumn("key", key).filter(F.array_contains("seen", F.col("key")))
        rows = rows.join(here, ["project_id", "at_module"], "left").withColumn(
            "at_path", F.coalesce("class_path", "at_path"))
        first = F.element_at("parts", 1)
        rows = rows.withColumn("first", F.when(F.size("parts") > 0, first)).withColumn(
            "rest", F.when(F.size("parts") > 0, F.slice("parts", F.lit(2), F.size("parts")))
        ).withColumn("submodule", F.when(
            F.col("in_scope") == "", F.when(F.col("at_module") == "", F.col("first")).otherwise(
                F.concat_ws(".", "at_module", "first"))))
        rows = rows.join(names, ["project_id", "at_path", "in_scope", "first"], "left").join(
            sub, ["project_id", "submodule"], "left")
        outside = F.col("at_path").isNull()
        dotted = F.concat_ws(".", "at_module", F.array_join("parts", "."))
        name = F.when(F.size("parts") > 0, dotted).otherwise(F.col("at_module"))
        is_external = outside & ~F.col("relative") & ~F.col("at_module").startswith("<")
        found = F.col("b_kind").isNotNull() & ~outside
        leaf = found & F.col("b_kind").isin("function", "class") & (F.size("rest") == 0)
        member = found & (F.col("b_kind") == "class") & (F.size("rest") == 1)
        hop = found & (F.col("b_kind") == "import")
        into = ~outside & F.col("b_kind").isNull() & F.coalesce("has_sub", F.lit(False))
        step = stage(rows.withColumn("outcome", F.when(is_external, "external").when(leaf, "leaf")
                                     .when(member, "member").when(hop, "hop")
                                     .when(into, "into").otherwise("unknown"))
                     .withColumn("external", name), f"link-step-{n}")
        outcome = F.col("outcome")
        done = done.unionByName(step.filter(outcome.isin("external", "leaf", "unknown")).select(
            "project_id", "call_id",
            F.when(outcome == "leaf", F.col("at_path")).alias("target_path"),
            F.when(outcome == "leaf", F.col("b_qualified")).alias("target_name"),
            F.when(outcome == "external", F.col("external")).alias("external")))
        done = done.unionByName(looped.select(
            "project_id", "call_id", none.alias("target_path"), none.alias("target_name"),
            none.alias("external")))
        as_parts = F.when(F.col("b_member") != "", F.concat(F.array("b_member"), "rest")).otherwise(
            F.col("rest"))
        is_hop, is_member = outcome == "hop", outcome == "member"
        state = step.filter(outcome.isin("hop", "member", "into")).select(
            "project_id", "call_id",
            F.when(is_hop, F.col("b_module")).when(is_member, F.col("at_module"))
            .otherwise(F.col("submodule")).alias("at_module"),
            F.when(is_hop, as_parts).otherwise(F.col("rest")).alias("parts"),
            F.when(is_hop, F.col("b_relative")).otherwise(F.col("relative")).alias("relative"),
            F.when(is_member, F.col("b_qualified")).otherwise("").alias("in_scope"),
            F.when(is_member, F.col("at_path")).alias("class_path"),
            F.array_append("seen", F.col("key")).alias("seen"))


def resolve_calls(calls: DataFrame, linked: DataFrame) -> DataFrame:
    """Calls with their target and resolution."""
    rows = calls.join(linked, ["project_id", "call_id"], "left")
    return rows.withColumn("resolution", F.when(
        F.col("external").isNotNull(), "external").when(
        F.col("target_path").isNotNull(), "resolved").otherwise("unresolved"))


def build_nodes(project: str, files: DataFrame, decls: DataFrame, externals: DataFrame) -> DataFrame:
    """Folder chain, files, functions and externals with stable ids and parents."""
    pid = F.lit(project)
    folder_id = lambda p: make_id("folder", pid, p, p)
    paths = files.select("path").distinct()
    folders = paths.select(F.explode(F.array_prepend(
        ancestors("path", include_self=False), F.lit("."))).alias("path")).distinct()
    none = F.lit(None).cast("string")
    folder_rows = folders.select(
        folder_id(F.col("path")).alias("id"), F.lit("folder").alias("kind"),
        F.when(F.col("path") == ".", ".").otherwise(basename("path")).alias("name"),
        F.col("path").alias("qualified_name"),
        F.when(F.col("path") != ".", F.col("path")).alias("file_path"),
        F.when(F.col("path") != ".", folder_id(dirname("path"))).alias("parent_id"),
        none.alias("language"))
    file_rows = paths.select(
        make_id("file", pid, "path", "path").alias("id"), F.lit("file").alias("kind"),
        basename("path").alias("name"), F.col("path").alias("qualified_name"),
        F.col("path").alias("file_path"), folder_id(dirname("path")).alias("parent_id"),
        language_of("path").alias("language"))
    by_kind = lambda path, q, k: make_id("function", pid, path, q, k)
    outer = decls.select("path", F.col("qualified").alias("parent"), F.col("kind").alias("p_kind"))
    decl_rows = decls.join(outer, ["path", "parent"], "left").select(
        by_kind("path", "qualified", "kind").alias("id"), F.lit("function").alias("kind"),
        "name", F.col("qualified").alias("qualified_name"), F.col("path").alias("file_path"),
        F.when(F.col("p_kind").isNotNull(), by_kind("path", "parent", "p_kind"))
        .otherwise(make_id("file", pid, "path", "path")).alias("parent_id"),
        language_of("path").alias("language"))
    ext_rows = externals.select("name").distinct().select(
        make_id("external", pid, F.lit(""), "name").alias("id"), F.lit("external").alias("kind"),
        "name", F.col("name").alias("qualified_name"), none.alias("file_path"),
        none.alias("parent_id"), none.alias("language"))
    return folder_rows.unionByName(file_rows).unionByName(decl_rows).unionByName(ext_rows)


def build_edges(project: str, raw: DataFrame) -> DataFrame:
    """Relations with ids that keep repeated calls apart.

    ``raw``: type, source_id, target_id, resolution, path, line, text.  Equal rows collapse to a
    count (combined map-side) and are numbered when expanded, so no group is ever sorted.
    """
    keys = ["type", "source_id", "target_id", "resolution", "path", "line", "text"]
    counted = raw.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    rows = expand_copies(counted, "copies", "nth")
    return rows.select(
        make_id("relation", F.lit(project), "type", "source_id",
                F.coalesce("target_id", F.lit("")), "resolution", "path", "line",
                F.coalesce("text", F.lit("")), "nth").alias("id"),
        "type", "source_id", "target_id", "resolution", F.col("path").alias("evidence_path"),
        F.col("line").alias("evidence_line"), F.col("text").alias("evidence_text"))


def content_hash(files: DataFrame) -> DataFrame:
    """Version-framed digest of typed, length-framed (path, bytes) per project, order-free.

    ``files``: project_id, type, path, content.  Bytes are hashed per file; only digests mix.
    """
    framed = F.concat_ws(
        ":", "type", F.octet_length("path").cast("string"), "path",
        F.octet_length("content").cast("string"), F.sha2("content", 256))
    return files.groupBy("project_id").agg(unordered_digest(framed).alias("d")).select(
        "project_id", digest(F.concat(F.lit("index-inputs-v1:"), "d")).alias("content_hash"))


def snapshot_id(content: DataFrame, facts: DataFrame) -> DataFrame:
    """Snapshot identity from content and extracted facts: new capabilities give a new id.

    ``facts``: project_id, fact (one text per fact row).
    """
    mixed = facts.groupBy("project_id").agg(unordered_digest(F.col("fact")).alias("facts"))
    return content.join(mixed, "project_id").select(
        "project_id", "content_hash",
        make_id("snapshot", "project_id", "content_hash", "facts").alias("snapshot_id"))


# ---- joins over pre-extracted rows of compiled languages ------------------------------------------
def link_external_bindings(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """External name ``spec:member:expression`` of calls whose root is an imported binding."""
    ext = imports.filter(~F.col("spec").startswith(".") & ~F.col("spec").startswith("/")).select(
        "path", F.col("alias").alias("root"), "spec", "member")
    return calls.join(ext, ["path", "root"]).withColumn(
        "external", F.concat_ws(":", "spec", "member", "expression"))


def const_binding_only(declarations: DataFrame) -> DataFrame:
    """Declarations that may identify a callee: functions, or const bindings never rewritten."""
    return declarations.filter(
        (F.col("form") == "function") | ((F.col("form") == "const") & ~F.col("rewritten")))


def type_only_exclude(imports: DataFrame, reexports: DataFrame, max_hops: int = 16) -> DataFrame:
    """Flag imports that are type-only somewhere on their re-export chain.

    ``imports``: import_id, module, name, type_only; ``reexports``: module, name, to_module,
    to_name, type_only.  A chain that does not end within ``max_hops`` counts as type-only.
    """
    hops = reexports.select("module", "name", "to_module", "to_name",
                            F.col("type_only").alias("hop_type"))
    state = imports.select("import_id", "module", "name", "type_only")
    settled = state.filter("type_only").select("import_id", F.lit(True).alias("excluded"))
    state = state.filter(~F.col("type_only")).select("import_id", "module", "name")
    for n in range(max_hops):
        step = stage(state.join(hops, ["module", "name"], "left"), f"type-only-{n}")
        settled = settled.unionByName(step.filter("hop_type").select(
            "import_id", F.lit(True).alias("excluded")))
        settled = settled.unionByName(step.filter(F.col("to_module").isNull()).select(
            "import_id", F.lit(False).alias("excluded")))
        state = step.filter(F.col("to_module").isNotNull() & ~F.col("hop_type")).select(
            "import_id", F.col("to_module").alias("module"), F.col("to_name").alias("name"))
        if state.isEmpty():
            break
    else:
        settled = settled.unionByName(state.select("import_id", F.lit(True).alias("excluded")))
    return settled.groupBy("import_id").agg(F.bool_or("excluded").alias("excluded"))


def export_veto(exports: DataFrame, rejections: DataFrame) -> DataFrame:
    """Exports left after rejections seen in any scope block them everywhere.

    ``rejections``: module, name (null = the whole module).
    """
    whole = rejections.filter(F.col("name").isNull()).select("module").distinct()
    named = rejections.filter(F.col("name").isNotNull()).select("module", "name").distinct()
    return exports.join(whole, "module", "left_anti").join(named, ["module", "name"], "left_anti")


def commonjs_link(calls: DataFrame, exports: DataFrame) -> DataFrame:
    """Calls through require: resolved only if the export has one valid write.

    ``exports``: module, name, target_id, valid; ``calls``: call_id, module, name, dynamic.
    """
    stable = exports.groupBy("module", "name").agg(
        F.count(F.lit(1)).alias("writes"), F.bool_and("valid").alias("all_valid"),
        F.min("target_id").alias("target_id"))
    rows = calls.join(stable, ["module", "name"], "left")
    ok = ~F.col("dynamic") & (F.col("writes") == 1) & F.col("all_valid")
    reason = (
        F.when(F.col("dynamic"), "dynamic property").when(F.col("writes").isNull(), "no export")
        .when(F.col("writes") > 1, "export written more than once")
        .when(~F.col("all_valid"), "export not stable"))
    return rows.select("call_id", F.when(ok, F.col("target_id")).alias("target_id"),
                       reason.alias("reason"))


def module_cycle_flag(requires: DataFrame, components: DataFrame) -> DataFrame:
    """Require edges whose two modules share a component are initialization-uncertain."""
    a = components.select(F.col("id").alias("importer"), F.col("component").alias("ca"))
    b = components.select(F.col("id").alias("target"), F.col("component").alias("cb"))
    return requires.join(a, "importer").join(b, "target").select(
        *requires.columns, (F.col("ca") == F.col("cb")).alias("uncertain"))


def forwarding_chain(forwarders: DataFrame, modules: DataFrame, max_hops: int = 16) -> DataFrame:
    """Leaf module of each forwarder, or itself with ``proven`` false.

    ``forwarders``: module, target, specifier; ``modules``: module, invalid, mode.  A hop needs a
    relative specifier, a valid forwarder and a CommonJS target; cycles and more than
    ``max_hops`` hops are not proven.
    """
    target = modules.select(F.col("module").alias("target"), F.col("mode").alias("t_mode"))
    source = modules.select("module", F.col("invalid").alias("m_invalid"))
    hop = forwarders.join(target, "target", "left").join(source, "module", "left").select(
        F.col("module").alias("at"), F.col("target").alias("next"),
        (F.col("specifier").rlike(r"^\.\.?/") & (F.col("t_mode") == "commonjs")
         & ~F.col("m_invalid")).alias("sound"))
    hop = stage(hop, "forward-hops")
    state = hop.select(F.col("at").alias("start"), F.col("at"))
    proven = None
    for n in range(max_hops + 1):
        step = stage(state.join(hop, "at", "left"), f"forward-{n}")
        ends = step.filter(F.col("next").isNull()).select("start", F.col("at").alias("leaf"))
        proven = ends if proven is None else proven.unionByName(ends)
        state = step.filter(F.col("next").isNotNull() & F.coalesce("sound", F.lit(False))).select(
            "start", F.col("next").alias("at"))
        if n == max_hops or state.isEmpty():
            break
    invalid = modules.filter("invalid").select(F.col("module").alias("leaf"))
    proven = proven.join(invalid, "leaf", "left_anti")
    starts = hop.select(F.col("at").alias("module")).distinct()
    return starts.join(proven.withColumnRenamed("start", "module"), "module", "left").select(
        "module", F.coalesce("leaf", "module").alias("leaf"),
        F.col("leaf").isNotNull().alias("proven"))


def alias_group_veto(modules: DataFrame, exports: DataFrame, rejected: DataFrame) -> DataFrame:
    """Exports that survive the vetoes shared by all aliases of one leaf.

    ``modules``: module, leaf, invalid, named_invalid; ``exports``: module, name (empty name is
    the default export), target_id; ``rejected``: module, name.
    """
    groups = modules.groupBy("leaf").agg(
        F.bool_or("invalid").alias("g_invalid"), F.bool_or("named_invalid").alias("g_named"))
    of_leaf = modules.select("module", "leaf")
    vetoed = rejected.join(of_leaf, "module").select("leaf", "name").distinct()
    rows = exports.join(of_leaf, "module").join(groups, "leaf")
    kept = rows.filter(~F.col("g_invalid") & ~(F.col("g_named") & (F.col("name") != "")))
    return kept.join(vetoed, ["leaf", "name"], "left_anti").select(
        "module", "leaf", "name", "target_id")
