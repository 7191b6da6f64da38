"""Structure files: strict checks, canonical digests, edits, policies and synchronization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import canonical_json, digest, make_id
from ..functions.paths import normalize_structure_path
from ..operators.paging import page

EXTENSION = "x-graph"
# Fixed size of a structure file.
MAX_BYTES = 1 << 20


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _get(value: Column, path: str) -> Column:
    return F.variant_get(value, path, "variant")


def _string(value: Column, path: str) -> Column:
    """The string at ``path``, null when it is missing or of another type."""
    found = _get(value, path)
    return F.when(_type(found) == "STRING", F.variant_get(value, path, "string"))


def _is_array(value: Column, path: str) -> Column:
    return _type(_get(value, path)).startswith("ARRAY")


def parse_structure(files: DataFrame) -> DataFrame:
    """Adds the variant ``doc``; null when the text is no JSON or repeats a key at any depth."""
    return files.withColumn("doc", F.try_parse_json("text"))


def _elements(parsed: DataFrame, path: str, name: str) -> DataFrame:
    rows = parsed.filter(_is_array(F.col("doc"), path))
    return rows.select(
        "project_id", F.posexplode(F.variant_get("doc", path, "array<variant>")).alias("i", name)
    )


def folders(parsed: DataFrame) -> DataFrame:
    rows = _elements(parsed, "$.folders", "f")
    path = _string(F.col("f"), "$.path")
    return rows.select(
        "project_id", "i", "f", path.alias("raw_path"), normalize_structure_path(path).alias("path"),
        _string(F.col("f"), "$.purpose").alias("purpose"),
    )


def dependency_rules(parsed: DataFrame) -> DataFrame:
    rows = _elements(parsed, "$.dependencyRules", "r")
    source = _string(F.col("r"), "$.from")
    return rows.select(
        "project_id", "i", "r", normalize_structure_path(source, pattern=True).alias("source"),
        _string(F.col("r"), "$.reason").alias("reason"),
        F.when(_type(_get(F.col("r"), "$.mustNotImport")) == "ARRAY<STRING>",
               F.variant_get("r", "$.mustNotImport", "array<string>")).alias("must_not_import"),
    )


def legacy_policies(parsed: DataFrame, extension: str = EXTENSION) -> DataFrame:
    rows = _elements(parsed, f"$['{extension}'].legacyPathPolicies", "p")
    targets = F.variant_get("p", "$.forbiddenDependencies", "array<string>")
    return rows.select(
        "project_id", "i", _string(F.col("p"), "$.id").alias("id"),
        normalize_structure_path(_string(F.col("p"), "$.pathPrefix")).alias("path_prefix"),
        _string(F.col("p"), "$.purpose").alias("purpose"),
        F.transform(targets, lambda t: normalize_structure_path(t)).alias("forbidden"),
    )


def structure_validate(files: DataFrame, extension: str = EXTENSION) -> DataFrame:
    """All problems as (project_id, pointer, kind); a file without rows is valid."""
    parsed = parse_structure(files)

    def issue(df, condition, pointer, kind):
        return df.filter(condition).select("project_id", pointer.alias("pointer"),
                                           F.lit(kind).alias("kind"))

    def at(prefix, suffix):
        return F.concat(F.lit(prefix), F.col("i").cast("string"), F.lit(suffix))

    doc = F.col("doc")
    keyed = F.json_object_keys("text").isNotNull()
    good = parsed.filter(doc.isNotNull())
    version = F.try_variant_get("doc", "$.schemaVersion", "int")
    fold, rule, legacy = folders(good), dependency_rules(good), legacy_policies(good, extension)
    first = fold.filter(F.col("path").isNotNull()).groupBy("project_id", "path").agg(
        F.min("i").alias("first_i"))
    again = fold.join(first, ["project_id", "path"]).filter(F.col("i") > F.col("first_i"))
    same_id = legacy.filter(F.col("id").isNotNull()).groupBy("project_id", "id").agg(
        F.min("i").alias("first_i"))
    twice = legacy.join(same_id, ["project_id", "id"]).filter(F.col("i") > F.col("first_i"))
    blank = F.exists(F.coalesce("must_not_import", F.array().cast("array<string>")),
                     lambda p: F.trim(p) == "")
    lp = f"/{extension}/legacyPathPolicies/"
    parts = [
        issue(parsed, doc.isNull() & keyed, F.lit(""), "duplicate_key"),
        issue(parsed, doc.isNull() & ~keyed, F.lit(""), "json"),
        issue(good, ~F.coalesce(version == 1, F.lit(False)), F.lit("/schemaVersion"), "version"),
        issue(good, ~_is_array(doc, "$.folders"), F.lit("/folders"), "type"),
        issue(good, ~_is_array(doc, "$.dependencyRules"), F.lit("/dependencyRules"), "type"),
        issue(fold, F.col("raw_path").isNull(), at("/folders/", "/path"), "type"),
        issue(fold, F.col("purpose").isNull(), at("/folders/", "/purpose"), "type"),
        issue(fold, F.col("raw_path").isNotNull() & F.col("path").isNull(),
              at("/folders/", "/path"), "path"),
        issue(again, F.lit(True), at("/folders/", "/path"), "duplicate_path"),
        issue(rule, F.col("source").isNull(), at("/dependencyRules/", "/from"), "path"),
        issue(rule, F.col("must_not_import").isNull() | blank,
              at("/dependencyRules/", "/mustNotImport"), "type"),
        issue(rule, F.col("reason").isNull(), at("/dependencyRules/", "/reason"), "type"),
        issue(legacy, F.coalesce("id", F.lit("")) == "", at(lp, "/id"), "type"),
        issue(legacy, F.col("path_prefix").isNull(), at(lp, "/pathPrefix"), "path"),
        issue(legacy, F.col("forbidden").isNull()
              | F.exists(F.coalesce("forbidden", F.array().cast("array<string>")),
                         lambda t: F.coalesce(t, F.lit("")) == ""),
              at(lp, "/forbiddenDependencies"), "path"),
        issue(twice, F.lit(True), at(lp, "/id"), "duplicate_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _others(value: Column, *keys: str) -> Column:
    """Canonical JSON of an object without some of its keys."""
    entries = F.map_filter(value.cast("map<string,variant>"), lambda k, _: ~k.isin(*keys))
    return canonical_json(F.to_json(entries))


def structure_canonical(files: DataFrame) -> DataFrame:
    """Order-free semantic digest of each valid document, all of it.

    Folders and rules are normalized as JSON texts with sorted sets beside their remaining keys, and
    sorted among themselves; everything else in the document, known or not, enters with sorted keys.
    Documents beyond a megabyte are no structure files and have no digest.
    """
    parsed = parse_structure(files.filter(F.octet_length("text") <= MAX_BYTES)).filter(
        F.col("doc").isNotNull())

    def sorted_set(value: Column, path: str) -> Column:
        return F.to_json(F.array_sort(F.array_distinct(
            F.try_variant_get(value, path, "array<string>"))))

    def lines(rows: DataFrame, item: str, name: str, *parts: Column, keys: list[str]) -> DataFrame:
        rows = rows.withColumn("others", _others(F.col(item), *keys))
        return rows.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(
            F.array(*parts, F.col("others"))))), "\n").alias(name))

    f = F.col("f")
    fold = lines(folders(parsed), "f", "folders", F.col("path"), sorted_set(f, "$.allowed"),
                 sorted_set(f, "$.forbidden"), keys=["path", "allowed", "forbidden"])
    rule = lines(dependency_rules(parsed), "r", "rules", F.col("source"), F.to_json(F.array_sort(
        F.array_distinct("must_not_import"))), keys=["from", "mustNotImport"])
    rest = parsed.select("project_id", _others(
        F.col("doc"), "folders", "dependencyRules").alias("others"))
    return (
        rest.join(fold, "project_id", "left").join(rule, "project_id", "left")
        .select("project_id", digest(F.concat_ws(
            "\n--\n", F.coalesce("folders", F.lit("")), F.coalesce("rules", F.lit("")), "others",
        )).alias("semantic_digest"))
    )


def structure_apply(current: DataFrame, operations: DataFrame, problems: DataFrame) -> DataFrame:
    """Folder upserts against current folders: resulting row or a conflict.

    A project whose document has ``problems`` (project_id) takes no operation.

    ``current``: project_id, path (normalized), body.  ``operations``: project_id, path,
    previous_path, purpose.  A rename keeps the unknown keys of the renamed folder.
    """
    ops = operations.select(
        "*", normalize_structure_path("path").alias("to_path"),
        normalize_structure_path("previous_path").alias("from_path"),
    )
    source = current.select("project_id", F.col("path").alias("from_path"),
                            F.col("body").alias("old_body"), F.lit(True).alias("has_source"))
    taken = current.select("project_id", F.col("path").alias("to_path"),
                           F.lit(True).alias("occupied"))
    bad = problems.select("project_id", F.lit(True).alias("bad")).distinct()
    valid = ops.join(bad, "project_id", "left_anti")
    rows = valid.join(source, ["project_id", "from_path"], "left").join(
        taken, ["project_id", "to_path"], "left")
    renames = F.col("from_path").isNotNull()
    outcome = (
        F.when(F.col("to_path").isNull(), "INVALID_PATH")
        .when(renames & F.col("has_source").isNull(), "SOURCE_MISSING")
        .when(F.col("occupied") & ~F.coalesce(F.col("from_path") == F.col("to_path"),
                                              F.lit(False)), "TARGET_EXISTS")
        .otherwise(F.when(renames, "updated").otherwise("added"))
    )
    none = F.lit(None).cast("string")
    refused = ops.join(bad, "project_id").select(
        *operations.columns, F.lit("DOCUMENT_INVALID").alias("outcome"), none.alias("new_path"),
        none.alias("kept_body"))
    return rows.select(
        *operations.columns, outcome.alias("outcome"),
        F.when(outcome.isin("updated", "added"), F.when(F.col("to_path") == "", ".").otherwise(
            F.col("to_path"))).alias("new_path"),
        F.when(outcome == "updated", F.col("old_body")).alias("kept_body"),
    ).unionByName(refused)


def project_policies(parsed: DataFrame) -> DataFrame:
    """Folders as purpose-only policies with generated ids, plus legacy path policies; ``clash``
    marks an id used more than once in a project."""
    generated = folders(parsed).select(
        "project_id", make_id("structure-folder", "project_id", "path").alias("id"),
        F.col("path").alias("path_prefix"), "purpose",
        F.array().cast("array<string>").alias("forbidden"),
    )
    both = generated.unionByName(
        legacy_policies(parsed).select("project_id", "id", "path_prefix", "purpose", "forbidden")
    )
    uses = both.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("uses"))
    return both.join(uses, ["project_id", "id"]).withColumn("clash", F.col("uses") > 1).drop("uses")


def policy_union(file_policies: DataFrame, stored: DataFrame) -> DataFrame:
    """Policies of the file first; stored legacy ones only for ids the file does not have."""
    left = stored.join(file_policies.select("project_id", "id"), ["project_id", "id"], "left_anti")
    return file_policies.withColumn("origin", F.lit("file")).unionByName(
        left.withColumn("origin", F.lit("stored")))


def legacy_pending_count(file_policies: DataFrame, stored: DataFrame) -> DataFrame:
    left = stored.join(file_policies.select("project_id", "id"), ["project_id", "id"], "left_anti")
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("pending"))


def owner_conflicts(*claims: DataFrame) -> DataFrame:
    """Policy ids claimed by more than one project (records, pending intents, saved states)."""
    rows = claims[0].select("id", "project_id")
    for claim in claims[1:]:
        rows = rows.unionByName(claim.select("id", "project_id"))
    # Distinct claims first (combined map-side); then one small row per id.
    return rows.distinct().groupBy("id").agg(
        F.count(F.lit(1)).alias("projects")).filter(F.col("projects") > 1)


def status_transition(observed: DataFrame, state: DataFrame, problems: DataFrame,
                      digests: DataFrame, clashes: DataFrame) -> DataFrame:
    """Next state of each project after observing its file.

    ``observed``: project_id, file_digest (null = missing).  ``state``: previous status, digests
    and revision.  The last good semantic digest is kept when the file turns bad.
    """
    bad = problems.select("project_id").distinct().withColumn("bad", F.lit(True))
    clash = clashes.select("project_id").distinct().withColumn("clash", F.lit(True))
    before = state.select(
        "project_id", F.col("status").alias("old_status"), F.col("file_digest").alias("old_file"),
        F.col("semantic_digest").alias("old_semantic"), F.col("revision").alias("old_revision"),
        "last_good", F.lit(True).alias("had"))
    rows = (
        observed.join(before, "project_id", "left").join(bad, "project_id", "left")
        .join(clash, "project_id", "left").join(digests, "project_id", "left")
    )
    status = (
        F.when(F.col("file_digest").isNull(), "missing").when(F.col("bad"), "invalid")
        .when(F.col("clash"), "conflict").otherwise("ready")
    )
    rows = rows.withColumn("status", status).withColumn(
        "semantic_digest", F.when(F.col("status") == "ready", F.col("semantic_digest")))
    changed = F.when(F.col("had"), ~F.col("old_file").eqNullSafe(F.col("file_digest"))).otherwise(
        F.col("file_digest").isNotNull())
    context = (
        ~F.col("old_semantic").eqNullSafe(F.col("semantic_digest"))
        | (changed & (F.col("status") == "invalid"))
        | (F.col("old_file").isNotNull() & F.col("file_digest").isNull())
    )
    moved = changed | ~F.col("old_status").eqNullSafe(F.col("status"))
    return rows.select(
        "project_id", "status", "file_digest", "semantic_digest",
        (F.coalesce("old_revision", F.lit(0)) + changed.cast("bigint")).alias("revision"),
        F.coalesce("semantic_digest", "last_good").alias("last_good"),
        moved.alias("audited"), (moved & context).alias("invalidates_plans"),
        F.when(F.col("status") == "invalid", "failed").when(
            F.col("status") == "conflict", "conflicted").otherwise("committed").alias("outcome"),
    )


def idempotent_mutations(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """Outcome of each mutation request: new, done, conflict, or an earlier failure.

    Requests repeat ids; the first of a batch (by ``seq``) decides which hash owns the id.
    """
    keys = ["project_id", "mutation_id"]
    owner = requests.groupBy(*keys).agg(
        F.min_by("request_hash", "seq").alias("owner_hash"), F.min("seq").alias("owner_seq"))
    known = receipts.select(*keys, F.col("request_hash").alias("receipt_hash"),
                            F.col("outcome").alias("receipt_outcome"))
    rows = requests.join(owner, keys).join(known, keys, "left")
    outcome = (
        F.when(F.col("receipt_hash").isNotNull() & (F.col("receipt_hash") != F.col("request_hash")),
               "conflict")
        .when(F.col("receipt_outcome").isin("committed", "no_op"), "done")
        .when(F.col("receipt_outcome").isNotNull(), "ended")
        .when(F.col("request_hash") != F.col("owner_hash"), "conflict")
        .when(F.col("seq") > F.col("owner_seq"), "done").otherwise("new")
    )
    return rows.select(*keys, "seq", outcome.alias("outcome"))


def structure_cas(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Whether each write request saw the current revision and file digest."""
    now = state.select("project_id", "revision", "file_digest")
    return requests.join(now, "project_id", "left").select(
        *requests.columns, F.when(
            (F.col("expected_revision") == F.col("revision"))
            & F.col("expected_digest").eqNullSafe(F.col("file_digest")), "accepted"
        ).otherwise("conflict").alias("outcome"))


def intent_outcome(intents: DataFrame, observations: DataFrame) -> DataFrame:
    """Recovery of pending writes from what is on disk now; unreadable files wait."""
    seen = observations.select("project_id", "observed_digest", "readable")
    rows = intents.join(seen, "project_id", "left")
    result = (
        F.when(F.col("phase") == "conflicted", "conflicted")
        .when(~F.coalesce("readable", F.lit(False)), "retry")
        .when(F.col("observed_digest").eqNullSafe(F.col("after_digest")), "committed")
        .when(F.col("observed_digest").eqNullSafe(F.col("before_digest")), "aborted")
        .otherwise("conflicted")
    )
    return rows.select(*intents.columns, result.alias("outcome"))


def legacy_migration(stored: DataFrame, migrated: DataFrame) -> DataFrame:
    """Stored policies against the file's version: equal rows are deleted, changed ones conflict.

    Both sides carry (project_id, id, canonical).
    """
    file = migrated.select("id", F.col("project_id").alias("file_project"),
                           F.col("canonical").alias("file_canonical"), F.lit(True).alias("moved"))
    return stored.join(file, "id", "left").select(
        "project_id", "id", F.when(F.col("moved").isNull(), "kept").when(
            (F.col("project_id") == F.col("file_project"))
            & (F.col("canonical") == F.col("file_canonical")), "deleted"
        ).otherwise("conflict").alias("action"))


def audit_page(audits: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return page(audits, ["project_id"], [F.col("validated_at").desc(), F.col("id").desc()], offset,
                limit, 100)


def structure_file_read(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Digest and checks of file bytes; a missing file is a state, not an error.

    ``files``: project_id, content (binary, null when missing).
    """
    size = F.octet_length("content")
    problem = F.when(size > max_bytes, "size").when(
        ~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    return files.select(
        "project_id", F.sha2("content", 256).alias("file_digest"), size.alias("bytes"),
        F.when(F.col("content").isNull(), "missing").when(problem.isNotNull(), "invalid")
        .otherwise("read").alias("state"), problem.alias("problem"))


