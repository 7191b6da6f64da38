"""Path rules as Catalyst expressions: no Python code runs per row.

Invalid input yields null, so a caller keeps the row and can report it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CONTROL = r"[\x00-\x1f\x7f]"
DRIVE = r"^[A-Za-z]:"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slashes(value) -> Column:
    return F.replace(_col(value), F.lit("\\"), F.lit("/"))


def _fold_segments(path: Column) -> Column:
    """Drop empty and dot segments and resolve parents; null when the path leaves the root."""
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.array_append(done, p)).when(
            F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ),
    )
    # A null stack stays null: appending to null is null and size(null) is not positive.
    return F.when(F.size(stack) > 0, F.array_join(stack, "/"))


def normalize_repo_path(value) -> Column:
    """Repository-relative file path, or null when it is not one."""
    path = slashes(value)
    rejected = (
        (F.trim(path) == "") | path.rlike(DRIVE) | path.startswith("/") | path.endswith("/")
        | path.rlike(r"(^|/)(\.|\.\.)$") | path.rlike(CONTROL)
    )
    folded = _fold_segments(path)
    return F.when(~rejected & ~folded.rlike(DRIVE), folded)


def path_problem(value) -> Column:
    """Why a path is rejected (null when it is accepted)."""
    path = slashes(value)
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "blank")
        .when(path.rlike(DRIVE), "drive")
        .when(path.startswith("/"), "absolute")
        .when(path.endswith("/") | path.rlike(r"(^|/)(\.|\.\.)$"), "directory")
        .when(path.rlike(CONTROL), "control")
        .when(normalize_repo_path(value).isNull(), "escapes")
    )


def normalize_structure_path(value, pattern: bool = False) -> Column:
    """Folder path of a structure file: trailing slashes allowed, parents rejected, root is ''."""
    path = F.regexp_replace(slashes(value), r"/+$", "")
    rejected = (
        slashes(value).startswith("/") | path.rlike(DRIVE) | path.rlike(CONTROL)
        | F.array_contains(F.split(path, "/"), "..")
    )
    if pattern:
        return F.when(~rejected & (F.trim(path) != ""), path)
    kept = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~rejected, F.array_join(kept, "/"))


def path_within(value, prefix) -> Column:
    value, prefix = _col(value), _col(prefix)
    return (prefix == "") | (value == prefix) | value.startswith(F.concat(prefix, F.lit("/")))


def path_touches(left, right) -> Column:
    left, right = _col(left), _col(right)
    return (
        (left == right) | left.startswith(F.concat(right, F.lit("/")))
        | right.startswith(F.concat(left, F.lit("/"))) | (right == ".")
    )


def dirname(value) -> Column:
    path = _col(value)
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def basename(value) -> Column:
    return F.element_at(F.split(_col(value), "/"), -1)


def ancestors(value, include_self: bool = True) -> Column:
    """Every prefix of a path at a segment boundary, shortest first (the root is not listed)."""
    parts = F.split(_col(value), "/")
    last = F.size(parts) if include_self else F.size(parts) - 1
    # Prefixes come from positions in the original text; an upper bound below one lists nothing.
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    return F.when(last >= 1, prefixes).otherwise(F.array().cast("array<string>"))


def breadcrumbs(path, kind, label) -> Column:
    """Project root, every prefix, then the function itself, as (label, kind, path) structs."""
    path, kind, label = _col(path), _col(kind), _col(label)
    at = F.coalesce(path, F.lit("."))

    def crumb(text, what, where):
        return F.struct(text.alias("label"), what.alias("kind"), where.alias("path"))

    root = F.array(crumb(F.lit("."), F.lit("folder"), F.lit(".")))
    inner = F.transform(
        ancestors(at),
        lambda p: crumb(
            F.element_at(F.split(p, "/"), -1),
            F.when((p == at) & (kind != "folder"), "file").otherwise("folder"), p,
        ),
    )
    listed = F.when((at != ".") & (kind != "external"), F.concat(root, inner)).otherwise(root)
    tail = F.array(crumb(label, F.lit("function"), at))
    return F.when(kind == "function", F.concat(listed, tail)).otherwise(listed)


def dir_distance(left, right) -> Column:
    """Hops between two directories through their common ancestor."""
    def parts(value):
        value = _col(value)
        return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, "/"))

    x, y = parts(left), parts(right)
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.aggregate(
        same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, eq: F.struct(
            F.when(s["on"] & eq, s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["on"] & eq).alias("on"),
        ),
        lambda s: s["n"],
    )
    return F.size(x) + F.size(y) - common * 2


def language_of(path) -> Column:
    path = _col(path)
    return (
        F.when(path.endswith(".py"), "python")
        .when(path.rlike(r"\.[cm]?tsx?$"), "typescript").otherwise("javascript")
    )


def language_family(path) -> Column:
    path = _col(path)
    return (
        F.when(path.rlike(r"(?i)\.py$"), "python")
        .when(path.rlike(r"(?i)\.[cm]?[jt]sx?$"), "javascript").otherwise("unknown")
    )


def supported_suffix(path) -> Column:
    return _col(path).rlike(r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|py)$")


def function_target(path) -> Column:
    """A planned target: a full supported source file path, or null."""
    path = _col(path)
    normal = normalize_repo_path(path)
    return F.when(~path.rlike(r"[\\/]$") & supported_suffix(normal), normal)


def complete_target_path(folder, filename) -> Column:
    """Canonical folder plus one bare source file name, or null."""
    folder, filename = _col(folder), _col(filename)
    bare = (F.trim(filename) == filename) & ~filename.rlike(r"[\\/:\x00-\x1f\x7f]")
    joined = F.when(folder == ".", filename).otherwise(F.concat_ws("/", folder, filename))
    canonical = (folder == ".") | normalize_repo_path(folder).eqNullSafe(folder)
    return F.when(
        bare & canonical & supported_suffix(filename)
        & normalize_repo_path(joined).eqNullSafe(joined), joined,
    )


def join_path(base, relative) -> Column:
    """``relative`` seen from directory ``base``; null when it leaves the repository."""
    base, relative = _col(base), _col(relative)
    return _fold_segments(
        F.when(base.isin(".", ""), relative).otherwise(F.concat_ws("/", base, relative))
    )


def reference_target(config_path, reference) -> Column:
    """(path, problem) of a project reference: a directory's tsconfig.json or a .json file."""
    raw = _col(reference)
    text = slashes(raw)
    syntax = (
        raw.isNull() | (raw == "") | text.startswith("/") | raw.contains("\x00")
        | text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    )
    is_json = text.endswith(".json")
    extension = text.rlike(r"(^|/)(?!\.\./*$)[^/]+\.[^/]*/*$")
    named = F.when(is_json, text).otherwise(
        F.concat(F.regexp_replace(text, r"/+$", ""), F.lit("/tsconfig.json"))
    )
    path = join_path(dirname(config_path), named)
    problem = (
        F.when(syntax, "syntax").when(extension & ~is_json, "extension")
        .when(path.isNull(), "escapes")
    )
    return F.struct(F.when(problem.isNull(), path).alias("path"), problem.alias("problem"))


PACKAGE_NAME = r"^(@[a-zA-Z0-9._-]+/)?[a-zA-Z0-9._-]+$"


def package_request(specifier) -> Column:
    """(name, subpath, valid) of a bare specifier; null when it names no package."""
    spec = _col(specifier)
    parts = F.split(spec, "/")
    width = F.when(spec.startswith("@"), 2).otherwise(1)
    name = F.array_join(F.slice(parts, F.lit(1), width), "/")
    tail = F.slice(parts, width + 1, F.greatest(F.size(parts) - width, F.lit(0)))
    named = (
        ~spec.startswith(".") & ~spec.startswith("/") & ~spec.contains("\\")
        & name.rlike(PACKAGE_NAME) & ~name.isin(".", "..")
    )
    bad_part = F.exists(
        tail, lambda p: p.isin("", ".", "..") | (F.lower(p) == "node_modules")
        | p.rlike(r"[\\%?#:*]")
    )
    subpath = F.when(F.size(tail) == 0, ".").otherwise(
        F.concat(F.lit("./"), F.array_join(tail, "/"))
    )
    return F.when(named, F.struct(name.alias("name"), F.when(~bad_part, subpath).alias("subpath"),
                                  (~bad_part).alias("valid")))


def symbol_location(path, name, line) -> Column:
    return F.concat_ws(":", F.coalesce(_col(path), _col(name)),
                       F.coalesce(_col(line), F.lit(1)).cast("string"))


def evidence_text(path, line, text) -> Column:
    text = _col(text)
    return F.concat(
        F.concat_ws(":", _col(path), _col(line).cast("string")),
        F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(" "), text)).otherwise(""),
    )
