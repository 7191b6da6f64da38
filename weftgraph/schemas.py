"""Explicit schemas and limits of the code-graph model (readers never infer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SCOPE = ["project_id", "snapshot_id"]

NODE_KINDS = ["function", "file", "folder", "external"]
RELATION_TYPES = ["calls", "imports", "contains"]
RESOLUTIONS = ["resolved", "unresolved", "external"]

# Fixed default budgets; every operator takes them as arguments.
PAGE_LIMIT, PAGE_MAX = 50, 200
NODE_BUDGET, NODE_BUDGET_MAX = 80, 300
DEPTH_MAX = 5
EDGES_PER_NODE = 3
SCOPE_EDGE_CAP = 900
ENTRYPOINT_CAP = 50


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


NODES = _schema(
    "project_id string, snapshot_id string, id string, kind string, declaration_kind string,"
    " name string, qualified_name string, file_path string, parent_id string, language string,"
    " signature string, start_line int, end_line int, exported boolean"
)
RELATIONS = _schema(
    "project_id string, snapshot_id string, ordinal string, id string, type string,"
    " source_id string, target_id string, resolution string, evidence_path string,"
    " evidence_line int, evidence_text string, reason string"
)
SNAPSHOTS = _schema(
    "project_id string, snapshot_id string, created_at timestamp, git_revision string,"
    " content_hash string, capture_complete boolean, availability_recorded boolean"
)
COVERAGE = _schema("project_id string, snapshot_id string, role string, path string")
DIAGNOSTICS = _schema(
    "project_id string, snapshot_id string, file_path string, line int, message string"
)
PLANS = _schema(
    "project_id string, id string, revision long, title string, description string,"
    " baseline_snapshot_id string, baseline_content_hash string, status string,"
    " created_at timestamp, updated_at timestamp"
)
PLAN_OPERATIONS = _schema(
    "project_id string, plan_id string, op_index long, kind string, temp_id string, name string,"
    " file_path string, signature string, description string, language string, node_id string,"
    " relation_id string, source_id string, target_id string, text string"
)
POLICIES = _schema(
    "project_id string, id string, path_prefix string, purpose string, forbidden array<string>"
)
ANNOTATIONS = _schema(
    "project_id string, id string, revision long, text string, author string, source string,"
    " is_constraint boolean, binding_state string, target_kind string, target_id string,"
    " selected_snapshot_id string, last_label string, last_path string, last_node_kind string,"
    " orphaned_at string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
APPROVALS = _schema(
    "id string, plan_id string, revision long, semantic_hash string,"
    " baseline_snapshot_id string, baseline_content_hash string, approved_at timestamp,"
    " insertion long, knowledge_hash string"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read-side schema evolution: missing optional columns become nulls, types are cast."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
