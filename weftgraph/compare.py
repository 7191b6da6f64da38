"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck_connection(duckdb, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _null(value) -> bool:
    return value is None or value is pd.NA or (isinstance(value, float) and value != value)


def _kind(series) -> str:
    values = [v for v in series if not _null(v)]
    return type(values[0]).__name__.replace("_", "") if values else "null"


def _text(value) -> str:
    if _null(value):
        return "∅"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def compare_frames(got, want) -> str:
    """Empty string when equal, else a short description of the first difference."""
    a, b = sorted(got.columns), sorted(want.columns)
    if a != b:
        return f"columns {a} != {b}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (_kind(got[c].astype(object)), _kind(want[c].astype(object))) for c in a}
    off = {c: k for c, k in kinds.items() if len(set(k) - {"null"}) > 1
           and set(k) not in ({"int", "float"},)}
    rows = [sorted(zip(*[[_text(v) for v in f[c].astype(object)] for c in a])) for f in (got, want)]
    for x, y in zip(*rows):
        if x != y:
            return f"row {dict(zip(a, x))} != {dict(zip(a, y))}"
    return f"types {off}" if off else ""
