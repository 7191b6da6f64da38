"""Helpers of the text operators: bounded Arrow batches, words, labelled samples, written steps.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  On UTF-8 bytes that is ``bytes.split()``, and
``bytes.lower()`` lowers exactly A-Z, so most operators work on encoded text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph.staging import stage_as_is as stage  # noqa: F401  (used by the operators)

BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: Rows of one class a classifier is fitted on at most (smallest hashes first).
FIT_ROWS = 4000
SPACES = " \t\n\x0b\x0c\r"


def bounded(spark: SparkSession) -> None:
    """Arrow batches for Python are cut by rows and by bytes, so long texts do not pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict],
                schema: str | T.StructType) -> DataFrame:
    """``fn`` over Arrow batches; it returns a batch or a dict of the columns of ``schema``."""
    bounded(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            yield out

    return df.mapInArrow(run, kind)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True for rows no model may learn from; false for a null id, which has no label."""
    return F.coalesce(F.pmod(id_crc(column), F.lit(modulus)) == remainder, F.lit(False))


def labelled(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """One row per labelled id that may be learned from; of contradicting labels the larger."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
            .where(~held_out(modulus, remainder))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))


def fit_sample(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class with their text (label, text).

    Ids are taken by smallest hash, so the sample is the same on every run; it is the only
    bounded step, and its bound is the parameter.
    """
    halves = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(per_class) for k in (0, 1)]
    # The right side has 2 * per_class rows of two numbers at most: safe to broadcast at any size.
    chosen = halves[0].union(halves[1])
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .select("label", F.coalesce("text", F.lit("")).alias("text")))


def class_counts(known: DataFrame) -> tuple[int, int]:
    found = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside ``width``-word windows that occur twice or more in the text.

    Windows meet by a 64-bit rolling hash; the few that meet are compared word by word.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    base, window = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for i in range(width):
        window = window * base + h[i:i + n]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    first: dict[tuple[bytes, ...], int] = {}
    repeats = np.zeros(n, bool)
    for i in np.flatnonzero(twin).tolist():
        j = first.setdefault(tuple(words[i:i + width]), i)
        if j != i:
            repeats[i] = repeats[j] = True
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeats)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + width, -1)
    return int((np.cumsum(ends) > 0).sum())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def calibrate(raw: np.ndarray, label: np.ndarray, weight: np.ndarray,
              rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a weighted, slightly regularised logistic fit on one score."""
    a, b = 1.0, 0.0
    w = weight / weight.sum()
    for _ in range(rounds):
        p = logistic(a * raw + b)
        g, s = w * (p - label), np.maximum(w * p * (1 - p), 1e-12)
        h = np.array([[(s * raw * raw).sum() + 1e-4, (s * raw).sum()],
                      [(s * raw).sum(), s.sum() + 1e-4]])
        step = np.linalg.solve(h, [(g * raw).sum() + 1e-4 * a, g.sum() + 1e-4 * b])
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-6), b
