"""Quality scores by Bradley-Terry pairwise ranking.

A document has the score ``w . x`` over a few text features; of a good and a bad document the good
one wins with probability ``logistic(w . (x_good - x_bad))``.  ``w`` minimises the logistic loss
over preference pairs of all labelled rows that may be learned from: rows are dealt to cells, tasks
add up the loss, its gradient and its curvature over the pairs of their cells, and the driver takes
a Newton step a round.  The cut is a score quantile over the same rows: the share of bad documents
among them; scores are mapped to 0..1 so that the cut is 0.5.

Defined results: a null text counts as empty and is scored like any other; without labels of both
classes every score is 0.5; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (bounded, class_counts, held_out, labelled, logistic, map_batches,
                     repeated_words, stage, texts)

MODULUS, REMAINDER = 3, 1
CUT = 0.5
#: Good documents each bad one of a cell is compared with.
RIVALS = 12
#: Rows of a cell, about; most cells; rows of the rarer class a cell should have (it is repeated for that).
CELL, CELLS, BOTH = 4000, 1024, 64
#: Weights and raw scores are rounded, so that they do not depend on the order of sums.
DIGITS = 9
#: Rows that are ranked on the driver at most, and ranges that more are counted in.
FEW, BINS = 20_000, 1024
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>@^~=+_\\{}[]"


def features(text: str | None) -> list[float]:
    """Shares and logarithms that say how much a text looks like prose; never its label columns."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    per = max(n, 1)
    cut = data.translate
    return [
        np.log1p(n),
        (size - len(cut(None, _UPPER))) / size,
        (size - len(cut(None, _DIGITS))) / size,
        min((size - len(cut(None, _SYMBOLS))) / per, 3.0),
        min(data.count(b"|") / per, 1.0),
        min(data.count(b"!") / per, 2.0),
        min((data.count(b".") + data.count(b",") + data.count(b"?")) / per, 2.0),
        min(np.log(size / per), 5.0),
        len(set(words)) / per,
        np.log1p(n) * len(set(words)) / per,
        repeated_words(words) / per,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(size / max(len(lines), 1)),
        float(n < 20),
        float(n == 0),
    ]


WIDTH = len(features(""))


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([z, z * z])


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, the cut and the spread of raw scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.round(expanded(x, self.mean, self.scale) @ self.weights, DIGITS)

    def score_of(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.weights.any():
            return np.full(len(x), CUT)
        return logistic((self.raw(x) - self.cut) / self.spread)

    def score(self, rows: list[str | None]) -> np.ndarray:
        return self.score_of(np.array([features(t) for t in rows], float))


def quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Smallest midpoint between neighbours that leaves ``share`` of the weight below it."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], np.cumsum(weights[order]) / weights.sum()
    i = int(np.searchsorted(w, share - 1e-12))
    return float((v[i] + v[min(i + 1, len(v) - 1)]) / 2)


def differences(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Features of the winner less those of the loser, a row a pair.

    Every bad row meets RIVALS good rows, dealt round the good ones, and each good row one bad.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return z[:0]
    pairs = [(good[(np.arange(len(bad)) * RIVALS + r) % len(good)], bad) for r in range(RIVALS)]
    pairs.append((good, bad[np.arange(len(good)) % len(bad)]))
    return z[np.concatenate([p[0] for p in pairs])] - z[np.concatenate([p[1] for p in pairs])]


def sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, loss, gradient and curvature of the pairs ``d`` at ``w``, in one row of numbers."""
    p = logistic(d @ w)
    return np.concatenate([[len(d), np.logaddexp(0, -(d @ w)).sum()], -(1 - p) @ d,
                           ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(total: Callable[[np.ndarray], np.ndarray], width: int, rounds: int = 40,
           ridge: float = 1e-3) -> np.ndarray:
    """Least mean loss with a ridge by Newton steps, halved while they do not lower it."""
    best, step, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(rounds):
        w = best + step
        found = total(w)
        n = max(found[0], 1)
        loss = found[1] / n + ridge / 2 * (w @ w)
        if loss > least:
            step = step / 2
        else:
            best, least = w, loss
            grad = found[2:2 + width] / n + ridge * w
            curve = found[2 + width:].reshape(width, width) / n + ridge * np.eye(width)
            step = -np.linalg.solve(curve, grad)
        if np.abs(step).max(initial=0.0) < 1e-8:
            break
    return np.round(best, 6)


def fit(x: np.ndarray, label: np.ndarray, counts: tuple[int, int]) -> Model:
    """The model of the rows of one cell; ``counts`` are the class sizes they stand for."""
    width = x.shape[1] if x.ndim == 2 else 0
    mean = x.mean(0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(width)
    good, bad = (label == 1).sum(), (label == 0).sum()
    if not good or not bad:
        return Model(mean, scale, np.zeros(2 * width), 0.0, 1.0)
    d = differences(expanded(x, mean, scale), label)
    w = newton(lambda at: sums(d, at), 2 * width)
    raw = Model(mean, scale, w, 0.0, 1.0).raw(x)
    share = np.where(label == 0, counts[0] / bad, counts[1] / good)
    cut = quantile(raw, share, counts[0] / max(sum(counts), 1))
    spread = max(float(np.median(np.abs(raw - cut))) / 3, 1e-6)
    return Model(mean, scale, w, cut, spread)


def measured(docs: DataFrame) -> DataFrame:
    """Staged doc_id, held_out, text_hash and features x of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {**{c: batch.column(c) for c in ("doc_id", "held_out", "text_hash")},
                "x": [features(t) for t in texts(batch)]}

    rows = docs.select(F.col("doc_id").cast("long"), held_out(MODULUS, REMAINDER).alias("held_out"),
                       F.xxhash64("text").alias("text_hash"), "text")
    return stage(map_batches(rows, run, "doc_id long, held_out boolean, text_hash long, x array<double>"),
                 "quality-features")


def matrix(rows) -> np.ndarray:
    """An Arrow column of feature lists as a matrix."""
    return np.array(rows.to_pylist(), float).reshape(len(rows), WIDTH)


def order_statistics(values: DataFrame, ranks: list[int]) -> list[float]:
    """The numbers at 0-based ``ranks`` among ``v`` of a staged table, in ascending order.

    The range a rank lies in is cut by counts until few rows or one number is left in it.
    """
    bounds = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    out = []
    for rank in ranks:
        n, lo, hi = bounds
        left, rank = values, min(max(rank, 0), n - 1)
        while n > FEW and lo < hi:
            place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
            for r in left.groupBy(place.alias("bin")).agg(
                    F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
                    ).orderBy("bin").collect():
                if rank < r["n"]:
                    break
                rank -= r["n"]
            n, lo, hi = r["n"], r["lo"], r["hi"]
            left = values.where(F.col("v").between(lo, hi))
        out.append(float(lo) if lo == hi else float(sorted(r["v"] for r in left.collect())[rank]))
    return out


def dealt(rows: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """``rows`` (doc_id, label, x) with a cell each; rows of a class too rare for all cells have
    several."""
    cells = min(-(-sum(counts) // CELL), CELLS)
    copies = F.when(F.col("label") == 0, -(-BOTH * cells // counts[0])).otherwise(
        -(-BOTH * cells // counts[1]))
    nth = F.explode(F.sequence(F.lit(0), F.least(copies, F.lit(4 * cells)) - 1 if cells > 1 else F.lit(0)))
    spread = rows.withColumn("nth", nth).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(cells)).cast("int"))
    return spread.groupBy("doc_id", "label", "cell").agg(F.first("x").alias("x"))


def train(features_of: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows of ``measured``; held-out rows are never read."""
    known = labelled(labels, "quality", MODULUS, REMAINDER)
    # Of rows with one id the text of least hash counts.
    rows = stage(features_of.join(known, "doc_id").groupBy("doc_id", "label").agg(
        F.min_by("x", "text_hash").alias("x")), "quality-learned")
    counts = class_counts(rows)
    zero = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 1.0)
    if not all(counts):
        return zero
    each = [F.col("x")[i] for i in range(WIDTH)]
    found = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean = np.round(np.array(found[:WIDTH], float), DIGITS)
    scale = np.maximum(np.round(np.array(found[WIDTH:], float), DIGITS), 1e-6)

    cells = stage(dealt(rows, counts), "quality-cells")

    def total(w: np.ndarray) -> np.ndarray:
        def add(table: pa.Table) -> pa.Table:
            x, label = matrix(table.column("x")), table.column("label").to_numpy()
            order = np.lexsort((*x.T[::-1], label))  # the same pairs whatever order rows come in
            z = expanded(x[order], mean, scale)
            own = sums(differences(z, label[order]), w)
            return pa.table({"cell": table.column("cell")[:1], "sums": pa.array([own.tolist()])})

        parts = cells.groupBy("cell").applyInArrow(add, "cell int, sums array<double>").collect()
        return np.sum([r["sums"] for r in sorted(parts, key=lambda r: r["cell"])], axis=0)

    bounded(rows.sparkSession)
    model = Model(mean, scale, newton(total, 2 * WIDTH), 0.0, 1.0)
    raw = stage(map_batches(rows.select("x"), lambda b: {"v": model.raw(matrix(b.column("x")))},
                            "v double"), "quality-raw")
    n = sum(counts)
    cut = sum(order_statistics(raw, [counts[0] - 1, counts[0]])) / 2
    away = raw.select(F.abs(F.col("v") - cut).alias("v"))
    spread = max(sum(order_statistics(away, [(n - 1) // 2, n // 2])) / 6, 1e-6)
    return Model(mean, scale, model.weights, cut, spread)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = measured(docs)
    model = train(rows, labels)

    def run(batch: pa.RecordBatch) -> dict:
        score = model.score_of(matrix(batch.column("x")))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": score, "predicted": (score >= CUT).astype("int32")}

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted good, with all their columns."""
    model = train(measured(docs), labels)
    return map_batches(docs, lambda b: b.filter(pa.array(model.score(texts(b)) >= CUT)), docs.schema)
