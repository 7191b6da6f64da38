"""Toxic passages by maximum-scoring segments.

Words get log-odds of toxic against clean labelled texts under Dirichlet priors (a common prior in
proportion to the pooled frequency, plus a flat one), lowered by two standard errors and a drift,
so that chance hits score below zero on average.  One linear scan per text finds all maximal
scoring segments (Ruzzo and Tompa).  A segment of score S in a text of n words is expected
``K n exp(-lambda S)`` times by chance; lambda solves the Karlin-Altschul equation on clean texts
and K comes from their best segments.  A text's evidence sums ``lambda S - ln(K n)`` over its
significant segments and is calibrated to 0..1 against the class sizes.

Defined results: a null text counts as empty; a text without any scored word has evidence zero and
gets the lowest score; without labels of both classes, or without any word that tells them apart,
nothing is known: scores are equal, below the cut, and no row is rejected;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (FIT_ROWS, calibrate, class_counts, fit_sample, held_out, labelled, logistic,
                     map_batches, stage, texts)

MODULUS, REMAINDER = 4, 2
CUT = 0.3
#: Flat and pooled Dirichlet prior mass (in texts), standard errors taken off, drift per word.
FLAT, POOLED, ERRORS, DRIFT = 0.5, 10.0, 2.4, 0.5
#: A word without a score of its own may take that of its first bytes.
STEM = 5
#: Words met in fewer toxic texts of the sample say too little.
LEAST_TEXTS = 3
_EDGE = b".,!?;:\"'()[]{}<>*#$%&|-_"
#: Expected chance segments a significant one may have.
SIGNIFICANT = 0.05


def tokens(text: str | None) -> list[bytes]:
    return [w.strip(_EDGE) for w in
            (text or "").encode("utf-8", "surrogatepass").lower().split()]


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Score of a word said in ``toxic`` and ``clean`` texts: lower confidence bound of the
    log-odds, less the drift.

    Counts are of texts, so a word said often in one text counts once.
    """
    prior = FLAT + POOLED * (toxic + clean) / (n_toxic + n_clean)
    odds = (F.log((toxic + prior) / (n_toxic + FLAT + POOLED))
            - F.log((clean + prior) / (n_clean + FLAT + POOLED)))
    return odds - ERRORS * F.sqrt(1 / (toxic + prior) + 1 / (clean + prior)) - DRIFT


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) when word ``at[i]`` scores
    ``score[i]`` and every other word ``-drift``; linear in the number of scored words."""
    found: list[list[float]] = []  # start, end, cumulative score before and after
    gain = 0.0
    for i, (p, s) in enumerate(zip(at.tolist(), score.tolist())):
        before = gain - drift * (p - i)
        gain += s
        item = [p, p + 1, before, before + s]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j -= 1
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in found]


def scored(toks: list[bytes], words: dict[bytes, float],
           stems: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the scored words, every occurrence of each."""
    at, score = [], []
    for i, w in enumerate(toks):
        s = words.get(w)
        if s is None:
            s = stems.get(w[:STEM])
        if s is not None:
            at.append(i)
            score.append(s)
    return np.array(at, np.int64), np.array(score, float)


@dataclass(frozen=True)
class Model:
    """Word and stem scores, the extreme-value parameters and the calibration of the evidence."""

    words: dict[bytes, float]
    stems: dict[bytes, float]
    rate: float
    log_k: float
    slope: float
    offset: float

    def significance(self, n: int, at, score) -> list[tuple[int, int, float, float]]:
        """(start, end, score, evidence) of the maximal segments of a text of ``n`` words."""
        if not len(at):
            return []
        base = self.log_k + np.log(max(n, 1))
        return [(a, b, s, self.rate * s - base)
                for a, b, s in segments(np.asarray(at), np.asarray(score), DRIFT)]

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        toks = tokens(text)
        return self.significance(len(toks), *scored(toks, self.words, self.stems))

    def weigh(self, n: int, at, score) -> float:
        """Sum of ``-ln(expected by chance)`` over significant segments, else the best one's."""
        values = [e for *_, e in self.significance(n, at, score)]
        strong = [e for e in values if e > -np.log(SIGNIFICANT)]
        return float(sum(strong) if strong else max([0.0, *values]))

    def evidence(self, text: str | None) -> float:
        toks = tokens(text)
        return self.weigh(len(toks), *scored(toks, self.words, self.stems))

    def score(self, rows: list[str | None]) -> np.ndarray:
        x = np.array([self.evidence(t) for t in rows], float)
        return logistic(self.slope * np.log1p(x) + self.offset)


#: The model when nothing can be learned; its score is half the cut for every text.
UNKNOWN = Model({}, {}, 1.0, 0.0, 1.0, float(np.log(CUT / 2 / (1 - CUT / 2))))


def lexicon(sample: DataFrame, sizes: tuple[int, int]) -> tuple[dict, dict]:
    """Scored words and stems of a sample (label, text) of ``sizes`` clean and toxic texts.

    Counting is a grouped sum; only words that score reach the driver, and a sample of bounded size
    has a bounded number of those.
    """

    def said(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"word": [], "stem": [], "label": []}
        for label, text in zip(batch.column("label").to_pylist(), texts(batch)):
            own = set(tokens(text)) - {b""}
            for stem, some in ((False, own), (True, {w[:STEM] for w in own if len(w) > STEM})):
                out["word"] += some
                out["stem"] += [stem] * len(some)
                out["label"] += [label] * len(some)
        return out

    rows = map_batches(sample, said, "word binary, stem boolean, label int")
    counts = rows.groupBy("word", "stem").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    score = log_odds(F.col("t"), F.col("n") - F.col("t"), sizes[1], sizes[0])
    found = counts.where(F.col("t") >= LEAST_TEXTS).withColumn("score", score).where(
        "score > 0").collect()
    words, stems = ({bytes(r["word"]): r["score"] for r in found if r["stem"] == kind}
                    for kind in (False, True))
    return words, stems


def fit(rows: list[tuple[int, int, list[int], list[float]]], words: dict, stems: dict,
        counts: tuple[int, int]) -> Model:
    """Extreme-value parameters and calibration from the scored words of the sample's texts:
    (label, number of words, places, scores)."""
    clean = [r for r in rows if r[0] == 0]
    # Distribution of word scores in clean texts, with a flat mass for words not met there.
    drawn = Counter(v for *_, score in clean for v in score)
    drawn[-DRIFT] += sum(n for _, n, *_ in clean) - sum(drawn.values())
    for v in (*words.values(), *stems.values()):
        drawn[v] += FLAT / (len(words) + len(stems))
    value = np.array(list(drawn), float)
    share = np.array([drawn[v] for v in drawn], float)
    share /= max(share.sum(), 1e-9)
    low, high = 1e-6, 50.0
    for _ in range(100):  # sum share exp(rate value) = 1 for one positive rate
        rate = (low + high) / 2
        low, high = (low, rate) if (share * np.exp(np.minimum(rate * value, 500))).sum() > 1 \
            else (rate, high)
    rate = max(low, 1e-3)
    best = [np.log(max(n, 1)) - rate * max(
        (x for *_, x in segments(np.array(at), np.array(score), DRIFT)), default=0.0)
        for _, n, at, score in clean]
    # Gumbel: the mean of K n exp(-rate S) over the best clean segments is 1.
    log_k = -float(np.logaddexp.reduce(best) - np.log(len(best)))
    log_k = float(np.clip(log_k, -12.0, 2.0))
    trial = Model(words, stems, rate, log_k, 1.0, 0.0)
    label = np.array([r[0] for r in rows], float)
    x = np.log1p([trial.weigh(*r[1:]) for r in rows])
    n1 = label.sum()
    weight = np.where(label == 1, counts[1] / n1, counts[0] / (len(label) - n1))
    slope, offset = calibrate(x, label, weight)
    return Model(words, stems, rate, log_k, slope, offset)


def train(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> Model:
    """A model from at most ``per_class`` rows of each class; held-out rows are never read.

    The sample is written once and read by tasks; copies of a text say nothing new and count once.
    """
    known = labelled(labels, "toxic", MODULUS, REMAINDER)
    sample = stage(fit_sample(docs, known, per_class).distinct(), "toxic-sample")
    sizes = class_counts(sample)
    if not all(sizes):
        return UNKNOWN
    words, stems = lexicon(sample, sizes)
    if not words and not stems:
        return UNKNOWN

    def hits(batch: pa.RecordBatch) -> dict:
        toks = [tokens(t) for t in texts(batch)]
        found = [scored(t, words, stems) for t in toks]
        return {"label": batch.column("label"), "n": [len(t) for t in toks],
                "at": [a.tolist() for a, _ in found], "score": [v.tolist() for _, v in found]}

    rows = map_batches(sample, hits, "label int, n long, at array<long>, score array<double>")
    found = sorted((r["label"], r["n"], r["at"], r["score"]) for r in rows.collect())
    return fit(found, words, stems, class_counts(known))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages (significant segments) per row."""
    model = train(docs, labels, per_class)

    def run(batch: pa.RecordBatch) -> dict:
        rows = texts(batch)
        score = model.score(rows)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": score, "predicted": (score >= CUT).astype("int32"),
                "n_passages": [sum(e > -np.log(SIGNIFICANT) for *_, e in model.passages(t))
                               for t in rows]}

    rows = docs.select(F.col("doc_id").cast("long"), held_out(MODULUS, REMAINDER).alias("held_out"),
                       "text")
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int, "
                                  "n_passages int")


def passages(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> DataFrame:
    """One row per significant passage: doc_id, first_word, last_word, score, expected (by chance)."""
    model = train(docs, labels, per_class)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "first_word": [], "last_word": [], "score": [],
                                "expected": []}
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            for a, b, s, e in model.passages(text):
                if e > -np.log(SIGNIFICANT):
                    for column, v in zip(out.values(), (doc, a, b - 1, s, float(np.exp(-e)))):
                        column.append(v)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, first_word long, last_word long, score double, expected double")


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS) -> DataFrame:
    """The rows not predicted toxic, with all their columns."""
    model = train(docs, labels, per_class)
    return map_batches(docs, lambda b: b.filter(pa.array(model.score(texts(b)) < CUT)), docs.schema)
