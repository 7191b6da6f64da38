"""Quality rules as a short-circuit cascade.

Every rule rejects a text or lets it pass.  On a bounded sample each rule's cost (seconds per
text) and selectivity (share it rejects) are measured; rules then run by rejections per second,
and a rejected text skips the rest.  The verdict is "no rule rejects", whatever the order.

Defined results: a null text counts as empty; empty texts have zero words and fail the base
rules; repeated rows are judged alike, one result row per input row; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_batches, repeated_words, texts

#: Fixed by the contract of the base statistics.
SYMBOLS = "#*$%&|<>"
#: Texts on which costs and selectivities are measured.
SAMPLE_ROWS = 400
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean")


class Text:
    """A text with its words; the costly statistics are computed when a rule first asks."""

    __slots__ = ("raw", "data", "words", "_repeats", "_lines")

    def __init__(self, raw: str | None):
        self.raw = raw or ""
        self.data = self.raw.encode("utf-8", "surrogatepass")
        self.words = self.data.split()
        self._repeats = self._lines = None

    @property
    def word_chars(self) -> int:
        return len(self.raw) - sum(map(self.raw.count, SPACES))

    @property
    def symbols(self) -> int:
        return sum(map(self.raw.count, SYMBOLS))

    @property
    def lines(self) -> list[str]:
        if self._lines is None:
            self._lines = [x for x in self.raw.split("\n") if x.strip(SPACES)]
        return self._lines

    @property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def repeats(self) -> int:
        if self._repeats is None:
            self._repeats = repeated_words(self.words)
        return self._repeats


@dataclass(frozen=True)
class Rule:
    """Rejects when ``bad`` is true; ``name`` says what it looks at."""

    name: str
    bad: Callable[[Text], bool] = field(compare=False)


def _share(part: int, whole: int, percent: int) -> bool:
    return 100 * part > percent * max(whole, 1)


#: The base conditions of the contract, then what marks junk in web text.  Limits are integers.
BASE = [
    Rule("too_few_words", lambda t: len(t.words) < 20),
    Rule("repeated_windows", lambda t: _share(t.repeats, len(t.words), 30)),
]
MORE = [
    Rule("symbols_per_word", lambda t: _share(t.symbols, len(t.words), 40)),
    Rule("shouting", lambda t: _share(
        len(t.data) - len(t.data.translate(None, _UPPER)), t.word_chars, 50)),
    Rule("exclamations", lambda t: _share(t.data.count(b"!"), len(t.words), 60)),
    Rule("digits", lambda t: _share(
        len(t.data) - len(t.data.translate(None, _DIGITS)), t.word_chars, 40)),
    Rule("table_cells", lambda t: _share(t.data.count(b" | "), len(t.words), 30)),
    Rule("duplicate_lines", lambda t: _share(t.dup_lines, len(t.lines), 50)),
    Rule("word_length", lambda t: bool(t.words) and not 2 <= t.word_chars / len(t.words) <= 40),
    Rule("one_word_again", lambda t: _share(
        len(t.words) - len(set(t.words)), len(t.words), 92)),
]


def measure(sample: list[str | None], rules: list[Rule] | None = None,
            clock: Callable[[], float] = time.perf_counter) -> dict[str, tuple[float, float]]:
    """Per rule: seconds per text when it runs first, and the share of texts it rejects."""
    found = {}
    for rule in rules or BASE + MORE:
        cost, rejected = 0.0, 0
        for raw in sample:
            text = Text(raw)  # fresh, so no rule profits from another's statistics
            began = clock()
            rejected += bool(rule.bad(text))
            cost += clock() - began
        n = max(len(sample), 1)
        found[rule.name] = (cost / n, rejected / n)
    return found


def plan(found: dict[str, tuple[float, float]], rules: list[Rule] | None = None) -> list[Rule]:
    """Rules by rejections per second, then by cost; the order that makes a cascade cheapest."""
    rules = rules or BASE + MORE
    return sorted(rules, key=lambda r: (-found[r.name][1] / max(found[r.name][0], 1e-9),
                                        found[r.name][0], r.name))


def verdict(text: Text, cascade: list[Rule]) -> str | None:
    """Name of the first rule that rejects, or None."""
    for rule in cascade:
        if rule.bad(text):
            return rule.name
    return None


def cascade_order(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names in running order, measured by one task on the ``rows`` texts of smallest hash."""
    # A hash filter first, so that each task hands on few of its texts.
    step = max(docs.count() // (2 * rows), 1)
    sample = (docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
              .orderBy(F.xxhash64("text")).limit(rows))

    def run(batch: pa.RecordBatch) -> dict:
        found, n = measure(texts(batch)), batch.num_rows
        return {"name": list(found), "cost": [c * n for c, _ in found.values()],
                "rejected": [r * n for _, r in found.values()], "n": [n] * len(found)}

    parts = map_batches(sample, run, "name string, cost double, rejected double, n long")
    total = parts.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("cost", "rejected", "n")))
    found = {r["name"]: (r["cost"] / max(r["n"], 1), r["rejected"] / max(r["n"], 1))
             for r in total.collect()}
    return [r.name for r in plan({r.name: found.get(r.name, (0.0, 0.0)) for r in BASE + MORE})]


def quality_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text)."""
    names = cascade_order(docs, sample_rows)

    def judge(batch: pa.RecordBatch) -> dict:
        by_name = {r.name: r for r in BASE + MORE}
        more = [by_name[n] for n in names if n not in {r.name for r in BASE}]
        out: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words", "base_failed", "kept")}
        for raw in texts(batch):
            t = Text(raw)
            n = len(t.words)
            failed = any(r.bad(t) for r in BASE)
            row = (n, t.word_chars, t.symbols, t.dup_lines, t.repeats, failed,
                   not failed and verdict(t, more) is None)
            for column, value in zip(out.values(), row):
                column.append(value)
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), judge, SCHEMA)


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows no rule rejects, with all their columns; here the whole cascade short-circuits."""
    names = cascade_order(docs, sample_rows)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        by_name = {r.name: r for r in BASE + MORE}
        cascade = [by_name[n] for n in names]
        return batch.filter(pa.array([verdict(Text(x), cascade) is None for x in texts(batch)],
                                     type=pa.bool_()))

    return map_batches(docs, judge, docs.schema)
