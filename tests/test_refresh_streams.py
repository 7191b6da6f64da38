"""Debounced refreshes and approvals of changes, replayed in many batches against plain versions."""

import datetime as dt
import random
import uuid

import pytest

from weftgraph.staging import stage_root
from weftgraph.streaming import streams as T

START = dt.datetime(2024, 5, 1)


def at(second):
    return START + dt.timedelta(seconds=second)


def stream_of(spark, batches, schema):
    """A stream that reads one file a batch, in order."""
    path = f"{stage_root(spark)}/in-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return T.stream_table(spark, path, files_per_trigger=1)


def run(spark, stream, name):
    base = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    query = T.run(stream, base)
    return query, [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{base}/data").collect()]


def slow(rows, quiet, longest, delay):
    end = max(t for p, t in rows if t is not None and p is not None) - delay
    out, by = [], {}
    for p, t in rows:
        if p is not None and t is not None:
            by.setdefault(p, []).append(t)
    for p, times in by.items():
        group = None
        for t in sorted(times):
            if group and t >= min(group[1] + quiet, group[0] + longest):
                out.append((p, *group))
                group = None
            group = (group[0], t, group[2] + 1) if group else (t, t, 1)
        out.append((p, *group))
    due = lambda f, l: min(l + quiet, f + longest)
    return sorted((p, at(f), at(l), at(due(f, l)), n) for p, f, l, n in out if due(f, l) <= end)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_refreshes_do_not_depend_on_batches(spark, batches):
    dice = random.Random(batches)
    rows = [(f"p{dice.choice([0, 0, 0, 1, 2, 3])}", dice.randrange(2000)) for _ in range(300)]
    rows.sort(key=lambda r: r[1] + dice.randrange(-25, 26))  # out of order by less than the delay
    rows += [(None, 50), ("p1", None), ("z", 3000)]
    size = -(-len(rows) // batches)
    parts = [[(p, None if t is None else at(t)) for p, t in rows[i:i + size]]
             for i in range(0, len(rows), size)]
    stream = stream_of(spark, parts, "project_id string, ts timestamp_ntz")
    query, got = run(spark, T.debounce(stream, "ts", "60 seconds", 20, 90), "refresh")
    assert T.late_rows(query) == 0
    want = slow(rows, 20, 90, 60)
    assert len(want) > 30 and sorted(got) == want


def test_late_changes_are_counted_and_dropped(spark):
    parts = [[("a", at(10)), ("a", at(12))], [("b", at(500))], [("b", at(600))],
             [("a", at(11)), ("b", at(601))], [("c", at(2000))]]
    query, got = run(spark, T.debounce(stream_of(
        spark, parts, "project_id string, ts timestamp_ntz"), "ts", "30 seconds", 20, 90), "late")
    assert T.late_rows(query) == 1
    assert sorted(got) == [("a", at(10), at(12), at(32), 2), ("b", at(500), at(500), at(520), 1),
                           ("b", at(600), at(601), at(621), 2)]


def test_steady_changes_wait_no_longer_than_allowed(spark):
    rows = [("a", at(t)) for t in range(0, 100, 5)] + [("b", at(1000))]
    _, got = run(spark, T.debounce(stream_of(
        spark, [rows], "project_id string, ts timestamp_ntz"), "ts", "1 second", 30, 40), "steady")
    assert sorted(got) == [("a", at(0), at(35), at(40), 8), ("a", at(40), at(75), at(80), 8),
                           ("a", at(80), at(95), at(120), 4)]


def test_changes_without_approval_come_out_after_the_watermark(spark):
    changes = [[("x", 1, 1, at(0)), ("x", 2, 2, at(5)), (None, 1, 3, at(6)), ("x", 1, 1, at(0))],
               [("y", 1, 4, at(400)), ("y", 1, 5, at(900))]]
    approvals = [[("x", 1, 70, at(50)), ("x", 1, 71, at(61)), ("x", 2, 72, at(4)), (None, 1, 73, at(7))],
                 [("y", 1, 74, at(450)), ("y", 1, 75, at(900))]]
    joined = T.approval_join(
        stream_of(spark, changes, "plan_id string, revision bigint, change_id bigint, changed_at timestamp_ntz"),
        stream_of(spark, approvals,
                  "plan_id string, revision bigint, approval_id bigint, approved_at timestamp_ntz"),
        "10 seconds", "60 SECONDS")
    _, got = run(spark, joined, "approval")
    # The last approval of y is at its change; the change of 400 has one, those of x and null wait in vain.
    assert sorted((r[0] or "", r[2], r[4] or 0) for r in got) == [
        ("", 3, 0), ("x", 1, 70), ("x", 1, 70), ("x", 2, 0), ("y", 4, 74), ("y", 5, 75)]
