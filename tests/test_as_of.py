"""As-of joins against plain loops, with cells of a few rows."""

import datetime as dt
import random

import pytest

from weftgraph.operators import as_of as Z

START = dt.datetime(2024, 5, 1)
LOG = ("project_id string, id string, at timestamp_ntz, event_id bigint, content string, "
       "deleted boolean")
PLANS = "plan_id string, at timestamp_ntz, event_id bigint, content string"
ASKS = "project_id string, plan_id string, at timestamp_ntz, ask string"


def at(n):
    return None if n is None else START + dt.timedelta(microseconds=n)


def last(rows, time):
    held = [r for r in rows if r[0] is not None and time is not None and r[0] <= time]
    return max(held, key=lambda r: (r[0], r[1])) if held else None


@pytest.mark.parametrize("per_cell", [1, 4, 10_000])
def test_last_value_equals_a_loop(spark, per_cell):
    dice = random.Random(per_cell)
    key = lambda: dice.choice(["hot"] * 6 + ["a", "b", None])
    when = lambda: dice.choice([None, dice.randrange(60), dice.randrange(5000)])
    events = [(key(), at(when()), i, dice.choice([None, f"v{i}"])) for i in range(300)]
    events += events[:20]
    asks = [("p", key(), at(when()), f"q{i // 2}") for i in range(200)]
    got = Z.last_as_of(
        spark.createDataFrame(asks, ASKS),
        spark.createDataFrame(events, PLANS).withColumnRenamed("content", "value"),
        ["plan_id"], "at", "event_id", ["event_id", "value"], per_cell).collect()
    want = []
    for p, k, t, name in asks:
        one = last([(e[1], e[2], e[3]) for e in events if e[0] == k], t)
        want.append((name, str(k), str(t), one[1] if one else -1, str(one[2] if one else None)))
    assert sorted((r.ask, str(r.plan_id), str(r.at), -1 if r.event_id is None else r.event_id,
                   str(r.value)) for r in got) == sorted(want)


@pytest.mark.parametrize("per_cell", [2, 10_000])
def test_sums_equal_a_loop(spark, per_cell):
    dice = random.Random(7)
    events = [(dice.choice(["hot", "hot", "a", None]), at(dice.randrange(300)), dice.choice([1, -1, None]))
              for _ in range(200)] + [("hot", None, 5)]
    asks = [("p", dice.choice(["hot", "a", "none", None]), at(dice.choice([None, dice.randrange(400)])), "q")
            for _ in range(60)]
    got = Z.sums_as_of(spark.createDataFrame(asks, ASKS), spark.createDataFrame(
        events, "plan_id string, at timestamp_ntz, n bigint"), ["plan_id"], "at", ["n"], per_cell).collect()
    want = [(str(k), str(t), sum(n or 0 for e, u, n in events if e == k and t and u and u <= t))
            for _, k, t, _ in asks]
    assert sorted((str(r.plan_id), str(r.at), int(r.n)) for r in got) == sorted(want)


@pytest.mark.parametrize("per_cell", [3, 10_000])
def test_state_of_plans_equals_a_replay(spark, per_cell):
    dice = random.Random(3)
    project = lambda: dice.choice(["hot"] * 4 + ["other"])
    log = lambda first: [(project(), f"n{dice.randrange(6)}", at(dice.randrange(500)), first + i,
                          dice.choice(["x", "y", None]), dice.random() < 0.3) for i in range(150)]
    notes, policies = log(0), log(1000)
    plans = [(f"p{dice.randrange(3)}", at(dice.randrange(500)), i, f"c{i}") for i in range(40)]
    asks = [(project(), f"p{dice.randrange(4)}", at(dice.randrange(600)), f"q{i}") for i in range(80)]
    frame = spark.createDataFrame
    got = {r.ask: r for r in Z.plan_state_as_of(
        frame(asks, ASKS), frame(plans, PLANS), frame(notes, LOG), frame(policies, LOG),
        per_cell).collect()}
    assert len(got) == 80

    def held(rows, p, t):
        ids = {r[1] for r in rows if r[0] == p}
        out = set()
        for i in ids:
            one = last([(r[2], r[3], r[4], r[5]) for r in rows if r[:2] == (p, i)], t)
            if one and not one[3]:
                out.add((i, one[2] or ""))
        return p, frozenset(out)

    digests = {}
    for p, k, t, name in asks:
        r, one = got[name], last([(x[1], x[2], x[3]) for x in plans if x[0] == k], t)
        assert (r.plan_event, r.plan_content) == ((one[1], one[2]) if one else (None, None))
        for rows, n, d in ((notes, r.notes, r.notes_digest), (policies, r.policies, r.policies_digest)):
            state = held(rows, p, t)
            assert n == len(state[1])
            digests.setdefault(state if state[1] else "none", set()).add(d)
    assert all(len(d) == 1 for d in digests.values())
    assert len({next(iter(d)) for d in digests.values()}) == len(digests)


def test_empty_tables(spark):
    frame = spark.createDataFrame
    none = Z.plan_state_as_of(frame([], ASKS), frame([], PLANS), frame([], LOG), frame([], LOG))
    assert none.collect() == []
    one = Z.plan_state_as_of(frame([("p", "x", at(3), "q"), (None, None, None, "r")], ASKS),
                             frame([], PLANS), frame([], LOG), frame([], LOG)).collect()
    assert sorted((r.ask, r.plan_event, r.notes, r.notes_digest, r.policies) for r in one) == [
        ("q", None, 0, "0", 0), ("r", None, 0, "0", 0)]
