"""Supersession against a sequential simulation, hand cases, and order independence."""

import datetime as dt
import random

import pytest

from factlake.operators import bitemporal as op

SCHEMA = "id long, namespace string, subject string, predicate string, object string, statement string, observed_at timestamp_ntz, valid_from timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def rows(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s, p, o = rng.choice("AB"), rng.choice(["status", "visited", "size"]), rng.choice(["x", "X", "5 rps", "6 rps", None])
        past = rng.random() < 0.2
        at = T0 + dt.timedelta(minutes=rng.randint(0, 40))  # many ties
        out.append((i, "ns", rng.choice([s, s.lower()]), p, o, f"{'Formerly ' if past else ''}{s} {p} is {o}", at, rng.choice([at, None])))
    return out


def closes(r):
    single = r[3] == "status" or (r[4] or "").endswith("rps") and r[3] != "visited"
    return single and not r[5].startswith("Formerly")


def simulate(data, mode):
    groups = {}
    for r in sorted(data, key=lambda r: (r[6], r[0])):
        groups.setdefault((r[2].lower(), r[3]), []).append(r)
    out = {r[0]: None for r in data}
    for own in groups.values():
        closers = [r for r in own if closes(r)]
        for n, r in enumerate(own):
            differs = lambda c: (c[4] or "").lower() != (r[4] or "").lower()  # noqa: E731, B023
            if mode == "write":
                later = [c for c in own[n + 1 :] if closes(c) and differs(c)]
                out[r[0]] = later[0][0] if later else None
            elif closers and differs(closers[-1]) and r[6] <= closers[-1][6]:
                out[r[0]] = closers[-1][0]
    return out


@pytest.mark.parametrize("mode", ["write", "reconcile"])
@pytest.mark.parametrize("seed", range(6))
def test_against_simulation_whatever_the_input_order(spark, mode, seed):
    data = rows(seed)
    for shuffled in (data, data[::-1]):
        state = op.supersede(spark.createDataFrame(shuffled, SCHEMA), mode).collect()
        assert {r["id"]: r["superseded_by"] for r in state} == simulate(data, mode)
        at = {r[0]: r[6] for r in data}
        for r in state:
            assert (r["valid_to"] is None) == (r["superseded_by"] is None)
            if r["valid_to"]:
                assert r["valid_to"] == max(r["valid_from"] or at[r["superseded_by"]], at[r["superseded_by"]])


def test_supersession_matrix(spark):
    cases = [
        ("status", "red", "S status is red", 0), ("status", "green", "S status is green", 1),  # flips
        ("lives_in", "Austin", "Alice lives in Austin", 0), ("lives_in", "Seattle", "Alice moved to Seattle on 2026-06-04", 1), ("lives_in", "Boston", "Alice lived in Boston in 2019", 2),
        ("rate_limit", "100 rps", "the limit is 100 rps", 0), ("rate_limit", "200 rps", "the limit was changed to 200 rps last year", 1),
        ("visited", "Paris", "saw Paris", 0), ("visited", "Rome", "saw Rome", 1), ("concurrency", "4", "c is 4", 0), ("concurrency", "8", "c is 8", 1),
    ]
    data = [(i, "n", "s", p, o, text, T0 + dt.timedelta(days=d), None) for i, (p, o, text, d) in enumerate(cases)]
    closed = {r["id"]: r["superseded_by"] for r in op.supersede(spark.createDataFrame(data, SCHEMA)).collect()}
    assert closed == {0: 1, 1: None, 2: 3, 3: None, 4: None, 5: 6, 6: None, 7: None, 8: None, 9: 10, 10: None}


def test_plan_has_one_shuffle_and_no_join(spark):
    plan = op.supersede(spark.createDataFrame(rows(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_rerun_changes_nothing(spark):
    facts = spark.createDataFrame(rows(3), SCHEMA)
    assert op.diff_states(op.supersede(facts), op.supersede(facts)).count() == 0
