"""Permutations inside of blocks against the same draws in plain Python."""

import hashlib
import random

import duckdb
import pytest

from tidecurve.operators import trials
from tidecurve.plans import trial_queries

SCHEMA = "subject string, block int, id int, in_a boolean, outcome long"


def expected(rows, draws, seed):
    found = {}
    for subject in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == subject]

        def stat(chosen, own=own):
            a, b = [r[4] for r in own if r[2] in chosen], [r[4] for r in own if r[2] not in chosen]
            return sum(a) * len(b) - sum(b) * len(a)

        true = {r[2] for r in own if r[3]}
        hits = 1
        for draw in range(1, draws + 1):
            chosen = set()
            for block in {r[1] for r in own}:
                inside = [r for r in own if r[1] == block]
                inside.sort(key=lambda r: (hashlib.md5(f"{seed}:{draw}:{r[2]}".encode()).hexdigest(), r[2]))
                chosen |= {r[2] for r in inside[: sum(r[3] for r in inside)]}
            hits += abs(stat(chosen)) >= abs(stat(true))
        found[subject] = hits / (draws + 1)
    return found


def test_draws_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(s, i % 5 if s != "n" else None, n * 100 + i, i // 5 % 2 == 0, rnd.randrange(100) + (60 if s == "e" and i // 5 % 2 == 0 else 0)) for n, s in enumerate("enx") for i in range(30)]
    rows += [("one", 1, 900 + i, True, 5) for i in range(3)]
    nulls = [(None, 1, 990, True, 1), ("e", 1, 991, None, 1), ("e", 1, 992, True, None)]
    df = spark.createDataFrame(rows + nulls, SCHEMA)
    got = {r.subject: r for r in trials.permutation_test(df, 99, 7).collect()}
    assert {s: r.p_value for s, r in got.items()} == expected(rows, 99, 7)
    assert got["e"].p_value <= 0.05 and (got["e"].n_a, got["e"].n_b) == (15, 15)
    assert (got["one"].diff, got["one"].p_value) == (None, 1)
    assert trials.permutation_test(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = {r.user_id: r for r in trial_queries.trial_permutations(spark, folder).collect()}
    want = duckdb.sql(trial_queries.SQL).fetchall()
    assert len(want) == len(got) > 10
    for user, n_a, n_b, diff, p in want:
        r = got[user]
        assert (r.n_a, r.n_b, r.p_value) == (n_a, n_b, p) and r.diff == (None if diff is None else pytest.approx(diff, abs=1e-9))


def test_blocks_of_any_size_and_wide_subjects_shuffle_no_row_for_each_draw(spark):
    rnd = random.Random(5)
    rows = [("big", 1, i, rnd.random() < 0.4, rnd.randrange(1000)) for i in range(700)] + [("big", None, 1000 + i, i % 3 == 0, rnd.randrange(50)) for i in range(90)]
    rows += [("wide", i % 40, 2000 + i, rnd.random() < 0.5, rnd.randrange(500)) for i in range(400)] + [("one", 1, 3000 + i, i < 2, i) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for limit in (50, 100, 10_000):
        told = trials.permutation_test(df, 19, 7, block_rows=limit)
        got = {r.subject: (r.p_value, r.n_a, r.n_b) for r in told.collect()}
        assert {s: p for s, (p, _, _) in got.items()} == expected(rows, 19, 7)
        assert got["big"][1:] == (sum(r[3] for r in rows if r[0] == "big"), sum(not r[3] for r in rows if r[0] == "big"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "draw" not in plan  # what is dealt are exposures, and sums in lists


def test_rows_without_an_id_are_drawn_as_in_sql(spark):
    rows = [("e", 1, i if i else None, i % 2 == 0, i * i) for i in range(9)]
    got = trials.permutation_test(spark.createDataFrame(rows, SCHEMA), 99, 42).first().p_value
    want = expected([(s, b, "" if i is None else i, a, y) for s, b, i, a, y in rows], 99, 42)
    assert got == want["e"]
