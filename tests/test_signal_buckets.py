"""Signals by time buckets equal those of a window over the whole session, in any width of bucket."""

import random

import pytest
from pyspark.sql import functions as F

from tidecurve.config import COMPRESSION_LOW, DEFAULT, IMPLAUSIBLE_RATE, OUT_OF_RANGE, WARMUP
from tidecurve.operators import signal


def curve(n=4000, seed=4):
    """Minutes and values with gaps, repeated times, steep steps, shallow and deep lows, some of them at the edges of days."""
    rng, t, v, rows = random.Random(seed), 0, 110.0, []
    for k in range(n):
        t += rng.choice([0, 5, 5, 5, 5, 5, 15, 40, 130]) if rng.random() < 0.3 else 5
        v = min(420.0, max(30.0, v + rng.choice([-60, 60]) if rng.random() < 0.06 else v + rng.uniform(-9, 9)))
        if k % 97 in (0, 1):
            v = 60.0 + k % 5
        elif k % 97 == 2:
            v = 125.0
        rows.append((t, round(v, 1)))
    return rows


def plain_flags(rows, resolution):
    rows = sorted(rows)
    spans, flags = [], [0] * len(rows)
    for i, (t, v) in enumerate(rows):
        if 0 < i < len(rows) - 1 and v <= rows[i - 1][1] and v <= rows[i + 1][1] and v < DEFAULT.compression_low_mgdl:
            pre = [(x, -s) for s, x in rows if t - DEFAULT.compression_drop_window_min <= s < t]
            post = [(x, -s) for s, x in rows if t < s <= t + DEFAULT.compression_recovery_min]
            if pre and post and max(pre)[0] - v >= DEFAULT.compression_drop_mgdl and max(post)[0] - v >= DEFAULT.compression_recovery_share * DEFAULT.compression_drop_mgdl:
                spans.append((-max(pre)[1], -max(post)[1]))
    for i, (t, v) in enumerate(rows):
        step = t - rows[i - 1][0] if i else None
        fast = i and step <= 2 * resolution and step > 0 and abs(v - rows[i - 1][1]) / step > DEFAULT.max_rate_mgdl_per_min
        flags[i] = (
            OUT_OF_RANGE * (not DEFAULT.physiological_min_mgdl <= v <= DEFAULT.physiological_max_mgdl) | IMPLAUSIBLE_RATE * bool(fast)
            | WARMUP * (t - rows[0][0] < DEFAULT.analysis_warmup_hours * 60) | COMPRESSION_LOW * any(a <= t <= b for a, b in spans)
        )
    return sorted((t, v, f) for (t, v), f in zip(rows, flags, strict=True))


@pytest.mark.parametrize("width", [30, 1440, 10**9])
def test_flags_and_resolution_equal_the_plain_version(spark, monkeypatch, width):
    monkeypatch.setattr(signal, "BUCKET_MIN", width)
    monkeypatch.setattr(signal, "EDGE_BUCKET_MIN", width)
    rows = curve()
    df = spark.createDataFrame([("s", t * 60, v) for t, v in rows], "session_id string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    known = signal.sessions(df)
    assert [(r["resolution"], r["n_readings"]) for r in known.collect()] == [(5, len(rows))]
    got = signal.quality_flags(df, known)
    assert sorted((r["t"] // 60, r["value"], r["flags"]) for r in got.collect()) == plain_flags(rows, 5)
    found = {r["flags"] & bit for r in got.select("flags").distinct().collect() for bit in (1, 2, 4, 8)}
    assert found == {0, 1, 2, 4, 8}


def test_session_steps_by_buckets(spark, monkeypatch):
    rows = [("a", "u", t, v) for t, v in curve(500, 1)] + [("b", "u", 10_000 + t, v + 40) for t, v in curve(500, 2)] + [("c", "u", 30_000 + t, v) for t, v in curve(7, 3)]
    df = spark.createDataFrame([(s, u, t * 60, v) for s, u, t, v in rows], "session_id string, user_id string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    told = []
    for width in (30, 10**9):
        monkeypatch.setattr(signal, "EDGE_BUCKET_MIN", width)
        steps = signal.session_steps(df, df.groupBy("session_id", "user_id").agg(F.min("ts").alias("started_at")))
        told.append({tuple(r) for r in steps.collect()})
    assert told[0] == told[1] and len(told[0]) == 3


def test_one_session_is_many_tasks_work(spark):
    """No bucket holds an eighth of a session's rows, and the windows need one shuffle by (session, bucket)."""
    df = spark.range(40_000).select(F.lit("s").alias("session_id"), F.timestamp_seconds(F.col("id") * 300).alias("ts"), (F.lit(100.0) + F.col("id") % 17).alias("value"))
    sizes = signal.in_buckets(df, 120, 90).groupBy("session_id", "bucket").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert sizes[0] < 40_000 / 8 and sizes[1] > 100 and sizes[2] < 1.3 * 40_000
    known = spark.createDataFrame([("s", 5)], "session_id string, resolution int").withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    plan = signal.quality_flags(df, F.broadcast(known))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
