"""Metrics and verdicts on windows whose values can be worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidecurve.operators import metrics, pairing
from tidecurve.plans import analysis


def points(spark, samples, resolution=15, post=180):
    rows = [(m, resolution, post, float(t), float(v), 0) for m, series in samples.items() for t, v in series]
    return spark.createDataFrame(rows, "meal_id string, resolution int, post int, rel double, value double, flags int")


def test_metrics_by_hand(spark):
    triangle = [(t, 90 + max(0, 60 - abs(t - 60))) for t in range(-30, 121, 15)]
    flat = [(t, 92) for t in range(-35, 190, 15)]
    bumps = [(-20, 90), *[(20 * i, 90 + d) for i, d in enumerate((0, 20, 55, 40, 25, 48, 30, 12, 4, 0))]]
    back = [(-20, 90), (0, 90), (60, 150), (120, 90), (180, 90)]
    bare = [(0, 90), (60, 120), (120, 90)]
    got = {r.meal_id: r for r in metrics.response_metrics(points(spark, {"triangle": triangle, "flat": flat, "bumps": bumps, "back": back, "bare": bare})).collect()}
    t = got["triangle"]
    assert (t.iauc_120, t.peak_delta_mgdl, t.time_to_peak_min, t.time_above_baseline_min, t.iauc_180) == (pytest.approx(3600), 60, 60, pytest.approx(120), None)
    assert (got["flat"].iauc_120, got["flat"].peak_delta_mgdl, got["flat"].cv_pct, got["flat"].curve_shape) == (0, 0, 0, "flat")
    assert got["bumps"].curve_shape == "biphasic"
    assert got["back"].time_to_return_baseline_min == pytest.approx(110)
    assert "bare" not in got


def test_flat_top_of_two_and_unsustained_return(spark):
    top = [(-20, 90), *[(15 * i, v) for i, v in enumerate((90, 120, 150, 150, 120, 90, 90))]]
    quick = [(-10, 90), *[(5 * i, v) for i, v in enumerate((90, 150, 98, 120, 95, 95, 95))]]
    assert metrics.response_metrics(points(spark, {"m": top})).first().curve_shape == "biphasic"
    assert metrics.response_metrics(points(spark, {"m": quick}, resolution=5)).first().time_to_return_baseline_min == pytest.approx(10.0)


START = datetime(2026, 8, 1, 13, 20)


def verdict_of(spark, age_h=72, prev=None, after=None, skip=(), flags=None, first=-60, resolution=15):
    meals = [("m", "u", START)] + [(f"x{i}", "u", START + timedelta(minutes=g)) for i, g in enumerate(g for g in (prev, after) if g is not None)]
    readings = [("s", START + timedelta(minutes=t), 95.0, (flags or {}).get(t, 0)) for t in range(first, 256, resolution) if t not in skip]
    sessions = [("s", "u", "one", START - timedelta(hours=age_h), START + timedelta(hours=9), resolution)]
    rows = analysis.analyze(
        spark.createDataFrame(meals, "meal_id string, user_id string, consumed_at timestamp"),
        spark.createDataFrame(sessions, "session_id string, user_id string, vendor string, started_at timestamp, ended_at timestamp, resolution int"),
        spark.createDataFrame(readings, "session_id string, ts timestamp, value double, flags int"),
    )
    return rows.where("meal_id = 'm'").first()


@pytest.mark.parametrize(
    ("case", "reasons"),
    [
        ({}, []), ({"age_h": 4}, ["sensor_warmup"]), ({"prev": -90}, ["prev_meal_too_close"]), ({"after": 90}, ["next_meal_too_soon"]), ({"skip": (30, 45, 60, 75)}, ["insufficient_coverage", "gap_too_large"]),
        ({"flags": {30: 2}}, ["flagged_readings"]), ({"first": 0, "resolution": 15}, ["no_baseline"]), ({"age_h": 2, "prev": -60, "after": 60}, ["sensor_warmup", "prev_meal_too_close", "next_meal_too_soon"]),
    ],
)
def test_verdicts(spark, case, reasons):
    row = verdict_of(spark, **case)
    assert set(reasons) <= set(row.exclusions) and (row.quality == "excluded") == bool(reasons)


def test_next_meal_limits_the_window(spark):
    row = verdict_of(spark, after=150)
    assert (row.post, row.degradations[0], row.quality) == (150, "next_meal_limits_window", "degraded")


def test_quality_of_reasons(spark):
    df = spark.createDataFrame([([], ["peak_underestimated"], True), ([], ["weak_baseline"], True), ([], [], False), (["x"], [], True)], "e array<string>, d array<string>, m boolean")
    assert [r.q for r in df.select(pairing.quality(F.col("e"), F.col("d"), F.col("m")).alias("q")).collect()] == ["ok", "degraded", "degraded", "excluded"]


def test_exclusion_counts_come_sorted(spark):
    rows = [("u", "excluded", ["b", "c"]), ("u", "excluded", ["c"]), ("t", "excluded", ["a"]), ("u", "excluded", []), ("u", "excluded", None), ("u", "ok", ["c"])]
    df = spark.createDataFrame(rows, "user_id string, quality string, exclusions array<string>")
    assert [tuple(r) for r in analysis.exclusion_counts(df).collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert [tuple(r) for r in analysis.exclusion_counts(df, "user_id").collect()] == [("t", "a", 1), ("u", "c", 2), ("u", "b", 1)]
    assert analysis.exclusion_counts(df.limit(0)).count() == 0
