"""Meals, their neighbours, their sensor session, their window of readings, and the verdict on it.

meals: meal_id, user_id, consumed_at. sessions: session_id, user_id, vendor, started_at, ended_at, resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.config import BLOCKING, DEFAULT, INFORMATIONAL, Thresholds
from tidecurve.functions.times import minutes

#: Minutes of a time bucket of the range joins: about a window; about a sensor's life.
BUCKET_MIN, SESSION_BUCKET_MIN = 240, 16 * 1440


def pre_window(resolution: Column, cfg: Thresholds = DEFAULT) -> Column:
    return F.greatest(F.lit(30), 2 * resolution + cfg.baseline_offset_min + 5)


def baseline_width(resolution: Column) -> Column:
    return F.greatest(F.lit(20), 2 * resolution)


def max_gap(resolution: Column) -> Column:
    return F.greatest(F.lit(20.0), 2.5 * resolution)


def min_sustained(resolution: Column) -> Column:
    return F.greatest(F.lit(15), resolution)


def neighbours(meals: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meals with prev_gap and next_gap in minutes to the user's meals before and after."""
    w = Window.partitionBy("user_id").orderBy("consumed_at", "meal_id")
    at = F.col("consumed_at")
    return meals.withColumn("prev_gap", minutes(F.lag("consumed_at").over(w), at, cfg.unit_s)).withColumn("next_gap", minutes(at, F.lead("consumed_at").over(w), cfg.unit_s))


def _bucket(at: Column, cfg: Thresholds) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(SESSION_BUCKET_MIN * cfg.unit_s * 1_000_000)).cast("long")


def _touched(sessions: DataFrame, low: str, high: str, cfg: Thresholds) -> DataFrame:
    """A row of a session for each time bucket that it touches, so that a user of many sessions isn't one group."""
    return sessions.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(low), cfg), _bucket(F.col(high), cfg))))


def with_session(meals: DataFrame, sessions: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meals with session_id, vendor, started_at, resolution of the first session that holds the meal; null if none does."""
    s = sessions.select("session_id", "user_id", "vendor", "started_at", F.coalesce("ended_at", "started_at").alias("ended_at"), "resolution")
    m = meals.select("meal_id", "user_id", "consumed_at").withColumn("__bucket", _bucket(F.col("consumed_at"), cfg))
    held = m.join(_touched(s, "started_at", "ended_at", cfg), ["user_id", "__bucket"]).where(F.col("consumed_at").between(F.col("started_at"), F.col("ended_at")))
    best = held.groupBy("meal_id").agg(F.min(F.struct("started_at", "session_id", "vendor", "resolution")).alias("s"))
    return meals.join(best, "meal_id", "left").select(*meals.columns, "s.session_id", "s.vendor", "s.started_at", "s.resolution")


def vendor_changed(meals: DataFrame, sessions: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """The meals (meal_id) near which the user wore a sensor of another vendor. meals: as with_session() gives them."""
    pad = F.expr(f"make_dt_interval(0, 0, 0, {cfg.exclude_if_vendor_changed_within_h * 60 * cfg.unit_s})")
    other = sessions.select("user_id", F.col("vendor").alias("__vendor"), (F.col("started_at") - pad).alias("__from"), (F.coalesce("ended_at", "started_at") + pad).alias("__to"))
    other = _touched(other, "__from", "__to", cfg)
    near = (F.col("__vendor") != F.col("vendor")) & F.col("consumed_at").between(F.col("__from"), F.col("__to"))
    m = meals.select("meal_id", "user_id", "consumed_at", "vendor").withColumn("__bucket", _bucket(F.col("consumed_at"), cfg))
    return m.join(other, (m["user_id"] == other["user_id"]) & (m["__bucket"] == other["__bucket"]) & near, "left_semi").select("meal_id")


def effective_post(next_gap: Column, cfg: Thresholds = DEFAULT) -> Column:
    limits = (next_gap >= cfg.exclude_if_next_meal_within_min) & (next_gap < cfg.degrade_if_next_meal_within_min)
    return F.when(limits, F.floor(next_gap).cast("int")).otherwise(cfg.post_window_min)


def window_points(meals: DataFrame, readings: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meal_id, resolution, post, rel, value, flags: readings from before the meal to a step after its window.

    meals: meal_id, session_id, consumed_at, resolution, post. readings: session_id, ts, value, flags. The range join runs
    on (session, time bucket): a reading has one bucket, a meal the two or three that its window touches, so
    one long session is many groups."""
    unit = F.lit(cfg.unit_s * 1_000_000).cast("long")
    wide = BUCKET_MIN * unit
    m = meals.where(F.col("session_id").isNotNull()).select("meal_id", "session_id", F.unix_micros("consumed_at").alias("at"), "resolution", "post")
    m = m.withColumn("low", (F.col("at") - pre_window(F.col("resolution"), cfg) * unit)).withColumn("high", (F.col("at") + (F.col("post") + F.col("resolution") + 1) * unit))
    bucket = lambda c: F.floor(F.col(c) / wide).cast("long")
    m = m.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high"))))
    r = readings.select("session_id", F.unix_micros("ts").alias("us"), "value", "flags").withColumn("bucket", bucket("us"))
    near = m.join(r, ["session_id", "bucket"]).where(F.col("us").between(F.col("low"), F.col("high")))
    return near.select("meal_id", "resolution", "post", ((F.col("us") - F.col("at")) / unit).alias("rel"), "value", "flags")


def coverage(points: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meal_id, n_points (whole window), coverage_pct, max_gap_min (of [-pre, post], with its edges), baseline_n, blocked."""
    low, high = -pre_window(F.col("resolution"), cfg), F.col("post")
    inside = F.col("rel").between(low, high)
    w = Window.partitionBy("meal_id").orderBy("rel", "value")
    p = points.withColumn("in", inside).withColumn("gap", F.when(inside & F.lag(inside).over(w), F.col("rel") - F.lag("rel").over(w)))
    hi = -cfg.baseline_offset_min
    base = F.col("rel").between(hi - baseline_width(F.col("resolution")), hi)
    got = p.groupBy("meal_id", "resolution", "post").agg(
        F.count("*").alias("n_points"), F.count_if("in").alias("n"), F.max("gap").alias("gap"), F.min(F.when(F.col("in"), F.col("rel"))).alias("first"),
        F.max(F.when(F.col("in"), F.col("rel"))).alias("last"), F.count_if(base).alias("baseline_n"), F.bool_or(F.col("flags").bitwiseAND(F.lit(BLOCKING)) != 0).alias("blocked"),
    )
    span = high - low
    pct = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(100.0), 100.0 * F.col("n") / (span / F.col("resolution") + 1)))
    gap = F.when(F.col("n") == 0, span).otherwise(F.greatest(F.coalesce("gap", F.lit(0.0)), F.col("first") - low, high - F.col("last")))
    return got.select("meal_id", "n_points", pct.cast("double").alias("coverage_pct"), gap.cast("double").alias("max_gap_min"), "baseline_n", "blocked")


def verdict(meals: DataFrame, cover: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meals with exclusions and degradations, all reasons in their fixed order.

    meals: meal_id, prev_gap, next_gap, session_id, started_at, resolution, consumed_at, vendor_changed. cover: as coverage() gives it."""
    m = meals.join(cover, "meal_id", "left")
    res = F.coalesce("resolution", F.lit(cfg.default_resolution_min))
    n = F.coalesce("n_points", F.lit(0))
    age_h = minutes(F.col("started_at"), F.col("consumed_at"), cfg.unit_s) / 60
    enough, gap = n >= 3, F.col("next_gap")
    has = F.col("session_id").isNotNull()
    reason = lambda cond, name: F.when(cond, F.lit(name))
    exclusions = [
        reason(age_h < cfg.analysis_warmup_hours, "sensor_warmup"), reason(F.col("prev_gap") < cfg.exclude_if_prev_meal_within_min, "prev_meal_too_close"),
        reason(F.col("vendor_changed"), "vendor_change"), reason(gap < cfg.exclude_if_next_meal_within_min, "next_meal_too_soon"), reason(~enough, "no_glucose_data"),
        reason(enough & (F.col("coverage_pct") < cfg.min_coverage_pct), "insufficient_coverage"), reason(enough & (F.col("max_gap_min") > max_gap(res)), "gap_too_large"),
        reason(enough & F.col("blocked"), "flagged_readings"), reason(enough & (F.col("baseline_n") == 0), "no_baseline"),
    ]
    limited = (gap >= cfg.exclude_if_next_meal_within_min) & (gap < cfg.degrade_if_next_meal_within_min)
    degradations = [reason(limited, "next_meal_limits_window"), reason(enough & (F.col("baseline_n") == 1), "weak_baseline"), reason(has & (res > cfg.peak_reliable_max_resolution_min), "peak_underestimated")]
    return m.withColumn("sensor_age_hours", age_h).withColumn("exclusions", F.array_compact(F.array(*exclusions))).withColumn("degradations", F.array_compact(F.array(*degradations)))


def quality(exclusions: Column, degradations: Column, has_metrics: Column) -> Column:
    real = F.array_except(degradations, F.array(*map(F.lit, INFORMATIONAL)))
    return F.when(F.size(exclusions) > 0, "excluded").when((F.size(real) > 0) | ~has_metrics, "degraded").otherwise("ok")
