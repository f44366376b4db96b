"""Meals and readings as two streams: a meal meets the readings of its window as they come, and is told once its window is complete.

The join is bounded on both sides: a reading is kept until no meal can come any more whose window holds it, a meal until its window is
over, both by the watermarks. So state follows the readings of a window's length and of DELAY, however long the streams run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecurve.config import DEFAULT, Thresholds
from tidecurve.streaming.readings import DELAY

#: Minutes before and after a meal, at the default resolution: its widest baseline, and a step and a minute after its longest window.
PRE_MIN = max(30, 2 * DEFAULT.default_resolution_min + DEFAULT.baseline_offset_min + 5)
POST_MIN = DEFAULT.post_window_min + DEFAULT.default_resolution_min + 1


def _span(minutes: int, cfg: Thresholds) -> Column:
    return F.expr(f"INTERVAL {minutes * cfg.unit_s} SECONDS")


def window_stream(meals: DataFrame, readings: DataFrame, cfg: Thresholds = DEFAULT, delay: str = DELAY, pre: int = PRE_MIN, post: int = POST_MIN, how: str = "inner") -> DataFrame:
    """meal_id, user_id, consumed_at, ts, rel (minutes after the meal), value, flags of the readings in each meal's window.

    meals: meal_id, user_id, consumed_at. readings: user_id, ts, value, flags. With how='left_outer' a meal without any reading
    is told too (ts null), once none can come."""
    m = meals.select("meal_id", "user_id", "consumed_at").withWatermark("consumed_at", delay)
    r = readings.select(F.col("user_id").alias("__user"), "ts", "value", "flags").withWatermark("ts", delay)
    near = (F.col("user_id") == F.col("__user")) & (F.col("ts") >= F.col("consumed_at") - _span(pre, cfg)) & (F.col("ts") <= F.col("consumed_at") + _span(post, cfg))
    rel = (F.unix_micros("ts") - F.unix_micros("consumed_at")) / F.lit(cfg.unit_s * 1_000_000)
    return m.join(r, near, how).select("meal_id", "user_id", "consumed_at", "ts", rel.alias("rel"), "value", "flags")


def closed_windows(meals: DataFrame, readings: DataFrame, cfg: Thresholds = DEFAULT, delay: str = DELAY, pre: int = PRE_MIN, post: int = POST_MIN) -> DataFrame:
    """meal_id, user_id, consumed_at, n_points, n_flagged, first_rel, last_rel, peak_mgdl: a row for each meal, when its window is
    complete (append mode); meals without a reading have n_points 0."""
    points = window_stream(meals, readings, cfg, delay, pre, post, "left_outer")
    return points.groupBy("meal_id", "user_id", "consumed_at").agg(
        F.count("ts").alias("n_points"), F.count_if(F.col("flags") != 0).alias("n_flagged"), F.min("rel").alias("first_rel"), F.max("rel").alias("last_rel"), F.max("value").alias("peak_mgdl")
    )
