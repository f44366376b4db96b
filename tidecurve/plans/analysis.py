"""The analysis: meals, sessions and readings to one response row for each meal.

Sessions, placed meals and window points are written once (settled tables), as several parts of the plan read each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecurve.config import ALGORITHM_VERSION, DEFAULT, Thresholds
from tidecurve.operators import metrics, pairing
from tidecurve.operators.tables import settled


def placed_meals(meals: DataFrame, sessions: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meals with neighbours, session, post window and vendor_changed."""
    placed = pairing.with_session(pairing.neighbours(meals, cfg), sessions, cfg)
    changed = pairing.vendor_changed(placed, sessions, cfg).select("meal_id", F.lit(True).alias("vendor_changed"))
    placed = placed.join(changed, "meal_id", "left").withColumn("vendor_changed", F.coalesce("vendor_changed", F.lit(False)))
    return placed.withColumn("post", pairing.effective_post(F.col("next_gap"), cfg))


def analyze(meals: DataFrame, sessions: DataFrame, readings: DataFrame, existing: DataFrame | None = None, recompute: bool = False, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Response rows. Only historic readings count; sessions without any are dropped; a meal whose existing row has
    the current algorithm version is left out unless recompute is set (its neighbours still see it)."""
    if "source_record" in readings.columns:
        readings = readings.where("source_record = 'historic'")
    live = sessions.join(readings.select("session_id").distinct(), "session_id", "left_semi").withColumn("resolution", F.coalesce("resolution", F.lit(cfg.default_resolution_min)))
    placed = placed_meals(meals, settled(live), cfg)
    if existing is not None and not recompute:
        placed = placed.join(existing.where(F.col("algorithm_version") == ALGORITHM_VERSION).select("meal_id"), "meal_id", "left_anti")
    placed = settled(placed)
    points = settled(pairing.window_points(placed, readings, cfg))
    cover = pairing.coverage(points, cfg)
    told = pairing.verdict(placed, cover, cfg)
    found = metrics.response_metrics(points, cfg, least=3).drop("resolution")
    rows = told.join(found.drop("baseline_n"), "meal_id", "left")
    return rows.withColumn("resolution", F.coalesce("resolution", F.lit(cfg.default_resolution_min))).withColumn("quality", pairing.quality(F.col("exclusions"), F.col("degradations"), F.col("peak_mgdl").isNotNull())).withColumn("algorithm_version", F.lit(ALGORITHM_VERSION))


def summary(rows: DataFrame) -> DataFrame:
    """One row: computed, usable, excluded, pairing_valid_ratio."""
    usable = F.count_if(F.col("quality").isin("ok", "degraded"))
    return rows.agg(F.count("*").alias("computed"), usable.alias("usable"), F.count_if(F.col("quality") == "excluded").alias("excluded"), F.round(F.try_divide(usable, F.count("*")), 4).alias("pairing_valid_ratio"))


def exclusion_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How often each reason excludes a meal, in each group of `by`: the most frequent first, equal ones by name."""
    return rows.where("quality = 'excluded'").select(*by, F.explode("exclusions").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "reason")
