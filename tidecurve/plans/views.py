"""Read views: each carries its counts and an evidence status beside its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.functions.times import local, local_day, local_hour

USABLE = ("ok", "degraded")
# Fixed values.
ENOUGH, SOME, LITTLE = "suficiente_para_observacion", "insuficiente_tendencia_no_concluyente", "insuficiente_no_interpretar"


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero, as decimals round."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def evidence(n: Column) -> Column:
    return F.when(n >= 8, ENOUGH).when(n >= 4, SOME).otherwise(LITTLE)


def meal_response(meals: DataFrame, responses: DataFrame) -> DataFrame:
    at, off = F.col("consumed_at"), F.col("tz_offset_min")
    extra = [c for c in responses.columns if c not in meals.columns]
    return meals.join(responses.select("meal_id", *extra), "meal_id", "left").withColumn("consumed_at_local", local(at, off)).withColumn("hour_local", local_hour(at, off))


def pairing_daily(responses: DataFrame) -> DataFrame:
    usable = F.count_if(F.col("quality").isin(*USABLE))
    return responses.groupBy("user_id", F.to_date("consumed_at_local").alias("day_local")).agg(
        F.count("*").alias("meals"), usable.alias("usable"), F.count_if(F.col("quality") == "excluded").alias("excluded"), rounded(100.0 * usable / F.count("*"), 1).alias("pairing_valid_pct")
    )


def coverage_daily(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    r = readings.where("source_record = 'historic'").join(sessions.select("session_id", "user_id", "resolution"), "session_id")
    return r.groupBy("user_id", local_day(F.col("ts"), F.col("tz_offset_min")).alias("day_local")).agg(
        F.count("*").alias("readings"), rounded(100.0 * F.count("*") / (1440.0 / F.max("resolution")), 1).alias("coverage_pct"), F.count_if(F.col("flags") != 0).alias("flagged"), F.max("resolution").alias("resolution_min")
    )


def meal_foods(responses: DataFrame, items: DataFrame, foods: DataFrame) -> DataFrame:
    """A row for each resolved item of a usable meal; Spark broadcasts foods while its size allows."""
    usable = responses.where(F.col("quality").isin(*USABLE) & F.col("iauc_120").isNotNull())
    return usable.join(items, "meal_id").join(foods, "food_id")


def food_summary(rows: DataFrame) -> DataFrame:
    """rows: user_id, meal_id, food_slug, food_name, food_category, iauc_120, peak_delta_mgdl. An item twice in a meal counts twice."""
    counted = rows.withColumn("foods_in_meal", F.count("*").over(Window.partitionBy("user_id", "meal_id")))
    quart = lambda p: rounded(F.percentile("iauc_120", F.lit(p)))
    return counted.groupBy("user_id", "food_slug", "food_name", "food_category").agg(
        F.count("*").alias("n_exposures"), rounded(F.avg("foods_in_meal"), 1).alias("mean_foods_per_meal"), quart(0.5).alias("iauc_120_median"), quart(0.25).alias("iauc_120_q1"), quart(0.75).alias("iauc_120_q3"),
        rounded(F.min("iauc_120")).alias("iauc_120_min"), rounded(F.max("iauc_120")).alias("iauc_120_max"), rounded(F.median("peak_delta_mgdl")).alias("peak_delta_median"), evidence(F.count("*")).alias("evidence_status"),
    )


def combination_summary(rows: DataFrame) -> DataFrame:
    combos = rows.groupBy("user_id", "meal_id", "iauc_120", "peak_delta_mgdl").agg(F.sort_array(F.collect_set("food_slug")).alias("food_slugs"))
    return combos.groupBy("user_id", "food_slugs").agg(
        F.size(F.first("food_slugs")).alias("n_foods"), F.count("*").alias("n_exposures"), rounded(F.median("iauc_120")).alias("iauc_120_median"), rounded(F.min("iauc_120")).alias("iauc_120_min"),
        rounded(F.max("iauc_120")).alias("iauc_120_max"), rounded(F.median("peak_delta_mgdl")).alias("peak_delta_median"), evidence(F.count("*")).alias("evidence_status"),
    )


def catalog_coverage(items: DataFrame, meals: DataFrame) -> DataFrame:
    done = F.count_if(F.col("food_id").isNotNull())
    return items.join(meals.select("meal_id", "user_id"), "meal_id").groupBy("user_id").agg(
        F.count("*").alias("items_total"), done.alias("items_resolved"), rounded(100.0 * done / F.count("*"), 1).alias("resolved_pct"), F.count_if(F.col("resolution_method") == "manual").alias("confirmed_by_user")
    )


def top_responses(responses: DataFrame, limit: int = 50, qualities: tuple[str, ...] = ()) -> DataFrame:
    """The latest responses (500 at most), of some qualities only if any are named; the report is limited, not its input."""
    rows = responses.where(F.col("quality").isin(*qualities)) if qualities else responses
    return rows.orderBy(F.desc("consumed_at"), "meal_id").limit(min(limit, 500))


def confounding(mean_foods: Column) -> Column:
    """A warning where a food seldom stands alone."""
    return F.when(mean_foods >= 2, F.format_string("shares its meals with %.1f foods on average: no effect can be told apart", mean_foods))


def interpretation(status: Column) -> Column:
    told = {ENOUGH: "enough exposures to report what was observed; not a cause", SOME: "a tendency that shows nothing yet", LITTLE: "single observations; don't interpret"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in told.items() for x in kv]), status)


#: How a reader lists each view; a view itself has no order.
ORDERS = {
    "pairing_daily": ["user_id", "day_local"], "coverage_daily": ["user_id", "day_local"], "food_summary": ["user_id", "-n_exposures", "food_slug"],
    "combination_summary": ["user_id", "-n_exposures", "food_slugs"], "catalog_coverage": ["user_id"], "meal_response": ["user_id", "-consumed_at", "meal_id"],
}


def ordered(rows: DataFrame, view: str) -> DataFrame:
    return rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDERS[view]])
