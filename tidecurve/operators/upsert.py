"""Idempotent writes as joins: first-wins deduplication, new rows only, merged sessions, replaced keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecurve.functions.times import to_utc


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; order should be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def new_only(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(stored.select(*keys), keys, "left_anti")


def merge_readings(readings: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The readings to append: historic before other records of the same (user, time, session), none that is stored."""
    keys = ["user_id", "ts", "session_id"]
    rank = F.when(F.col("source_record") == "historic", 0).when(F.col("source_record") == "scan", 1).otherwise(2)
    fresh = first_of(readings, keys, [rank, F.col("value")])
    return fresh if stored is None else new_only(fresh, stored, keys)


def merge_sessions(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions after an import: earliest start, latest end, the later resolution, the larger count."""
    both = stored.withColumn("__late", F.lit(0)).unionByName(found.withColumn("__late", F.lit(1)))
    return both.groupBy(*keys).agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.max(F.struct("__late", "resolution"))["resolution"].alias("resolution"), F.max("n_readings").alias("n_readings"))


def replace_keys(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of the given keys replaced."""
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def food_log_meals(entries: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Meals of food-log rows (user_id, ts, tz_offset_min, carbs_grams, carbs_servings, note) whose time isn't stored from this source yet."""
    full = F.when(F.col("note").isNotNull(), 0.3).otherwise(0.15)
    meals = entries.select("user_id", F.col("ts").alias("consumed_at"), "tz_offset_min", F.col("note").alias("free_text"), F.col("carbs_grams").alias("carbs_g"), F.lit("food_log").alias("source"), full.alias("entry_completeness"))
    meals = meals.withColumn("meal_id", F.sha2(F.concat_ws("|", "user_id", "consumed_at", "source", F.coalesce("free_text", F.lit("")), F.coalesce(F.col("carbs_g").cast("string"), F.lit(""))), 256))
    return meals if stored is None else meals.join(stored.where("source = 'food_log'").select("user_id", "consumed_at"), ["user_id", "consumed_at"], "left_anti")


def carb_items(meals: DataFrame) -> DataFrame:
    """The item of each food-log meal that tells carbohydrates: their grams as a quantity."""
    return meals.where("carbs_g is not null").select("meal_id", "user_id", F.lit(0).alias("item_no"), F.lit("carbohydrate").alias("raw_label"), F.col("carbs_g").alias("quantity_value"), F.lit("g").alias("quantity_unit"))


def single_meal(spark: SparkSession, user_id: str, wall: str, zone: str, free_text: str, meal_type: str = "unknown") -> DataFrame:
    """One meal at a local time 'YYYY-MM-DD HH:MM', as a row to append."""
    local = F.to_timestamp_ntz(F.lit(wall), F.lit("yyyy-MM-dd HH:mm"))
    at = to_utc(local, zone)
    offset = ((F.unix_micros(local.cast("timestamp")) - F.unix_micros(at)) / 6e7).cast("short")
    row = spark.range(1).select(F.lit(user_id).alias("user_id"), at.alias("consumed_at"), offset.alias("tz_offset_min"), F.lit(free_text).alias("free_text"), F.lit(meal_type).alias("meal_type"), F.lit("manual").alias("source"))
    return row.withColumn("meal_id", F.sha2(F.concat_ws("|", "user_id", "consumed_at", "source", "free_text"), 256))


def lineage(files: DataFrame, stored: DataFrame | None, counts: DataFrame) -> DataFrame:
    """A row for each imported file (user_id, path, content_sha256, rows): its counts (path, found, inserted) and duplicate_file, whether
    the user has imported the same content before or under an earlier path of this import."""
    repeat = F.row_number().over(Window.partitionBy("user_id", "content_sha256").orderBy("path")) > 1
    rows = files.withColumn("__again", repeat)
    if stored is None:
        rows = rows.withColumn("__seen", F.lit(False))
    else:
        rows = rows.join(stored.select("user_id", "content_sha256").distinct().withColumn("__seen", F.lit(True)), ["user_id", "content_sha256"], "left")
    rows = rows.withColumn("duplicate_file", F.col("__again") | F.coalesce("__seen", F.lit(False))).drop("__again", "__seen").join(counts, "path", "left").fillna(0, ["found", "inserted"])
    return rows.withColumn("duplicate", F.col("found") - F.col("inserted"))


def import_counts(parsed: DataFrame, appended: DataFrame) -> DataFrame:
    """One row: found, inserted, duplicate."""
    return parsed.agg(F.count("*").alias("found")).crossJoin(appended.agg(F.count("*").alias("inserted"))).withColumn("duplicate", F.col("found") - F.col("inserted"))


def seen_before(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches whose content (sha256) the user imported already."""
    return batches.join(stored, ["user_id", "content_sha256"], "left_semi")
