"""Named queries on the order model: an order is a meal, its lines are items, a part's name is a food; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecurve.operators import catalog, upsert
from tidecurve.plans import proxy, signal_queries, views
from tidecurve.plans.proxy import SQL
from tidecurve.plans.signal_queries import VERDICT

QUERIES, SQLS = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


OFFSET = -360
#: The order model in DuckDB: mr (meals with responses), mf (their foods).
MEALS = """
WITH mr AS (SELECT o_orderkey AS meal_id, o_custkey AS user_id, o_orderdate - INTERVAL 360 MINUTE AS at_local, o_totalprice AS iauc_120, o_totalprice / 4 AS peak_delta_mgdl,
  CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'degraded' ELSE 'excluded' END AS quality, o_orderdate AS consumed_at FROM orders),
mf AS (SELECT mr.*, p_name AS food_slug, p_brand AS food_category, l_quantity FROM mr JOIN lineitem ON l_orderkey = meal_id JOIN part ON p_partkey = l_partkey WHERE quality IN ('ok', 'degraded'))
"""
DEC = "CAST(round(CAST({} AS DECIMAL(38,10)), {}) AS DOUBLE)"
EVIDENCE = f"CASE WHEN count(*) >= 8 THEN '{views.ENOUGH}' WHEN count(*) >= 4 THEN '{views.SOME}' ELSE '{views.LITTLE}' END"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meals(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    meals = o.select(F.col("o_orderkey").alias("meal_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("consumed_at"), F.lit(OFFSET).alias("tz_offset_min"))
    quality = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "degraded").otherwise("excluded")
    responses = o.select(F.col("o_orderkey").alias("meal_id"), F.col("o_totalprice").alias("iauc_120"), (F.col("o_totalprice") / 4).alias("peak_delta_mgdl"), quality.alias("quality"))
    return views.meal_response(meals, responses)


def _meal_foods(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meal_id"), F.col("l_partkey").alias("food_id"), F.col("l_quantity").alias("quantity_value"))
    foods = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), F.col("p_name").alias("food_slug"), F.col("p_name").alias("food_name"), F.col("p_brand").alias("food_category"))
    return views.meal_foods(_meals(spark, sf_dir), items, foods)


@query(MEALS + "SELECT meal_id, user_id, CAST(hour(at_local) AS INT) AS hour_local, strftime(at_local, '%Y-%m-%d %H:%M:%S') AS consumed_at_local, iauc_120, quality FROM mr")
def meal_response_view(spark, sf_dir):
    return _meals(spark, sf_dir).select("meal_id", "user_id", "hour_local", F.date_format("consumed_at_local", "yyyy-MM-dd HH:mm:ss").alias("consumed_at_local"), "iauc_120", "quality")


@query(SQL + VERDICT + ", q AS (SELECT user_id, strftime(make_timestamp(us), '%Y-%m-%d') AS day_local, quality FROM qual) SELECT user_id, day_local, count(*) AS meals, count(*) FILTER (quality <> 'excluded') AS usable, count(*) FILTER (quality = 'excluded') AS excluded, " + DEC.format("100.0 * count(*) FILTER (quality <> 'excluded') / count(*)", 1) + " AS pairing_valid_pct FROM q GROUP BY 1, 2")
def pairing_daily(spark, sf_dir):
    rows = signal_queries._analyzed(spark, sf_dir).withColumn("consumed_at_local", F.col("consumed_at"))
    return views.pairing_daily(rows).withColumn("day_local", F.col("day_local").cast("string"))


@query(SQL + ", q AS (SELECT user_id, strftime(make_timestamp(us) - INTERVAL 360 MINUTE, '%Y-%m-%d') AS day_local, resolution, f_range + f_rate + f_warm + f_low AS flags FROM fl) SELECT user_id, day_local, count(*) AS readings, " + DEC.format("100.0 * count(*) / (1440.0 / max(resolution))::DOUBLE", 1) + " AS coverage_pct, count(*) FILTER (flags <> 0) AS flagged, max(resolution) AS resolution_min FROM q GROUP BY 1, 2")
def coverage_daily(spark, sf_dir):
    r = proxy.flagged(spark, sf_dir).drop("resolution").withColumn("source_record", F.lit("historic")).withColumn("tz_offset_min", F.lit(OFFSET))
    return views.coverage_daily(r, proxy.sessions(spark, sf_dir)).withColumn("day_local", F.col("day_local").cast("string"))


@query(MEALS + "SELECT user_id, meal_id, food_slug, food_category, iauc_120, l_quantity AS quantity_value FROM mf")
def meal_foods(spark, sf_dir):
    return _meal_foods(spark, sf_dir).select("user_id", "meal_id", "food_slug", "food_category", "iauc_120", "quantity_value")


@query(MEALS + ", c AS (SELECT *, count(*) OVER (PARTITION BY meal_id) AS k FROM mf) SELECT user_id, food_slug, food_slug AS food_name, food_category, count(*) AS n_exposures, " + DEC.format("avg(k)", 1) + " AS mean_foods_per_meal, "
       + ", ".join(DEC.format(f"quantile_cont(iauc_120, {p})", 0) + f" AS iauc_120_{n}" for p, n in ((0.5, "median"), (0.25, "q1"), (0.75, "q3")))
       + ", " + DEC.format("min(iauc_120)", 0) + " AS iauc_120_min, " + DEC.format("max(iauc_120)", 0) + " AS iauc_120_max, " + DEC.format("median(peak_delta_mgdl)", 0) + f" AS peak_delta_median, {EVIDENCE} AS evidence_status FROM c GROUP BY 1, 2, 3, 4")
def food_summary(spark, sf_dir):
    return views.food_summary(_meal_foods(spark, sf_dir))


@query(MEALS + ", c AS (SELECT user_id, meal_id, iauc_120, peak_delta_mgdl, string_agg(DISTINCT food_slug, '|' ORDER BY food_slug) AS food_slugs, count(DISTINCT food_slug) AS k FROM mf GROUP BY 1, 2, 3, 4) SELECT user_id, food_slugs, CAST(any_value(k) AS INT) AS n_foods, count(*) AS n_exposures, "
       + DEC.format("median(iauc_120)", 0) + " AS iauc_120_median, " + DEC.format("min(iauc_120)", 0) + " AS iauc_120_min, " + DEC.format("max(iauc_120)", 0) + " AS iauc_120_max, " + DEC.format("median(peak_delta_mgdl)", 0) + f" AS peak_delta_median, {EVIDENCE} AS evidence_status FROM c GROUP BY 1, 2")
def combination_summary(spark, sf_dir):
    return views.combination_summary(_meal_foods(spark, sf_dir)).withColumn("food_slugs", F.array_join("food_slugs", "|"))


@query("SELECT o_custkey AS user_id, count(*) AS items_total, count(p_partkey) AS items_resolved, " + DEC.format("100.0 * count(p_partkey) / count(*)", 1) + " AS resolved_pct, count(*) FILTER (p_partkey IS NOT NULL AND l_linenumber = 1) AS confirmed_by_user FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL') ON p_partkey = l_partkey GROUP BY 1")
def catalog_coverage(spark, sf_dir):
    """Here the catalogue knows the parts of all types but one; first lines are confirmed by hand."""
    known = _table(spark, sf_dir, "part").where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("food_id"))
    items = _table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left")
    method = F.when(F.col("food_id").isNotNull() & (F.col("l_linenumber") == 1), "manual")
    return views.catalog_coverage(items.select(F.col("l_orderkey").alias("meal_id"), "food_id", method.alias("resolution_method")), _meals(spark, sf_dir))


@query(MEALS + "SELECT meal_id, user_id, quality, iauc_120 FROM mr WHERE quality IN ('ok', 'degraded') ORDER BY consumed_at DESC, meal_id LIMIT 50")
def top_responses(spark, sf_dir):
    return views.top_responses(_meals(spark, sf_dir), 50, views.USABLE).select("meal_id", "user_id", "quality", "iauc_120")


@query("SELECT l_orderkey AS recipe_food_id, round(sum(l_discount), 4) AS total, abs(round(sum(l_discount), 4) - 1) > 0.01 AS off FROM lineitem GROUP BY 1")
def recipe_sum(spark, sf_dir):
    parts = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recipe_food_id"), F.col("l_discount").alias("mass_fraction"))
    sums = catalog.recipe_sums(parts)
    return sums.select("recipe_food_id", F.round("total", 4).alias("total"), (F.abs(F.round("total", 4) - 1) > 0.01).alias("off"))


@query("SELECT count(*) AS foods, count(*) FILTER (p_size > 25) AS recipes, count(DISTINCT p_name) AS aliases, count(DISTINCT p_brand) AS categories FROM part")
def catalog_stats(spark, sf_dir):
    return _table(spark, sf_dir, "part").agg(F.count("*").alias("foods"), F.count_if(F.col("p_size") > 25).alias("recipes"), F.countDistinct("p_name").alias("aliases"), F.countDistinct("p_brand").alias("categories"))


@query("SELECT user_id, event_type AS session_id, strftime(ts, '%Y-%m-%d %H') AS hour, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY value, event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(spark, sf_dir):
    e = proxy.events(spark, sf_dir).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    first = upsert.first_of(e, ["user_id", "event_type", "hour"], [F.col("value"), F.col("event_id")])
    return first.select("user_id", F.col("event_type").alias("session_id"), "hour", "event_id")


@query("WITH k AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'view') SELECT event_id FROM events e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = e.user_id AND k.d = strftime(e.ts, '%Y-%m-%d'))")
def anti_new_only(spark, sf_dir):
    e = proxy.events(spark, sf_dir).withColumn("d", F.date_format("ts", "yyyy-MM-dd"))
    return upsert.new_only(e.where("event_type <> 'view'"), e.where("event_type = 'view'").select("user_id", "d").distinct(), ["user_id", "d"]).select("event_id")


@query("""
WITH h AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS late, count(*) AS n, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events GROUP BY 1, 2)
SELECT user_id, min(lo) AS started_us, max(hi) AS ended_us, CAST(arg_max(n, late) AS BIGINT) AS resolution, max(n) AS n_readings FROM h GROUP BY 1
""")
def session_upsert(spark, sf_dir):
    """Two imports of a user's session, here views and all else; a count stands for the resolution."""
    e = proxy.events(spark, sf_dir)
    half = lambda rows: rows.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("resolution"), F.count("*").alias("n_readings"))
    merged = upsert.merge_sessions(half(e.where("event_type = 'view'")), half(e.where("event_type <> 'view'")), ["user_id"])
    return merged.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "resolution", "n_readings")
