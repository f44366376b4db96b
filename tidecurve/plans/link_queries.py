"""Named queries on imports, the seed, links and confirmations, over the driver's tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecurve.config import ALGORITHM_VERSION
from tidecurve.functions import text, times
from tidecurve.operators import catalog, upsert
from tidecurve.operators.tables import settled_path
from tidecurve.plans import analysis, proxy, views
from tidecurve.plans.proxy import CFG, SQL
from tidecurve.plans.signal_queries import VERDICT
from tidecurve.sources import nutrients, sensor_csv

QUERIES, SQLS = {}, {}
#: Rows of a written sensor file, about twice as many at most.
FILE_ROWS = 50_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH al AS (SELECT p_name AS n, min(p_partkey) AS food_id, NULL AS owner FROM part GROUP BY 1 UNION ALL SELECT p_name, max(p_partkey), 'ana' FROM part WHERE p_size > 25 GROUP BY 1),
lb AS (SELECT p_partkey AS label_id, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'ana' ELSE 'ben' END AS u FROM part)
SELECT label_id, food_id, CASE WHEN owner IS NULL THEN 'exact_alias' ELSE 'user_alias' END AS method FROM lb JOIN al ON n = p_name AND (owner IS NULL OR owner = u)
""")
def own_alias(spark, sf_dir):
    """A user's own alias counts beside the catalogue's, another user's doesn't."""
    part = _table(spark, sf_dir, "part")
    aliases = part.groupBy(F.col("p_name").alias("normalized")).agg(F.min("p_partkey").alias("food_id")).withColumn("user_id", F.lit(None).cast("string"))
    own = part.where("p_size > 25").groupBy(F.col("p_name").alias("normalized")).agg(F.max("p_partkey").alias("food_id")).withColumn("user_id", F.lit("ana"))
    labels = part.select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("normalized"), F.when(F.col("p_partkey") % 2 == 0, "ana").otherwise("ben").alias("user_id"))
    return catalog.exact_candidates(labels, aliases.unionByName(own), "normalized").select("label_id", "food_id", "method")


#: Items of orders: a food for two parts in three, confidence by the discount; a third of the orders has items, some corrected.
LINKS = """
WITH rs AS (SELECT l_orderkey AS meal_id, l_linenumber, l_partkey, l_discount, l_tax, p_name, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS food, CASE WHEN l_partkey % 3 <> 0 THEN CASE WHEN l_discount >= 0.05 THEN 0.97 ELSE 0.6 END END AS conf
  FROM lineitem JOIN part ON p_partkey = l_partkey),
it AS (SELECT meal_id, l_linenumber AS item_no, p_name AS raw_label, CASE WHEN conf >= 0.95 THEN food END AS food_id, conf, CASE WHEN conf >= 0.95 THEN 'auto_assigned' WHEN conf IS NOT NULL THEN 'needs_confirmation' ELSE 'unresolved' END AS status,
  CASE WHEN conf >= 0.95 THEN 'exact_alias' END AS method, l_partkey, l_discount FROM rs WHERE NOT (meal_id % 3 = 0 AND meal_id % 2 = 0))
"""


def _links(spark, sf_dir):
    known = F.col("l_partkey") % 3 != 0
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct(F.col("p_name").alias("raw"), F.lit(None).cast("double").alias("quantity_value"), F.lit(None).cast("string").alias("quantity_unit"), F.lit(None).cast("string").alias("preparation"))
    resolved = lines.select(
        F.col("l_orderkey").alias("text_id"), F.lit("ana").alias("user_id"), F.col("l_linenumber").alias("item_no"), F.monotonically_increasing_id().alias("part_no"), item.alias("item"), F.when(known, F.col("l_partkey")).alias("food_id"),
        F.when(known, F.when(F.col("l_discount") >= 0.05, 0.97).otherwise(0.6)).alias("confidence"), F.lit("exact_alias").alias("method"),
    )
    existing = _table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("meal_id"), (F.col("o_orderkey") % 2 == 0).alias("user_corrected"))
    return catalog.link_items(resolved, existing, rebuild=True)


@query(LINKS + "SELECT meal_id, item_no, raw_label, food_id, conf AS resolution_confidence, method AS resolution_method, status, count(*) AS n FROM it GROUP BY ALL")
def link_items(spark, sf_dir):
    rows = _links(spark, sf_dir).withColumn("resolution_confidence", F.col("resolution_confidence").cast("decimal(3,2)"))
    return rows.groupBy("meal_id", "item_no", "raw_label", "food_id", "resolution_confidence", "resolution_method", "status").agg(F.count("*").alias("n"))


@query(LINKS + "SELECT count(*) AS items, count(*) FILTER (status = 'auto_assigned') AS auto_assigned, count(*) FILTER (status = 'needs_confirmation') AS needs_confirmation, count(*) FILTER (status = 'unresolved') AS unresolved, round(count(*) FILTER (status = 'auto_assigned') / count(*), 6) AS auto_assign_rate FROM it")
def link_report(spark, sf_dir):
    return catalog.link_report(_links(spark, sf_dir)).withColumn("auto_assign_rate", F.round("auto_assign_rate", 6))


@query(LINKS + "SELECT 'ana' AS user_id, raw_label, count(*) AS n FROM it WHERE food_id IS NULL GROUP BY 2 ORDER BY n DESC, raw_label LIMIT 10")
def pending_labels(spark, sf_dir):
    return catalog.pending(_links(spark, sf_dir), 10)


@query("""
WITH al AS (SELECT p_name AS n, min(p_partkey) AS food_id FROM part GROUP BY 1), it AS (SELECT p_name AS raw_label, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1)
SELECT raw_label, it.n, food_id AS suggestion, 0.97 AS confidence FROM it JOIN al ON al.n = raw_label
""")
def pending_suggestions(spark, sf_dir):
    """Unassigned labels with what their text suggests."""
    part = _table(spark, sf_dir, "part")
    aliases = part.groupBy(F.col("p_name").alias("normalized")).agg(F.min("p_partkey").alias("food_id")).withColumn("user_id", F.lit(None).cast("string"))
    items = part.where("p_size > 10").select(F.lit("ana").alias("user_id"), F.col("p_name").alias("raw_label"), F.lit(None).cast("long").alias("food_id"))
    return catalog.suggested(items, aliases).select("raw_label", "n", "suggestion", F.col("confidence").cast("decimal(3,2)").alias("confidence"))


def _confirmed(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("meal_id"), F.lit(0).alias("item_no"), F.lit(0).alias("part_no"), F.lit("ana").alias("user_id"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("raw_label"),
        F.lit(None).cast("long").alias("food_id"), F.lit(None).cast("string").alias("resolution_method"), F.lit(0.5).alias("resolution_confidence"), F.lit(False).alias("user_corrected"),
    )
    aliases = part.where("p_size = 7").select(F.col("p_partkey").cast("long").alias("food_id"), F.concat("p_name", F.lit(" 7")).alias("normalized"), F.lit("ana").alias("user_id")).dropDuplicates(["normalized"])
    confirmed = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("meal_id"), F.lit(0).alias("item_no"), F.lit(0).alias("part_no"), (F.col("p_partkey") + 1_000_000).cast("long").alias("food_id"))
    return items, *catalog.confirm(items, aliases, confirmed)


@query("SELECT p_partkey AS meal_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1000000 END AS food_id, CASE WHEN p_partkey % 4 = 0 THEN 'manual' END AS resolution_method, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.5 END AS resolution_confidence, p_partkey % 4 = 0 AS user_corrected FROM part")
def confirm_items(spark, sf_dir):
    return _confirmed(spark, sf_dir)[1].select("meal_id", "food_id", "resolution_method", F.col("resolution_confidence").cast("decimal(2,1)").alias("resolution_confidence"), "user_corrected")


@query("WITH l AS (SELECT lower(p_name) || ' ' || p_size AS normalized, min(p_partkey + 1000000) AS food_id FROM part WHERE p_partkey % 4 = 0 GROUP BY 1) SELECT normalized, food_id FROM l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 7 AND p_name || ' 7' = normalized)")
def confirm_learns(spark, sf_dir):
    """Own aliases learned from confirmed labels, where the user had none."""
    return _confirmed(spark, sf_dir)[2].where("food_id >= 1000000").select("normalized", "food_id")


@query("WITH e AS (SELECT p_partkey AS k, 0 AS pos, p_name AS a FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part), n AS (SELECT k, pos, lower(trim(regexp_replace(a, '[^a-zA-Z0-9 ]', ' ', 'g'))) AS normalized FROM e) SELECT normalized, arg_min(k, k * 2 + pos) AS food_id FROM n GROUP BY 1")
def alias_sync(spark, sf_dir):
    """The first claimant wins an alias."""
    entries = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed_no"), F.col("p_partkey").alias("food_id"), F.array("p_name", "p_brand").alias("names"))
    return catalog.alias_table(entries).select("normalized", "food_id")


def _seed(spark, sf_dir):
    """Parts by name as a seed: those of a brand below 13 are recipes of two parts, one of which may be unknown."""
    part = _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("slug")).agg(F.min("p_partkey").alias("seed_no"), F.min("p_brand").alias("category"))
    other = F.when(F.col("seed_no") % 2 == 0, F.lit("nowhere")).otherwise(F.col("slug"))
    components = F.array(F.struct(F.col("slug"), F.lit(0.5).alias("fraction")), F.struct(other.alias("slug"), F.lit(0.25).alias("fraction")))
    return part.select("seed_no", "slug", F.upper("slug").alias("name"), "category", F.lit("hint").alias("hint"), (F.col("category") < "Brand#13").alias("is_recipe"), components.alias("components"))


def _seeded(spark, sf_dir):
    seed = _seed(spark, sf_dir)
    stored = seed.where("seed_no % 2 = 0").select(F.col("seed_no").cast("long").alias("food_id"), "slug", F.lit("old").alias("name"), "category", "hint", F.lit(False).alias("is_recipe"))
    stored = stored.unionByName(stored.limit(1).select(F.lit(-5).cast("long").alias("food_id"), F.lit("only stored").alias("slug"), "name", F.lit("none").alias("category"), "hint", "is_recipe"))
    return seed, catalog.upsert_foods(stored, seed)


SEED = """
WITH s AS (SELECT p_name AS slug, min(p_partkey) AS k, min(p_brand) AS category FROM part GROUP BY 1), top AS (SELECT max(k) AS top FROM s WHERE k % 2 = 0),
f AS (SELECT CASE WHEN k % 2 = 0 THEN k ELSE top + row_number() OVER (PARTITION BY k % 2 ORDER BY k) END AS food_id, slug, upper(slug) AS name, category, category < 'Brand#13' AS is_recipe, k FROM s, top)
"""


@query(SEED + "SELECT food_id, slug, name, category, is_recipe FROM f UNION ALL SELECT -5, 'only stored', 'old', 'none', false")
def seed_foods(spark, sf_dir):
    return _seeded(spark, sf_dir)[1].select("food_id", "slug", "name", "category", "is_recipe")


@query(SEED + "SELECT food_id AS recipe_food_id, food_id AS component_food_id, slug AS component_slug, 0.5 AS mass_fraction FROM f WHERE is_recipe UNION ALL SELECT food_id, CASE WHEN k % 2 <> 0 THEN food_id END, CASE WHEN k % 2 = 0 THEN 'nowhere' ELSE slug END, 0.25 FROM f WHERE is_recipe")
def recipe_rows(spark, sf_dir):
    seed, foods = _seeded(spark, sf_dir)
    return catalog.recipe_components(seed, foods).withColumn("mass_fraction", F.col("mass_fraction").cast("decimal(3,2)"))


@query(SQL + VERDICT + "SELECT meal_id, quality FROM qual WHERE meal_id % 3 <> 0")
def incremental(spark, sf_dir):
    """Meals with a row of this algorithm version are left out; rows of another version don't count."""
    meals = proxy.meals(spark, sf_dir)
    version = F.when(F.col("meal_id") % 3 == 0, ALGORITHM_VERSION).otherwise("older")
    return analysis.analyze(meals, *proxy.settled_base(spark, sf_dir), existing=meals.select("meal_id", version.alias("algorithm_version")), cfg=CFG).select("meal_id", "quality")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice WHEN 2 THEN o_totalprice END AS x FROM orders")
def lenient_number(spark, sf_dir):
    """Decimal points, decimal commas, thousands with commas, and no number."""
    price, k = F.col("o_totalprice").cast("decimal(12,2)"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, price.cast("string")).when(k == 1, F.replace(price.cast("string"), F.lit("."), F.lit(","))).when(k == 2, F.concat(F.lit(" "), F.format_number(price, 2))).otherwise("n/a")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.lenient_number(raw).alias("x"))


@query("SELECT event_id, CAST(epoch_us(date_trunc('minute', ts)) AS BIGINT) AS us FROM events")
def two_digit_years(spark, sf_dir):
    e = proxy.events(spark, sf_dir).select("event_id", times.date_parts(F.date_format("ts", "dd/MM/yy HH:mm")).alias("p"))
    return e.select("event_id", F.unix_micros(times.assembled(F.col("p"), "DMY").cast("timestamp")).alias("us"))


@query("SELECT user_id::VARCHAR AS path, CASE user_id % 4 WHEN 0 THEN 'DMY' WHEN 1 THEN 'MDY' WHEN 2 THEN 'YMD' END AS date_order, CASE WHEN user_id % 4 = 3 THEN 'mixed' ELSE 'firm' END AS how FROM events GROUP BY user_id HAVING max(day(ts)) > 12 AND (user_id % 4 <> 3 OR count(DISTINCT event_id % 2) FILTER (day(ts) > 12) = 2)")
def date_orders(spark, sf_dir):
    """Files of each order and files that mix two; users without late days are left out, as they can't tell."""
    k = F.col("user_id") % 4
    e = proxy.events(spark, sf_dir)
    enough = e.groupBy("user_id").agg(F.max(F.dayofmonth("ts")).alias("d"), F.count_distinct(F.when(F.dayofmonth("ts") > 12, F.col("event_id") % 2)).alias("both")).where((F.col("d") > 12) & ((k != 3) | (F.col("both") == 2)))
    mixed = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd-MM-yyyy HH:mm")).otherwise(F.date_format("ts", "MM-dd-yyyy HH:mm"))
    raw = F.when(k == 0, F.date_format("ts", "dd-MM-yyyy HH:mm")).when(k == 1, F.date_format("ts", "MM/dd/yyyy h:mm a")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(mixed)
    rows = e.join(enough.select("user_id"), "user_id", "left_semi").select(F.col("user_id").cast("string").alias("path"), raw.alias("raw"))
    return sensor_csv.date_orders(rows).select("path", "date_order", "how")


@query("SELECT user_id::VARCHAR AS path, count(*) FILTER (event_id % 5 = 0) AS n_skipped, count(*) FILTER (event_id % 5 = 1) AS n_ambiguous FROM events GROUP BY 1")
def zone_counts(spark, sf_dir):
    """Wall clocks that New York skips, has twice, or has once."""
    k = F.col("event_id") % 5
    day = F.when(k == 0, "2026-03-08 02:").when(k == 1, "2026-11-01 01:").otherwise("2026-06-01 01:")
    wall = F.to_timestamp_ntz(F.concat(day, F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")), F.lit("yyyy-MM-dd HH:mm"))
    walls = proxy.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), wall.alias("wall"))
    return sensor_csv.zone_counts(walls, "America/New_York").select("path", "n_skipped", "n_ambiguous")


@query("""
SELECT sha256('SYN' || user_id) AS session_id, count(*) AS n, round(sum(round(value, 2) * CASE WHEN user_id % 2 = 0 THEN 18.0182 ELSE 1 END), 2) AS total, CAST(min(epoch_us(date_trunc('minute', ts))) AS BIGINT) AS first_us, CAST(max(epoch_us(date_trunc('minute', ts))) AS BIGINT) AS last_us FROM events GROUP BY user_id
""")
def sensor_files(spark, sf_dir):
    """Events written as sensor files (two units, day-first dates, a semicolon between fields, an odd first line) and read back."""
    e = proxy.events(spark, sf_dir)
    folder = settled_path(spark, "sensor")
    even = F.col("user_id") % 2 == 0
    row = F.concat_ws(";", F.lit("Synthetic"), F.concat(F.lit("SYN"), "user_id"), F.date_format("ts", "dd-MM-yyyy HH:mm"), F.round("value", 2).cast("string"))
    # A file has the sensors of many users of one unit: files are as many as the rows ask for, and a user's rows are in one of them.
    place = [even.cast("int").alias("even"), F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-e.count() // FILE_ROWS)))).alias("part")]
    rows = e.select(*place, row.alias("line"), F.lit(2).alias("place"))
    top = e.select(*place).distinct()
    named = F.when(F.col("even") == 1, "Historic Glucose mmol/L").otherwise("Historico de glucosa mg/dL")
    head = top.select("even", "part", F.posexplode(F.array(F.lit("Export of sensors"), F.concat(F.lit("Device;Serial Number;Device Timestamp;"), named))).alias("place", "line"))
    files = head.select("even", "part", "line", "place").unionByName(rows).repartition("even", "part").sortWithinPartitions("even", "part", "place")
    files.select("even", "part", "line").write.partitionBy("even", "part").text(folder)  # a file for each: one header each
    readings, _, _ = sensor_csv.parse(spark, f"{folder}/*/*/*.txt", "UTC")
    return readings.where("source_record = 'historic'").groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query(f"SELECT user_id, CASE WHEN n >= 8 THEN 'enough exposures to report what was observed; not a cause' WHEN n >= 4 THEN 'a tendency that shows nothing yet' ELSE 'single observations; don''t interpret' END AS told, CASE WHEN m >= 2 THEN 'shares its meals with ' || printf('%.1f', m) || ' foods on average: no effect can be told apart' END AS warning FROM (SELECT o_custkey AS user_id, count(*) AS n, CAST(count(*) % 40 AS DOUBLE) / 10 AS m FROM orders GROUP BY 1)")
def evidence_texts(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n")).withColumn("m", (F.col("n") % 40).cast("double") / 10)
    return n.select("user_id", views.interpretation(views.evidence(F.col("n"))).alias("told"), views.confounding(F.col("m")).alias("warning"))


@query("""
WITH f AS (SELECT 'ana' AS user_id, o_orderkey AS path, o_orderpriority || o_custkey AS sha, CAST(floor(o_totalprice) AS BIGINT) % 50 AS found FROM orders), st AS (SELECT DISTINCT sha FROM f WHERE path % 10 = 0)
SELECT path, row_number() OVER (PARTITION BY sha ORDER BY path) > 1 OR sha IN (SELECT sha FROM st) AS duplicate_file, found, found // 2 AS inserted, found - found // 2 AS duplicate FROM f
""")
def batch_lineage(spark, sf_dir):
    """Orders as imported files: one repeats another if it has the customer and priority of one before or of a stored one."""
    files = _table(spark, sf_dir, "orders").select(F.lit("ana").alias("user_id"), F.col("o_orderkey").alias("path"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("content_sha256"))
    found = (F.expr("cast(floor(o_totalprice) as bigint)") % 50).alias("found")
    counts = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), found).withColumn("inserted", F.expr("found div 2"))
    return upsert.lineage(files, files.where("path % 10 = 0"), counts).select("path", "duplicate_file", "found", "inserted", "duplicate")


@query("WITH p AS (SELECT * FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT user_id, ts FROM p WHERE event_id % 3 = 0) SELECT count(*) AS found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.ts = p.ts)) AS inserted, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.ts = p.ts)) AS duplicate FROM p")
def import_counters(spark, sf_dir):
    e = proxy.events(spark, sf_dir).where("event_type = 'view'")
    return upsert.import_counts(e, upsert.new_only(e, e.where("event_id % 3 = 0").select("user_id", "ts").distinct(), ["user_id", "ts"]))


@query("WITH p AS (SELECT * FROM events WHERE event_type = 'view'), m AS (SELECT user_id, ts, CASE WHEN event_id % 2 = 0 THEN value END AS carbs, CASE WHEN event_id % 5 = 0 THEN 'note' END AS note FROM p WHERE event_id % 3 <> 0) SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, carbs, CASE WHEN note IS NOT NULL THEN 0.3 ELSE 0.15 END AS completeness, carbs IS NOT NULL AS has_item FROM m ANTI JOIN (SELECT DISTINCT user_id, ts FROM p WHERE event_id % 3 = 0) USING (user_id, ts)")
def food_log(spark, sf_dir):
    """Views as food-log rows: times that are stored are skipped; those with carbohydrates have an item."""
    e = proxy.events(spark, sf_dir).where("event_type = 'view'")
    entries = e.where("event_id % 3 <> 0").select("user_id", "ts", F.lit(0).alias("tz_offset_min"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("carbs_grams"), F.lit(None).cast("double").alias("carbs_servings"), F.when(F.col("event_id") % 5 == 0, "note").alias("note"))
    stored = e.where("event_id % 3 = 0").select("user_id", F.col("ts").alias("consumed_at"), F.lit("food_log").alias("source"))
    meals = upsert.food_log_meals(entries, stored)
    items = upsert.carb_items(meals).select("meal_id", F.lit(True).alias("has_item"))
    return meals.join(items, "meal_id", "left").select("user_id", F.unix_micros("consumed_at").alias("us"), F.col("carbs_g").alias("carbs"), F.col("entry_completeness").cast("decimal(3,2)").alias("completeness"), F.coalesce("has_item", F.lit(False)).alias("has_item"))


@query("SELECT o_orderkey AS meal_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS told FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0")
def response_sink(spark, sf_dir):
    """Rows of the keys computed anew replace the stored ones."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meal_id"))
    return upsert.replace_keys(o.where("meal_id % 3 = 0").withColumn("told", F.lit("old")), o.where("meal_id % 4 = 0").withColumn("told", F.lit("new")), ["meal_id"])


@query("SELECT user_id, event_id FROM events e WHERE event_type <> 'view' AND EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND sha256(v.props) = sha256(e.props))")
def seen_before(spark, sf_dir):
    e = proxy.events(spark, sf_dir).withColumn("content_sha256", F.sha2("props", 256))
    return upsert.seen_before(e.where("event_type <> 'view'"), e.where("event_type = 'view'").select("user_id", "content_sha256")).select("user_id", "event_id")


@query("SELECT p_partkey AS food_id FROM part WHERE p_size > 5 AND p_brand >= 'Brand#13' AND p_partkey % 3 <> 0 ORDER BY p_name || p_partkey LIMIT 40")
def wanted_foods(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    foods = part.select(F.col("p_partkey").alias("food_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("slug"), F.when(F.col("p_size") > 5, "hint").alias("hint"), (F.col("p_brand") < "Brand#13").alias("is_recipe"))
    return nutrients.wanted_foods(foods, part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("food_id")), limit=40).select("food_id")


@query("SELECT p_partkey AS food_id, 'protein' AS nutrient, CAST(p_size AS DOUBLE) AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS source FROM part")
def nutrient_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"), F.lit("protein").alias("nutrient"), F.col("p_size").cast("double").alias("amount"), F.lit("g").alias("unit"))
    stored = rows.withColumn("source", F.lit("old"))
    return nutrients.upsert_nutrients(stored, rows.where("food_id % 2 = 0"), "new").select("food_id", "nutrient", "amount", "source")


@query("SELECT p_partkey AS food_id, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END || p_partkey AS external_id FROM part")
def nutrient_sources(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("food_id"))
    named = lambda x: F.concat(F.lit(x), F.col("food_id").cast("string")).alias("external_id")
    stored = rows.select("food_id", F.lit("s").alias("source"), named("y"))
    return nutrients.source_map(stored, rows.where("food_id % 2 = 0").select("food_id", named("x")), "s").select("food_id", "external_id")
