"""Named queries on texts, labels, payloads and dates; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecurve.functions import text, times
from tidecurve.operators import catalog
from tidecurve.plans import proxy
from tidecurve.sources import nutrients, sensor_csv

QUERIES, SQLS = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_sql(x: str) -> str:
    bare = rf"regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]', ' ', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


STOP = "('" + "','".join(text.STOPWORDS) + "')"
#: Labels of items: a count, a unit (or none) and a food, from order lines.
UNIT_WORDS = ("tazas de", "cucharadas de", "", "rebanadas de", "grandes", "g de", "piezas de")
LABEL = "CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{w}{' ' if w else ''}'" for i, w in enumerate(UNIT_WORDS)) + " ELSE '' END || p_name || CASE WHEN p_size > 25 THEN ' a la plancha' WHEN p_size > 10 THEN ' fritos' ELSE '' END"


def _labels(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.lit("")
    for i, w in enumerate(UNIT_WORDS):
        unit = F.when(F.col("l_linenumber") == i + 1, w + (" " if w else "")).otherwise(unit)
    tail = F.when(F.col("p_size") > 25, " a la plancha").when(F.col("p_size") > 10, " fritos").otherwise("")
    return lines.select(F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit, F.col("p_name"), tail).alias("label"))


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normalized_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normalized_md5"))


@query(f"WITH n AS (SELECT conv_id, turn, {norm_sql('text')} AS t FROM conversations) SELECT conv_id, turn, coalesce(nullif(array_to_string(list_filter(string_split(t, ' '), lambda w: w NOT IN {STOP} AND w <> ''), ' '), ''), t) AS stripped FROM n")
def stopwords(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_stopwords(text.normalize(F.col("text"))).alias("stripped"))


@query(rf"""WITH t AS (SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN string_agg(p_name, ', ' ORDER BY l_linenumber, p_name) WHEN 1 THEN string_agg(p_name, ' y ' ORDER BY l_linenumber, p_name) ELSE string_agg(p_name, ' + ' ORDER BY l_linenumber, p_name) END AS x FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, CAST(i - 1 AS INT) AS item_no, p[i] AS item FROM (SELECT l_orderkey, list_filter(list_transform(regexp_split_to_array(x, '(?i)\s*(?:,|;|\+|\||\by\b|\be\b|/)\s*'), lambda s: trim(s)), lambda s: s <> '') AS p FROM t), range(1, 100) r(i) WHERE i <= len(p)""")
def split_items(spark, sf_dir):
    """Items of a meal told as one text, with three ways to part them."""
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("n"))
    by = F.when(F.col("l_orderkey") % 3 == 0, ", ").when(F.col("l_orderkey") % 3 == 1, " y ").otherwise(" + ")
    told = F.aggregate("n", F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["p_name"]).otherwise(F.concat(acc, by, x["p_name"])))
    return names.select("l_orderkey", F.posexplode(text.split_items(told)).alias("item_no", "item"))


@query(rf"""WITH t AS (SELECT l_orderkey, l_linenumber, {LABEL} AS label FROM lineitem JOIN part ON p_partkey = l_partkey),
q AS (SELECT *, regexp_extract(label, '^\s*(\d+(?:[.,]\d+)?)(?:\s*([a-zA-Zñáéíóú]+))?\s+(.+)$', 1) AS num, lower(regexp_extract(label, '^\s*(\d+(?:[.,]\d+)?)(?:\s*([a-zA-Zñáéíóú]+))?\s+(.+)$', 2)) AS word, trim(regexp_extract(label, '^\s*(\d+(?:[.,]\d+)?)(?:\s*([a-zA-Zñáéíóú]+))?\s+(.+)$', 3)) AS rest FROM t),
u AS (SELECT *, CASE {" ".join(f"WHEN word IN ({', '.join(repr(w) for w in words)}) THEN '{unit}'" for unit, words in text.UNITS.items())} END AS unit FROM q)
SELECT l_orderkey, l_linenumber, label, CAST(num AS DOUBLE) AS quantity_value, unit AS quantity_unit, CASE WHEN word <> '' AND unit IS NULL THEN word || ' ' || rest ELSE rest END AS rest FROM u""")
def quantity(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("q", text.quantity(F.col("label")))
    return rows.select("l_orderkey", "l_linenumber", "label", F.col("q.value").alias("quantity_value"), F.col("q.unit").alias("quantity_unit"), F.col("q.rest").alias("rest"))


@query(rf"""WITH t AS (SELECT l_orderkey, l_linenumber, {norm_sql(LABEL)} AS n, {LABEL} AS label FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, label, CASE {" ".join(rf"WHEN regexp_matches(n, '\b{w}\b') THEN '{p}'" for p, words in text.PREPARATIONS.items() for w in words)} END AS preparation FROM t""")
def preparation(spark, sf_dir):
    return _labels(spark, sf_dir).select("l_orderkey", "l_linenumber", "label", text.preparation(text.normalize(F.col("label"))).alias("preparation"))


def _aliases(spark, sf_dir):
    part = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("food_id"))
    return part.select("food_id", text.normalize(F.col("p_name")).alias("normalized"), F.lit(None).cast("string").alias("user_id"))


TYPOS = """
WITH al AS (SELECT p_name AS alias, min(p_partkey) AS food_id FROM part GROUP BY 1),
lb AS (SELECT DISTINCT replace(replace(p_name, 'e', 'a'), 't', '') AS label FROM part),
ga AS (SELECT alias, unnest(list_distinct(flatten(list_transform(string_split(alias, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM al),
gl AS (SELECT label, unnest(list_distinct(flatten(list_transform(string_split(label, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM lb),
na AS (SELECT alias, count(*) AS m FROM ga GROUP BY 1), nl AS (SELECT label, count(*) AS n FROM gl GROUP BY 1),
sim AS (SELECT label, alias, count(*) / (any_value(n) + any_value(m) - count(*)) AS sim FROM gl JOIN ga USING (g) JOIN na USING (alias) JOIN nl USING (label) GROUP BY 1, 2),
top AS (SELECT label, alias, food_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, alias, food_id) AS k FROM sim JOIN al USING (alias) WHERE CAST(sim AS FLOAT) >= 0.45)
"""


@query(TYPOS + ", best AS (SELECT label, food_id, max(sim) AS sim, min(alias) AS alias FROM top WHERE k <= 15 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, alias, food_id) AS k FROM best) SELECT label, food_id, round(least(0.9, sim), 6) AS confidence FROM r WHERE k <= 5")
def trigram_fuzzy(spark, sf_dir):
    labels = _table(spark, sf_dir, "part").select(F.replace(F.replace("p_name", F.lit("e"), F.lit("a")), F.lit("t"), F.lit("")).alias("normalized")).distinct()
    labels = labels.select(F.col("normalized").alias("label_id"), "normalized", F.lit(None).cast("string").alias("user_id"))
    return catalog.fuzzy_candidates(labels, _aliases(spark, sf_dir)).select(F.col("label_id").alias("label"), "food_id", F.round("confidence", 6).alias("confidence"))


@query("""
WITH al AS (SELECT p_name AS alias, min(p_partkey) AS food_id FROM part GROUP BY 1),
lb AS (SELECT p_partkey AS label_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'la ' || p_name ELSE 'los de ' || p_name || '!' END AS label, p_name FROM part)
SELECT label_id, food_id, 0.97 AS confidence, 'exact_alias' AS method FROM lb JOIN al ON alias = p_name
""")
def exact_cascade(spark, sf_dir):
    """Names in capitals, with articles and marks: each is found, some only without stop words."""
    name, k = F.col("p_name"), F.col("p_partkey") % 3
    label = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.lit("la "), name)).otherwise(F.concat(F.lit("los de "), name, F.lit("!")))
    labels = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label_id"), F.lit(None).cast("string").alias("user_id"), label.alias("label"))
    return catalog.resolve_labels(labels, _aliases(spark, sf_dir)).select("label_id", "food_id", F.col("confidence").cast("decimal(3,2)").alias("confidence"), "method").withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


@query("""
WITH al AS (SELECT p_name AS alias, min(p_partkey) AS food_id FROM part GROUP BY 1),
tx AS (SELECT p_partkey AS text_id, p_name AS a, (SELECT min(p_name) FROM part) AS b FROM part),
parts AS (SELECT text_id, 0 AS part_no, a AS p FROM tx UNION ALL SELECT text_id, 1, b FROM tx)
SELECT CAST(text_id AS VARCHAR) AS text_id, CAST(part_no AS INT) AS part_no, p AS label, food_id FROM parts JOIN al ON alias = p
""")
def connector_split(spark, sf_dir):
    """Two foods told as 'a con b': no alias as a whole, so parted at the connector."""
    part = _table(spark, sf_dir, "part")
    other = part.agg(F.min("p_name").alias("b"))
    texts = part.crossJoin(F.broadcast(other)).select(F.col("p_partkey").cast("string").alias("text_id"), F.lit(None).cast("string").alias("user_id"), F.concat("p_name", F.lit(" con "), "b").alias("text"))
    return catalog.resolve_texts(texts, _aliases(spark, sf_dir)).select("text_id", "part_no", F.col("item.label").alias("label"), "food_id")


@query("SELECT event_id, 'carbohydrate' AS nutrient, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS amount, 'g' AS unit FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extract(spark, sf_dir):
    """Each event's number as a nutrient payload, of one shape or the other."""
    e = proxy.events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"))
    short = F.format_string('{"foodNutrients":[{"nutrientId":1005,"unitName":"G","value":%s}]}', "k")
    nested = F.format_string('{"foodNutrients":[{"nutrient":{"id":1005,"unitName":"g"},"amount":%s}]}', "k")
    payloads = e.where("k is not null").select("event_id", F.when(F.col("event_id") % 2 == 0, short).otherwise(nested).alias("payload"))
    return nutrients.nutrients(payloads, "event_id")


@query("SELECT l_orderkey, l_linenumber, unnest(['historic', 'scan', 'strip']) AS source, unnest([l_quantity, l_extendedprice, l_tax]) AS value FROM lineitem")
def melt(spark, sf_dir):
    return sensor_csv.melt(_table(spark, sf_dir, "lineitem"), {"historic": F.col("l_quantity"), "scan": F.col("l_extendedprice"), "strip": F.col("l_tax")}, ["l_orderkey", "l_linenumber"])


@query("SELECT user_id::VARCHAR AS path, CASE WHEN max(day(ts)) > 12 THEN 'DMY' END AS date_order FROM events GROUP BY 1")
def date_order(spark, sf_dir):
    """A user's events as a file of day-first texts."""
    e = proxy.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.date_format("ts", "dd-MM-yyyy HH:mm").alias("raw"))
    return sensor_csv.date_orders(e).select("path", "date_order")


DENSE = """
WITH t AS (SELECT event_type AS path, make_timestamp(2024, CAST(1 + event_id % 3 AS INT), CAST(1 + (event_id // 97) % 9 AS INT), CAST(hour(ts) AS INT), CAST(minute(ts) AS INT), 0.0) AS d FROM events),
b AS (SELECT path, d, 'DMY' AS ord FROM t UNION ALL SELECT path, make_timestamp(year(d), day(d), month(d), hour(d), minute(d), 0.0), 'MDY' FROM t),
g AS (SELECT *, (epoch_us(d) - epoch_us(lag(d) OVER (PARTITION BY path, ord ORDER BY d))) / 6e7 AS gap FROM b),
s AS (SELECT path, ord, count(*) AS n, count(gap) AS k, count(*) FILTER (gap > 0 AND gap <= 60) AS m, list_sort(list(gap) FILTER (gap > 0 AND gap <= 60)) AS steps, (epoch_us(max(d)) - epoch_us(min(d))) / 6e7 AS span FROM g GROUP BY 1, 2),
z AS (SELECT path, ord, greatest(0.0, 0.4 * m / k + 0.6 * least(1.0, n / (span / steps[m // 2 + 1] + 1))) AS score FROM s)
SELECT path, round(max(score) FILTER (ord = 'DMY'), 6) AS dmy, round(max(score) FILTER (ord = 'MDY'), 6) AS mdy FROM z GROUP BY 1
"""


@query(DENSE)
def density(spark, sf_dir):
    """Dates up to the 9th of a month, so that only density can tell their order."""
    e = proxy.events(spark, sf_dir)
    raw = F.concat(F.lpad((1 + F.expr("event_id div 97") % 9).cast("string"), 2, "0"), F.lit("-"), F.lpad((1 + F.col("event_id") % 3).cast("string"), 2, "0"), F.date_format("ts", "'-2024' HH:mm"))
    return sensor_csv.date_orders(e.select(F.col("event_type").alias("path"), raw.alias("raw"))).select("path", "dmy", "mdy")


@query("SELECT c_custkey, sha256(c_name) AS serial_hash FROM customer")
def hash_serial(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("serial_hash"))


@query("SELECT event_id, CAST(epoch_us(timezone('America/New_York', date_trunc('minute', ts))) AS BIGINT) AS utc_us FROM events")
def tz_local(spark, sf_dir):
    e = proxy.events(spark, sf_dir).select("event_id", times.date_parts(F.date_format("ts", "MM/dd/yyyy h:mm a")).alias("p"))
    return e.select("event_id", F.unix_micros(times.to_utc(times.assembled(F.col("p"), "MDY"), "America/New_York")).alias("utc_us"))
