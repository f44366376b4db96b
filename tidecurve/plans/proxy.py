"""The driver's event table as a glucose model: purchases are meals, other events readings, a user is a sensor
session, and a minute has 1800 seconds (the median step of the events is then a usual resolution)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecurve.config import DEFAULT
from tidecurve.operators import signal
from tidecurve.operators.tables import settled

CFG = replace(DEFAULT, unit_s=1800)

#: The same model in DuckDB: e, r (readings), m (meals), res, sess, fl (flags), n (meals placed), p (window points).
SQL = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value AS v, event_type FROM events),
r AS (SELECT * FROM e WHERE event_type <> 'purchase'),
m AS (SELECT event_id AS meal_id, user_id, us FROM e WHERE event_type = 'purchase'),
steps AS (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 1.8e9 AS step FROM r),
res AS (SELECT user_id, greatest(1, CAST(round_even(median(step), 0) AS INT)) AS resolution FROM steps WHERE step > 0 AND step <= 60 GROUP BY 1),
sess AS (SELECT user_id, count(*) AS n_readings, min(us) AS lo, max(us) AS hi, any_value(resolution) AS resolution FROM r JOIN res USING (user_id) GROUP BY 1),
near AS (SELECT r.*, s.lo, s.resolution, (us - lag(us) OVER w) / 1.8e9 AS step, v - lag(v) OVER w AS change, lag(v) OVER w AS vb, lead(v) OVER w AS va
  FROM r JOIN sess s USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY us, v)),
f1 AS (SELECT *, CASE WHEN v < 40 OR v > 400 THEN 1 ELSE 0 END AS f_range,
  CASE WHEN step <= 2 * resolution AND (CASE WHEN step > 0 THEN abs(change) / step ELSE 0 END) > 6 THEN 2 ELSE 0 END AS f_rate,
  CASE WHEN (us - lo) / 1.8e9 < 720 THEN 4 ELSE 0 END AS f_warm FROM near),
lows AS (SELECT a.user_id, a.event_id, a.us, a.v,
    max(b.v) FILTER (b.us < a.us) AS pre, arg_max(b.us, b.v * 1e9 - (b.us - a.us) / 1e6) FILTER (b.us < a.us) AS pre_us,
    max(b.v) FILTER (b.us > a.us) AS post, arg_max(b.us, b.v * 1e9 - (b.us - a.us) / 1e6) FILTER (b.us > a.us) AS post_us
  FROM near a JOIN r b ON a.user_id = b.user_id AND b.us >= a.us - 30 * 1800000000::BIGINT AND b.us <= a.us + 60 * 1800000000::BIGINT
  WHERE a.v <= a.vb AND a.v <= a.va AND a.v < 80 GROUP BY 1, 2, 3, 4),
squeezed AS (SELECT * FROM lows WHERE pre - v >= 30 AND post - v >= 0.7 * 30),
fl AS (SELECT f1.*, CASE WHEN EXISTS (SELECT 1 FROM squeezed q WHERE q.user_id = f1.user_id AND f1.us BETWEEN q.pre_us AND q.post_us) THEN 8 ELSE 0 END AS f_low FROM f1),
nb AS (SELECT meal_id, user_id, us, (us - lag(us) OVER w) / 1.8e9 AS prev_gap, (lead(us) OVER w - us) / 1.8e9 AS next_gap FROM m WINDOW w AS (PARTITION BY user_id ORDER BY us, meal_id)),
n AS (SELECT nb.*, s.user_id AS session_id, s.lo, s.resolution, CASE WHEN next_gap >= 120 AND next_gap < 180 THEN CAST(floor(next_gap) AS INT) ELSE 180 END AS post
  FROM nb LEFT JOIN sess s ON s.user_id = nb.user_id AND nb.us BETWEEN s.lo AND s.hi),
p AS (SELECT n.meal_id, n.resolution, n.post, (r.us - n.us) / 1.8e9 AS rel, r.v, r.f_range + r.f_rate + r.f_warm + r.f_low AS flags
  FROM n JOIN fl r ON r.user_id = n.session_id
   AND r.us BETWEEN n.us - greatest(30, 2 * n.resolution + 10) * 1800000000::BIGINT AND n.us + (n.post + n.resolution + 1) * 1800000000::BIGINT),
base AS (SELECT meal_id, median(v) AS baseline, stddev_samp(v) AS sd, count(*) AS n FROM p WHERE rel BETWEEN -(5 + greatest(20, 2 * resolution)) AND -5 GROUP BY 1),
seg0 AS (SELECT p.*, lead(rel) OVER w AS t2, lead(v) OVER w AS v2 FROM p WINDOW w AS (PARTITION BY meal_id ORDER BY rel, v)),
ends AS (SELECT meal_id, min(rel) AS first_rel, max(rel) AS last_rel, count(*) AS n_all, count(*) FILTER (rel BETWEEN 0 AND post) AS n_post FROM p GROUP BY meal_id),
seg AS (SELECT s.*, b.baseline, e.first_rel, e.last_rel, e.n_all, e.n_post FROM seg0 s JOIN base b USING (meal_id) JOIN ends e USING (meal_id) WHERE e.n_post >= 2 AND e.n_all >= 3),
post AS (SELECT p.*, b.baseline, row_number() OVER (PARTITION BY meal_id ORDER BY rel, v) AS i FROM p JOIN base b USING (meal_id) JOIN ends e USING (meal_id)
  WHERE e.n_post >= 2 AND e.n_all >= 3 AND rel BETWEEN 0 AND post),
pk AS (SELECT meal_id, max(v) AS peak, any_value(baseline) AS baseline, min(resolution) AS resolution, any_value(post) AS post, count(*) AS n FROM post GROUP BY 1),
ttp AS (SELECT meal_id, peak, pk.baseline, peak - pk.baseline AS delta, pk.resolution, pk.n, min(rel) AS ttp FROM pk JOIN post USING (meal_id) WHERE post.v = pk.peak GROUP BY ALL)
"""


def clip_sql(hi: str) -> str:
    """CTE c: segments cut to [0, hi], as increments d1, d2 over the baseline and their length dt."""
    return f""", c AS (SELECT meal_id, baseline, dt, v + (v2 - v) * (a - rel) / (t2 - rel) - baseline AS d1, v + (v2 - v) * (b - rel) / (t2 - rel) - baseline AS d2
  FROM (SELECT *, greatest(rel, 0) AS a, least(t2, {hi}) AS b, least(t2, {hi}) - greatest(rel, 0) AS dt FROM seg WHERE t2 > rel AND n_all >= 2 AND first_rel <= 0 AND last_rel >= {hi}) WHERE dt > 0)"""


AREA = "CASE WHEN d1 >= 0 AND d2 >= 0 THEN 0.5 * (d1 + d2) * dt WHEN d1 <= 0 AND d2 <= 0 THEN 0 WHEN d1 > 0 THEN 0.5 * d1 * d1 / (d1 - d2) * dt ELSE 0.5 * d2 * d2 / (d2 - d1) * dt END"
TIME = "CASE WHEN d1 >= 0 AND d2 >= 0 THEN dt WHEN d1 <= 0 AND d2 <= 0 THEN 0 WHEN d1 > 0 THEN d1 / (d1 - d2) * dt ELSE d2 / (d2 - d1) * dt END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type <> 'purchase'").select(F.col("user_id").alias("session_id"), "ts", "value", "event_id")


def meals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("meal_id"), "user_id", F.col("ts").alias("consumed_at"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.sessions(readings(spark, sf_dir), CFG).select("session_id", F.col("session_id").alias("user_id"), F.lit("one").alias("vendor"), "started_at", "ended_at", "resolution", "n_readings")


def flagged(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    return signal.quality_flags(readings(spark, sf_dir), known if known is not None else sessions(spark, sf_dir), CFG)


def settled_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and flagged readings, written once for plans that read them several times."""
    known = settled(sessions(spark, sf_dir))
    return known, settled(flagged(spark, sf_dir, known))
