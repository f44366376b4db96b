"""Named queries on the event model: sessions, flags, windows, metrics, verdicts; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecurve.config import COMPRESSION_LOW
from tidecurve.operators import metrics, pairing, signal
from tidecurve.operators.tables import settled
from tidecurve.plans import analysis, proxy
from tidecurve.plans.proxy import AREA, CFG, SQL, TIME, clip_sql

QUERIES, SQLS = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


def _r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


@query(SQL + "SELECT user_id AS session_id, resolution FROM res")
def resolution(spark, sf_dir):
    return signal.resolutions(proxy.readings(spark, sf_dir), CFG)


@query(SQL + "SELECT user_id AS session_id, n_readings, lo AS started_us, hi AS ended_us, resolution FROM sess")
def sessions(spark, sf_dir):
    s = signal.sessions(proxy.readings(spark, sf_dir), CFG)
    return s.select("session_id", "n_readings", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "resolution")


@query("SELECT event_id, CASE WHEN value < 40 OR value > 400 THEN 1 ELSE 0 END AS flag FROM events WHERE event_type <> 'purchase'")
def qc_range(spark, sf_dir):
    return proxy.readings(spark, sf_dir).select("event_id", signal.range_flag(F.col("value")).alias("flag"))


def _flag(spark, sf_dir, bit):
    return proxy.flagged(spark, sf_dir).select("event_id", F.col("flags").bitwiseAND(F.lit(bit)).alias("flag"))


@query(SQL + "SELECT event_id, f_rate AS flag FROM f1")
def qc_rate(spark, sf_dir):
    return _flag(spark, sf_dir, 2)


@query(SQL + "SELECT event_id, f_warm AS flag FROM f1")
def qc_warmup(spark, sf_dir):
    return _flag(spark, sf_dir, 4)


@query(SQL + "SELECT event_id, f_low AS flag FROM fl")
def qc_compression(spark, sf_dir):
    return _flag(spark, sf_dir, COMPRESSION_LOW)


@query(SQL + "SELECT user_id AS session_id, count(*) FILTER (f_range > 0) AS n_out_of_range, count(*) FILTER (f_rate > 0) AS n_implausible, count(*) FILTER (f_warm > 0) AS n_warmup, count(*) FILTER (f_low > 0) AS n_compression FROM fl GROUP BY 1")
def qc_counters(spark, sf_dir):
    return signal.flag_counters(proxy.flagged(spark, sf_dir))


@query("""
WITH r AS (SELECT user_id, event_type, epoch_us(ts) AS us, value AS v FROM events WHERE event_type <> 'purchase'),
s AS (SELECT user_id, event_type, min(us) AS lo FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, v) AS f, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, v DESC) AS l FROM r),
ed AS (SELECT user_id, event_type, median(v) FILTER (f <= 12) AS head, median(v) FILTER (l <= 12) AS tail FROM k GROUP BY 1, 2),
st AS (SELECT user_id, event_type, head - lag(tail) OVER (PARTITION BY user_id ORDER BY lo, user_id || ':' || event_type) AS step FROM ed JOIN s USING (user_id, event_type))
SELECT user_id || ':' || event_type AS session_id, user_id, round(CASE WHEN abs(step) >= 15 THEN step END, 4) AS step FROM st
""")
def session_step(spark, sf_dir):
    """Here an event type of a user is a sensor, so that users have several."""
    e = proxy.events(spark, sf_dir).where("event_type <> 'purchase'").withColumn("session_id", F.concat_ws(":", "user_id", "event_type"))
    s = e.groupBy("session_id", "user_id").agg(F.min("ts").alias("started_at"))
    return signal.session_steps(e.select("session_id", "ts", "value"), s).withColumn("step", F.round("step", 4))


@query(SQL + "SELECT meal_id, round(prev_gap, 4) AS prev_gap, round(next_gap, 4) AS next_gap FROM nb")
def meal_neighbours(spark, sf_dir):
    return pairing.neighbours(proxy.meals(spark, sf_dir), CFG).select("meal_id", *_r4("prev_gap", "next_gap"))


def _placed(spark, sf_dir, known=None):
    return analysis.placed_meals(proxy.meals(spark, sf_dir), known if known is not None else settled(proxy.sessions(spark, sf_dir)), CFG)


@query(SQL + "SELECT meal_id, session_id, resolution, post FROM n")
def session_for_meal(spark, sf_dir):
    return _placed(spark, sf_dir).select("meal_id", "session_id", "resolution", "post")


def _points(spark, sf_dir):
    known, flagged = proxy.settled_base(spark, sf_dir)
    return pairing.window_points(_placed(spark, sf_dir, known), flagged, CFG)


@query(SQL + "SELECT meal_id, resolution, post, round(rel, 4) AS rel, v AS value, flags FROM p")
def window_points(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("rel", F.round("rel", 4))


@query(SQL + "SELECT meal_id, round(baseline, 4) AS baseline, round(sd, 4) AS baseline_sd, n AS baseline_n FROM base")
def baseline(spark, sf_dir):
    return metrics.baselines(_points(spark, sf_dir), CFG).select("meal_id", *_r4("baseline", "baseline_sd"), "baseline_n")


COVER = """
, inside AS (SELECT *, -greatest(30, 2 * resolution + 10) AS lo FROM p),
g AS (SELECT meal_id, rel, rel - lag(rel) OVER (PARTITION BY meal_id ORDER BY rel, v) AS gap FROM inside WHERE rel BETWEEN lo AND post),
cv AS (SELECT meal_id, resolution, post, lo, count(*) AS n_points, count(*) FILTER (rel BETWEEN lo AND post) AS k, min(rel) FILTER (rel BETWEEN lo AND post) AS a, max(rel) FILTER (rel BETWEEN lo AND post) AS b,
  count(*) FILTER (rel BETWEEN -(5 + greatest(20, 2 * resolution)) AND -5) AS baseline_n, bool_or((flags & 15) <> 0) AS blocked FROM inside GROUP BY 1, 2, 3, 4),
cover AS (SELECT cv.meal_id, n_points, CASE WHEN k = 0 THEN 0.0 ELSE least(100.0, 100.0 * k / ((post - lo) / resolution + 1)) END AS coverage_pct,
  CASE WHEN k = 0 THEN post - lo ELSE greatest(coalesce((SELECT max(gap) FROM g WHERE g.meal_id = cv.meal_id), 0), a - lo, post - b) END AS max_gap_min, baseline_n, blocked FROM cv)
"""


@query(SQL + COVER + "SELECT meal_id, n_points, round(CAST(coverage_pct AS DOUBLE), 4) AS coverage_pct, round(CAST(max_gap_min AS DOUBLE), 4) AS max_gap_min, baseline_n, blocked FROM cover")
def coverage_gap(spark, sf_dir):
    return pairing.coverage(_points(spark, sf_dir), CFG).select("meal_id", "n_points", *_r4("coverage_pct", "max_gap_min"), "baseline_n", "blocked")


def _metrics(spark, sf_dir):
    return metrics.response_metrics(_points(spark, sf_dir), CFG, least=3)


@query(SQL + "SELECT meal_id, round(peak, 4) AS peak_mgdl, round(delta, 4) AS peak_delta_mgdl, round(ttp, 4) AS time_to_peak_min, resolution > 5 AS peak_underestimated FROM ttp")
def peak_ttp(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", *_r4("peak_mgdl", "peak_delta_mgdl", "time_to_peak_min"), "peak_underestimated")


@query(SQL + "SELECT meal_id, round(CASE WHEN avg(v) > 0 THEN coalesce(stddev_samp(v) / avg(v) * 100, 0) ELSE 0 END, 4) AS cv_pct FROM post GROUP BY 1")
def cv(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", *_r4("cv_pct"))


@query(SQL + clip_sql("120") + f", x AS (SELECT meal_id, sum({AREA}) AS a FROM c GROUP BY 1)" + clip_sql("180").replace(", c AS", ", c3 AS") + f", y AS (SELECT meal_id, sum({AREA}) AS a FROM c3 GROUP BY 1) SELECT pk.meal_id, round(x.a, 3) AS iauc_120, round(CASE WHEN pk.post >= 180 THEN y.a END, 3) AS iauc_180 FROM pk LEFT JOIN x USING (meal_id) LEFT JOIN y USING (meal_id)")
def iauc(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", F.round("iauc_120", 3).alias("iauc_120"), F.round("iauc_180", 3).alias("iauc_180"))


@query(SQL + clip_sql("120") + ", x AS (SELECT meal_id, sum(0.5 * (d1 + d2) * dt) AS a, sum((0.5 * (d1 + d2) + baseline) * dt) AS b FROM c GROUP BY 1) SELECT pk.meal_id, round(x.a, 3) AS iauc_net_120, round(x.b, 3) AS auc_total_120 FROM pk LEFT JOIN x USING (meal_id)")
def auc_net_total(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", F.round("iauc_net_120", 3).alias("iauc_net_120"), F.round("auc_total_120", 3).alias("auc_total_120"))


@query(SQL + clip_sql("least(post, last_rel)") + f""", x AS (SELECT meal_id, sum({TIME}) AS a FROM c GROUP BY 1),
q AS (SELECT meal_id, rel, v - baseline AS d1, lead(v) OVER w - baseline AS d2, lead(rel) OVER w - rel AS dt FROM post WINDOW w AS (PARTITION BY meal_id ORDER BY i)),
y AS (SELECT meal_id, coalesce(sum({TIME}) FILTER (dt > 0), 0) AS a FROM q GROUP BY 1)
SELECT pk.meal_id, round(CASE WHEN e.first_rel <= 0 THEN x.a ELSE y.a END, 4) AS time_above_baseline_min FROM pk JOIN ends e USING (meal_id) LEFT JOIN x USING (meal_id) LEFT JOIN y USING (meal_id)""")
def time_above(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", *_r4("time_above_baseline_min"))


@query(SQL + """, q AS (SELECT meal_id, i, resolution, baseline + 10 AS thr, rel AS t1, v AS v1, lead(rel) OVER w AS t2, lead(v) OVER w AS v2 FROM post WINDOW w AS (PARTITION BY meal_id ORDER BY i)),
x AS (SELECT q.*, ttp.ttp, t1 + (v1 - thr) / nullif(v1 - v2, 0) * (t2 - t1) AS tc FROM q JOIN ttp USING (meal_id) WHERE t2 IS NOT NULL AND t2 > ttp.ttp),
y AS (SELECT meal_id, i, CASE WHEN v1 > thr AND v2 <= thr THEN
   CASE WHEN tc >= ttp AND NOT EXISTS (SELECT 1 FROM post o WHERE o.meal_id = x.meal_id AND o.rel > x.tc AND o.rel <= x.tc + greatest(15, x.resolution) AND o.v > x.thr) THEN tc END
   WHEN t1 >= ttp AND v1 <= thr THEN t1 END AS t FROM x)
SELECT pk.meal_id, round(z.t, 4) AS time_to_return_baseline_min FROM pk LEFT JOIN (SELECT meal_id, arg_min(t, i) AS t FROM y WHERE t IS NOT NULL GROUP BY 1) z USING (meal_id)""")
def time_to_return(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", *_r4("time_to_return_baseline_min"))


@query(SQL + f""", q AS (SELECT post.meal_id, i, rel, post.v, lag(post.v) OVER w AS vb, lead(post.v) OVER w AS va, lead(rel) OVER w - rel AS dt, t.delta, t.baseline, t.n FROM post JOIN ttp t USING (meal_id) WINDOW w AS (PARTITION BY post.meal_id ORDER BY i)),
tops AS (SELECT * FROM q WHERE v >= vb AND v >= va AND NOT (v = vb AND v = va)),
stops AS (SELECT a.meal_id, a.i, a.v, a.delta, coalesce(max(b.i) FILTER (b.i < a.i AND b.v > a.v), 0) AS l, coalesce(min(b.i) FILTER (b.i > a.i AND b.v > a.v), 1000000) AS r FROM tops a JOIN q b USING (meal_id) GROUP BY 1, 2, 3, 4),
prom AS (SELECT s.meal_id, s.i, s.v - greatest(min(b.v) FILTER (b.i > s.l AND b.i <= s.i), min(b.v) FILTER (b.i >= s.i AND b.i < s.r)) AS p, s.delta FROM stops s JOIN q b USING (meal_id) GROUP BY s.meal_id, s.i, s.v, s.delta),
peaks AS (SELECT meal_id, count(*) AS k FROM prom WHERE p >= greatest(10, 0.25 * delta) GROUP BY 1),
pl AS (SELECT meal_id, v - (baseline + delta * 0.9) AS d1, va - (baseline + delta * 0.9) AS d2, dt FROM q WHERE dt > 0),
near_top AS (SELECT meal_id, sum({TIME}) AS t FROM pl GROUP BY 1)
SELECT t.meal_id, CASE WHEN t.n < 5 THEN 'unknown' WHEN t.delta < 15 THEN 'flat' WHEN coalesce(k, 0) >= 2 THEN 'biphasic' WHEN coalesce(near_top.t, 0) > 45 THEN 'plateau' ELSE 'monophasic' END AS curve_shape
FROM ttp t LEFT JOIN peaks USING (meal_id) LEFT JOIN near_top USING (meal_id)""")
def curve_shape(spark, sf_dir):
    return _metrics(spark, sf_dir).select("meal_id", "curve_shape")


VERDICT = COVER + """
, vd AS (SELECT n.*, coalesce(c.n_points, 0) AS np, c.coverage_pct, c.max_gap_min, c.baseline_n, c.blocked, (n.us - n.lo) / 1.8e9 / 60 AS age_h, coalesce(n.resolution, 15) AS res FROM n LEFT JOIN cover c USING (meal_id)),
ex AS (SELECT meal_id, user_id, us, age_h, list_filter([
   CASE WHEN age_h < 12 THEN 'sensor_warmup' END, CASE WHEN prev_gap < 180 THEN 'prev_meal_too_close' END, CASE WHEN next_gap < 120 THEN 'next_meal_too_soon' END, CASE WHEN np < 3 THEN 'no_glucose_data' END,
   CASE WHEN np >= 3 AND coverage_pct < 85 THEN 'insufficient_coverage' END, CASE WHEN np >= 3 AND max_gap_min > greatest(20.0, 2.5 * res) THEN 'gap_too_large' END,
   CASE WHEN np >= 3 AND blocked THEN 'flagged_readings' END, CASE WHEN np >= 3 AND baseline_n = 0 THEN 'no_baseline' END], lambda x: x IS NOT NULL) AS ex,
  list_filter([CASE WHEN next_gap >= 120 AND next_gap < 180 THEN 'next_meal_limits_window' END, CASE WHEN np >= 3 AND baseline_n = 1 THEN 'weak_baseline' END, CASE WHEN session_id IS NOT NULL AND res > 5 THEN 'peak_underestimated' END], lambda x: x IS NOT NULL) AS dg FROM vd),
qual AS (SELECT ex.*, CASE WHEN len(ex) > 0 THEN 'excluded' WHEN len(list_filter(dg, lambda x: x <> 'peak_underestimated')) > 0 OR pk.peak IS NULL THEN 'degraded' ELSE 'ok' END AS quality FROM ex LEFT JOIN pk USING (meal_id))
"""


def _analyzed(spark, sf_dir):
    return analysis.analyze(proxy.meals(spark, sf_dir), *proxy.settled_base(spark, sf_dir), cfg=CFG)


@query(SQL + VERDICT + "SELECT meal_id, array_to_string(ex, '|') AS exclusions, array_to_string(dg, '|') AS degradations, round(age_h, 4) AS sensor_age_hours FROM ex")
def verdict(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("meal_id", F.array_join("exclusions", "|").alias("exclusions"), F.array_join("degradations", "|").alias("degradations"), *_r4("sensor_age_hours"))


#: The event model with two sensors of a user, an event type each, that are of different vendors.
SENSORS = (
    SQL.replace("r AS (SELECT * FROM e WHERE event_type <> 'purchase')", "r AS (SELECT event_id, user_id || ':' || event_type AS user_id, us, v, event_type FROM e WHERE event_type IN ('view', 'click'))")
    .replace("n AS (SELECT nb.*, s.user_id AS session_id, s.lo, s.resolution,", "held AS (SELECT nb.meal_id, s.*, row_number() OVER (PARTITION BY nb.meal_id ORDER BY s.lo, s.user_id) AS i FROM nb JOIN sess s ON split_part(s.user_id, ':', 1) = nb.user_id::VARCHAR AND nb.us BETWEEN s.lo AND s.hi),\nn AS (SELECT nb.*, s.user_id AS session_id, s.lo, s.resolution, EXISTS (SELECT 1 FROM sess o WHERE split_part(o.user_id, ':', 1) = nb.user_id::VARCHAR AND o.user_id <> s.user_id AND nb.us BETWEEN o.lo - 2592000000000 AND o.hi + 2592000000000) AS changed,")
    .replace("FROM nb LEFT JOIN sess s ON s.user_id = nb.user_id AND nb.us BETWEEN s.lo AND s.hi)", "FROM nb LEFT JOIN held s ON s.meal_id = nb.meal_id AND s.i = 1)")
)


@query(SENSORS + VERDICT.replace("CASE WHEN next_gap < 120 THEN", "CASE WHEN changed THEN 'vendor_change' END, CASE WHEN next_gap < 120 THEN") + "SELECT meal_id, array_to_string(ex, '|') AS exclusions, array_to_string(dg, '|') AS degradations FROM ex")
def verdict_of_two_sensors(spark, sf_dir):
    """Verdicts where users wear sensors of two vendors, views and clicks, at times both."""
    e = proxy.events(spark, sf_dir).where("event_type in ('view', 'click')").withColumn("session_id", F.concat_ws(":", "user_id", "event_type"))
    readings = e.select("session_id", "ts", "value", "event_id")
    owners = e.select("session_id", "user_id", F.col("event_type").alias("vendor")).distinct()
    known = settled(signal.sessions(readings, CFG).join(owners, "session_id"))
    told = analysis.analyze(proxy.meals(spark, sf_dir), known, settled(signal.quality_flags(readings, known, CFG)), cfg=CFG)
    return told.select("meal_id", F.array_join("exclusions", "|").alias("exclusions"), F.array_join("degradations", "|").alias("degradations"))


@query(SQL + VERDICT + "SELECT meal_id, quality FROM qual")
def quality(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("meal_id", "quality")


@query(SQL + VERDICT + "SELECT reason, count(*) AS n FROM (SELECT unnest(ex) AS reason FROM qual WHERE quality = 'excluded') GROUP BY 1")
def exclusion_hist(spark, sf_dir):
    return analysis.exclusion_counts(_analyzed(spark, sf_dir))


@query(SQL + VERDICT + "SELECT user_id, reason, count(*) AS n FROM (SELECT user_id, unnest(ex) AS reason FROM qual WHERE quality = 'excluded') GROUP BY 1, 2")
def exclusion_unnest(spark, sf_dir):
    return analysis.exclusion_counts(_analyzed(spark, sf_dir), "user_id")


@query(SQL + VERDICT + "SELECT count(*) AS computed, count(*) FILTER (quality <> 'excluded') AS usable, count(*) FILTER (quality = 'excluded') AS excluded, round(count(*) FILTER (quality <> 'excluded') / count(*), 4) AS pairing_valid_ratio FROM qual")
def analysis_summary(spark, sf_dir):
    return analysis.summary(_analyzed(spark, sf_dir))


@query("""
WITH r AS (SELECT user_id, event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
m AS (SELECT event_id AS meal_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
s AS (SELECT m.*, (SELECT arg_min(event_type, lo::VARCHAR || event_type) FROM r WHERE r.user_id = m.user_id AND m.us BETWEEN r.lo AND r.hi) AS vendor FROM m)
SELECT meal_id FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.event_type <> s.vendor AND s.us BETWEEN r.lo - 86400000000 AND r.hi + 86400000000)
""")
def vendor_change(spark, sf_dir):
    """Here an event type is a vendor."""
    e = proxy.events(spark, sf_dir).where("event_type <> 'purchase'")
    s = e.groupBy("user_id", F.col("event_type").alias("vendor")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).withColumn("session_id", F.col("vendor")).withColumn("resolution", F.lit(15))
    return pairing.vendor_changed(pairing.with_session(proxy.meals(spark, sf_dir), s), s)
