"""Response metrics of meal windows: segment algebra with exact zero crossings and no extrapolation.

points: meal_id, resolution, post, rel, value (as window_points() gives them). All metrics come from one shuffle by meal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.config import DEFAULT, Thresholds
from tidecurve.operators.pairing import baseline_width, min_sustained

MIN_SHAPE_POINTS, MIN_PROMINENCE, PROMINENCE_SHARE, PLATEAU_SHARE, PLATEAU_MIN = 5, 10.0, 0.25, 0.9, 45.0


def area_above(d1: Column, d2: Column, dt: Column) -> Column:
    """Integral of the positive part of a straight segment."""
    cross = F.when(d1 > 0, 0.5 * d1 * (d1 / (d1 - d2)) * dt).otherwise(0.5 * d2 * (d2 / (d2 - d1)) * dt)
    return F.when((d1 >= 0) & (d2 >= 0), 0.5 * (d1 + d2) * dt).when((d1 <= 0) & (d2 <= 0), 0.0).otherwise(cross)


def time_above(d1: Column, d2: Column, dt: Column) -> Column:
    """Time of a straight segment at or over zero (one that stays at zero counts)."""
    cross = F.when(d1 > 0, d1 / (d1 - d2) * dt).otherwise(d2 / (d2 - d1) * dt)
    return F.when((d1 >= 0) & (d2 >= 0), dt).when((d1 <= 0) & (d2 <= 0), 0.0).otherwise(cross)


def segments(points: DataFrame) -> DataFrame:
    """points with the next sample (t2, v2) of the meal beside each."""
    w = Window.partitionBy("meal_id").orderBy("rel", "value")
    return points.withColumn("t2", F.lead("rel").over(w)).withColumn("v2", F.lead("value").over(w))


def clipped(low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Values at the ends and length of a segment cut to [low, high]; the length is null or not positive outside."""
    t1, t2, v1, v2 = (F.col(c) for c in ("rel", "t2", "value", "v2"))
    a, b = F.greatest(t1, low), F.least(t2, high)
    at = lambda t: v1 + (v2 - v1) * (t - t1) / (t2 - t1)
    return F.when(t2 > t1, at(a)), F.when(t2 > t1, at(b)), b - a


def baselines(points: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """meal_id, baseline, baseline_sd, baseline_n of the meals with a sample before the meal."""
    high = -cfg.baseline_offset_min
    pre = points.where(F.col("rel").between(high - baseline_width(F.col("resolution")), high))
    return pre.groupBy("meal_id").agg(F.median("value").alias("baseline"), F.stddev_samp("value").alias("baseline_sd"), F.count("*").alias("baseline_n"))


def return_time(points: Column, threshold: Column, after: Column, sustained: Column) -> Column:
    """First time after the peak that the curve falls to the threshold. points: array<struct<rel,value>> of the post window.

    A crossing counts if no sample of the following `sustained` minutes is over the threshold; else the next sample
    at or under it counts."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda p, q: F.struct(p["rel"].alias("t1"), p["value"].alias("v1"), q["rel"].alias("t2"), q["value"].alias("v2")))

    def time(s: Column) -> Column:
        cross = s["t1"] + (s["v1"] - threshold) / F.nullif(s["v1"] - s["v2"], F.lit(0.0)) * (s["t2"] - s["t1"])
        falls = (s["v1"] > threshold) & (s["v2"] <= threshold)
        again = F.exists(points, lambda p: (p["rel"] > cross) & (p["rel"] <= cross + sustained) & (p["value"] > threshold))
        return F.when(s["t2"] > after, F.when(falls, F.when((cross >= after) & ~again, cross)).when((s["t1"] >= after) & (s["v1"] <= threshold), s["t1"]))

    return F.when(F.size(points) > 1, F.get(F.filter(F.transform(pairs, time), lambda t: t.isNotNull()), F.lit(0)))


def prominent_peaks(values: Column, least: Column) -> Column:
    """Number of inner local maxima whose prominence reaches `least` (both samples of a flat top of two count)."""
    n = F.size(values)
    at = lambda i: F.get(values, i)

    def is_peak(i: Column) -> Column:
        v = at(i)
        top = (v >= at(i - 1)) & (v >= at(i + 1)) & ~((v == at(i - 1)) & (v == at(i + 1)))
        left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), i), lambda j: at(j) > v)), F.lit(-1))
        right = F.coalesce(F.array_min(F.filter(F.sequence(i, n - 1), lambda j: at(j) > v)), n)
        left_low = F.array_min(F.slice(values, left + 2, i - left))
        right_low = F.array_min(F.slice(values, i + 1, right - i))
        return F.when(top, v - F.greatest(left_low, right_low) >= least).otherwise(False)

    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(1), n - 2), is_peak))).otherwise(0)


def response_metrics(points: DataFrame, cfg: Thresholds = DEFAULT, least: int = 0) -> DataFrame:
    """One row for each meal with `least` points, a baseline and two samples or more in [0, post]."""
    by_meal = Window.partitionBy("meal_id")
    hi = -cfg.baseline_offset_min
    pre = F.when(F.col("rel").between(hi - baseline_width(F.col("resolution")), hi), F.col("value"))
    p = segments(points).withColumn("baseline", F.median(pre).over(by_meal)).withColumn("last_rel", F.max("rel").over(by_meal)).withColumn("first_rel", F.min("rel").over(by_meal))
    base, post = F.col("baseline"), F.col("post")
    zero = F.lit(0.0)

    def over(low, high, f):
        a, b, dt = clipped(low, high)
        return F.sum(F.when(dt > 0, f(a - base, b - base, dt)).otherwise(0.0))

    reach = F.least(post.cast("double"), F.col("last_rel"))
    in_post = F.col("rel").between(0, post)
    inner = in_post & (F.col("t2") <= post)
    dt = F.col("t2") - F.col("rel")
    sample = F.when(in_post, F.struct("rel", "value"))
    near = F.col("value") - base
    got = p.groupBy("meal_id", "resolution", "post", "baseline", "first_rel", "last_rel").agg(
        F.stddev_samp(pre).alias("baseline_sd"), F.count(pre).alias("baseline_n"), F.count(sample).alias("n_points"), F.count("*").alias("n_all"),
        F.min(F.when(in_post, F.struct((-F.col("value")).alias("less"), "rel"))).alias("peak"),
        over(zero, F.lit(120.0), area_above).alias("iauc_120"), over(zero, F.lit(180.0), area_above).alias("iauc_180"),
        over(zero, F.lit(120.0), lambda a, b, t: 0.5 * (a + b) * t).alias("iauc_net_120"), over(zero, F.lit(120.0), lambda a, b, t: (0.5 * (a + b) + base) * t).alias("auc_total_120"),
        over(zero, reach, time_above).alias("above"), F.sum(F.when(inner & (dt > 0), time_above(near, F.col("v2") - base, dt)).otherwise(0.0)).alias("above_post"),
        F.stddev_samp(F.when(in_post, F.col("value"))).alias("sd"), F.avg(F.when(in_post, F.col("value"))).alias("mean"), F.sort_array(F.collect_list(sample)).alias("samples"),
    )
    got = got.where(base.isNotNull() & (F.col("n_points") >= 2) & (F.col("n_all") >= least)).withColumn("peak_mgdl", -F.col("peak.less")).withColumn("peak_delta_mgdl", F.col("peak_mgdl") - base)
    covers = lambda high: (F.col("n_all") >= 2) & (F.col("first_rel") <= 0) & (F.col("last_rel") >= high)
    delta = F.col("peak_delta_mgdl")
    values = F.transform("samples", lambda s: s["value"])
    plateau = base + delta * PLATEAU_SHARE
    pairs = F.zip_with(F.slice("samples", 1, F.size("samples") - 1), F.slice("samples", 2, F.size("samples")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near_peak = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + F.when(s["b"]["rel"] > s["a"]["rel"], time_above(s["a"]["value"] - plateau, s["b"]["value"] - plateau, s["b"]["rel"] - s["a"]["rel"])).otherwise(0.0))
    peaks = prominent_peaks(values, F.greatest(F.lit(MIN_PROMINENCE), PROMINENCE_SHARE * delta))
    shape = F.when(F.col("n_points") < MIN_SHAPE_POINTS, "unknown").when(delta < cfg.flat_curve_threshold_mgdl, "flat").when(peaks >= 2, "biphasic").when(near_peak > PLATEAU_MIN, "plateau").otherwise("monophasic")
    return got.select(
        "meal_id", F.col("baseline").alias("baseline_mgdl"), "baseline_sd", "baseline_n", "peak_mgdl", "peak_delta_mgdl", F.col("peak.rel").alias("time_to_peak_min"),
        (F.col("resolution") > cfg.peak_reliable_max_resolution_min).alias("peak_underestimated"), F.when(covers(120), F.col("iauc_120")).alias("iauc_120"),
        F.when((F.col("post") >= 180) & covers(180), F.col("iauc_180")).alias("iauc_180"), F.when(covers(120), F.col("iauc_net_120")).alias("iauc_net_120"),
        F.when(covers(120), F.col("auc_total_120")).alias("auc_total_120"), F.when(covers(F.least(F.col("post").cast("double"), F.col("last_rel"))), F.col("above")).otherwise(F.col("above_post")).alias("time_above_baseline_min"),
        return_time(F.col("samples"), base + cfg.return_to_baseline_margin_mgdl, F.col("peak.rel"), min_sustained(F.col("resolution"))).alias("time_to_return_baseline_min"),
        F.when(F.col("mean") > 0, F.coalesce(F.col("sd") / F.col("mean") * 100, F.lit(0.0))).otherwise(0.0).alias("cv_pct"), shape.alias("curve_shape"), F.col("n_points").alias("n_points_post"), "resolution",
    )
