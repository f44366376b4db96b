"""Sensor sessions and quality flags of readings. Flags mark; no reading is removed.

readings: session_id, ts, value, source_record ('historic' where not given).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.config import COMPRESSION_LOW, DEFAULT, IMPLAUSIBLE_RATE, OUT_OF_RANGE, WARMUP, Thresholds
from tidecurve.functions.times import minutes


#: Minutes of a time bucket of a session: windows run by (session, bucket), so a session of any length is many tasks' work.
BUCKET_MIN = 1440
#: Minutes of the buckets whose first and last readings a session's edges are taken from.
EDGE_BUCKET_MIN = 64 * 1440


def in_buckets(readings: DataFrame, before: int, after: int, cfg: Thresholds = DEFAULT, width: int | None = None) -> DataFrame:
    """readings with us, bucket and home: each in the bucket of its time (home), and copied into those whose readings
    look back `before` or ahead `after` minutes to it. Windows by bucket then see what a window over the session would."""
    unit = cfg.unit_s * 1_000_000
    of = lambda us: F.floor(us / F.lit((width or BUCKET_MIN) * unit)).cast("long")
    us = F.col("us")
    spread = F.explode(F.sequence(of(us - after * unit), of(us + before * unit)))
    return readings.withColumn("us", F.unix_micros("ts")).where("us is not null").withColumn("bucket", spread).withColumn("home", F.col("bucket") == of(us))


def resolutions(readings: DataFrame, cfg: Thresholds = DEFAULT, by: str = "session_id") -> DataFrame:
    """by, resolution: the median step of up to an hour, rounded half to even, at least 1; sessions without such a step are left out."""
    near = in_buckets(readings.select(by, "ts"), cfg.max_interval_min, 0, cfg)
    step = (F.col("us") - F.lag("us").over(Window.partitionBy(by, "bucket").orderBy("us"))) / (cfg.unit_s * 1e6)
    steps = near.select(by, "home", step.alias("step")).where("home").where((F.col("step") > 0) & (F.col("step") <= cfg.max_interval_min))
    return steps.groupBy(by).agg(F.greatest(F.lit(1), F.bround(F.median("step"), 0).cast("int")).alias("resolution"))


def sessions(readings: DataFrame, cfg: Thresholds = DEFAULT, by: str = "session_id") -> DataFrame:
    """by, n_readings, started_at, ended_at, resolution of the historic readings of each sensor; sensors without a resolution are dropped."""
    bounds = readings.groupBy(by).agg(F.count("*").alias("n_readings"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return bounds.join(resolutions(readings, cfg, by), by)


def range_flag(value: Column, cfg: Thresholds = DEFAULT) -> Column:
    return F.when((value < cfg.physiological_min_mgdl) | (value > cfg.physiological_max_mgdl), OUT_OF_RANGE).otherwise(0)


def rate_flag(step: Column, change: Column, resolution: Column, cfg: Thresholds = DEFAULT) -> Column:
    """Of the later reading; gaps over twice the resolution say nothing."""
    fast = F.when(step > 0, F.abs(change) / step).otherwise(F.lit(0.0)) > cfg.max_rate_mgdl_per_min
    return F.when((step <= 2 * resolution) & fast, IMPLAUSIBLE_RATE).otherwise(0)


def warmup_flag(ts: Column, started_at: Column, cfg: Thresholds = DEFAULT) -> Column:
    return F.when(minutes(started_at, ts, cfg.unit_s) < cfg.analysis_warmup_hours * 60, WARMUP).otherwise(0)


def quality_flags(readings: DataFrame, sessions_: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """readings with flags. sessions_: session_id, started_at, resolution. Readings without a session are left out.

    A compression low's span goes from the first highest reading before a V-shaped low to the first highest one after it, and
    covers all readings in between. A reading at or after the low is covered if a span of the lows behind it ends at or after it; one before
    the low, if a span of the lows ahead begins at or before it. All windows are by (session, bucket), after one shuffle."""
    unit = cfg.unit_s * 1_000_000
    drop, recover = cfg.compression_drop_window_min * unit, cfg.compression_recovery_min * unit
    # What a reading's flags depend on: steps of up to twice the longest resolution, and lows of a span that may cover it with all that the span needs.
    look = cfg.compression_drop_window_min + cfg.compression_recovery_min
    r = readings.join(sessions_.select("session_id", F.col("started_at").alias("__started"), F.col("resolution").alias("__resolution")), "session_id")
    r = in_buckets(r, max(look, 2 * cfg.max_interval_min), look, cfg)
    w, span = (Window.partitionBy("session_id", "bucket").orderBy(*c) for c in (("us", "value"), ("us",)))
    v, us = F.col("value"), F.col("us")
    step, change = (us - F.lag("us").over(w)) / float(unit), v - F.lag("value").over(w)
    top = F.max(F.struct("value", (-us).alias("less")))  # of equal values the earliest
    r = r.withColumns({
        "__step": step, "__change": change, "__low": (v <= F.lag("value").over(w)) & (v <= F.lead("value").over(w)) & (v < cfg.compression_low_mgdl),
        "__pre": top.over(span.rangeBetween(-drop, -1)), "__post": top.over(span.rangeBetween(1, recover)),
    })
    fits = F.col("__low") & (F.col("__pre.value") - v >= cfg.compression_drop_mgdl) & (F.col("__post.value") - v >= cfg.compression_recovery_share * cfg.compression_drop_mgdl)
    r = r.withColumns({"__from": F.when(fits, -F.col("__pre.less")), "__to": F.when(fits, -F.col("__post.less"))})
    r = r.withColumns({"__reach": F.max("__to").over(span.rangeBetween(-recover, 0)), "__begin": F.min("__from").over(span.rangeBetween(0, drop))})
    squeezed = F.when((F.col("__reach") >= us) | (F.col("__begin") <= us), COMPRESSION_LOW).otherwise(0)
    single = range_flag(v, cfg).bitwiseOR(rate_flag(F.col("__step"), F.col("__change"), F.col("__resolution"), cfg)).bitwiseOR(warmup_flag(F.col("ts"), F.col("__started"), cfg))
    told = r.where("home").withColumns({"started_at": F.col("__started"), "resolution": F.col("__resolution"), "flags": single.bitwiseOR(squeezed)})
    return told.select("session_id", *[c for c in readings.columns if c != "session_id"], "started_at", "resolution", "flags")


def flag_counters(flagged: DataFrame) -> DataFrame:
    count = lambda k, name: F.count_if(F.col("flags").bitwiseAND(F.lit(k)) != 0).alias(name)
    return flagged.groupBy("session_id").agg(count(OUT_OF_RANGE, "n_out_of_range"), count(IMPLAUSIBLE_RATE, "n_implausible"), count(WARMUP, "n_warmup"), count(COMPRESSION_LOW, "n_compression"))


def session_steps(readings: DataFrame, sessions_: DataFrame, cfg: Thresholds = DEFAULT, edge: int = 12) -> DataFrame:
    """session_id, user_id, step: median of the first readings less that of the user's session before; null where small."""
    placed = in_buckets(readings, 0, 0, cfg, EDGE_BUCKET_MIN).select("session_id", "ts", "value", "bucket")

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "value"))
        last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("value")))
        return rows.withColumns({"__f": first, "__l": last}).where((F.col("__f") <= edge) | (F.col("__l") <= edge))

    edges = ranked(ranked(placed, "session_id", "bucket"), "session_id")
    edges = edges.groupBy("session_id").agg(F.median(F.when(F.col("__f") <= edge, F.col("value"))).alias("head"), F.median(F.when(F.col("__l") <= edge, F.col("value"))).alias("tail"))
    of_user = Window.partitionBy("user_id").orderBy("started_at", "session_id")
    step = F.col("head") - F.lag("tail").over(of_user)
    known = sessions_.select("session_id", "user_id", "started_at").join(edges, "session_id")
    return known.select("session_id", "user_id", F.when(F.abs(step) >= cfg.sensor_step_threshold_mgdl, step).alias("step"))
