"""Columns of time: spans, local time, raw date texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: three numeric groups, a time of day, an optional meridiem.
DATE = r"(?i)^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{2,4})[\sT]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM|a\.?\s?m\.?|p\.?\s?m\.?)?\s*$"


def minutes(start: Column, stop: Column, unit_s: int = 60) -> Column:
    """Minutes from start to stop, null if either is."""
    return (F.unix_micros(stop) - F.unix_micros(start)) / (unit_s * 1e6)


def local(ts: Column, offset_min: Column) -> Column:
    return F.timestamp_add("MINUTE", offset_min.cast("int"), ts)


def local_hour(ts: Column, offset_min: Column) -> Column:
    return F.hour(local(ts, offset_min))


def local_day(ts: Column, offset_min: Column) -> Column:
    return F.to_date(F.date_trunc("DAY", local(ts, offset_min)))


def date_parts(raw: Column) -> Column:
    """struct(g1, g2, g3, hour, minute, second) of a raw date text, hour on the 24-hour clock; null if it is none."""
    group = lambda i: F.try_to_number(F.nullif(F.regexp_extract(raw, DATE, i), F.lit("")), F.lit("999999")).cast("int")
    mark = F.lower(F.regexp_extract(raw, DATE, 7))
    hour = group(4)
    hour = F.when(mark.startswith("p") & (hour < 12), hour + 12).when(mark.startswith("a") & (hour == 12), 0).otherwise(hour)
    parts = F.struct(group(1).alias("g1"), group(2).alias("g2"), group(3).alias("g3"), hour.alias("hour"), group(5).alias("minute"), F.coalesce(group(6), F.lit(0)).alias("second"))
    return F.when(raw.rlike(DATE), parts)


def assembled(parts: Column, order: Column | str) -> Column:
    """The wall-clock time of date parts under an order DMY, MDY or YMD; impossible dates are null."""
    order = F.lit(order) if isinstance(order, str) else order
    year = F.when(order == "YMD", parts["g1"]).otherwise(F.when(parts["g3"] < 100, parts["g3"] + 2000).otherwise(parts["g3"]))
    month = F.when(order == "DMY", parts["g2"]).when(order == "MDY", parts["g1"]).otherwise(parts["g2"])
    day = F.when(order == "DMY", parts["g1"]).when(order == "MDY", parts["g2"]).otherwise(parts["g3"])
    fits = parts["hour"].between(0, 23) & parts["minute"].between(0, 59) & parts["second"].between(0, 59) & (year > 0)
    return F.when(fits, F.try_make_timestamp_ntz(year, month, day, parts["hour"], parts["minute"], parts["second"].cast("decimal(8,6)")))


def wall_kind(wall: Column, zone: Column | str) -> Column:
    """"skipped" if no instant has this wall clock in the zone (a clock was put forward), "ambiguous" if two have it, else "plain";
    clocks move by half an hour or by an hour."""
    local, at = wall.cast("timestamp"), to_utc(wall, zone)
    later = [F.from_utc_timestamp(F.timestamp_add("MINUTE", F.lit(m), at), zone) == local for m in (30, 60)]
    earlier = [F.from_utc_timestamp(F.timestamp_add("MINUTE", F.lit(-m), at), zone) == local for m in (30, 60)]
    return F.when(F.from_utc_timestamp(at, zone) != local, "skipped").when(F.greatest(*later, *earlier), "ambiguous").otherwise(F.when(local.isNotNull(), "plain"))


def to_utc(wall: Column, zone: Column | str) -> Column:
    """UTC instant of a local wall clock; of two the first, and a time that a gap skips moves by the gap."""
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)
