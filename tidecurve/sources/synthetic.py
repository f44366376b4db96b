"""Synthetic sensor exports: a closed-form glucose curve with meal responses, written as CSV files that the reader takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours of the day's meals, and the rise of each in mg/dL.
MEALS = ((8, 45.0), (14, 65.0), (20, 55.0))


def curve(minute: Column) -> Column:
    """mg/dL at a minute since midnight of the first day: a daily wave and a rise after each meal (t * exp(-t), peak at 45 minutes)."""
    of_day = F.pmod(minute, F.lit(1440)).cast("double")
    rise = F.lit(0.0)
    for hour, height in MEALS:
        t = (of_day - hour * 60) / 45.0
        rise = rise + F.when(t > 0, height * t * F.exp(1 - t)).otherwise(0.0)
    return F.round(95 + 6 * F.sin(of_day * 2 * 3.141592653589793 / 1440) + rise, 0)


def readings(spark: SparkSession, sensors: int, days: int, start: str, step_min: int = 15) -> DataFrame:
    """sensor, wall (local time), value: each sensor follows the one before; as many rows as sensors x days x steps a day."""
    a_day = 1440 // step_min
    rows = spark.range(sensors * days * a_day)
    minute = F.col("id") * step_min
    wall = F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(mins=minute.cast("int"))
    return rows.select((F.col("id") / (days * a_day)).cast("int").alias("sensor"), wall.alias("wall"), curve(minute).alias("value"))


def write_sensor_csv(rows: DataFrame, path: str, pattern: str = "dd-MM-yyyy HH:mm") -> None:
    """A folder for each sensor with CSV files of its readings under a header in English."""
    out = rows.select(
        "sensor", F.lit("Synthetic").alias("Device"), F.format_string("SYN%06d", "sensor").alias("Serial Number"), F.date_format("wall", pattern).alias("Device Timestamp"),
        F.lit(0).alias("Record Type"), F.col("value").cast("int").alias("Historic Glucose mg/dL"), F.lit(None).cast("string").alias("Scan Glucose mg/dL"),
    )
    out.write.partitionBy("sensor").option("header", True).csv(path)
