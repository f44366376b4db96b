"""Readings as a stream: duplicates within the delay of late data, daily rollups, idempotent appends.

Sensor data arrives one to three hours late; DELAY is the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidecurve.operators.upsert import merge_readings

DELAY = "3 hours"
KEYS = ["user_id", "ts", "session_id"]


def distinct_readings(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each (user, time, session) once; state is kept for the delay only."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEYS)


def daily_counts(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """user_id, day, readings, flagged in tumbling days; a day is told once it can't change any more."""
    days = stream.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "1 day").alias("day"))
    return days.agg(F.count("*").alias("readings"), F.count_if(F.col("flags") != 0).alias("flagged"))


def append_readings(stream: DataFrame, path: str, checkpoint: str, schema: StructType) -> StreamingQuery:
    """Append what is new of each batch to the Parquet table at path; a batch that runs twice adds nothing the second time."""

    exists: list[bool] = []

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        low, high = batch.agg(F.min("ts"), F.max("ts")).first()
        if low is None:
            return
        if not exists:
            spark.createDataFrame([], schema).write.mode("append").parquet(path)  # the table exists from the first batch on
            exists.append(True)
        stored = spark.read.schema(schema).parquet(path).where(F.col("ts").between(low, high))  # other times' files are passed over
        merge_readings(batch, stored).select(*schema.names).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
