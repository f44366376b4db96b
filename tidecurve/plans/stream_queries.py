"""Named queries that run the streams over the driver's events, dealt in batches of which some rows come late."""

from __future__ import annotations

import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecurve.operators.tables import settled_path
from tidecurve.plans import proxy
from tidecurve.plans.proxy import CFG
from tidecurve.streaming import pairing, sessions, vendor

QUERIES, SQLS = {}, {}
#: Files of a batch.
FILES = 4


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


def dealt(rows: DataFrame, batch: Column, batches: int) -> str:
    """A folder where the rows of each batch were written after those of the one before."""
    folder = settled_path(rows.sparkSession, "arriving")
    told = rows.withColumn("__batch", batch)
    for k in range(batches):
        told.where(F.col("__batch") == k).drop("__batch").repartition(FILES).write.mode("append").parquet(folder)
    return folder


def arriving(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def told_by(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream tells until all that is there has been read, from a table in the shared folder."""
    spark = stream.sparkSession
    path, check = settled_path(spark, "told"), settled_path(spark, "progress")
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: A third of the month each; of the last day of a third every seventh event comes with the next batch.
DAY = "date_diff(to_date(ts), to_date(timestamp'2024-01-01'))"
ARRIVES = f"least(2, {DAY} div 10 + if({DAY} % 10 = 9 and event_id % 7 = 0, 1, 0))"


@query("""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value AS v FROM events)
SELECT m.event_id AS meal_id, count(*) AS n_points, round(sum((r.us - m.us) / 1.8e9), 3) AS total_rel, round(sum(r.v), 3) AS total, max(r.v) AS peak
FROM e m JOIN e r ON m.event_type = 'purchase' AND r.event_type <> 'purchase' AND r.user_id = m.user_id AND r.us BETWEEN m.us - 40 * 1800000000::BIGINT AND m.us + 196 * 1800000000::BIGINT GROUP BY 1
""")
def stream_pairing(spark, sf_dir):
    """Purchases as meals and the other events as readings, joined as two streams in three batches with late rows."""
    events = proxy.events(spark, sf_dir)
    stream = arriving(spark, dealt(events, F.expr(ARRIVES), 3), events.schema)
    meals = stream.where("event_type = 'purchase'").select(F.col("event_id").alias("meal_id"), "user_id", F.col("ts").alias("consumed_at"))
    readings = stream.where("event_type <> 'purchase'").select("user_id", "ts", "value", F.lit(0).alias("flags"))
    points = told_by(pairing.window_stream(meals, readings, CFG, "3 days"))
    return points.groupBy("meal_id").agg(F.count("*").alias("n_points"), F.round(F.sum("rel"), 3).alias("total_rel"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("peak"))


@query("SELECT user_id::VARCHAR AS user_id, event_type AS serial, CAST(min(epoch_us(ts)) AS BIGINT) AS started_us, CAST(max(epoch_us(ts)) AS BIGINT) AS ended_us, count(*) AS n_readings FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2")
def stream_sessions(spark, sf_dir):
    """An event type of a user as a sensor, in three batches whose order is not that of time."""
    events = proxy.events(spark, sf_dir).where("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("serial"), "ts", "event_id")
    keyed = sessions.keyed_session(spark)
    stream = arriving(keyed, dealt(events, F.expr(f"case least(2, {DAY} div 10) when 0 then 1 when 1 then 2 else 0 end"), 3), events.schema)
    found = sessions.latest(told_by(sessions.session_updates(stream, late="60 days"), "update"))
    return spark.read.schema(found.schema).parquet(_kept(found)).select("user_id", "serial", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_readings")


def _kept(found: DataFrame) -> str:
    """The path of a frame of another session, written."""
    path = settled_path(found.sparkSession)
    found.write.parquet(path)
    return path


@query("""
WITH r AS (SELECT * FROM events WHERE event_type <> 'purchase')
SELECT user_id::VARCHAR AS user_id, count(*) AS n, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us, round(sum(value), 2) AS total FROM r WHERE ts <= (SELECT max(ts) FROM r) - INTERVAL 3 HOURS GROUP BY 1
""")
def stream_vendor(spark, sf_dir):
    """Events as the deliveries of a vendor with a delay of three hours."""
    told = vendor.Capabilities("events", native_resolution_min=15, data_delay_minutes=180)
    adapter = vendor.ParquetAdapter(f"{sf_dir}/events.parquet", told, {"user_id": "user_id", "serial": "event_type", "ts": "ts", "value": "value"}, ds.field("event_type") != "purchase")
    rows = told_by(vendor.readings(spark, adapter))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.round(F.sum("value"), 2).alias("total"))
