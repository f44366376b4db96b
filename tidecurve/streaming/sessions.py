"""Sensor sessions as keyed state: one session for each user and serial, merged from batches in any order.

A session is not inferred from gaps. Its state is its start, its end and the number of its readings; a timer closes it
when the watermark has passed the sensor's life after its last reading, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days after its last reading that a sensor may still speak; how late a batch of readings may come (manual uploads).
LIFE_DAYS, LATE = 16, "30 days"


def _told(key: tuple, session: tuple, closed: bool) -> pd.DataFrame:
    return pd.DataFrame([(*key, *session, closed)], columns=["user_id", "serial", "started_us", "ended_us", "n_readings", "closed"])


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state on disk: open sessions needn't fit in memory."""
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def session_updates(readings: DataFrame, late: str = LATE, life_days: float = LIFE_DAYS) -> DataFrame:
    """A row (user_id, serial, started_at, ended_at, n_readings, closed) for each session that a batch changes, and one when it closes. readings: user_id, serial, ts of the
    historic readings, from a stream of a keyed_session(); output mode update."""
    rows = readings.where("ts is not null").select(F.col("user_id").cast("string").alias("user_id"), F.coalesce(F.col("serial").cast("string"), F.lit("unknown")).alias("serial"), "ts", F.unix_micros("ts").alias("us"))
    life_ms = int(life_days * 86_400_000)

    def merged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            session = state.get
            state.remove()
            yield _told(key, session, True)
            return
        low, high, n = state.getOption or (None, None, 0)
        for batch in batches:
            us = batch["us"].to_numpy()
            first, last = int(us.min()), int(us.max())
            low, high = (first, last) if low is None else (min(low, first), max(high, last))
            n += len(us)
        state.update((low, high, n))
        state.setTimeoutTimestamp(max(high // 1000 + life_ms, state.getCurrentWatermarkMs() + 1))
        yield _told(key, (low, high, n), False)

    # State comes and goes with the rows in batches: no call for each session and value.
    keyed = rows.withWatermark("ts", late).groupBy("user_id", "serial")
    held = "started_us long, ended_us long, n_readings long"
    told = keyed.applyInPandasWithState(merged, f"user_id string, serial string, {held}, closed boolean", held, "Update", GroupStateTimeout.EventTimeTimeout)
    return told.select("user_id", "serial", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"), "n_readings", "closed")


def latest(updates: DataFrame) -> DataFrame:
    """user_id, serial, started_at, ended_at, n_readings, closed: the last update of each session."""
    last = F.max_by(F.struct("started_at", "ended_at", "n_readings", "closed"), F.struct("n_readings", "closed"))
    return updates.groupBy("user_id", "serial").agg(last.alias("s")).select("user_id", "serial", "s.*")
