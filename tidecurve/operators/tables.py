"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A settled table is broadcast up to so many bytes, by its rows and the lengths of what they hold.
BROADCAST_BYTES = 16_000_000

_OWN: dict[str, str] = {}


def settled_path(spark: SparkSession, name: str = "settled") -> str:
    """A new path below spark.checkpoint.dir. A local session without that setting gets a temporary folder; a cluster
    must name one that its machines share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        folder = _OWN[app]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: for tiers of joins whose plans would else repeat one another."""
    path = settled_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame) -> tuple[DataFrame, bool]:
    """(df, whether it is small), marked for broadcast if its rows, as text, take BROADCAST_BYTES at most; it is read once for that."""
    size = df.select((F.length(F.to_json(F.struct(*df.columns))) + 32).alias("n")).agg(F.sum("n")).first()[0] or 0
    return (F.broadcast(df), True) if size <= BROADCAST_BYTES else (df, False)
