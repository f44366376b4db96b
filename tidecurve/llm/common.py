"""What the corpus operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast by hand up to so many bytes in memory.
BROADCAST_BYTES = 16_000_000
#: Bytes of a row's fixed part and of a value of a type (strings and arrays of this library's tables: class names, line numbers).
ROW_BYTES, WIDE_BYTES = 32, 64

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without that
    setting (a test) gets a temporary folder; a cluster must name one that its machines share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again. It cuts lineage, survives lost
    executors, and gives the optimizer the true size of what follows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def released(*tables: DataFrame) -> None:
    """Delete tables that written() gave and that no frame in use reads any more: what was made of them is written too."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            df.written_at = None


def fits(df: DataFrame, times: int = 1) -> bool:
    """Whether the frame takes BROADCAST_BYTES at most by its rows and columns, `times` over. It should be a written table: it is
    counted."""
    width = ROW_BYTES + sum(WIDE_BYTES if f.dataType.typeName() in ("string", "binary", "array", "struct") else 8 for f in df.schema)
    return df.count() * width * times <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if it fits; else any join of it is Spark's choice."""
    return F.broadcast(df) if fits(df) else df


def small_lists(df: DataFrame) -> DataFrame:
    """As small(), for written tables with lists: what the lists hold is counted too."""
    lists = [F.size(f.name) * WIDE_BYTES if f.dataType.elementType.typeName() in ("string", "binary", "struct", "array") else F.size(f.name) * 8 for f in df.schema if f.dataType.typeName() == "array"]
    if df.count() * ROW_BYTES > BROADCAST_BYTES:
        return df
    held = df.select(sum((F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)).cast("long") for x in lists), F.lit(0).cast("long")).alias("n")).agg(F.sum("n")).first()[0] or 0
    return small(df) if held <= BROADCAST_BYTES else df


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of one is small; what Arrow holds unused at the end goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit numbers with their bits mixed (a finalizer without collisions)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
