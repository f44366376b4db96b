"""Vendors of sensors as streaming sources: readings by time range, with offsets, replay and stated capabilities.

An adapter says what its vendor can give and fetches the readings of a time range; the source turns that into a stream. An offset
is a time: a batch is the readings after one offset up to the next, in slices that tasks fetch by themselves. Offsets are in
the query's checkpoint, so a restart goes on where the last batch ended, and a batch that is run again fetches the same range. The
vendor's delay is kept back: what it may still add to is not offered yet.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "user_id string, serial string, ts timestamp, value double, source_record string"
#: Minutes that a task fetches at once.
SLICE_MIN = 1440


@dataclass(frozen=True)
class Capabilities:
    """What a vendor's way in can do. is_official_api and legal_basis belong to the lineage of each batch."""

    vendor: str
    native_resolution_min: int
    data_delay_minutes: int = 0
    supports_backfill: bool = True
    max_history_days: int | None = None
    provides_trend: bool = False
    provides_calibration_events: bool = False
    provides_sensor_session_boundaries: bool = False
    is_official_api: bool = False
    legal_basis: str = "user_csv_upload"


class Adapter(ABC):
    """A vendor: its capabilities, the times it has readings of, and the readings of a time range."""

    @abstractmethod
    def capabilities(self) -> Capabilities: ...

    @abstractmethod
    def bounds(self) -> tuple[int, int] | None:
        """First and last time (microseconds) that the vendor has readings of; None if it has none."""

    @abstractmethod
    def fetch(self, after: int, upto: int) -> Iterator[pa.RecordBatch]:
        """The readings with after < time <= upto (microseconds), as SCHEMA; the same rows each time."""


class ParquetAdapter(Adapter):
    """A vendor whose deliveries are Parquet files in a folder. columns: of SCHEMA by their names in the files."""

    def __init__(self, path: str, told: Capabilities, columns: dict[str, str], where: ds.Expression | None = None) -> None:
        self.path, self.told, self.columns, self.where = path, told, columns, where

    def capabilities(self) -> Capabilities:
        return self.told

    def _read(self, columns: list[str], low: int | None = None, high: int | None = None) -> Iterator[pa.RecordBatch]:
        data = ds.dataset(self.path, format="parquet")
        at = ds.field(self.columns["ts"])
        kind = data.schema.field(self.columns["ts"]).type
        stamp = lambda us: pa.scalar(us, pa.timestamp("us", tz=kind.tz)).cast(kind)
        cond = self.where
        for one in ([] if low is None else [at > stamp(low), at <= stamp(high)]):
            cond = one if cond is None else cond & one
        yield from data.to_batches(columns=columns, filter=cond)

    def bounds(self) -> tuple[int, int] | None:
        told = [pc.min_max(b.column(0).cast(pa.timestamp("us", tz=b.column(0).type.tz)).cast(pa.int64())).as_py() for b in self._read([self.columns["ts"]]) if b.num_rows]
        return (min(x["min"] for x in told), max(x["max"] for x in told)) if told else None

    def fetch(self, after: int, upto: int) -> Iterator[pa.RecordBatch]:
        kinds = {"user_id": pa.string(), "serial": pa.string(), "ts": pa.timestamp("us", tz="UTC"), "value": pa.float64(), "source_record": pa.string()}
        for batch in self._read([*self.columns.values()], after, upto):
            of = {k: batch.column(batch.schema.get_field_index(v)) for k, v in self.columns.items()}
            made = [of[k].cast(t) if k in of else pa.array(["historic" if k == "source_record" else None] * batch.num_rows, t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(made, names=list(kinds))


@dataclass
class Slice(InputPartition):
    after: int
    upto: int


class VendorReader(DataSourceStreamReader):
    def __init__(self, adapter: Adapter, slice_min: int) -> None:
        self.adapter, self.slice = adapter, slice_min * 60_000_000

    def initialOffset(self) -> dict:
        """Before the first reading that the vendor still has."""
        told, bounds = self.adapter.capabilities(), self.adapter.bounds()
        if bounds is None:
            return {"us": 0}
        first = bounds[0] - 1 if told.supports_backfill else bounds[1]
        return {"us": first if told.max_history_days is None else max(first, bounds[1] - told.max_history_days * 86_400_000_000)}

    def latestOffset(self) -> dict:
        bounds = self.adapter.bounds()
        if bounds is None:
            return {"us": 0}
        return {"us": max(self.initialOffset()["us"], bounds[1] - self.adapter.capabilities().data_delay_minutes * 60_000_000)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        after, upto = start["us"], end["us"]
        if after == 0 and (bounds := self.adapter.bounds()):  # the vendor had nothing at the stream's start
            after = max(after, bounds[0] - 1)
        n = max(0, math.ceil((upto - after) / self.slice))
        return [Slice(after + i * self.slice, min(upto, after + (i + 1) * self.slice)) for i in range(n)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from self.adapter.fetch(partition.after, partition.upto)

    def commit(self, end: dict) -> None:
        pass


def vendor_source(adapter: Adapter, slice_min: int = SLICE_MIN) -> type[DataSource]:
    """A data source of one vendor, to be registered with spark.dataSource."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"vendor_{adapter.capabilities().vendor}"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> VendorReader:
            return VendorReader(adapter, slice_min)

    return Vendor


def readings(spark: SparkSession, adapter: Adapter, slice_min: int = SLICE_MIN) -> DataFrame:
    """The vendor's readings as a stream (SCHEMA), with the lineage's vendor, is_official_api and legal_basis."""
    source, told = vendor_source(adapter, slice_min), asdict(adapter.capabilities())
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).load().select("*", *[F.lit(told[c]).alias(c) for c in ("vendor", "is_official_api", "legal_basis")])
