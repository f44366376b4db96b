"""Media columns: payloads kept as image members of archives, read back by a Spark data source.

``media_archive`` is a Python data source with both directions.

* Writing: each task streams its rows into one tar archive of 8-bit greyscale PNG members (64 samples a
  row) and a sidecar index of member offsets. Names carry a random part, so a retried or speculative task
  never meets an earlier attempt's file; the commit writes a manifest, and only archives named there exist
  for readers.
* Reading: the driver plans byte ranges over the archives' sizes (it never opens an index). A task reads the
  sidecar, takes the members whose offset falls in its range, and yields Arrow batches bounded in bytes.
  Each member is fetched and checked on its own by offset; a failed read reopens the file and tries that
  member again, and a member that stays broken becomes a row with ``error`` set instead of ending the task.

Null text counts as empty, an empty text as 64 zero bytes. Null keys, repeated rows and clashing extra
columns are harmless: rows are members, each with its own key, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegralType

from tidecurve.llm.common import fresh_path

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
MEMBERS = "key long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_image(data: bytes) -> bytes:
    """Bytes as a greyscale image of 64 samples a row, zero-padded; their number is kept as a text chunk."""
    rows = max(1, -(-len(data) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)
    samples[:, 1:] = np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """The samples of to_image()'s images and the number of bytes before padding. Raises ValueError if broken."""
    if image[:8] != PNG:
        raise ValueError("not an image")
    at, body, n, rows = 8, [], 0, 0
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + size]
        if image[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            rows = struct.unpack(">II", data[:8])[1]
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n = int(data[6:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    samples = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, WIDTH + 1)
    if samples[:, 0].any():
        raise ValueError("unknown row filter")
    return samples[:, 1:].tobytes(), n


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Members in one batch of an archive's index.
INDEXED = 4096


@dataclass
class Archived(WriterCommitMessage):
    name: str
    size: int
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archived:
        store, root = _open(self.path)
        store.create_dir(root)
        name, at, index = f"part-{uuid.uuid4().hex}.tar", 0, ([], [], [])
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for key, data in zip(batch.column(0), batch.column(1), strict=True):
                    image = to_image(data.as_py() or b"")
                    head = tarfile.TarInfo(f"{key.as_py()}.png")
                    head.size = len(image)
                    out.write(head.tobuf(tarfile.USTAR_FORMAT))
                    out.write(image)
                    out.write(bytes(-len(image) % 512))
                    for column, x in zip(index, (key.as_py(), at + 512, len(image)), strict=True):
                        column.append(x)
                    at += 512 + len(image) + -len(image) % 512
            out.write(bytes(1024))
        members = pa.table({"key": pa.array(index[0], pa.int64()), "offset": pa.array(index[1], pa.int64()), "size": pa.array(index[2], pa.int64())})
        with store.open_output_stream(f"{root}/{name}.index") as out, pa.ipc.new_file(out, members.schema) as sink:
            sink.write_table(members, max_chunksize=INDEXED)
        return Archived(name, at + 1024, len(index[0]))

    def commit(self, messages: list[Archived]) -> None:
        store, root = _open(self.path)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Archived]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m:
                for name in (m.name, f"{m.name}.index"):
                    store.delete_file(f"{root}/{name}")


@dataclass
class ByteRange(InputPartition):
    name: str
    low: int
    high: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path = path
        self.range_bytes = int(options.get("range_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/manifest.json") as f:
            archives = json.loads(f.read())
        ranges = [ByteRange(name, low, min(low + self.range_bytes, size)) for name, size in archives for low in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def member(self, store, path: str, source, offset: int, size: int):
        """One member by offset: (source, media, error). Each failed try opens the file anew."""
        error = ""
        for attempt in range(self.retries + 1):
            try:
                source = source or store.open_input_file(path)
                source.seek(offset)
                media = source.read(size)
                from_image(media)
                return source, media, None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                source, error = None, f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return source, None, error

    def members(self, store, path: str, partition: ByteRange) -> Iterator[tuple[int, int, int]]:
        """key, offset and size of the members that begin in a range. The index is in the order of offsets, in batches of
        INDEXED: the first one is found by halving, and only those of the range are read."""
        with store.open_input_file(path) as f:
            index = pa.ipc.open_file(f)
            low, high = 0, index.num_record_batches
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if index.get_batch(middle)["offset"][0].as_py() <= partition.low else (low, middle)
            for i in range(low, index.num_record_batches):
                batch = index.get_batch(i)
                for key, offset, size in zip(*(batch[c].to_pylist() for c in ("key", "offset", "size")), strict=True):
                    if offset >= partition.high:
                        return
                    yield key, offset, size

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        if not partition.name:
            return
        store, root = _open(self.path)
        path, source, rows, held = f"{root}/{partition.name}", None, [], 0
        for key, offset, size in self.members(store, f"{path}.index", partition):
            if partition.low <= offset < partition.high:
                source, media, error = self.member(store, path, source, offset, size)
                rows.append((key, media, error))
                held += size
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def _register(spark: SparkSession) -> None:
    """Make media_archive known. Spark looks its name up in the thread's active session, which a thread begun elsewhere lacks and
    which may be another one of the application; creating a frame makes spark the active one."""
    spark.dataSource.register(MediaArchive)
    spark.createDataFrame([], MEMBERS)


def store_media(df: DataFrame, path: str, key: str = "doc_id", payload: str = "text") -> None:
    """Write (key, payload) as archives under path. key: an integer; payload: a string (as UTF-8) or binary column."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is no integer column")
    _register(df.sparkSession)
    df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """Members of the archives under path: key, media (the image's bytes), error (null if well read)."""
    _register(spark)
    return spark.read.format("media_archive").options(**options).load(path)


FEATURES = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and a small descriptor of each payload: mean, deviation, entropy in bits and a 16-bin histogram."""
    for batch in batches:
        rows = []
        for key, media, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if media is None:
                raise OSError(f"member {key} can't be read: {error}")
            payload, n = from_image(media)
            samples = np.frombuffer(payload, np.uint8)
            counts = np.bincount(samples, minlength=256)
            p = counts[counts > 0] / samples.size
            bins = counts.reshape(16, 16).sum(1) * 255 // samples.size
            text = f"mean={samples.mean():.4f};std={samples.std():.4f};bits={-(p * np.log2(p)).sum() + 0.0:.4f};hist={bins.astype(np.uint8).tobytes().hex()}"
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), text))
        if rows:
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def media_column(docs: DataFrame, key: str = "doc_id", payload: str = "text", path: str | None = None) -> DataFrame:
    """Store every payload, read the stored bytes back, and describe them; one row for each row of docs."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")
    store_media(docs, path, key, payload)
    return read_media(spark, path).mapInArrow(features, FEATURES).withColumnRenamed("key", key)
