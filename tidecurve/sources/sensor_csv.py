"""Sensor exports as CSV files of several locales: files to typed readings and food-log rows.

A file of any size is read in chunks by as many tasks as its bytes ask for (spark.sql.files.maxPartitionBytes). A first small pass
tells of each chunk what the whole file needs: its encoding, its delimiter, and whether a quoted field that an
earlier chunk opens goes on in it. The second cuts the lines into cells; records that a chunk's end cuts are put together from
their pieces. From there on (columns, units, dates, zones) it is DataFrame work over all files at once. A file that can't be
used has a row in ``problems``.
"""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecurve.config import MMOL_TO_MGDL
from tidecurve.functions import text
from tidecurve.functions.times import assembled, date_parts, to_utc, wall_kind
from tidecurve.operators.tables import broadcast_small, settled

# Column by the words that its header holds and doesn't hold, alternatives in order.
COLUMNS = {
    "timestamp": [("timestamp",), ("sello", "tiempo"), ("marca", "tiempo"), ("hora", "dispositivo"), ("fecha", "-nacimiento")],
    "historic": [("historic", "glucos"), ("historico", "glucos")], "scan": [("scan", "glucos"), ("escane", "glucos")], "strip": [("strip", "glucos"), ("tira", "glucos")],
    "serial": [("serial",), ("serie",)], "device": [("device", "-serial", "-timestamp"), ("dispositivo", "-serie", "-hora", "-tiempo")], "carbs_g": [("carbohydrate", "gram"), ("carbohidrato", "gramo")],
    "carbs_servings": [("carbohydrate", "serving"), ("carbohidrato", "racion")], "notes": [("notes",), ("notas",)],
}
STAMP, MAX_PREAMBLE, SNIFFED = ("timestamp", "sello de tiempo", "marca de tiempo"), 8, 8192
DELIMITERS = ",;\t"
#: Files up to so many bytes are named by the SHA-256 of their bytes, larger ones by hashes of their lines.
WHOLE_BYTES = 64_000_000


def delimiter(sample: str) -> str | None:
    counts = [(sample.count(d), -i, d) for i, d in enumerate(DELIMITERS)]
    n, _, best = max(counts)
    return best if n else None


def stays_quoted(line: str, quoted: bool, cut: str) -> bool:
    """Whether a quoted field is open after the line, from whether one is before it."""
    if '"' not in line:
        return quoted
    start, inside, closing = not quoted, quoted, False
    for c in line:
        if inside and not closing:
            closing = c == '"'
        elif inside and c == '"':  # two quotes are one
            closing = False
        elif c == cut:
            start, inside, closing = True, False, False
            continue
        elif inside:  # text after the closing quote
            inside, closing = False, False
        elif start and c == '"':
            inside = True
        start = False
    return inside and not closing


def _chunks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows by the values of their first columns, in order; a chunk may go on in the next batch."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, lambda r: r[:n_keys])


FACTS = "path string, block long, sample binary, utf8 boolean, cp1252 boolean, n long, hash long, ends array<boolean>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk. ends: for each delimiter, whether a quoted field is open at the chunk's end if none, or one, is at its start."""
    kinds = pa.schema([("path", pa.string()), ("block", pa.int64()), ("sample", pa.binary()), ("utf8", pa.bool_()), ("cp1252", pa.bool_()), ("n", pa.int64()), ("hash", pa.int64()), ("ends", pa.list_(pa.bool_()))])
    for (path, block), rows in _chunks(batches, 2):
        sample, kept, utf8, cp1252, n, total, ends = [], 0, True, True, 0, 0, [False, True] * len(DELIMITERS)
        for _, _, line in rows:
            n += 1
            total += int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "big")
            if block == 0 and kept < SNIFFED:
                sample.append(line)
                kept += len(line) + 1
            if not line.isascii():
                for name in ("utf-8", "cp1252"):
                    try:
                        line.decode(name)
                    except UnicodeDecodeError:
                        utf8, cp1252 = utf8 and name != "utf-8", cp1252 and name != "cp1252"
            if b'"' in line:
                plain = line.decode("latin-1")
                ends = [stays_quoted(plain, q, DELIMITERS[i // 2]) for i, q in enumerate(ends)]
        values = (path, block, b"\n".join(sample) if block == 0 else None, utf8, cp1252, n, (total % 2**64) - 2**63, ends)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, kinds, strict=True)], schema=kinds)


def _dialect(sample: pd.Series, utf8: pd.Series, cp1252: pd.Series) -> pd.DataFrame:
    encoding = ["utf-8" if u else "cp1252" if c else "latin-1" for u, c in zip(utf8, cp1252, strict=True)]
    return pd.DataFrame({"cut": [delimiter((s or b"").decode(e, "replace")[:SNIFFED]) for s, e in zip(sample, encoding, strict=True)], "encoding": encoding})


def _record(text: pd.Series, cut: pd.Series) -> pd.Series:
    csv.field_size_limit(1 << 30)
    return pd.Series([next(csv.reader(t.splitlines(keepends=True), delimiter=c or ","), []) for t, c in zip(text, cut, strict=True)])


CELLS = "path string, block long, row_no int, piece string, cells array<string>"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells with their number in the chunk; pieces of records that begin before the chunk (row_no -1) or end after it."""
    csv.field_size_limit(1 << 30)
    kinds = pa.schema([("path", pa.string()), ("block", pa.int64()), ("row_no", pa.int32()), ("piece", pa.string()), ("cells", pa.list_(pa.string()))])
    for (path, block, cut, encoding, quoted), rows in _chunks(batches, 5):
        cut, found, held, row_no = cut or ",", [], [], 0
        foreign = quoted
        for i, (*_, line) in enumerate(rows):
            told = line.decode(encoding)
            held.append(told.removeprefix("\ufeff") if block == 0 and i == 0 else told)
            quoted = stays_quoted(told, quoted, cut)
            if quoted:
                continue
            if foreign:
                found.append((path, block, -1, "\n".join(held), None))
            else:
                cells = next(csv.reader((x + "\n" for x in held), delimiter=cut), [])
                if any(c.strip() for c in cells):
                    found.append((path, block, row_no, None, cells))
                    row_no += 1
            held, foreign = [], False
            if len(found) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)
                found = []
        if held:
            found.append((path, block, -1 if foreign else row_no, "\n".join(held), None))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (first byte of a chunk), line (bytes) of all files under a path; a chunk's lines follow one another in one task."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def file_table(spark: SparkSession, path: str, facts: DataFrame) -> DataFrame:
    """path, cut, encoding, content_sha256, warnings of each file, and the chunks (block, quoted at its start) in order."""
    whole = spark.read.format("binaryFile").load(path).where(F.col("length") <= WHOLE_BYTES).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("whole"))
    some = facts.groupBy("path").agg(
        F.max("sample").alias("sample"), F.bool_and("utf8").alias("utf8"), F.bool_and("cp1252").alias("cp1252"), F.sha2(F.concat_ws(":", F.sum("n").cast("string"), F.sum(F.col("hash").cast("decimal(38,0)")).cast("string")), 256).alias("lines"),
        F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("chunks"),
    )
    dialect = F.pandas_udf(_dialect, "cut string, encoding string")
    some = some.withColumn("t", dialect("sample", "utf8", "cp1252")).select("path", "t.cut", "t.encoding", "lines", "chunks")
    of = F.coalesce(F.instr(F.lit(DELIMITERS), F.col("cut")), F.lit(1)) - 1
    # Whether a quoted field is open at the start of each chunk: the chunks' functions, one after the other.
    start = F.struct(F.lit(False).alias("open"), F.expr("cast(array() as array<struct<block:bigint,quoted:boolean>>)").alias("told"))
    step = lambda acc, c: F.struct(F.get(c["ends"], 2 * of + acc["open"].cast("int")).alias("open"), F.array_append(acc["told"], F.struct(c["block"].alias("block"), acc["open"].alias("quoted"))).alias("told"))
    chunks = F.aggregate("chunks", start, step, lambda acc: acc["told"])
    strange = F.when(F.col("encoding") != "utf-8", F.concat(F.lit("not UTF-8, read as "), "encoding"))
    odd = F.when(F.col("cut") != ",", F.concat(F.lit("fields are parted by "), F.when(F.col("cut") == "\t", "'\\t'").otherwise(F.concat(F.lit("'"), "cut", F.lit("'")))))
    return some.join(whole, "path", "left").select("path", "cut", "encoding", F.coalesce("whole", "lines").alias("content_sha256"), F.array_compact(F.array(strange, odd)).alias("warnings"), chunks.alias("chunks"))


def mended(pieces: DataFrame) -> DataFrame:
    """Rows of the records that chunk ends cut: few, each from the piece that begins it and those that follow."""
    at = Window.partitionBy("path").orderBy("block", "row_no")  # a chunk's foreign piece comes before its own open record
    numbered = pieces.withColumn("record", F.sum(F.when(F.col("row_no") >= 0, 1).otherwise(0)).over(at))
    whole = numbered.groupBy("path", "cut", "record").agg(F.min_by("block", F.struct("block", "row_no")).alias("block"), F.max("row_no").alias("row_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row_no", "piece"))), lambda p: p["piece"]), "\n").alias("text"))

    cells = F.pandas_udf(_record, "array<string>")
    return whole.select("path", "block", "row_no", cells("text", "cut").alias("cells"))


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, files): path, block, row_no (within the block), cells of all rows that aren't blank; and file_table()."""
    lines = raw_lines(spark, path)
    files = settled(file_table(spark, path, settled(lines.mapInArrow(_facts, FACTS))))
    chunks = files.select("path", "cut", "encoding", F.explode("chunks").alias("c")).select("path", "c.block", "cut", "encoding", "c.quoted")
    chunks, fits = broadcast_small(settled(chunks))
    placed = lines.withColumn("id", F.monotonically_increasing_id()).join(chunks, ["path", "block"])
    if not fits:  # a shuffled join mixes the lines: back to chunks, in order
        placed = placed.repartition("path", "block").sortWithinPartitions("path", "block", "id")
    cells = settled(placed.select("path", "block", "cut", "encoding", "quoted", "line").mapInArrow(_cells, CELLS))  # read for headers, orders, readings and notes
    pieces = cells.where("piece is not null").join(broadcast_small(files.select("path", "cut"))[0], "path")
    return cells.where("piece is null").select("path", "block", "row_no", "cells").unionByName(mended(pieces)), files


def column_of(headers: Column, alternatives: list[tuple[str, ...]]) -> Column:
    """Position of the first header that fits the first alternative that any fits; null if none does."""
    def fits(words):
        def one(h: Column) -> Column:
            ok = F.lit(True)
            for w in words:
                ok = ok & (~F.contains(h, F.lit(w[1:])) if w[0] == "-" else F.contains(h, F.lit(w)))
            return ok

        return F.array_min(F.filter(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: one(F.get(headers, i))))

    return F.coalesce(*map(fits, alternatives))


def headers(cells: DataFrame) -> DataFrame:
    """path, header_no, a column position for each of COLUMNS, unit. The header is the first of the first rows that names a time stamp."""
    named = cells.where((F.col("block") == 0) & (F.col("row_no") < MAX_PREAMBLE)).withColumn("names", F.transform("cells", text.header))
    stamp = F.exists("names", lambda n: F.greatest(*[F.contains(n, F.lit(s)) for s in STAMP]))
    first = named.where(stamp & (F.size("names") >= 4)).groupBy("path").agg(F.min(F.struct("row_no", "names")).alias("h")).select("path", F.col("h.row_no").alias("header_no"), F.col("h.names").alias("names"))
    placed = first.select("path", "header_no", "names", *[column_of(F.col("names"), alternatives).alias(f"c_{c}") for c, alternatives in COLUMNS.items()])
    value = F.coalesce("c_historic", "c_scan", "c_strip")
    return placed.withColumn("unit", F.when(F.contains(F.get("names", value), F.lit("mmol")), "mmol/L").otherwise("mg/dL"))


def date_orders(stamps: DataFrame, hint: str | None = None) -> DataFrame:
    """path, date_order (null if it can't be told), how: of the raw time stamps (path, raw) of each file.

    Years first or parts over 12 decide; both over 12 is a mixed file; else the order in which the series is denser by 0.15, else the hint."""
    return _orders(stamps.select("path", date_parts(F.col("raw")).alias("p")), hint)


def _orders(parts: DataFrame, hint: str | None) -> DataFrame:
    """date_orders() of date parts (path, p)."""
    parts = parts.where("p is not null")
    firm = parts.groupBy("path").agg(F.max("p.g1").alias("a"), F.max("p.g2").alias("b"))
    both = parts.select("path", "p", F.explode(F.array(F.lit("DMY"), F.lit("MDY"))).alias("ord")).withColumn("t", assembled(F.col("p"), F.col("ord")).cast("timestamp"))
    # Only gaps of up to an hour are looked at, so windows by day, with the last hour of the day before, see them all.
    day, hour = 86_400_000_000, 3_600_000_000
    of = lambda us: F.floor(us / F.lit(day)).cast("long")
    us = F.col("us")
    near = both.select("path", "ord", F.unix_micros("t").alias("us")).where("us is not null").withColumn("day", F.explode(F.sequence(of(us), of(us + hour))))
    gap = (us - F.lag("us").over(Window.partitionBy("path", "ord", "day").orderBy("us"))) / 6e7
    gaps = near.withColumn("gap", gap).where((F.col("day") == of(us)) & (F.col("gap") > 0) & (F.col("gap") <= 60))
    small = gaps.groupBy("path", "ord").agg(F.count("*").alias("n_small"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)").alias("typical"))  # the upper median
    s = both.groupBy("path", "ord").agg(F.count("*").alias("all"), F.count("t").alias("n"), ((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 6e7).alias("span"))
    s = s.join(small, ["path", "ord"], "left").fillna(0, ["n_small"]).withColumn("n_gaps", F.col("n") - 1)
    density = F.least(F.lit(1.0), F.col("n") / (F.col("span") / F.col("typical") + 1))
    score = F.greatest(F.lit(0.0), 0.4 * F.try_divide("n_small", "n_gaps") + 0.6 * density - (F.col("all") - F.col("n")) / F.col("all"))
    scored = s.withColumn("score", F.when((F.col("n") >= 3) & (F.col("n_small") > 0), score).otherwise(0.0))
    scores = scored.groupBy("path").agg(F.max(F.when(F.col("ord") == "DMY", F.col("score"))).alias("dmy"), F.max(F.when(F.col("ord") == "MDY", F.col("score"))).alias("mdy"))
    told = firm.join(scores, "path", "left")
    a, b, d, m = F.col("a"), F.col("b"), F.col("dmy"), F.col("mdy")
    order = F.when(a >= 1000, "YMD").when((a > 12) & (b > 12), None).when(a > 12, "DMY").when(b > 12, "MDY").when(d - m > 0.15, "DMY").when(m - d > 0.15, "MDY").otherwise(F.lit(hint))
    how = F.when(a >= 1000, "firm").when((a > 12) & (b > 12), "mixed").when((a > 12) | (b > 12), "firm").when(F.abs(d - m) > 0.15, "density").otherwise("hint" if hint else "unknown")
    return told.select("path", order.alias("date_order"), how.alias("how"), F.round("dmy", 6).alias("dmy"), F.round("mdy", 6).alias("mdy"))


def parse(spark: SparkSession, path: str, zone: str, hint: str | None = None, user: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(readings, food_log, files) of all files under a path; wall clocks are in the zone. user: whose a file is, as a column of its
    path; a session is a user's sensor, so that files without a serial are one session of each user. Without it all are one user's."""
    cells, known = read_cells(spark, path)
    heads = settled(headers(cells))
    at = lambda c: F.get("cells", F.col(f"c_{c}"))
    body = cells.join(broadcast_small(heads)[0].drop("names"), "path").where((F.col("block") > 0) | (F.col("row_no") > F.col("header_no")))
    # Written: a plan would put the patterns of date_parts() in place of each use of a part.
    body = settled(body.withColumn("p", date_parts(at("timestamp"))))
    orders = settled(_orders(body.select("path", "p"), hint))
    timed = body.join(broadcast_small(orders)[0], "path").withColumn("wall", assembled(F.col("p"), F.col("date_order"))).where("wall is not null")
    timed = timed.withColumn("ts", to_utc(F.col("wall"), zone)).withColumn("tz_offset_min", ((F.unix_micros(F.col("wall").cast("timestamp")) - F.unix_micros("ts")) / 6e7).cast("short"))
    serial = F.coalesce(F.nullif(F.trim(at("serial")), F.lit("")), F.lit("unknown"))
    device = F.nullif(F.trim(at("device")), F.lit(""))
    factor = F.when(F.col("unit") == "mmol/L", MMOL_TO_MGDL).otherwise(1.0)
    owner = F.lit(None).cast("string") if user is None else user.cast("string")
    timed = timed.withColumn("user_id", owner)
    melted = melt(timed.withColumn("session_id", F.sha2(F.concat_ws(":", "user_id", serial), 256)).withColumn("device", device), {k: text.lenient_number(at(k)) * factor for k in ("historic", "scan", "strip")}, ["path", "user_id", "ts", "tz_offset_min", "session_id", "device"])
    readings = melted.withColumnRenamed("source", "source_record")
    food = timed.select("path", "user_id", "ts", "tz_offset_min", text.lenient_number(at("carbs_g")).alias("carbs_grams"), text.lenient_number(at("carbs_servings")).alias("carbs_servings"), F.nullif(F.trim(at("notes")), F.lit("")).alias("note"))
    food = food.where(F.coalesce(F.col("carbs_grams").cast("string"), F.col("carbs_servings").cast("string"), "note").isNotNull())
    files = known.select("path", "content_sha256", "warnings").join(cells.groupBy("path").agg(F.count("*").alias("rows")), "path").join(heads.select("path", "header_no", "unit"), "path", "left").join(orders, "path", "left")
    problem = F.when(F.col("header_no").isNull(), "no header with a time stamp").when(F.col("how").isNull(), "no time stamp can be read").when(F.col("how") == "mixed", "two date orders in one file").when(F.col("date_order").isNull(), "the date order can't be told; name it")
    files = files.join(zone_counts(timed, zone), "path", "left").fillna(0, ["n_ambiguous", "n_skipped"])
    return readings, food, files.withColumn("problem", problem)


def in_order(readings: DataFrame) -> DataFrame:
    """Readings as files list them: by session and time."""
    return readings.orderBy("path", "session_id", "ts", "source_record", "value")


def zone_counts(walls: DataFrame, zone: str, by: str = "path") -> DataFrame:
    """by, n_ambiguous, n_skipped: local times (wall) that the zone has twice or not at all; to_utc() takes the first, and moves
    skipped ones by the gap."""
    kind = wall_kind(F.col("wall"), zone)
    return walls.groupBy(by).agg(F.count_if(kind == "ambiguous").alias("n_ambiguous"), F.count_if(kind == "skipped").alias("n_skipped"))


def melt(rows: DataFrame, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row (keep..., source, value) for each value that isn't null."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), v.cast("double").alias("value")) for k, v in values.items()]))
    return rows.select(*keep, each.alias("m")).select(*keep, "m.source", "m.value").where("value is not null")


def read_meal_lines(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """consumed_at, free_text of lines 'YYYY-MM-DD HH:MM|text'; comments and lines without a date are left out, the first of a time stays."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    cut = lines.select(F.trim(F.substring_index("value", "|", 1)).alias("t"), F.trim(F.expr("substr(value, instr(value, '|') + 1)")).alias("free_text"))
    timed = cut.withColumn("consumed_at", F.to_utc_timestamp(F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm")), zone)).where("consumed_at is not null and free_text <> ''")
    return timed.groupBy("consumed_at").agg(F.min("free_text").alias("free_text"))
