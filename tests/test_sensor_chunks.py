"""Sensor files in many chunks: records, encodings and headers are those of the whole file."""

import csv
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecurve.sources import sensor_csv


@pytest.fixture
def small_chunks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.set("spark.sql.files.openCostInBytes", opened)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a",; \n', max_size=25))
def test_open_quotes_are_those_of_the_csv_module(text):
    """A text with a line more is one record more exactly if no quoted field is open at its end."""
    quoted = False
    for line in text.split("\n"):
        quoted = sensor_csv.stays_quoted(line, quoted, ",")
    rows = lambda t: len(list(csv.reader(t.splitlines(keepends=True))))
    assert quoted == (rows(text + "\nzz\n") == rows(text + "\n"))


def rows_of(text, cut):
    return sorted(str(r) for r in csv.reader(text.splitlines(keepends=True), delimiter=cut) if any(c.strip() for c in r))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
def test_cells_of_chunks(spark, tmp_path, small_chunks, encoding):
    rng = random.Random(encoding)
    odd = {"cp1252": "ñ€é", "latin-1": "ñ\x81é"}.get(encoding, "ñ€é日本")
    want = []
    for k in range(4):
        cut = ",;\t,"[k]
        lines = ["Export " + odd, cut.join(["Device", "Serial Number", "Device Timestamp", "Notes"])]
        for i in range(120):
            note = rng.choice(["", "plain", '"quoted"', '"a ""b"" c"', '"two\nlines ' + odd + '"', '"' + "long\n\n" * rng.randrange(60) + 'end"', 'in"side', f'"has {cut} it"', " "])
            lines.append(cut.join(["x", f"S{k}", f"{1 + i % 28:02d}-01-2026 10:{i % 60:02d}", note]))
        text = "\n".join(lines) + ("\n" if k % 2 else "")
        (tmp_path / f"f{k}.csv").write_bytes(text.encode(encoding))
        want += rows_of(text, cut)
    cells, files = sensor_csv.read_cells(spark, f"file://{tmp_path}/*.csv")
    assert sorted(str(r["cells"]) for r in cells.collect()) == sorted(want)
    assert cells.select("path", "block").distinct().count() > 20
    told = {r["path"][-6:]: (r["cut"], r["encoding"]) for r in files.collect()}
    assert told == {f"f{k}.csv": (",;\t,"[k], encoding.removesuffix("-sig")) for k in range(4)}


def test_an_open_quote_at_the_end_and_wide_fields(spark, tmp_path, small_chunks):
    text = "Device,Serial,Device Timestamp,Notes\n" + "".join(f"x,S,{k},n\n" for k in range(100)) + 'x,S,101,"never closed\n' + "and on\n" * 300
    wide = 'a,b\n"' + "w" * 200_000 + '",1\n'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text(wide)
    (tmp_path / "c.csv").write_text("")
    cells, files = sensor_csv.read_cells(spark, f"file://{tmp_path}/*.csv")
    before = csv.field_size_limit(1 << 30)
    want = rows_of(text.rstrip(), ",") + rows_of(wide, ",")
    csv.field_size_limit(before)
    assert sorted(str(r["cells"]) for r in cells.collect()) == sorted(want)
    assert files.where("length(content_sha256) = 64").count() == 2  # an empty file has no lines


def test_sessions_of_users(spark, tmp_path, small_chunks):
    """Files without a serial are one session of each user, not of all; chunks of a large file meet in one session."""
    for user, n in (("ana", 400), ("ben", 30)):
        (tmp_path / user).mkdir()
        lines = ["Device,Device Timestamp,Historic Glucose mg/dL,Notes", *(f"x,{13 + i // 96:02d}-01-2026 {i // 4 % 24:02d}:{15 * (i % 4):02d},{80 + i % 50},n" for i in range(n))]
        (tmp_path / user / "f.csv").write_text("\n".join(lines))
    user = F.element_at(F.split("path", "/"), -2)
    readings, food, files = sensor_csv.parse(spark, f"file://{tmp_path}/*/*.csv", "UTC", user=user)
    got = {(r["user_id"], r["n"], r["s"]) for r in readings.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s")).collect()}
    assert got == {("ana", 400, 1), ("ben", 30, 1)} and readings.select("session_id").distinct().count() == 2
    assert files.where("problem is null").count() == 2 and food.count() == 430
    assert sensor_csv.parse(spark, f"file://{tmp_path}/*/*.csv", "UTC")[0].select("session_id").distinct().count() == 1
