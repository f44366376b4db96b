"""Streams over files: the same file twice adds nothing, and duplicates within a batch are one."""

import pytest
from pyspark.sql import functions as F

from tidecurve.streaming import pairing, readings, sessions, vendor

SCHEMA = "user_id string, ts timestamp, session_id string, source_record string, value double, flags int"


def test_appends_and_distinct(spark, tmp_path):
    rows = "[('u', timestamp'2026-01-01 00:00:00', 's', 'scan', 5.0D, 0), ('u', timestamp'2026-01-01 00:00:00', 's', 'historic', 4.0D, 0), ('u', timestamp'2026-01-01 00:15:00', 's', 'historic', 6.0D, 1)]"
    df = spark.sql("SELECT * FROM VALUES " + rows[1:-1] + " AS t(user_id, ts, session_id, source_record, value, flags)").coalesce(1)
    df.write.parquet(str(tmp_path / "in/a"))
    stream = lambda: spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = lambda: readings.append_readings(stream(), str(tmp_path / "out"), str(tmp_path / "check"), df.schema).awaitTermination(60)
    run()
    df.write.parquet(str(tmp_path / "in/b"))
    run()
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [4.0, 6.0]
    query = readings.distinct_readings(stream()).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("once").count() == 2
    assert "day" in readings.daily_counts(stream()).columns


def _arrive(df, folder):
    df.coalesce(2).write.mode("append").parquet(folder)


def _run(stream, mode, path, check):
    def write(batch, _):
        batch.write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_windows_are_told_once_when_complete(spark, tmp_path):
    """Three runs over one checkpoint (a restart each): late readings count, and a meal without readings is told too."""
    base = 1_767_225_600  # seconds
    meals = [(k, f"u{k % 3}", base + 3600 * 5 * k) for k in range(12)] + [(99, "nobody", base + 3600)]
    readings = [(f"u{j % 3}", base - 7200 + 600 * (j // 3), 90.0 + j % 7, j % 2) for j in range(1200)]
    late = {("u0", base + 600 * 40, 500.0, 1), ("u1", base + 600 * 41, 501.0, 0)}
    stamp = lambda rows, names: spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    m = stamp([(k, u, s) for k, u, s in meals], "meal_id long, user_id string, s long").withColumnRenamed("ts", "consumed_at")
    everything = stamp([*readings, *late], "user_id string, s long, value double, flags int")
    first, second = everything.where("value < 500 and unix_seconds(ts) < %d" % (base + 3600 * 8)), everything.where("value >= 500 or unix_seconds(ts) >= %d" % (base + 3600 * 8))
    beat = 3600 * 24 * 30
    m_dir, r_dir, out, check = (str(tmp_path / x) for x in ("meals", "readings", "out", "check"))
    m.limit(0).write.parquet(m_dir)
    everything.limit(0).write.parquet(r_dir)
    for k in range(3):
        if k == 0:
            _arrive(m.where("unix_seconds(consumed_at) < %d" % (base + 3600 * 6)), m_dir)
            _arrive(first, r_dir)
        elif k == 1:
            _arrive(m.where("unix_seconds(consumed_at) >= %d" % (base + 3600 * 6)), m_dir)
            _arrive(second, r_dir)
        else:  # time goes on
            _arrive(stamp([(1000, "x", base + beat)], "meal_id long, user_id string, s long").withColumnRenamed("ts", "consumed_at"), m_dir)
            _arrive(stamp([("y", base + beat, 1.0, 0)], "user_id string, s long, value double, flags int"), r_dir)
        read = lambda df, d: spark.readStream.schema(df.schema).parquet(d)
        _run(pairing.closed_windows(read(m, m_dir), read(everything, r_dir), delay="6 hours"), "append", out, check)
    got = {r["meal_id"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == len(meals)
    for k, u, at in meals:
        inside = [(s, v, f) for w, s, v, f in [*readings, *late] if w == u and at - 60 * pairing.PRE_MIN <= s <= at + 60 * pairing.POST_MIN]
        r = got[k]
        assert (r["n_points"], r["n_flagged"], r["peak_mgdl"]) == (len(inside), sum(f != 0 for *_, f in inside), max((v for _, v, _ in inside), default=None))
        assert r["first_rel"] == (min((s - at) / 60 for s, *_ in inside) if inside else None)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_sessions_merge_in_any_order_of_batches(spark, tmp_path, order):
    rows = [(f"u{k % 4}", None if k % 4 == 3 else f"s{k % 3}", 1_767_225_600 + 900 * ((k * 37) % 500)) for k in range(500)]
    df = spark.createDataFrame(rows, "user_id string, serial string, s long").withColumn("ts", F.timestamp_seconds("s"))
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    keyed = sessions.keyed_session(spark)
    for k in order:
        _arrive(df.where(F.pmod(F.xxhash64("s"), F.lit(3)) == k), folder)
        _run(sessions.session_updates(keyed.readStream.schema(df.schema).parquet(folder)), "update", out, check)
    got = {tuple(r) for r in sessions.latest(spark.read.parquet(out)).collect()}
    batch = df.groupBy("user_id", F.coalesce("serial", F.lit("unknown"))).agg(F.min("ts"), F.max("ts"), F.count("*"), F.lit(False))
    assert got == {tuple(r) for r in batch.collect()} and len(got) > 8


def test_a_session_closes_after_its_sensor_s_life(spark, tmp_path):
    hour = lambda serial, *hs: spark.createDataFrame([("u", serial, 3600 * h) for h in hs], "user_id string, serial string, s long").withColumn("ts", F.timestamp_seconds("s"))
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    keyed = sessions.keyed_session(spark)
    for rows in (hour("old", 1, 2, 3), hour("new", 100), hour("new", 300)):
        _arrive(rows, folder)
        _run(sessions.session_updates(keyed.readStream.schema(rows.schema).parquet(folder), late="1 hour", life_days=2), "update", out, check)
    got = {(r["serial"], r["n_readings"], r["closed"]) for r in sessions.latest(spark.read.parquet(out)).collect()}
    assert ("old", 3, True) in got and {s for s, *_ in got} == {"old", "new"}


def test_a_vendor_s_stream_restarts_without_reading_twice(spark, tmp_path):
    """Deliveries come between runs; the vendor's delay is kept back; a restart reads what is new only."""
    folder, out, check = (str(tmp_path / x) for x in ("vendor", "out", "check"))
    deliver = lambda *hours: spark.createDataFrame([(1, "s", 3600 * h, float(h)) for h in hours], "u long, serial string, s long, v double").select("u", "serial", F.timestamp_seconds("s").alias("at"), "v").coalesce(1).write.mode("append").parquet(folder)
    told = vendor.Capabilities("two", native_resolution_min=5, data_delay_minutes=120, is_official_api=True, legal_basis="oauth_user_consent")
    adapter = vendor.ParquetAdapter(folder, told, {"user_id": "u", "serial": "serial", "ts": "at", "value": "v"})
    seen = []
    for hours in ((1, 2, 3, 50), (), (49, 51, 60), (70,)):
        if hours:
            deliver(*hours)
        _run(vendor.readings(spark, adapter, slice_min=600), "append", out, check)
        seen.append(sorted(r["value"] for r in spark.read.parquet(out).collect()))
    assert seen == [[1, 2, 3], [1, 2, 3], [1, 2, 3, 49, 50, 51], [1, 2, 3, 49, 50, 51, 60]]
    row = spark.read.parquet(out).first()
    assert (row["vendor"], row["is_official_api"], row["legal_basis"], row["source_record"]) == ("two", True, "oauth_user_consent", "historic")
    reader = vendor.VendorReader(adapter, 600)
    slices = reader.partitions({"us": 0}, reader.latestOffset())
    assert len(slices) > 5 and all(a.upto == b.after for a, b in zip(slices, slices[1:], strict=False))
    late = vendor.VendorReader(vendor.ParquetAdapter(folder, vendor.Capabilities("x", 5, max_history_days=1), adapter.columns), 600)
    assert late.initialOffset()["us"] == (70 - 24) * 3_600_000_000


def test_state_travels_with_the_rows(spark, tmp_path):
    df = spark.createDataFrame([("u", "s", 1)], "user_id string, serial string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    updates = sessions.session_updates(sessions.keyed_session(spark).readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert "FlatMapGroupsInPandasWithState" in updates._jdf.queryExecution().logical().toString()  # no call to the state for each session
