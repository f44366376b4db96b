"""Seed, synthetic sensors, single meals, lineage, local times, thresholds, ordered views; and every named query against its SQL."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from tidecurve.config import Thresholds
from tidecurve.functions import text, times
from tidecurve.operators import catalog, upsert
from tidecurve.plans import catalogue, link_queries, views
from tidecurve.sources import seed, sensor_csv, synthetic

SF = "/root/testdata/sf0.001"


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["verdict", "iauc", "quantity", "trigram_fuzzy", *sorted(link_queries.SQLS)])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("part", "orders", "lineitem", "events", "customer", "supplier", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    told = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = lambda xs: sorted((tuple(map(plain, r)) for r in xs), key=str)
    assert rows(got.select(*names).collect()) == rows(told.fetchall())


def test_seed(spark, tmp_path):
    told = """{"foods": [{"slug": "rice", "name": "Rice", "category": "grain", "hint": "rice, cooked", "aliases": ["arroz", "Arróz!"]}, {"slug": "egg", "name": "Egg", "category": "animal", "aliases": []}],
      "recipes": [{"slug": "bowl", "name": "Bowl", "category": "dish", "aliases": ["arroz"], "components": [{"slug": "rice", "fraction": 0.7}, {"slug": "tofu", "fraction": 0.2}]}]}"""
    (tmp_path / "seed.json").write_text(told)
    rows = seed.read_seed(spark, f"file://{tmp_path}/seed.json")
    assert [r.slug for r in rows.orderBy("seed_no").collect()] == ["rice", "egg", "bowl"]
    none = spark.createDataFrame([], "food_id long, slug string, name string, category string, hint string, is_recipe boolean")
    foods = catalog.upsert_foods(none, rows)
    ids = {r.slug: r.food_id for r in foods.collect()}
    assert ids == {"rice": 1, "egg": 2, "bowl": 3}
    again = catalog.upsert_foods(foods, rows)
    assert {r.slug: r.food_id for r in again.collect()} == ids
    parts = catalog.recipe_components(rows, foods)
    assert sorted((r.recipe_food_id, r.component_food_id, r.mass_fraction) for r in parts.where("component_food_id is not null").collect()) == [(3, 1, 0.7)]
    assert [r.component_slug for r in parts.where("component_food_id is null").collect()] == ["tofu"] and catalog.recipe_sums(parts).first().off
    entries = rows.join(foods.select("slug", "food_id"), "slug").withColumn("names", F.concat(F.array("name"), "aliases"))
    assert {r.normalized: r.food_id for r in catalog.alias_table(entries).collect()} == {"rice": 1, "arroz": 1, "egg": 2, "bowl": 3}


def test_synthetic_sensors_are_read_back(spark, tmp_path):
    rows = synthetic.readings(spark, sensors=2, days=14, start="2026-01-20 00:00:00")
    assert rows.count() == 2 * 14 * 96 and rows.agg(F.min("value"), F.max("value")).first()[0] > 70
    synthetic.write_sensor_csv(rows.repartition(1), f"file://{tmp_path}/out")
    readings, _, files = sensor_csv.parse(spark, f"file://{tmp_path}/out/*/*.csv", "Europe/Madrid")
    assert readings.count() == 2 * 14 * 96 and {r.device for r in readings.select("device").distinct().collect()} == {"Synthetic"}
    assert all(r.problem is None and r.n_ambiguous == r.n_skipped == 0 for r in files.collect())
    listed = [(r.session_id, r.ts) for r in sensor_csv.in_order(readings).select("path", "session_id", "ts").collect()]
    assert listed == sorted(listed, key=lambda x: [y[0] for y in listed].index(x[0])) or len(listed) == 2688


def test_written_sensor_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """Users don't make files: a file has many sensors, and any number of files gives the same."""
    folders = iter([f"file://{tmp_path}/one", f"file://{tmp_path}/many"])
    monkeypatch.setattr(link_queries, "settled_path", lambda *_: next(folders))
    rows = lambda: sorted(map(tuple, catalogue.queries()["sensor_files"](spark, SF).collect()))
    first = rows()
    users, n = spark.read.parquet(f"{SF}/events.parquet").agg(F.count_distinct("user_id"), F.count("*")).first()
    assert len(first) == users and len(list(tmp_path.glob("one/*/*/*.txt"))) == 2 < users
    monkeypatch.setattr(link_queries, "FILE_ROWS", n // 4)
    assert rows() == first and 2 < len(list(tmp_path.glob("many/*/*/*.txt"))) <= 10


def test_items_of_a_task_are_bounded(spark, monkeypatch):
    """However few bytes are shuffled, items are dealt by rows; what is linked stays the same."""
    monkeypatch.setattr(catalog, "TASK_ITEMS", 100)
    item = F.struct(F.concat(F.lit("food "), "id").alias("raw"), F.lit(None).cast("double").alias("quantity_value"), F.lit(None).cast("string").alias("quantity_unit"), F.lit(None).cast("string").alias("preparation"))
    resolved = spark.range(2000).select(F.expr("id div 2").alias("text_id"), F.lit("ana").alias("user_id"), F.col("id").cast("int").alias("item_no"), F.lit(0).alias("part_no"), item.alias("item"), F.col("id").alias("food_id"), F.lit(0.97).alias("confidence"), F.lit("exact_alias").alias("method"))
    existing = spark.range(0, 1000, 10).select(F.col("id").alias("meal_id"), (F.col("id") % 20 == 0).alias("user_corrected"))
    linked = catalog.link_items(resolved, existing, rebuild=True)
    assert linked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300
    assert sorted(r["item_no"] for r in linked.collect()) == [i for i in range(2000) if i // 2 % 20]
    assert catalog.link_items(resolved, existing).count() == 1800 and catalog.link_items(resolved).count() == 2000


def test_local_times(spark):
    walls = ["2026-03-08 01:59", "2026-03-08 02:30", "2026-11-01 01:30", "2026-11-01 02:00", "2026-11-01 00:59", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(walls)], "i int, w string").withColumn("wall", F.to_timestamp_ntz("w", F.lit("yyyy-MM-dd HH:mm")))
    got = [r.k for r in df.select("i", times.wall_kind(F.col("wall"), "America/New_York").alias("k")).orderBy("i").collect()]
    assert got == ["plain", "skipped", "ambiguous", "plain", "plain", None]
    half = df.select("i", times.wall_kind(F.to_timestamp_ntz(F.lit("2026-04-05 01:45"), F.lit("yyyy-MM-dd HH:mm")), "Australia/Lord_Howe").alias("k"))
    assert half.first().k == "ambiguous"


def test_single_meal_and_lineage(spark):
    meal = upsert.single_meal(spark, "ana", "2026-07-01 13:30", "America/Mexico_City", "arroz con huevo").first()
    assert meal.consumed_at == datetime.datetime(2026, 7, 1, 19, 30) and meal.tz_offset_min == -360 and len(meal.meal_id) == 64
    files = spark.createDataFrame([("ana", "a", "x"), ("ana", "b", "x"), ("ben", "c", "x"), ("ana", "d", "y")], "user_id string, path string, content_sha256 string")
    counts = spark.createDataFrame([("a", 5, 5), ("d", 4, 1)], "path string, found long, inserted long")
    stored = files.where("path = 'd'")
    got = {r.path: (r.duplicate_file, r.found, r.inserted, r.duplicate) for r in upsert.lineage(files, stored, counts).collect()}
    assert got == {"a": (False, 5, 5, 0), "b": (True, 0, 0, 0), "c": (False, 0, 0, 0), "d": (True, 4, 1, 3)}


def test_full_decomposition(spark):
    given = ["Šťastný Őr", "ﬁn Ａｂ １２", "x² ½", "ŒUVRE", "ÅNGSTRÖM № 5", "İstanbul", "日本 ㎏", None, ""]
    want = ["stastny or", "fin ab 12", "x2 1 2", "œuvre", "angstrom no 5", "istanbul", "日本 kg", None, ""]
    got = [r.n for r in spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == want


def test_thresholds_come_from_the_environment():
    told = "from tidecurve.config import DEFAULT; print(DEFAULT.post_window_min, DEFAULT.min_coverage_pct)"
    out = subprocess.run([sys.executable, "-c", told], env=os.environ | {"TIDECURVE_POST_WINDOW_MIN": "150", "TIDECURVE_MIN_COVERAGE_PCT": "70"}, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["150", "70.0"] and Thresholds().post_window_min == 180


def test_views_are_ordered_for_readers(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, "y"), ("a", 9, "z")], "user_id string, n_exposures int, food_slug string")
    assert [r.food_slug for r in views.ordered(rows, "food_summary").collect()] == ["z", "y", "x"]
