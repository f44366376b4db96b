"""Meal text, resolution, nutrients, sensor files and idempotent writes."""

import pytest
from pyspark.sql import functions as F

from tidecurve.functions import text
from tidecurve.operators import catalog, upsert
from tidecurve.sources import nutrients, sensor_csv


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "want"), [("piña,  con   limón", "pina con limon"), ("  Mañana! ", "manana"), ("", "")])
def test_normalize(spark, x, want):
    assert one(spark, x, text.normalize) == want


@pytest.mark.parametrize(("x", "value", "unit"), [("2.5 vasos de leche", 2.5, "vaso"), ("3,5 rebanadas de pan", 3.5, "rebanada"), ("media papaya", 0.5, None), ("un mango", 1.0, None), ("4 galletas saladas", 4.0, None), ("papaya", None, None), ("7", None, None)])
def test_quantity(spark, x, value, unit):
    item = one(spark, x, text.parsed_item)
    assert (item.quantity_value, item.quantity_unit) == (value, unit)


def test_items(spark):
    assert one(spark, "nopales, queso y sopa", text.split_items) == ["nopales", "queso", "sopa"]
    assert one(spark, "sopa con pan", text.split_items) == ["sopa con pan"]
    assert one(spark, "mango con yogur", text.split_on_connector) == ["mango", "yogur"] and one(spark, "papaya", text.split_on_connector) == []
    assert one(spark, "en el", text.strip_stopwords) == "en el" and one(spark, "caldo de res", text.strip_stopwords) == "caldo res"
    assert [one(spark, x, text.preparation) for x in ("platanos fritos", "pescado a la plancha", "calabaza de la olla", "pan blanco")] == ["frito", "asado", "hervido", None]


def test_similarity(spark):
    alike = spark.range(1).select(text.similarity(text.trigrams(F.lit("galeta")), text.trigrams(F.lit("galleta"))).alias("s")).first().s
    assert round(alike, 4) == 0.6667


def test_resolution(spark):
    aliases = spark.createDataFrame([("f1", "caldo res", None), ("f2", "sopa con pan", None), ("f3", "mango", None), ("f4", "yogur", None), ("f5", "mango", "u")], "food_id string, normalized string, user_id string")
    texts = spark.createDataFrame([("a", "v", "Sopa con Pan"), ("b", "v", "mango con yógur"), ("c", "u", "mango"), ("d", "v", "2 caldo de res y torta de jamon"), ("e", "v", None), ("f", "v", "caldo rez")], "text_id string, user_id string, text string")
    got = {(r.text_id, r.item_no, r.part_no): (r.food_id, r.method) for r in catalog.resolve_texts(texts, aliases).collect()}
    assert got[("a", 0, 0)] == ("f2", "exact_alias") and got[("c", 0, 0)] == ("f5", "user_alias")
    assert got[("b", 0, 0)][0] == "f3" and got[("b", 0, 1)][0] == "f4"
    assert got[("d", 0, 0)][0] == "f1" and got[("d", 1, 0)] == (None, None)
    assert got[("f", 0, 0)] == ("f1", "fuzzy") and not any(k[0] == "e" for k in got)


def test_nutrients(spark):
    short = '{"foodNutrients":[{"nutrientId":1005,"unitName":"G","value":44.6},{"nutrientId":1005,"value":1},{"nutrientNumber":"291","unitName":"G","value":5.2},{"nutrientId":1003,"value":null}]}'
    nested = '{"foodNutrients":[{"nutrient":{"id":1005,"number":"205","unitName":"g"},"amount":23.71}]}'
    df = spark.createDataFrame([("a", short), ("b", nested), ("c", "{broken"), ("d", "{}"), ("e", None)], "food_id string, payload string")
    got = {(r.food_id, r.nutrient): (r.amount, r.unit) for r in nutrients.nutrients(df).collect()}
    assert got == {("a", "carbohydrate"): (44.6, "g"), ("a", "fiber"): (5.2, "g"), ("b", "carbohydrate"): (23.71, "g")}


def test_sensor_files(spark, tmp_path):
    head = "preamble\nDevice,Serial Number,Device Timestamp,Record Type,Historic Glucose mg/dL,Scan Glucose mg/dL,Notes,Carbohydrates (grams)\n"
    (tmp_path / "a.csv").write_text(head + "d,S1,14-08-2026 00:00,0,95,,,\nd,S1,14-08-2026 00:15,1,,101,,\nd,S1,14-08-2026 00:20,5,,,pozole,45\n", "utf-8-sig")
    spanish = "x\nDispositivo;Número de serie;Sello de tiempo del dispositivo;Histórico de glucosa mmol/L\n"
    (tmp_path / "b.csv").write_bytes((spanish + "d;S2;08-28-2026 07:00 PM;5,0\n").encode("cp1252"))
    (tmp_path / "c.csv").write_text("nothing,of,use\n")
    readings, food, files = sensor_csv.parse(spark, str(tmp_path), "America/Mexico_City")
    got = sorted((r.source_record, str(r.ts), r.tz_offset_min, round(r.value, 3)) for r in readings.collect())
    assert got == [("historic", "2026-08-14 06:00:00", -360, 95.0), ("historic", "2026-08-29 01:00:00", -360, 90.091), ("scan", "2026-08-14 06:15:00", -360, 101.0)]
    assert [(r.note, r.carbs_grams) for r in food.collect()] == [("pozole", 45.0)]
    told = {r.path[-5:]: r for r in files.collect()}
    assert told["a.csv"].date_order == "DMY" and told["b.csv"].unit == "mmol/L" and told["c.csv"].problem


def test_writing_twice_adds_nothing(spark):
    rows = spark.createDataFrame([("u", 1, "s", "scan", 5.0), ("u", 1, "s", "historic", 4.0), ("u", 2, "s", "historic", 6.0)], "user_id string, ts int, session_id string, source_record string, value double")
    first = upsert.merge_readings(rows, None)
    assert sorted(r.value for r in first.collect()) == [4.0, 6.0]
    assert upsert.merge_readings(rows, first).count() == 0


def test_alike_names_are_looked_for_where_a_text_stays_unsure(spark, monkeypatch):
    asked, plain = [], catalog.fuzzy_candidates
    monkeypatch.setattr(catalog, "fuzzy_candidates", lambda labels, *a, **k: asked.append({r.label for r in labels.select("label").collect()}) or plain(labels, *a, **k))
    aliases = spark.createDataFrame([(1, "mango", None), (2, "yogur natural", None), (3, "papaya", None)], "food_id int, normalized string, user_id string")
    sure = spark.createDataFrame([("1", "u", "mango con papaya"), ("2", "u", "mango, papaya"), ("3", "u", "papaya")], "text_id string, user_id string, text string")
    got = sorted((r.text_id, r.item_no, r.part_no, r.food_id, r.method) for r in catalog.resolve_texts(sure, aliases).collect())
    assert got == [("1", 0, 0, 1, "exact_alias"), ("1", 0, 1, 3, "exact_alias"), ("2", 0, 0, 1, "exact_alias"), ("2", 1, 0, 3, "exact_alias"), ("3", 0, 0, 3, "exact_alias")]
    assert asked == []
    some = spark.createDataFrame([("1", "u", "mango con yogur naturel"), ("2", "u", "papayas"), ("3", "u", "zzz con qqq")], "text_id string, user_id string, text string")
    got = sorted((r.text_id, r.item_no, r.part_no, r.item.label, r.food_id, r.method) for r in catalog.resolve_texts(some, aliases).collect())
    assert got == [("1", 0, 0, "mango", 1, "exact_alias"), ("1", 0, 1, "yogur naturel", 2, "fuzzy"), ("2", 0, 0, "papayas", 3, "fuzzy"), ("3", 0, 0, "zzz con qqq", None, None)]
    assert sorted(map(sorted, asked)) == [["papayas", "zzz con qqq"], ["yogur naturel"]]
