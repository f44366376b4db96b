"""Nutrients of foods from JSON payloads of two shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nutrient by its ids and legacy numbers.
NUTRIENTS = {
    "energy_kcal": ((1008,), ("208",)), "protein": ((1003,), ("203",)), "fat": ((1004,), ("204",)),
    "carbohydrate": ((1005,), ("205",)), "fiber": ((1079,), ("291",)), "sugars": ((2000, 1063), ("269",)),
}
SHAPE = "foodNutrients array<struct<nutrient:struct<id:bigint,number:string,unitName:string>,nutrientId:bigint,nutrientNumber:string,unitName:string,amount:double,value:double>>"


def nutrient(number: Column, legacy: Column) -> Column:
    name = F.lit(None).cast("string")
    for k, (ids, numbers) in reversed(NUTRIENTS.items()):
        name = F.when(F.coalesce(number.isin(*ids), F.lit(False)) | F.coalesce(legacy.isin(*numbers), F.lit(False)), k).otherwise(name)
    return name


def nutrients(payloads: DataFrame, key: str = "food_id", payload: str = "payload") -> DataFrame:
    """key, nutrient, amount, unit: the first entry of each nutrient that has an amount; broken payloads give nothing."""
    each = payloads.select(key, F.posexplode(F.from_json(payload, SHAPE)["foodNutrients"]).alias("pos", "e"))
    n, e = F.col("e.nutrient"), F.col("e")
    nested = n.isNotNull()
    pick = lambda a, b: F.when(nested, a).otherwise(b)
    rows = each.select(
        key, "pos", nutrient(pick(n["id"], e["nutrientId"]), pick(n["number"], e["nutrientNumber"])).alias("nutrient"), pick(e["amount"], e["value"]).alias("amount"),
        F.coalesce(F.nullif(F.lower(pick(n["unitName"], e["unitName"])), F.lit("")), F.lit("g")).alias("unit"),
    ).where("nutrient is not null and amount is not null")
    return rows.groupBy(key, "nutrient").agg(F.min(F.struct("pos", "amount", "unit")).alias("r")).select(key, "nutrient", "r.amount", "r.unit")


def wanted_foods(foods: DataFrame, stored: DataFrame, limit: int | None = None, refresh: bool = False) -> DataFrame:
    """Foods to ask a nutrient service for: with a hint, no recipe, without nutrients yet (unless refresh); in slug order, limited if asked."""
    rows = foods.where("hint is not null and not is_recipe")
    if not refresh:
        rows = rows.join(stored.select("food_id").distinct(), "food_id", "left_anti")
    rows = rows.orderBy("slug")
    return rows if limit is None else rows.limit(limit)


def upsert_nutrients(stored: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """food_id, nutrient, amount, unit, source: entries of a food and nutrient are replaced by those found."""
    rows = found.withColumn("source", F.lit(source))
    return stored.join(rows.select("food_id", "nutrient"), ["food_id", "nutrient"], "left_anti").select(*rows.columns).unionByName(rows)


def source_map(stored: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """food_id, source, external_id: which entry of a source a food's nutrients come from. found: food_id, external_id."""
    rows = found.select("food_id", F.lit(source).alias("source"), "external_id").distinct()
    return stored.join(rows.select("food_id", "source"), ["food_id", "source"], "left_anti").select(*rows.columns).unionByName(rows)
