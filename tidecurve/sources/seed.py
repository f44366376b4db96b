"""The catalogue's seed: JSON (or YAML, where a reader is installed) with foods and recipes, to tables of foods, aliases and components."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOD = "slug string, name string, category string, hint string, aliases array<string>"
SHAPE = f"foods array<struct<{FOOD.replace(' ', ':').replace(',:', ',')}>>, recipes array<struct<{FOOD.replace(' ', ':').replace(',:', ',')},components:array<struct<slug:string,fraction:double>>>>"


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """seed_no, slug, name, category, hint, aliases, components, is_recipe: foods in their order, then recipes."""
    docs = spark.read.text(path, wholetext=True)
    if path.rstrip("/").endswith((".yaml", ".yml")):
        import yaml  # optional: a seed is a small file of configuration

        docs = spark.createDataFrame([(json.dumps(yaml.safe_load(r.value)),) for r in docs.collect()], "value string")
    told = docs.select(F.from_json("value", SHAPE).alias("s"))
    foods = told.select(F.posexplode("s.foods").alias("pos", "f")).select("pos", "f.*", F.expr("cast(array() as array<struct<slug:string,fraction:double>>)").alias("components"), F.lit(False).alias("is_recipe"))
    recipes = told.select(F.posexplode("s.recipes").alias("pos", "f")).select("pos", "f.*", F.lit(True).alias("is_recipe"))
    seed_no = F.col("pos") + F.when(F.col("is_recipe"), 1_000_000).otherwise(0)
    return foods.unionByName(recipes).withColumn("seed_no", seed_no).drop("pos")
