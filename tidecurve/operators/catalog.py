"""Free text to foods: exact aliases first (a user's own before the catalogue's), then trigram suggestions, which are never
assigned by themselves.

aliases: food_id, normalized, user_id (null: everyone's). labels: label_id, user_id, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.config import DEFAULT, Thresholds
from tidecurve.functions import text
from tidecurve.operators.tables import settled

#: Texts of a task; items of a task that stored meals are looked up for.
TASK_TEXTS, TASK_ITEMS = 10_000, 250_000


def exact_candidates(labels: DataFrame, aliases: DataFrame, on: str) -> DataFrame:
    """label_id, food_id, confidence, method of the aliases equal to labels[on]: 1.0 for the user's own, else 0.97."""
    a = aliases.select("food_id", F.col("normalized").alias("__n"), F.col("user_id").alias("__owner"))
    met = labels.join(a, labels[on] == a["__n"]).where(F.col("__owner").isNull() | (F.col("__owner") == F.col("user_id")))
    own = F.col("__owner").isNotNull()
    return met.select("label_id", "food_id", F.when(own, 1.0).otherwise(0.97).alias("confidence"), F.when(own, "user_alias").otherwise("exact_alias").alias("method"))


def fuzzy_candidates(labels: DataFrame, aliases: DataFrame, k: int = 5, cfg: Thresholds = DEFAULT) -> DataFrame:
    """label_id, food_id, confidence, method of the k best foods whose aliases are alike enough.

    Two texts that are alike in a share s of their trigrams have one in common among the rarest of each (all but s of a text's, and
    one more), so the join is on those and frequent trigrams are no hot keys; texts of too different sizes don't meet. Equal
    labels are compared once. Ties: the smaller alias first."""
    names = labels.select("normalized").distinct().withColumn("grams", text.trigrams(F.col("normalized")))
    known = aliases.select(F.col("normalized").alias("alias")).distinct().withColumn("grams", text.trigrams(F.col("alias")))
    often = known.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("often"))
    least = cfg.suggest_min_similarity - 1e-6  # similarities are compared as single precision below

    def rarest(texts: DataFrame, name: str, own: str) -> DataFrame:
        each = texts.select(name, F.size("grams").alias("size"), F.explode("grams").alias("g")).join(often, "g", "left")
        held = each.groupBy(name, "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g"))).alias("order"))
        some = F.slice("order", 1, F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1)
        return held.select(name, F.transform("order", lambda o: o["g"]).alias(own), F.explode(some).alias("o")).select(name, own, F.col("o.g").alias("g"))

    n, m = F.size("a"), F.size("b")
    pairs = rarest(names, "normalized", "a").join(rarest(known, "alias", "b"), "g").where((m >= n * least) & (n >= m * least)).dropDuplicates(["normalized", "alias"])
    alike = pairs.select("normalized", "alias", text.similarity(F.col("a"), F.col("b")).alias("sim")).where(F.col("sim").cast("float") >= cfg.suggest_min_similarity)
    met = labels.join(alike, "normalized").join(aliases.select("food_id", F.col("normalized").alias("alias"), F.col("user_id").alias("__owner")), "alias")
    met = met.where(F.col("__owner").isNull() | (F.col("__owner") == F.col("user_id")))
    by_label = Window.partitionBy("label_id").orderBy(F.desc("sim"), "alias", "food_id")
    first = met.withColumn("place", F.row_number().over(by_label)).where(F.col("place") <= 3 * k)
    best = first.groupBy("label_id", "food_id").agg(F.min(F.struct((-F.col("sim")).alias("less"), "alias")).alias("b"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("label_id").orderBy("b.less", "b.alias", "food_id"))).where(F.col("place") <= k)
    return ranked.select("label_id", "food_id", F.least(F.lit(cfg.fuzzy_cap), -F.col("b.less")).alias("confidence"), F.lit("fuzzy").alias("method"))


def exact_tiers(labels: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label_id, food_id, confidence, method of exact matches, else of those without stop words; the labels without either)."""
    named = settled(labels.withColumn("normalized", text.normalize(F.col("label"))).where("normalized <> ''").withColumn("stripped", text.strip_stopwords(F.col("normalized"))))
    first = settled(exact_candidates(named, aliases, "normalized"))
    rest = settled(named.join(first, "label_id", "left_anti"))
    second = settled(exact_candidates(rest.where("stripped <> normalized"), aliases, "stripped"))
    return first.unionByName(second), rest.join(second, "label_id", "left_anti")


def best_few(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("label_id").orderBy(F.desc("confidence"), "food_id"))
    return candidates.withColumn("place", place).where(F.col("place") <= k).drop("place")


def resolve_labels(labels: DataFrame, aliases: DataFrame, k: int = 5, cfg: Thresholds = DEFAULT) -> DataFrame:
    """label_id, food_id, confidence, method: exact, else exact without stop words, else fuzzy; at most k a label."""
    met, rest = exact_tiers(labels, aliases)
    return best_few(met.unionByName(settled(fuzzy_candidates(rest, aliases, k, cfg))), k)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """label_id, food_id, confidence, method of the best candidate; the smaller food id of equals."""
    best = candidates.groupBy("label_id").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "food_id", "method")).alias("b"))
    return best.select("label_id", "b.food_id", (-F.col("b.less")).alias("confidence"), "b.method")


def resolve_texts(texts: DataFrame, aliases: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Items of meal texts (text_id, user_id, text) with their best candidate.

    A text that is an alias as a whole is one item. Else it is split; an item without an exact match is split again at a connector
    if two parts or more match exactly, or one of two parts does."""
    sure = lambda c: c.where(F.col("confidence") >= cfg.auto_assign_min)
    named = lambda rows, label: rows.select("label_id", "user_id", label.alias("label"))
    # What is alike is never sure (unless the thresholds say so), and only what is sure splits a text: so alike names are looked for
    # at the end, for items and parts that stay.
    alike = cfg.fuzzy_cap >= cfg.auto_assign_min

    def known(labels: DataFrame) -> DataFrame:
        return settled(best_candidates(resolve_labels(labels, aliases, cfg=cfg) if alike else best_few(exact_tiers(labels, aliases)[0], 5)))

    def completed(rows: DataFrame, label: Column, found: DataFrame) -> DataFrame:
        """rows with their best candidate, of which the exact ones are found."""
        if not alike:
            rest = settled(named(rows, label).join(found, "label_id", "left_anti").withColumn("normalized", text.normalize(F.col("label"))).where("normalized <> ''"))
            if not rest.isEmpty():
                found = found.unionByName(settled(best_candidates(fuzzy_candidates(rest, aliases, cfg=cfg))))
        return rows.join(found, "label_id", "left")

    clean = texts.withColumn("text", text.squeeze_ends(F.coalesce("text", F.lit("")))).where("text <> ''")
    # Texts are short and their work long: dealt by rows, as a file's bytes would give them to few tasks.
    clean = settled(clean.repartition(max(1, -(-texts.count() // TASK_TEXTS))))
    whole = sure(known(named(clean.withColumn("label_id", F.col("text_id")), F.col("text"))))
    wholes = clean.join(whole.select(F.col("label_id").alias("text_id"), "food_id", "confidence", "method"), "text_id").select("text_id", "user_id", F.lit(0).alias("item_no"), F.lit(0).alias("part_no"), text.parsed_item(F.col("text")).alias("item"), "food_id", "confidence", "method")
    wholes = settled(wholes)
    rest = clean.join(wholes.select("text_id"), "text_id", "left_anti")
    items = rest.select("text_id", "user_id", F.posexplode(F.transform(text.split_items(F.col("text")), text.parsed_item)).alias("item_no", "item"))
    items = settled(items.withColumn("label_id", F.concat_ws(":", "text_id", "item_no")))
    found = known(named(items, F.col("item.label")))
    parts = items.join(sure(found).select("label_id"), "label_id", "left_anti").select("text_id", "user_id", "item_no", F.col("label_id").alias("item_id"), F.posexplode(text.split_on_connector(F.col("item.label"))).alias("part_no", "part"))
    parts = settled(parts.withColumn("label_id", F.concat_ws(":", "item_id", "part_no")))
    part_found = known(named(parts, F.col("part")))
    counts = parts.join(part_found, "label_id", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= cfg.auto_assign_min).alias("hits"))
    split = settled(counts.where((F.col("hits") >= 2) | ((F.col("hits") == 1) & (F.col("n") == 2))).select("item_id"))
    split_rows = completed(parts.join(split, "item_id", "left_semi"), F.col("part"), part_found).select("text_id", "user_id", "item_no", "part_no", text.parsed_item(F.col("part")).alias("item"), "food_id", "confidence", "method")
    kept = completed(items.join(split.withColumnRenamed("item_id", "label_id"), "label_id", "left_anti"), F.col("item.label"), found)
    item_rows = kept.select("text_id", "user_id", "item_no", F.lit(0).alias("part_no"), "item", "food_id", "confidence", "method")
    return wholes.unionByName(item_rows).unionByName(split_rows)


def status(confidence, cfg: Thresholds = DEFAULT):
    return F.when(confidence >= cfg.auto_assign_min, "auto_assigned").when(confidence.isNotNull(), "needs_confirmation").otherwise("unresolved")


def link_items(resolved: DataFrame, existing: DataFrame | None = None, rebuild: bool = False, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Meal items to store: a food and a method only where it is sure, the confidence either way. Meals that have items are
    skipped (unless rebuild), meals with an item that a user corrected always."""
    rows = resolved.withColumnRenamed("text_id", "meal_id")
    if existing is not None:
        # Dealt by rows: shuffled bytes tell little of what a task's items take when they are sorted and counted.
        rows = rows.repartition(max(1, -(-resolved.count() // TASK_ITEMS)), "meal_id")
        held = existing.groupBy("meal_id").agg(F.bool_or("user_corrected").alias("corrected"))
        rows = rows.join(held.where("corrected") if rebuild else held, "meal_id", "left_anti")
    sure = F.col("confidence") >= cfg.auto_assign_min
    return rows.select(
        "meal_id", "user_id", "item_no", "part_no", F.col("item.raw").alias("raw_label"), F.when(sure, F.col("food_id")).alias("food_id"), F.col("confidence").alias("resolution_confidence"), F.when(sure, F.col("method")).alias("resolution_method"),
        F.col("item.quantity_value").alias("quantity_value"), F.col("item.quantity_unit").alias("quantity_unit"), F.col("item.preparation").alias("preparation"), F.lit(False).alias("user_corrected"), status(F.col("confidence"), cfg).alias("status"),
    )


def link_report(items: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return items.agg(F.count("*").alias("items"), n("auto_assigned").alias("auto_assigned"), n("needs_confirmation").alias("needs_confirmation"), n("unresolved").alias("unresolved"), F.try_divide(n("auto_assigned"), F.count("*")).alias("auto_assign_rate"))


def suggested(items: DataFrame, aliases: DataFrame, cfg: Thresholds = DEFAULT) -> DataFrame:
    """Unassigned labels (user_id, raw_label, n) with the food that their text suggests, if any, and its confidence."""
    waiting = settled(items.where("food_id is null").groupBy("user_id", "raw_label").agg(F.count("*").alias("n")).withColumn("label_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "raw_label"), 256)))
    found = best_candidates(resolve_labels(waiting.select("label_id", "user_id", F.col("raw_label").alias("label")), aliases, cfg=cfg))
    return waiting.join(found.select("label_id", F.col("food_id").alias("suggestion"), "confidence"), "label_id", "left").drop("label_id")


def pending(items: DataFrame, limit: int = 50) -> DataFrame:
    """Unassigned labels, the most frequent first."""
    return items.where("food_id is null").groupBy("user_id", "raw_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id", "raw_label").limit(limit)


def confirm(items: DataFrame, aliases: DataFrame, confirmed: DataFrame, learn: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items and aliases after a user's confirmations (meal_id, item_no, part_no, food_id); a new own alias is learned from the raw label."""
    key = ["meal_id", "item_no", "part_no"]
    c = confirmed.select(*key, F.col("food_id").alias("__food"))
    out = items.join(c, key, "left")
    hit = F.col("__food").isNotNull()
    out = out.withColumn("food_id", F.coalesce("__food", "food_id")).withColumn("resolution_method", F.when(hit, "manual").otherwise(F.col("resolution_method"))).withColumn("resolution_confidence", F.when(hit, 1.0).otherwise(F.col("resolution_confidence"))).withColumn("user_corrected", F.col("user_corrected") | hit)
    if learn:
        new = out.where(hit).select(F.col("__food").alias("food_id"), text.normalize(F.col("raw_label")).alias("normalized"), "user_id").where("normalized <> ''")
        new = new.groupBy("normalized", "user_id").agg(F.min("food_id").alias("food_id"))
        aliases = aliases.unionByName(new.join(aliases, ["normalized", "user_id"], "left_anti").select(*[c for c in aliases.columns if c in ("food_id", "normalized", "user_id")]), allowMissingColumns=True)
    return out.drop("__food"), aliases


def alias_table(entries: DataFrame) -> DataFrame:
    """food_id, alias, normalized, user_id (null) of seed entries (seed_no, food_id, names array): the first claimant wins an alias."""
    each = entries.select("seed_no", "food_id", F.posexplode("names").alias("pos", "alias")).withColumn("normalized", text.normalize(F.col("alias"))).where("normalized <> ''")
    first = F.row_number().over(Window.partitionBy("normalized").orderBy("seed_no", "pos"))
    return each.withColumn("place", first).where("place = 1").select("food_id", "alias", "normalized", F.lit(None).cast("string").alias("user_id"))


def upsert_foods(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """food_id, slug, name, category, hint, is_recipe after a seed: a known slug keeps its id and takes the seed's values, a new one gets
    an id after the largest, in seed order; stored foods that the seed doesn't name stay."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy("seed_no"))
    first = seed.withColumn("__place", place).where("__place = 1").select("seed_no", "slug", "name", "category", "hint", "is_recipe")
    known = first.join(stored.select("slug", "food_id"), "slug").drop("seed_no")
    top = stored.agg(F.coalesce(F.max("food_id"), F.lit(0)).alias("top"))
    fresh = first.join(stored, "slug", "left_anti").crossJoin(top)  # one row: a seed is configuration
    fresh = fresh.withColumn("food_id", F.col("top") + F.row_number().over(Window.orderBy("seed_no"))).drop("top", "seed_no")
    columns = ["food_id", "slug", "name", "category", "hint", "is_recipe"]
    return stored.join(first, "slug", "left_anti").select(*columns).unionByName(known.select(*columns)).unionByName(fresh.select(*columns))


def recipe_components(seed: DataFrame, foods: DataFrame) -> DataFrame:
    """recipe_food_id, component_food_id (null if no food has the slug), component_slug, mass_fraction of the seed's recipes."""
    each = seed.where("is_recipe").select("slug", F.explode("components").alias("c")).select("slug", F.col("c.slug").alias("component_slug"), F.col("c.fraction").alias("mass_fraction"))
    ids = foods.select("slug", "food_id")
    named = each.join(ids.withColumnRenamed("food_id", "recipe_food_id"), "slug")
    return named.join(ids.select(F.col("slug").alias("component_slug"), F.col("food_id").alias("component_food_id")), "component_slug", "left").select("recipe_food_id", "component_food_id", "component_slug", "mass_fraction")


def recipe_sums(components: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """recipe_food_id, total, off: the sum of mass fractions of each recipe and whether it misses 1."""
    return components.groupBy("recipe_food_id").agg(F.sum("mass_fraction").alias("total")).withColumn("off", F.abs(F.col("total") - 1) > tolerance)
