"""Meal text: normal form, items, quantities, preparation. All Java-side expressions with Unicode-aware patterns."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = ("de", "del", "la", "el", "los", "las", "al", "a", "en", "un", "una", "mi", "mis")
NUMBERS = {"un": 1.0, "uno": 1.0, "una": 1.0, "dos": 2.0, "tres": 3.0, "cuatro": 4.0, "cinco": 5.0, "seis": 6.0, "medio": 0.5, "media": 0.5, "cuarto": 0.25}
UNITS = {
    "g": ("g", "gr", "grs", "gramo", "gramos"), "ml": ("ml", "mililitro", "mililitros"), "taza": ("taza", "tazas"),
    "cucharada": ("cucharada", "cucharadas", "cda", "cdas"), "cucharadita": ("cucharadita", "cucharaditas", "cdta", "cdtas"),
    "pieza": ("pieza", "piezas", "pza", "pzas"), "rebanada": ("rebanada", "rebanadas"), "porcion": ("porcion", "porciones"),
    "plato": ("plato", "platos"), "vaso": ("vaso", "vasos"),
}
PREPARATIONS = {
    "frito": ("frito", "fritos", "frita", "fritas", "fritura"), "asado": ("asado", "asada", "asados", "asadas", "a la plancha", "plancha", "parrilla"),
    "hervido": ("hervido", "hervida", "cocido", "cocida", "de la olla"), "horneado": ("horneado", "horneada", "al horno"),
    "crudo": ("crudo", "cruda", "fresco", "fresca"), "capeado": ("capeado", "capeada", "empanizado", "empanizada"),
}
SPLIT = r"(?iU)\s*(?:,|;|\+|\||\by\b|\be\b|/)\s*"
CONNECTOR = r"(?iU)\s+(?:con|sin|acompanado de|acompanada de|mas)\s+"


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What each lower-case character of the basic plane becomes by compatibility decomposition without marks, where it changes:
    those that become one character, and those that become several or none. Hangul syllables stay whole."""
    single, several = {}, {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain != c and c.lower() == c and not unicodedata.category(c).startswith("M"):
            (single if len(plain) == 1 else several)[c] = plain
    return single, several


SINGLE, SEVERAL = _decompositions()


def _unit_lookup() -> Column:
    return F.create_map(*[x for unit, words in UNITS.items() for w in words for x in (F.lit(w), F.lit(unit))])


def _number_lookup() -> Column:
    return F.create_map(*[x for w, n in NUMBERS.items() for x in (F.lit(w), F.lit(n))])


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def unaccented(x: Column) -> Column:
    """Lower case by full compatibility decomposition without accents: combining marks go, letters with marks, wide forms and
    ligatures become plain ones."""
    told = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string,string>")
    singles = lambda t: F.translate(t, "".join(SINGLE), "".join(SINGLE.values()))
    spread = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(told, c), c)), "")
    # One pass replaces letters by letters and marks those that become several; few texts hold one of them.
    quick = lambda t: F.translate(t, "".join([*SINGLE, *SEVERAL]), "".join(SINGLE.values()) + "\x01" * len(SEVERAL))
    bare = F.regexp_replace(F.lower(x), r"\p{M}", "")
    return let(bare, lambda b: let(quick(b), lambda t: F.when(F.contains(t, F.lit("\x01")), F.regexp_replace(singles(spread(b)), r"\p{M}", "")).otherwise(t)))


def normalize(x: Column) -> Column:
    """Lower case, no accents, no punctuation, single spaces: the form in which aliases are compared."""
    return squeeze(F.regexp_replace(unaccented(x), r"(?U)[^\w\s]", " "))


def header(x: Column) -> Column:
    """As normalize(), with the punctuation."""
    return squeeze(unaccented(x))


def strip_stopwords(normalized: Column) -> Column:
    """Without stop words; as it was if nothing is left."""
    kept = F.array_join(F.filter(F.split(normalized, " "), lambda w: ~w.isin(*STOPWORDS) & (w != "")), " ")
    return F.coalesce(F.nullif(kept, F.lit("")), normalized)


def strip_leading_stopwords(x: Column) -> Column:
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: ~F.coalesce(normalize(F.get(words, i)).isin(*STOPWORDS), F.lit(False))))
    rest = F.array_join(F.slice(words, first + 1, F.size(words) + 1), " ")
    return F.coalesce(F.nullif(rest, F.lit("")), x)


def split_items(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, SPLIT), squeeze_ends), lambda p: p != "")


def squeeze_ends(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_on_connector(x: Column) -> Column:
    """Parts around a connector; empty if there is one part only."""
    parts = F.filter(F.transform(F.split(x, CONNECTOR), squeeze_ends), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.expr("cast(array() as array<string>)"))


# Fixed value: a number or number word, perhaps a word, the rest.
QUANTITY = r"(?iU)^\s*(\d+(?:[.,]\d+)?|(?:" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + r")\b)(?:\s*([a-zA-Zñáéíóú]+))?\s+(.+)$"


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def quantity(x: Column) -> Column:
    """struct(value, unit, rest): a leading number or number word; a word that is no unit stays with the rest.

    One match gives all three groups."""
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), squeeze_ends(x).alias("rest"))

    def told(parts: Column) -> Column:
        number, word, rest = F.replace(F.lower(F.get(parts, F.lit(0))), F.lit(","), F.lit(".")), F.lower(F.get(parts, F.lit(1))), squeeze_ends(F.get(parts, F.lit(2)))
        value = F.coalesce(F.try_element_at(_number_lookup(), number), number.try_cast("double"))
        unit = F.when(word != "", F.try_element_at(_unit_lookup(), F.translate(word, "ñáéíóú", "naeiou")))
        known = F.struct(value.alias("value"), unit.alias("unit"))
        named = lambda k: F.struct(k["value"].alias("value"), k["unit"].alias("unit"), F.when((word != "") & k["unit"].isNull(), F.concat_ws(" ", word, rest)).otherwise(rest).alias("rest"))
        return F.when(F.size(parts) == 3, let(known, lambda k: F.when(k["value"].isNotNull(), named(k)).otherwise(none))).otherwise(none)

    return F.when(x.isNotNull(), let(F.split(F.regexp_replace(F.translate(x, "\x01", " "), QUANTITY, "$1\x01$2\x01$3"), "\x01"), told))


def preparation(normalized: Column) -> Column:
    """The first preparation, in the order of the list, one of whose words stands in the text."""
    pairs = [(word, name) for name, words in PREPARATIONS.items() for word in words]
    return F.coalesce(*[F.when(normalized.rlike(rf"(?U)\b{word}\b"), name) for word, name in pairs])


def parsed_item(raw: Column) -> Column:
    """struct(raw, label, normalized, quantity_value, quantity_unit, preparation) of one item."""

    def told(q: Column, label: Column, n: Column) -> Column:
        return F.struct(squeeze_ends(raw).alias("raw"), label.alias("label"), n.alias("normalized"), q["value"].alias("quantity_value"), q["unit"].alias("quantity_unit"), preparation(n).alias("preparation"))

    return let(quantity(raw), lambda q: let(strip_leading_stopwords(q["rest"]), lambda label: let(normalize(label), lambda n: told(q, label, n))))


def lenient_number(x: Column) -> Column:
    """A number with a decimal comma or point; of both separators the comma is dropped; null if it is none."""
    t = squeeze_ends(x)
    plain = F.when(F.contains(t, F.lit(",")) & F.contains(t, F.lit(".")), F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def trigrams(x: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(x), r"(?U)[^\w]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two texts (given as trigram arrays)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
