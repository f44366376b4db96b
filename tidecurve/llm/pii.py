"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates. Four base kinds (email, ip, card, phone) by fixed patterns and checks, which always stand; and
   wider kinds that need evidence: a spelled-out email, a national id, a local phone number, a person's name.
2. Votes. Five labelers look at each candidate: its form (regex), a gazetteer (given names, top-level domains, area
   codes), cue words before it, words before it that speak against it, and the make-up of its characters. Each votes for
   (1), against (-1) or abstains (0).
3. Expectation-maximisation over the histogram of vote patterns estimates, for each kind, how often it is real and
   how each labeler votes on real and unreal spans.
4. The posteriors train the final classifier, naive Bayes over features of the span and its
   surroundings that no labeler votes on alone. A wider candidate is taken if its probability reaches 1/2.

The histogram's size is bounded by kinds, votes and feature values (fixed numbers), whatever the corpus is; it
covers all rows. No shuffle carries text. The patterns are written so that a text is passed once and no run of
characters is tried from each of its positions.

Null and empty texts have no spans; repeated rows get equal results; other columns are kept by ``redact``; an empty table
gives an empty table (and a model that takes no wider candidate).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.spans import regex_spans

BASE = ("email", "ip", "card", "phone")
WIDER = ("spelled_email", "national_id", "local_phone", "name")
KINDS = BASE + WIDER
#: Given names.
GIVEN = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Steven Ashley Andrew Emily Kevin Donna Brian Michelle George Carol Hans Peter Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Jean Pierre Michel Philippe Alain Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel Francisco Juan Carmen Josefa Dolores Pilar Teresa".split()
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme)\.?"
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|mx|us"
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled_email": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}(?:\x20?\[at\]\x20?|\x20?\(at\)\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}(?:(?:\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20)[A-Za-z0-9-]{{2,63}})++",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "name": rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{TITLES}\x20\p{{Lu}}\p{{Ll}}+|(?:{'|'.join(GIVEN)}))\x20\p{{Lu}}\p{{Ll}}+(?!\p{{L}})",
}
#: What a text holds at least if it has a match that can pass the checks.
GATE = {
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "spelled_email": r"dot[\x20)\]]",
    "national_id": r"[0-9]-[0-9]{2}-[0-9]{4}", "local_phone": r"[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "name": PATTERN["name"],
}
CUES = {
    "email": r"mail|contact|write|@", "ip": r"\bip\b|address|host|server", "card": r"card|visa|mastercard|credit|carte|tarjeta|karte", "phone": r"phone|tel|call|mobile|fax|dial",
    "spelled_email": r"mail|contact|write|reach", "national_id": r"ssn|social|security|national|identity|\bid\b", "local_phone": r"phone|tel|call|mobile|fax|dial|number", "name": r"name|dear|by|author|contact|from|signed|regards",
}
AGAINST = {"name": r"street|avenue|saint|university|the$", "email": r"example of$"}
AGAINST_ELSE = r"version|isbn|order|invoice|figure|section|chapter|serial|part no|page"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VOTES = ("form", "gazetteer", "cue", "against", "make_up")
FEATURES = ("left", "right", "size", "digits", "cued", "line")
CANDIDATE = "struct<start:int,kind:int,stop:int,found:string>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return (n > 0) & (total % 10 == 0)


def base_valid(kind: str, found: Column) -> Column:
    """The check that a match of a base kind has to pass."""
    if kind == "ip":
        return found.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def with_candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """docs and array<struct<start,kind,stop,found>> of base spans and wider candidates, by start and kind (its number
    in KINDS). A wider candidate that touches a base span is no candidate."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as array<{CANDIDATE}>)")

    def found(kind: str) -> Column:
        gate = F.contains(t, F.lit("@")) if kind == "email" else t.rlike(GATE[kind])
        spans = regex_spans(t, PATTERN[kind])
        if kind in BASE:
            spans = F.filter(spans, lambda s: base_valid(kind, s["found"]))
        shaped = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop"), s["found"].alias("found")))
        return F.when(gate, shaped).otherwise(none)

    base, wider = f"{out}__base", f"{out}__wider"
    got = docs.withColumn(base, F.concat(*map(found, BASE))).withColumn(wider, F.concat(*map(found, WIDER)))
    apart = F.filter(F.col(wider), lambda w: ~F.exists(F.col(base), lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))
    return got.withColumn(out, F.array_sort(F.concat(F.col(base), F.when(F.size(wider) > 0, apart).otherwise(F.col(wider))))).drop(base, wider)


def _by_kind(kind: Column, of: dict[str, str], other: str) -> Column:
    chosen = F.lit(other)
    for k, x in of.items():
        chosen = F.when(kind == KINDS.index(k), x).otherwise(chosen)
    return chosen


def evidence(text: Column, c: Column) -> Column:
    """struct(kind, votes..., features...) of a candidate, all small integers."""
    low = F.lower(F.substring(text, F.greatest(c["start"] - 39, F.lit(1)), F.least(c["start"], F.lit(40))))
    kind, found = c["kind"], c["found"]
    digits = _digits(found)
    n = F.length(found)
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    is_ = lambda *k: kind.isin(*[KINDS.index(x) for x in k])
    form = F.when(is_("national_id"), vote(found.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit(True)))
    form = form.when(is_("local_phone"), vote(found.rlike(r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}([-. ]))[2-9][0-9]{2}[-. ][0-9]{4}$"), F.lit(True)))
    form = form.when(is_("spelled_email"), vote(found.rlike(r"\[at\]|\(at\)|\[dot\]|\(dot\)"), ~found.rlike(r"^\S+ at \S+ dot \S+$"))).when(is_("name"), vote(found.rlike(f"^{TITLES} "))).otherwise(1)
    gazetteer = F.when(is_("email", "spelled_email"), vote(F.lower(found).rlike(rf"(?:\.|dot[\])]? ?)(?:{DOMAINS})$")))
    gazetteer = gazetteer.when(is_("name"), vote(found.rlike(f"(?:^| )(?:{'|'.join(GIVEN)}) ")))
    gazetteer = gazetteer.when(is_("phone", "local_phone"), vote(digits.rlike("^(?:1|33|34|44|49|52)?[2-9][0-9]{2}"), digits.rlike("^(?:000|123|999)"))).otherwise(0)
    cue = F.when(F.regexp_like(low, _by_kind(kind, CUES, "$^")), 1).otherwise(0)
    against = F.when(F.regexp_like(low, _by_kind(kind, AGAINST, AGAINST_ELSE)), -1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    make_up = F.when(F.length(digits) > 0, vote(distinct >= 4, distinct <= 2)).otherwise(vote(n.between(5, 60), n > 80))
    side = lambda ch: F.when(ch == "", 0).when(ch.rlike(r"\s"), 1).when(ch.rlike(r"[\p{L}0-9]"), 2).otherwise(3)
    left = side(F.when(c["start"] > 0, F.substring(text, c["start"], F.lit(1))).otherwise(""))
    right = side(F.substring(text, c["stop"] + 1, F.lit(1)))
    size = F.least(F.floor(n / 8), F.lit(4)).cast("int")
    share = F.floor(F.lit(3.0) * F.length(digits) / n).cast("int")
    cued = F.when(low.rlike(r"[:=]\s*$"), 1).when(low.rlike(r"\p{L}\s*$"), 2).otherwise(0)
    line = F.when(low.rlike(r"(?:^|\n)\s*$"), 1).otherwise(0)
    parts = dict(zip((*VOTES, *FEATURES), (form, gazetteer, cue, against, make_up, left, right, size, share, cued, line), strict=True))
    return F.struct(kind.alias("kind"), *[v.cast("int").alias(k) for k, v in parts.items()])


def estimate(histogram: list[tuple], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation over (kind, votes..., features..., count) rows, then naive Bayes on the posteriors.
    Returns log-odds by "kind|feature|value", and by "kind" the prior's."""
    by_kind = defaultdict(list)
    for kind, *rest in histogram:
        by_kind[kind].append((tuple(rest[: len(VOTES)]), tuple(rest[len(VOTES) : -1]), rest[-1]))
    model: dict[str, float] = {}
    for kind, rows in by_kind.items():
        real = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _, _ in rows]  # to begin with, by majority
        for _ in range(rounds):
            mass = [sum(n * p for (_, _, n), p in zip(rows, real, strict=True)), sum(n * (1 - p) for (_, _, n), p in zip(rows, real, strict=True))]
            says = defaultdict(lambda: [0.5, 0.5])  # smoothed
            for (v, _, n), p in zip(rows, real, strict=True):
                for labeler in enumerate(v):
                    says[labeler][0] += n * p
                    says[labeler][1] += n * (1 - p)
            lean = math.log((mass[0] + 1) / (mass[1] + 1))
            real = []
            for v, _, _ in rows:
                odds = lean + sum(math.log(says[x][0] / (mass[0] + 1.5)) - math.log(says[x][1] / (mass[1] + 1.5)) for x in enumerate(v))
                real.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        yes, no = sum(n * p for (_, _, n), p in zip(rows, real, strict=True)), sum(n * (1 - p) for (_, _, n), p in zip(rows, real, strict=True))
        model[str(kind)] = math.log((yes + 1) / (no + 1))
        seen = defaultdict(lambda: [1.0, 1.0])
        for (_, f, n), p in zip(rows, real, strict=True):
            for value in enumerate(f):
                seen[value][0] += n * p
                seen[value][1] += n * (1 - p)
        for (i, value), (a, b) in seen.items():
            model[f"{kind}|{i}|{value}"] = math.log(a / (yes + 2)) - math.log(b / (no + 2))
    return model


def fit(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """The classifier, from the candidates of all rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    told = with_candidates(docs.select(t.alias("text")), "text").where(F.size("candidates") > 0)
    each = told.select("text", F.explode("candidates").alias("c")).select(evidence(F.col("text"), F.col("c")).alias("e")).select("e.*")
    return estimate(sorted(tuple(r) for r in each.groupBy(*each.columns).count().collect()))


def probability(e: Column, model: dict[str, float]) -> Column:
    """The final classifier's probability of a candidate, from its evidence."""
    table = F.create_map(*[x for k, v in (model or {"": 0.0}).items() for x in (F.lit(k), F.lit(v))])
    at = lambda k: F.coalesce(F.try_element_at(table, k), F.lit(0.0))
    kind = e["kind"].cast("string")
    odds = at(kind)
    for i, name in enumerate(FEATURES):
        odds = odds + at(F.concat(kind, F.lit(f"|{i}|"), e[name].cast("string")))
    return 1 / (1 + F.exp(-odds))


def find(docs: DataFrame, model: dict[str, float], text: str = "text", out: str = "pii") -> DataFrame:
    """docs and array<struct<start,stop,kind,base>> of the personal data in each text; kind is a name."""
    held = f"{out}__text"
    got = with_candidates(docs.withColumn(held, F.coalesce(F.col(text), F.lit(""))), held, f"{out}__candidates")
    names = F.array(*map(F.lit, KINDS))
    n_base = len(BASE)
    sure = F.filter(F.col(f"{out}__candidates"), lambda c: (c["kind"] < n_base) | (probability(evidence(F.col(held), c), model) >= 0.5))
    shaped = F.transform(sure, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.get(names, c["kind"]).alias("kind"), (c["kind"] < n_base).alias("base")))
    return got.withColumn(out, shaped).drop(held, f"{out}__candidates")


def redact(docs: DataFrame, model: dict[str, float], text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; spans that overlap are replaced as one."""
    found = find(docs, model, text, "__pii")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        shown = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(shown).alias("out"))

    clean = F.aggregate("__pii", start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return found.withColumn(text, F.when(F.size("__pii") > 0, clean).otherwise(whole)).drop("__pii")
