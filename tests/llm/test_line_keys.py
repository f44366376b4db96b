"""Keys of lines in an encoding of fixed width, and what is done for lines that met another one only."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import check_lines, edited, lev
from tidecurve.llm import line_dedup


def test_lines_within_two_edits_share_a_key_and_parts(spark):
    """Of any two lines within EDITS edits a segment's key of the shorter one is probed by the longer one, and enough parts fit;
    of random ones few do. Characters of one to four bytes."""
    rnd = random.Random(21)
    text = lambda: "".join(rnd.choice("abcdefgh é中😀") for _ in range(rnd.randint(16, 90)))
    pairs = [(x, edited(rnd, x, rnd.randint(0, 2)), True) for x in (text() for _ in range(400))]
    pairs += [(x, "".join(rnd.sample(x, len(x))), False) for x in (text() for _ in range(200))]
    pairs = [(*sorted((a, b), key=len, reverse=True), near) for a, b, near in pairs]
    assert all(lev(a, b) <= 2 for a, b, near in pairs if near)
    df = spark.createDataFrame(pairs, "a string, b string, near boolean").withColumns({"n": F.length("a"), "m": F.length("b"), "aw": F.encode("a", line_dedup.WIDE), "bw": F.encode("b", line_dedup.WIDE)})
    met = F.arrays_overlap(F.array(*line_dedup.index_keys(F.col("bw"), F.col("m"))), F.array(*line_dedup.probe_keys(F.col("aw"), F.col("n"))))
    rows = df.select("near", met.alias("met"), line_dedup.parts_fit(F.col("a"), F.col("b"), F.col("m")).alias("fit")).collect()
    assert all(r.met and r.fit for r in rows if r.near)
    assert sum(r.fit for r in rows if not r.near) < 10


def test_letters_are_counted_where_lines_met_and_unlike_pairs_are_not_folded(spark, monkeypatch):
    """Twelve lines of one segment and the same words in another order: they meet, no letter tells them apart, and no pair gets
    as far as the fold. Of the other lines only the keys are made."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(12)]
    lines = ["the order of the following words is: " + " ".join(rnd.sample(words, 12)) for _ in range(12)]
    lines += ["".join(rnd.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(120)]
    near = lines[40][:30] + "Q" + lines[40][30:]
    told, plain = {}, line_dedup.written

    def written(df, name):
        back = plain(df, name)
        told.setdefault(name, (back.columns, back.count()))
        return back

    monkeypatch.setattr(line_dedup, "written", written)
    _, links = check_lines(spark, [(i, x) for i, x in enumerate([*lines, near])])
    assert links == 1
    assert told["keyed"] == (["id", "own", "asked"], len(lines) + 1)
    assert told["letters"][1] == told["lines"][1] == 12 + 2
    assert told["candidates"][1] == 66 + 1 and told["middles"][1] == 1
