"""Hot segments with more lines than a block: the split by rarest grams equals all pairs, and copies follow the lines."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import check_lines
from tidecurve.llm import line_dedup


def variants(n, seed, tail=14, letters="0123456789abcdef"):
    rnd = random.Random(seed)
    return [f"shipment notice for the order number {''.join(rnd.choices(letters, k=tail))}" for _ in range(n)]


def hot_rows(spark, lines):
    """The rows of one segment that all lines index and ask for, each in a component of its own."""
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("id"), "line", F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"))
    both = line_dedup.sketches(F.col("line"))
    return df.select(F.lit(1).cast("long").alias("k"), "id", "asks", F.col("id").cast("string").alias("component"), both["s"].alias("s"), both["t"].alias("t")), df.select("id", "line").distinct()


def test_copies_follow_the_lines(spark, monkeypatch):
    """Each line has 7 grams on either side and each of these rows one copy at most. With letters of which few grams are
    shared at 2,048 lines the growth is steeper until all are, below the same bound."""
    counts, plain = [], line_dedup.dealt

    def dealt(rows, block):
        own, asked = plain(rows, block)
        counts.append((own.count() + asked.count(), rows.count()))
        return own, asked

    monkeypatch.setattr(line_dedup, "dealt", dealt)
    for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"):
        counts.clear()
        for n in (2048, 4096, 8192):
            rows, lines = hot_rows(spark, variants(n, n, letters=letters))
            line_dedup.mixed_pairs(rows, lines, 256)
            assert sum(side.count() for side in plain(rows, 256)) == 2 * n * n // 256
        assert all(copies <= given == 14 * n for (copies, given), n in zip(counts, (2048, 4096, 8192), strict=True)), counts
        if len(letters) == 16:
            assert counts[1][0] <= 2.2 * counts[0][0] and counts[2][0] <= 2.2 * counts[1][0], counts


def test_crowded_segments_against_all_pairs(spark, monkeypatch):
    """Variants, links among them, lines with few distinct grams, characters beyond the basic plane and very long lines."""
    rnd = random.Random(5)
    lines = variants(150, 1) + variants(60, 2, tail=3)
    for x in rnd.sample(lines, 60):
        at = rnd.randrange(30, len(x))
        lines.append(rnd.choice([x[:at] + "Q" + x[at:], x[:at] + x[at + 1 :], x[:at] + "\U0001f600" + x[at + 1 :], x[:at] + "\U0001f600\U0001f601" + x[at:]]))
    lines += ["-" * n for n in range(16, 40)] + ["-" * 20 + c + "-" * 9 for c in "abcdef"] + ["ab" * n for n in range(8, 30)] + ["=" * 5000 + c for c in "xyz"]
    rnd.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4 + 1)]
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(line_dedup, "STARS", 1)
    taken, plain = [], line_dedup.rare_grams
    monkeypatch.setattr(line_dedup, "rare_grams", lambda found: taken.append(1) or plain(found))
    _, links = check_lines(spark, docs)
    assert taken and links > 100


def test_rarest_grams(spark):
    """GRAM * EDITS + 1 grams of a line, or all with an entry shared by such lines; a line shorter than a gram has only that."""
    df = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "aaaaaaaa"), (3, "ab"), (4, "\U0001f600a\U0001f601"), (5, "")], "id long, line string")
    got = {r.id: r.grams for r in line_dedup.rare_grams(df).collect()}
    assert [len(got[i]) for i in range(1, 6)] == [7, 2, 1, 2, 1] and 0 not in got[1] and all(0 in got[i] for i in range(2, 6))
