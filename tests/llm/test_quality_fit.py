"""The isolation forest against a plain recursive one, and a fit that copies of a row don't move."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidecurve.llm import common, quality


def harmonic(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def plain_forest(rows, trees, sample, seed):
    """Mean path lengths by recursion, from the same random numbers."""
    rnd = np.random.default_rng(seed)
    size = min(sample, len(rows))
    limit = math.ceil(math.log2(max(size, 2)))
    grown = []
    for _ in range(trees):
        todo, splits = [("", rows[rnd.choice(len(rows), size, replace=False)])], {}
        while todo:
            name, here = todo.pop()
            wide = [k for k in range(rows.shape[1]) if here[:, k].max() > here[:, k].min()]
            if len(name) >= limit or len(here) < 2 or not wide:
                splits[name] = len(here)
                continue
            f = int(rnd.choice(wide))
            v = rnd.uniform(here[:, f].min(), here[:, f].max())
            if not (here[:, f] < v).any() or (here[:, f] < v).all():
                v = here[:, f].max()
            splits[name] = (f, v)
            todo += [(name + "0", here[here[:, f] < v]), (name + "1", here[here[:, f] >= v])]
        grown.append(splits)

    def path(splits, x):
        name = ""
        while isinstance(splits[name], tuple):
            f, v = splits[name]
            name += "0" if x[f] < v else "1"
        return len(name) + harmonic(splits[name])

    return lambda x: 2 ** -(np.mean([path(s, x) for s in grown]) / harmonic(size))


def test_forest_equals_a_plain_one():
    rnd = np.random.default_rng(2)
    rows = np.concatenate([rnd.normal(size=(300, 4)), rnd.normal(6, 1, (6, 4)), np.ones((30, 4))])
    rows[:, 3] = np.round(rows[:, 3])
    ours, plain = quality.Forest.fit(rows, trees=12, sample=64, seed=3), plain_forest(rows, 12, 64, 3)
    scores = ours.score(rows)
    assert np.allclose(scores, [plain(x) for x in rows])
    assert scores[300:306].min() > np.median(scores[:300])


def test_copies_of_a_labelled_row_move_nothing(spark):
    rnd = np.random.default_rng(6)
    said = lambda n: "\n".join(" ".join("".join(rnd.choice(list("abdeginorst"), rnd.integers(2, 9))) for _ in range(9)) for _ in range(n))
    good = [(i, said(8 + i % 5) + "\n") for i in range(300)]
    texts = [(i, t if i % 4 else t + " ".join(f"#{k} ${k}{i} | !" for k in range(30 + i % 3))) for i, t in good]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    copied = spark.createDataFrame(texts + [texts[0]] * 3000, "doc_id long, text string")
    fits = [quality.fit(d, labels, sample_rows=4000) for d in (plain, copied)]
    assert abs(fits[0].threshold - fits[1].threshold) < 1e-9 and math.isfinite(fits[0].threshold)


def test_long_lists_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100_000)
    few = common.written(spark.range(100).select("id", F.array(F.lit(1)).alias("x")), "few")
    long = common.written(spark.range(100).select("id", F.array_repeat(F.lit(1), 1000).alias("x")), "long")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    assert hinted(common.small_lists(few)) and not hinted(common.small_lists(long))


def test_masses_and_threshold_come_from_every_row(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = rnd.normal(size=(4000, 3))
    grown = quality.Forest.fit(rows, trees=5, sample=64)
    masses = [np.bincount(node, minlength=len(tree[0])) for tree, node in zip(grown.trees, grown.leaves(rows), strict=True)]
    assert all(m.sum() == 4000 for m in masses)
    lone = [np.full_like(m, 0) for m in masses]
    assert (grown.weighed(masses, 64).score(rows) < grown.weighed(lone, 64).score(rows)).all()  # fuller leaves lie deeper

    scores, bad = np.round(rnd.random(3000), 3), rnd.random(3000) < 0.3
    bad |= scores > 0.9
    df = spark.createDataFrame([(float(s), bool(b)) for s, b in zip(scores, bad, strict=True)], "score double, bad boolean").repartition(5)
    for ranges in (1, 7, 4096):
        monkeypatch.setattr(quality, "RANGES", ranges)
        assert abs(quality.threshold(df, 2.0) - quality.calibrated(scores, bad, 2.0)) < 1e-12
    assert quality.threshold(df.where("bad"), 2.0) == quality.threshold(df.limit(0), 2.0) == math.inf


def test_labelled_rows_beyond_the_draw_count(spark):
    rnd = np.random.default_rng(6)
    said = lambda n: "\n".join(" ".join("".join(rnd.choice(list("abdeginorst"), rnd.integers(2, 9))) for _ in range(9)) for _ in range(n))
    texts = [(i, said(8 + i % 5) + ("" if i % 4 else " ".join(f"#{k} ${k}{i} | !" for k in range(30)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    seen = []
    plain = quality.threshold
    quality.threshold = lambda scored, strictness: seen.append(scored.count()) or plain(scored, strictness)
    try:
        quality.fit(docs, labels, sample_rows=40)
    finally:
        quality.threshold = plain
    assert seen == [300]
