"""Quality rules: rule statistics of every document, and an isolation forest over them.

Rules give statistics of the whole text (words, symbols, repeated lines and word windows, capitals, marks). Base
rules reject by themselves; of the others an isolation forest makes one score: each tree splits a small sample by random
features at random values, and a document that is alone after few splits is anomalous. The threshold on the
score comes from labelled rows: the one with the best F-measure of rejecting quality 0, in which wrong rejections weigh
``strictness`` times as much as misses.

The forest's splits are random by the method, from about ``sample_rows`` rows drawn by a hash of id and text over the whole
table (each tree looks at 256 of them). All that is counted covers every row: the mass of each leaf, of which its path's length
comes, is that of all documents, and the threshold is that of all labelled documents, found by distributed running sums. The driver
gets the drawn rows and a number for each leaf.

Null and empty texts have no words and fail the base rules. Null ids are drawn row by row; repeated rows get equal verdicts;
other columns are kept (of equal names, those of this operator replace them); an empty table gives an empty result;
without usable labels (none, or one class only) nothing but the base rules rejects.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.llm.common import released, written

SYMBOLS = "#*$%&|<>"  # fixed value
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ranges of scores in which running sums are taken.
RANGES = 4096
MARKS = "!\"#$%&()*+/:;<=>?@[]^_`{|}~"
FEATURES = ("symbols", "symbol_chars", "marks", "bars", "shouts", "capitals", "dup_lines", "repeats", "odd_length", "odd_lines")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts and the features of a whole text."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        found = Counter(windows)
        if len(found) < len(windows):
            covered = 0  # words before this position count already
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    m = max(n, 1)
    mean = word_chars / m
    per_line = n / max(len(lines), 1)
    chars = max(word_chars, 1)
    features = (  # each 0 where the rule has nothing against the text: one line or passage said twice is nothing yet
        n_symbols / m, n_symbols / chars, max(0.0, sum(map(text.count, MARKS)) / chars - 0.02), text.count("|") / m,
        max(0.0, text.count("!") / m - 0.05), max(0.0, sum(map(bytes.isupper, words)) / m - 0.05), max(0, dup_lines - 1) / max(len(lines), 1),
        max(0.0, repeated / m - 0.25), max(0.0, 2.5 - mean, mean - 12.0), max(0.0, 3.0 - per_line),
    )
    return (n, word_chars, n_symbols, dup_lines, repeated), features


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """_average_path() between whole numbers: a leaf's expected rows in a tree's sample needn't be one."""
    m = np.maximum(n - 1, 1.0)
    return np.where(n < 2, np.clip(n - 1, 0.0, 1.0), np.maximum(1.0, 2 * (np.log(m) + np.euler_gamma + 1 / (2 * m) - 1 / (12 * m * m)) - 2 * m / np.maximum(n, 1)))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search among n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over node numbers: feature (-1: leaf), value, left child (right: the next), path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    @staticmethod
    def fit(rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
        random = np.random.default_rng(seed)
        size = min(sample, len(rows))
        limit = math.ceil(math.log2(max(size, 2)))
        grown = []
        for _ in range(trees if size else 0):
            feature, value, left, path = [-1], [0.0], [0], [0.0]
            todo = [(0, rows[random.choice(len(rows), size, replace=False)], 0)]
            while todo:
                node, here, depth = todo.pop()
                low, high = here.min(0), here.max(0)
                wide = np.flatnonzero(high > low)
                if depth >= limit or len(here) < 2 or not len(wide):
                    path[node] = depth + float(_average_path(len(here)))
                    continue
                f = int(random.choice(wide))
                v = random.uniform(low[f], high[f])
                under = here[:, f] < v
                if not under.any() or under.all():
                    under, v = here[:, f] < high[f], high[f]
                feature[node], value[node], left[node] = f, v, len(feature)
                for part in (here[under], here[~under]):
                    todo.append((len(feature), part, depth + 1))
                    for column, x in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                        column.append(x)
            grown.append((np.array(feature), np.array(value), np.array(left), np.array(path)))
        return Forest(grown, float(_average_path(size)) or 1.0)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree the leaf of each row."""
        for feature, value, left, _ in self.trees:
            node = np.zeros(len(rows), int)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = left[at] + (rows[inner, feature[at]] >= value[at])
            yield node

    def weighed(self, masses: list[np.ndarray], sample: int = 256) -> Forest:
        """The forest with path lengths by all rows: masses are the rows of each node (a leaf) of each tree."""
        grown = []
        for (feature, value, left, _), mass in zip(self.trees, masses, strict=True):
            depth = np.zeros(len(feature))
            for node in np.flatnonzero(feature >= 0):  # a node stands before its children
                depth[left[node] : left[node] + 2] = depth[node] + 1
            whole = max(float(mass.sum()), 1.0)
            grown.append((feature, value, left, depth + _mean_path(mass * (min(sample, whole) / whole))))
        return Forest(grown, self.norm)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 if isolated early."""
        total = np.zeros(len(rows))
        for (*_, path), node in zip(self.trees, self.leaves(rows), strict=True):
            total += path[node]
        return 2.0 ** -(total / max(len(self.trees), 1) / self.norm)


def calibrated(scores: np.ndarray, bad: np.ndarray, strictness: float) -> float:
    """The threshold (reject above it) of best F-measure; infinite if there is nothing to learn from."""
    if not bad.any() or bad.all():
        return math.inf
    order = np.argsort(-scores, kind="stable")
    s, b = scores[order], bad[order].astype(float)
    hits, taken = np.cumsum(b), np.arange(1, len(b) + 1)
    w = 1 / strictness**2
    f = (1 + w) * hits / (w * b.sum() + taken)
    f[:-1][s[:-1] == s[1:]] = -1  # a threshold can't part equal scores
    k = int(f.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


@dataclass
class Model:
    forest: Forest
    threshold: float


def _features(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    told = [statistics(t or "") for t in texts]
    return np.array([c for c, _ in told], np.int64).reshape(-1, len(COUNTS)), np.array([f for _, f in told], float).reshape(-1, len(FEATURES))


def threshold(scored: DataFrame, strictness: float) -> float:
    """calibrated() of a frame of any size (score, bad): running sums inside of score ranges, which are summed first."""
    each = scored.groupBy("score").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).withColumn("range", F.floor(F.col("score") * RANGES))
    higher = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy("range").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), F.max("score").alias("top"))
    ranges = ranges.select(F.col("range"), F.sum("n").over(higher).alias("taken_before"), F.sum("n_bad").over(higher).alias("hits_before"), F.lead("top").over(Window.orderBy(F.desc("range"))).alias("below"))
    whole = each.agg(F.sum("n").alias("n"), F.sum("n_bad").alias("bad")).first()
    if not whole["bad"] or whole["bad"] == whole["n"]:
        return math.inf
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.join(F.broadcast(ranges), "range").select(
        "score", (F.coalesce("taken_before", F.lit(0)) + F.sum("n").over(upto)).alias("taken"), (F.coalesce("hits_before", F.lit(0)) + F.sum("n_bad").over(upto)).alias("hits"),
        F.coalesce(F.lead("score").over(inside), "below", F.lit(0.0)).alias("next"),
    )
    w = 1 / strictness**2
    measure = (1 + w) * F.col("hits") / (w * whole["bad"] + F.col("taken"))
    return run.agg(F.max_by((F.col("score") + F.col("next")) / 2, F.struct(measure.alias("f"), "score")).alias("t")).first()["t"]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = 20_000, strictness: float = 2.0, seed: int = 7) -> Model:
    """The forest and the threshold; see the module's text. Rows of one id and text are one document."""

    @F.pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            counts, features = _features(t)
            yield pd.Series(list(np.concatenate([counts, features], axis=1)))

    each = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("place"), F.col(key).alias("known_key"), measured(F.col(text)).alias("m"))
    each = written(each.groupBy("place").agg(F.first("known_key").alias("known_key"), F.first("m").alias("m")), "features")
    scale = 1 << 30
    drawn = each.where(F.pmod(F.xxhash64(F.lit(0), "place"), F.lit(scale)) < int(scale * min(1.0, sample_rows / max(each.count(), 1))))
    got = drawn.select("place", "m").toPandas().sort_values("place")
    forest = Forest.fit(_matrix(got["m"])[:, len(COUNTS) :], seed=seed)

    def masses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(len(tree[0]), np.int64) for tree in forest.trees]
        for frame in frames:
            for mass, node in zip(held, forest.leaves(_matrix(frame["m"])[:, len(COUNTS) :]), strict=True):
                mass += np.bincount(node, minlength=len(mass))
        for i, mass in enumerate(held):
            node = np.flatnonzero(mass)
            yield pd.DataFrame({"tree": np.full(len(node), i), "node": node, "n": mass[node]})

    held = [np.zeros(len(tree[0]), np.int64) for tree in forest.trees]
    for row in each.select("m").mapInPandas(masses, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
        held[row["tree"]][row["node"]] = row["n"]
    forest = forest.weighed(held)

    @F.pandas_udf("double")
    def score(ms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for m in ms:
            yield pd.Series(forest.score(_matrix(m)[:, len(COUNTS) :]))

    known = labels.where(F.col(quality).isNotNull()).groupBy(F.col(key).alias("known_key")).agg(F.min(quality).alias("quality"))
    passed = each.join(known, "known_key").where(~base_failed(F.col("m")[0], F.col("m")[4]))
    scored = written(passed.select(score("m").alias("score"), (F.col("quality") == 0).alias("bad")), "scores")
    model = Model(forest, threshold(scored, strictness))
    released(each, scored)
    return model


def _matrix(m: pd.Series) -> np.ndarray:
    return np.array(m.tolist(), float).reshape(-1, len(COUNTS) + len(FEATURES))


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed, anomaly (the forest's score) and kept."""

    @F.pandas_udf(SCHEMA)
    def verdict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            counts, features = _features(t)
            out = pd.DataFrame(counts, columns=list(COUNTS))
            out["base_failed"] = base_failed(counts[:, 0], counts[:, 4])
            out["anomaly"] = model.forest.score(features)
            out["kept"] = ~out["base_failed"] & ~(out["anomaly"] > model.threshold)
            yield out

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    judged = docs.withColumn("__verdict", verdict(F.col(text)))
    return judged.drop(*[n for n in names if n != text]).select("*", *[F.col(f"__verdict.{n}").alias(n) for n in names]).drop("__verdict")
