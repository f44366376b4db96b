"""Packing by optimal length buckets.

1. Sequences: a text has as many tokens as white-space words, or as a given length column or column of token ids says. A text
   over the window is cut into windows of ``window`` tokens and a rest, so no token is lost.
2. The global histogram of sequence lengths has at most ``window`` + 1 rows, whatever the corpus is; a dynamic program
   over it chooses at most ``buckets`` upper bounds that minimise the padding of all sequences together.
3. Inside a bucket, sequences padded to its bound are dealt into batches of at most ``budget`` tokens.
   Places within a bucket are counted over hashed groups (their number follows the histogram's total), each
   ranked by itself and moved by the counts of the groups before, so no task ranks a whole bucket; repeated
   sequences are ranked as counts, in pieces of their own groups. All batches but a bucket's last are full.

``with_tokens`` gives each packed sequence its range of the text's token ids, so that a batch holds what a model reads.

Null and empty texts are one sequence of length 0 (in the first bucket). Rows are told apart by key, and equal keys
by length; repeated rows are repeated sequences and get places of their own. An empty table has no buckets and gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.llm.common import written

WINDOW, BUCKETS, BUDGET = 2048, 16, 65_536
#: Sequences that one group ranks, about.
GROUP_ROWS = 5_000


def word_count(text: Column) -> Column:
    """White-space words as the tokens of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most `buckets` buckets over sorted distinct lengths, with the least padding in all;
    among equals those of fewer buckets, then of smaller bounds from the last back."""
    n = len(lengths)
    if not n:
        return []
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # pad(i, j): lengths i..j-1 padded to lengths[j-1]
    best = x * total[1:] - mass[1:]  # with one bucket, of the first j lengths
    best = np.concatenate([[0], best])
    cut: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        now, at = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            i = np.arange(j)
            cost = best[:j] + x[j - 1] * (total[j] - total[i]) - (mass[j] - mass[i])
            k = int(cost.argmin())
            if cost[k] < now[j]:
                now[j], at[j] = cost[k], k
        cut.append(at)
        if (now == best).all():
            break
        best = now
    bounds, j = [], n
    for at in [*reversed(cut), np.full(n + 1, -1)]:
        if j <= 0:
            break
        if at[j] < 0:
            continue
        bounds.append(int(x[j - 1]))
        j = int(at[j])
    if j > 0:
        bounds.append(int(x[j - 1]))
    return sorted(bounds)


def _ids(ids: str) -> Column:
    return F.coalesce(F.col(ids).cast("array<int>"), F.expr("cast(array() as array<int>)"))


def sequences(docs: DataFrame, key: str = "doc_id", text: str | None = "text", length: str | None = None, window: int = WINDOW, ids: str | None = None) -> DataFrame:
    """key, part, length: the windows of every text. With a column of token ids also version, a hash of them."""
    tokens = F.size(_ids(ids)) if ids else F.coalesce(F.col(length), F.lit(0)) if length else word_count(F.col(text))
    version = [F.xxhash64(_ids(ids)).alias("version")] if ids else []
    given = docs.select(F.col(key).alias("key"), tokens.cast("long").alias("tokens"), *version)
    parts = F.greatest(F.ceil(F.col("tokens") / window), F.lit(1)).cast("int")
    cut = given.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return cut.select("key", "part", F.least(F.lit(window), F.col("tokens") - F.col("part") * window).cast("int").alias("length"), *(["version"] if ids else []))


def pack(seqs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """key, part, length (and version), bucket, bound, batch, place, padding of each sequence. batch counts within its bucket."""
    names = seqs.columns
    seqs = written(seqs.groupBy(*names).agg(F.count("*").alias("n")), "sequences")  # a few numbers for each text: the texts are read once
    histogram = sorted(tuple(r) for r in seqs.groupBy("length").agg(F.sum("n")).collect())  # at most window + 1 rows
    bounds = optimal_bounds([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    groups = 1 + sum(r[1] for r in histogram) // (GROUP_ROWS * max(1, len(bounds)))
    edges = F.array(*[F.lit(b) for b in bounds or [0]])
    bucket = F.size(F.filter(edges, lambda b: b < F.col("length"))).cast("int")
    most = max(1, GROUP_ROWS // 16)  # repeats in one piece
    pieces = seqs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most)))).withColumn("n", F.least(F.lit(most), F.col("n") - F.col("piece") * most))
    dealt = pieces.withColumn("bucket", bucket).withColumn("bound", F.get(edges, F.col("bucket"))).withColumn("grp", F.pmod(F.xxhash64(*names, "piece"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("bucket", "grp").agg(F.sum("n").alias("n"))
    before = sizes.select("bucket", "grp", (F.sum("n").over(Window.partitionBy("bucket").orderBy("grp")) - F.col("n")).alias("before"))
    order = Window.partitionBy("bucket", "grp").orderBy(*names, "piece").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("first", F.sum("n").over(order) - F.col("n")).withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))), F.lit(1)).cast("long")
    place = F.col("rank") + F.col("before")
    return ranked.join(before, ["bucket", "grp"]).select(
        *names, "bucket", "bound", F.floor(place / capacity).alias("batch"), (place % capacity).cast("int").alias("place"), (F.col("bound") - F.col("length")).alias("padding")
    )


def with_tokens(packed: DataFrame, docs: DataFrame, ids: str, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The packed sequences of docs' column of token ids, with start (of their range) and tokens. Rows that repeat a key and ids
    have been packed as repeated sequences; each gets the tokens."""
    held = docs.select(F.col(key).alias("__key"), F.xxhash64(_ids(ids)).alias("__version"), _ids(ids).alias("__ids")).dropDuplicates(["__key", "__version"])
    start = F.col("part") * F.lit(window)
    joined = packed.join(held, packed["key"].eqNullSafe(held["__key"]) & (packed["version"] == held["__version"]))
    return joined.select(*packed.columns, start.alias("start"), F.slice("__ids", start + 1, F.col("length")).alias("tokens"))
