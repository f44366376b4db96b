"""Spelling variants: words that are one edit apart, grouped without making pairs.

1. Words (runs of letters, lower-cased in A-Z, some with a letter deleted as a made-up misspelling) are counted in each task,
   then over all tasks. The vocabulary is ranked by frequency, then by code points: a word's rank is its id, so
   the best of some words is the least id, and groups carry numbers only.
2. A word has a wildcard key for each position: all that is before and after it. Words of one key differ in that
   position's letter alone: the group's size and its top two ids tell each of its members how many words it is near by a replacement and
   which is the best. A word also has its distinct deletions as keys, and itself: a group of a word and the deletions equal to it
   tells the word its longer neighbours and these their shorter one.
3. Partial answers are summed by word. No pair is made: rows are a word's letters twice and once. A group holds at most a word for each
   letter of the alphabet and place of insertion, however many words there are.

Keys are 128 bits: sums of hashed (letter, position), so that all keys of a word of any length cost time in proportion to it.
Two different keys of ten billion are equal with probability under 1e-18.

Defined cases: null and empty texts have no words; a null id is written as nothing before the colon; repeated rows count each; ties go
to the smallest word in code-point order; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.llm.common import mixed, parts, released, small, written

LETTERS, LEAST_CHARS, LEAST_N, MISSPELT, TIMES = r"a-zÀ-ÿ", 5, 3, 97, 2
#: What a row stands for in its group: a word, one of its deletions, one of its wildcards.
WORD, DELETION, WILDCARD = 0, 1, 2
#: Letters whose keys are made at once.
LETTERS_AT_ONCE = 1 << 16

_RUN = re.compile(f"[{LETTERS}]+")


def words(key: object, text: bytes | None) -> Counter:
    """Counts of the words of one text, of LEAST_CHARS letters at least."""
    found: Counter = Counter()
    start = f"{'' if key is None else key}:"
    for run, n in Counter(_RUN.findall((text or b"").lower().decode("utf-8", "replace"))).items():
        if len(run) < LEAST_CHARS:
            continue
        h = zlib.crc32((start + run).encode())
        if h % MISSPELT == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= LEAST_CHARS:
            found[run] += n
    return found


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        found: Counter = Counter()
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found.update(words(key, text))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, word, n of the words of LEAST_N occurrences; ids grow with falling n, then with the word."""
    found = docs.select(F.col(key), F.col(text)).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)
    plain = written(found, "words")
    ranked = written(plain.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    released(plain)
    return ranked


def word_keys(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some words: which word, kind, and the two halves of the key, for each row of a group."""
    length = np.array([len(w) for w in found])
    letter = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(found)), length)
    end = np.cumsum(length)
    start = end - length
    place = (np.arange(len(letter)) - start[of]).astype(np.uint64)
    last = np.arange(len(letter)) + 1 == end[of]
    follows = np.append(letter[1:], 0)
    deleted = (last | (follows != letter)) & (length[of] > LEAST_CHARS)  # equal neighbours give one deletion; shorter ones aren't words
    halves = []
    for salt in (0, 16):
        here, left = mixed(letter << np.uint64(32) | place, salt), mixed(letter << np.uint64(32) | (place - np.uint64(1)) & np.uint64(0xFFFFFFFF), salt)
        sums, shifted = np.append(np.uint64(0), np.cumsum(here, dtype=np.uint64)), np.append(np.uint64(0), np.cumsum(left, dtype=np.uint64))
        total, n = sums[end] - sums[start], length.astype(np.uint64)
        # Without letter t: those before stand where they did, those behind one place to the left.
        shorter = (sums[:-1] - sums[start][of]) + (shifted[end][of] - shifted[1:])
        wild = mixed(mixed(total[of] - here, salt + 1) + mixed(place << np.uint64(32) | n[of], salt + 2), salt + 3)
        plain = lambda x, n: mixed(mixed(x, salt + 4) + mixed(n, salt + 5), salt + 6)  # noqa: B023, E731
        halves.append(np.concatenate([plain(total, n), plain(shorter, n[of] - np.uint64(1))[deleted], wild]).view(np.int64))
    kind = np.repeat(np.array([WORD, DELETION, WILDCARD], np.int8), [len(found), int(deleted.sum()), len(letter)])
    return np.concatenate([np.arange(len(found)), of[deleted], of]), kind, halves[0], halves[1]


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 4096):
        ids, found = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        upto = np.cumsum([len(w) for w in found]) // LETTERS_AT_ONCE
        for at in np.split(np.arange(len(found)), np.flatnonzero(np.diff(upto)) + 1):
            if len(at):
                of, kind, high, low = word_keys([found[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(kind), pa.array(ids[at][of])], names=["high", "low", "kind", "id"])


def neighbours(ranked: DataFrame) -> DataFrame:
    """id, n_near, best (least id) of the words that are near another one."""
    rows = ranked.select("id", "word").mapInArrow(keyed, "high long, low long, kind byte, id long")
    group = Window.partitionBy("high", "low").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, longer = (F.when(F.col("kind") == k, F.col("id")) for k in (WORD, DELETION))
    told = rows.select(
        "id", "kind", F.count("*").over(group).alias("size"), F.nth_value("id", 1).over(group).alias("first"), F.nth_value("id", 2).over(group).alias("second"),
        F.min(own).over(group).alias("own"), F.min(longer).over(group).alias("longer"), F.count(longer).over(group).alias("n_longer"),
    ).where("size > 1")
    is_ = lambda k: F.col("kind") == k
    n = F.when(is_(WILDCARD), F.col("size") - 1).when(is_(WORD), F.col("n_longer")).otherwise(F.col("own").isNotNull().cast("long"))
    best = F.when(is_(WILDCARD), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(is_(WORD), F.col("longer")).otherwise(F.col("own"))
    return told.select("id", n.alias("n"), best.alias("best")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(up: DataFrame) -> DataFrame:
    """id, root: the last of the forms that are followed from each id. up: id, form. Each round doubles the steps; a form has
    twice its word's count at least, so rounds grow with the logarithm of the logarithm of the largest count."""
    now = written(up.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = written(now.join(small(on), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        released(now)
        if not after.where("moved").head(1):
            return after.select("id", "root")
        now = after.select("id", "root")
        now.written_at = after.written_at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form (its near word of most occurrences, if these are TIMES the word's), form_n, root of each word."""
    ranked = vocabulary(docs, key, text)
    near = written(neighbours(ranked), "near")
    named = ranked.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = ranked.join(near, "id", "left").join(named, "best", "left")
    strong = F.col("form_n") >= TIMES * F.col("n")
    found = written(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(strong, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms")
    last = roots(found.where("best is not null").select("id", F.col("best").alias("form")))
    ends = last.join(ranked.select(F.col("id").alias("root"), F.col("word").alias("last")), "root").select("id", "last")
    return found.join(ends, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("last", "word").alias("root"))
