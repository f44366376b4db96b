"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class (white space or not), each with the number of units that end in
it or before it. A unit is a word with the white space before it, or white space at the end of the text; so a run of a
word holds one unit and white space none, but at the end. A cut after k units is found by binary search of the run that holds
its k-th unit; its offset follows from the run's end and the units still missing. With ``unit="character"`` the
classes are the lengths of characters in UTF-8, a run holds many units, and the same search and arithmetic apply.

A document's cuts, form and draws come from a hash of its id, so a job gives the same output whenever it is run. The text can be
rebuilt from output and form.

Defined cases: a null or empty text is plain with 0 units; texts that hold a marker are plain; a null id draws as an empty one;
repeated rows get equal results; other columns aren't read (a column of the same name as a result's doesn't matter); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.common import parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and of these percent in the order suffix, prefix, middle.
RATE, SPM, SEED = 50, 80, 42

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the character that a byte begins; 0 for one that goes on.
_WIDTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int8)


class Runs(NamedTuple):
    """Maximal runs of a text of UTF-8 bytes: class, end (bytes), units that end in the run or before it, bytes of a unit within it."""

    kind: np.ndarray
    end: np.ndarray
    units: np.ndarray
    width: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, k: int) -> int:
        """Bytes before the cut after k units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.units, k))
        return int(self.end[run] - (self.units[run] - k) * self.width[run])


def runs(text: bytes, unit: str = "token") -> Runs:
    b = np.frombuffer(text, np.uint8)
    if unit == "token":
        kind = _SPACE[b]
    elif unit == "character":
        first = _WIDTH[b]
        at = np.flatnonzero(first)
        kind = np.repeat(first[at], np.diff(np.append(at, len(b)))) if len(at) else first
    else:
        raise ValueError(f"no such unit: {unit}")
    if not len(b):
        return Runs(kind, *(np.empty(0, np.int64) for _ in range(3)))
    end = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(b))
    kind = kind[end - 1]
    size = np.diff(end, prepend=0)
    if unit == "token":  # the word's run holds its unit; white space only at the end
        held = (~kind).astype(np.int64)
        held[-1] = 1
        return Runs(kind, end, np.cumsum(held), size)
    return Runs(kind, end, np.cumsum(size // kind), kind.astype(np.int64))


def cuts(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def transformed(text: bytes, draws: tuple[int, int, int, int], rate: int, spm: int, unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle (null if plain), output."""
    held = runs(text, unit)
    h1, h2, h3, h4 = draws
    if not text or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return held.n, "plain", None, None, text
    a, b = map(held.offset, cuts(held.n, h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    points = lambda x: int(np.count_nonzero(_WIDTH[np.frombuffer(x, np.uint8)]))
    if h4 % 100 < spm:
        return held.n, "spm", points(prefix), points(middle), b"".join((s, suffix, p, prefix, m, middle))
    return held.n, "psm", points(prefix), points(middle), b"".join((p, prefix, s, suffix, m, middle))


def drawn(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "token") -> DataFrame:
    """key, n, form (plain, psm or spm), prefix_chars, middle_chars, output for each row of docs."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(drawn(F.col(key), seed), 1)])
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            draws = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            n, form, prefix, middle, output = zip(*(transformed(t, d, rate, spm, unit) for t, d in zip(texts, draws, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form: a text with markers is plain, so in the others each marker stands once."""
    cut = F.split(output, "<[PSM]>", -1)  # empty, then the three parts in the form's order
    part = lambda i: F.get(cut, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
