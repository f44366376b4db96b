"""Code-point spans of regex matches, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,stop:int,found:string>>"


def anchored(pattern: str) -> str:
    """The pattern with the gap before it as its one group, anchored at the end of the match before, so that a text is passed
    once. The pattern may use \\G for the end of the match before. It must not have capturing groups."""
    return rf"\G([\s\S]*?)(?:{pattern})"


def spans_of(whole: Column, gaps: Column) -> Column:
    """array<struct<start,stop,found>> from all matches of an anchored pattern and their gaps: lengths (in code points) add up to
    offsets."""
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        low, high = acc["at"] + F.length(x["gap"]), acc["at"] + F.length(x["all"])
        found = F.struct(low.alias("start"), high.alias("stop"), F.substring(x["all"], F.length(x["gap"]) + 1, F.length(x["all"]) - F.length(x["gap"])).alias("found"))
        return F.struct(high.alias("at"), F.array_append(acc["spans"], found).alias("spans"))

    pairs = F.zip_with(whole, gaps, lambda a, g: F.struct(a.alias("all"), g.alias("gap")))
    return F.aggregate(pairs, start, add)["spans"]


def regex_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,found>> of the leftmost matches that don't overlap, in order."""
    full = F.lit(anchored(pattern))
    return spans_of(F.regexp_extract_all(text, full, F.lit(0)), F.regexp_extract_all(text, full, F.lit(1)))
