"""Comparison of two arms within one subject (an N-of-1 trial) by permutations inside of blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecurve.operators.tables import broadcast_small, settled

#: A block of more rows is ranked by the first digits of its hashes; a subject of more rows is spread over tasks by its blocks.
BLOCK_ROWS = 65_536
#: Rows times draws of a task; rows that are drawn at once.
TASK_DRAWS, HELD = 2_000_000, 10_000


def permutation_test(exposures: DataFrame, draws: int = 199, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """subject, n_a, n_b, diff (mean of arm a minus mean of the others, in the outcome's unit), p_value: the share of draws, the true
    order included, whose difference is as large or larger on either side.

    exposures: subject, block, id (one for each exposure), in_a, outcome (a whole number: sums are exact, so ties are ties).
    A draw orders the exposures of a block by a hash of seed, draw and id and gives arm a to as many of the first as had it;
    it depends on nothing else, so any partitioning gives the same draws. Rows with a null in subject, arm or outcome don't count; a null
    block is a block. Subjects with one arm only have a null diff and p 1.

    An exposure is shuffled once, not once for each draw: blocks lie together and are drawn where they lie. Of blocks with more than
    block_rows rows only counts by the hash's first digits are shuffled, and the rows of the one group of digits where arm a ends."""
    rows = exposures.select("subject", "block", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("in_a").cast("boolean").alias("in_a"), F.col("outcome").cast("long").alias("outcome"))
    rows = rows.where("subject is not null and in_a is not null and outcome is not null")
    sizes = settled(rows.groupBy("subject", "block").agg(F.count("*").alias("n"), F.count_if("in_a").alias("of_a")))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    large = settled(sizes.where(F.col("n") > block_rows))
    wide = sizes.where(F.col("n") <= block_rows).groupBy("subject").agg(F.sum("n").alias("held")).where(F.col("held") > block_rows)
    wide, _ = broadcast_small(settled(wide.select("subject", F.ceil(F.col("held") / block_rows).alias("slices"))))
    hot, _ = broadcast_small(large)
    same = [F.col("h.subject") == F.col("r.subject"), F.col("h.block").eqNullSafe(F.col("r.block"))]
    if large.isEmpty():
        parts = _drawn(rows, wide, whole, draws, seed)
    else:
        parts = _drawn(rows.alias("r").join(hot.alias("h"), same, "left_anti"), wide, whole, draws, seed)
        parts = parts.unionByName(_counted(rows.alias("r").join(hot.alias("h"), same).select("r.*", "n", "of_a"), draws, seed))

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    told = parts.groupBy("subject").agg(F.sum("n_a").alias("n_a"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.collect_list("sums").alias("lists"))
    told = told.withColumn("sums", F.aggregate("lists", F.array_repeat(F.lit(0).cast("long"), draws + 1), plus))
    # n_a and n don't change with the draw, so this number orders draws as the difference of means does.
    told = told.withColumn("stats", F.transform("sums", lambda x: F.abs(x * F.col("n") - F.col("n_a") * F.col("total"))))
    told = told.select("subject", "n_a", (F.col("n") - F.col("n_a")).alias("n_b"), F.col("sums")[0].alias("sum_a"), "total", (F.size(F.filter("stats", lambda x: x >= F.col("stats")[0])) / F.lit(draws + 1)).alias("p_value"))
    return told.select("subject", "n_a", "n_b", (F.try_divide("sum_a", "n_a") - F.try_divide(F.col("total") - F.col("sum_a"), F.col("n_b"))).alias("diff"), "p_value")


def _drawn(rows: DataFrame, wide: DataFrame, whole: int, draws: int, seed: int) -> DataFrame:
    """subject, n_a, n, total, sums (of arm a's outcomes by draw) of whole blocks: one row for a subject, some for a wide one."""
    kind = rows.schema["subject"].dataType
    slices = F.pmod(F.xxhash64("r.block"), F.coalesce("w.slices", F.lit(1)))
    rows = rows.alias("r").join(wide.alias("w"), F.col("r.subject") == F.col("w.subject"), "left").select("r.*", slices.alias("slice"))
    rows = rows.repartition(max(1, -(-whole * (draws + 1) // TASK_DRAWS)), "subject", "slice").sortWithinPartitions("subject", "block")

    def codes(batch: pa.Table, name: str) -> np.ndarray:
        return batch[name].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)

    def sums(batch: pa.Table, new: np.ndarray) -> np.ndarray:
        """The outcomes' sums by subject (they begin at `new`) and draw; rows are in the order of subject and block."""
        subject, block = codes(batch, "subject"), codes(batch, "block")
        first = np.flatnonzero(np.r_[True, (subject[1:] != subject[:-1]) | (block[1:] != block[:-1])])
        sizes = np.diff(np.r_[first, len(subject)])
        in_a, y = batch["in_a"].to_numpy(), batch["outcome"].to_numpy()
        of = np.repeat(np.arange(len(first)), sizes)
        chosen = np.arange(len(of)) - first[of] < np.add.reduceat(in_a.astype(np.int64), first)[of]
        names = [x.encode() for x in batch["id"].to_pylist()]
        told = [np.add.reduceat(np.where(in_a, y, 0), new)]
        for draw in range(1, draws + 1):
            head = f"{seed}:{draw}:".encode()
            high, low = np.frombuffer(b"".join([hashlib.md5(head + x).digest() for x in names]), ">u8").reshape(-1, 2).T.astype(np.uint64)
            order = np.lexsort((high, of))
            if (high[order][1:] == high[order][:-1]).any():
                order = np.lexsort((in_a, y, low, high, of))
            told.append(np.add.reduceat(np.where(chosen, y[order], 0), new))
        return np.array(told).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, open_row = [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
                if n < HELD:
                    continue
            if not n:
                continue
            rows = pa.Table.from_batches(held)
            subject, block = codes(rows, "subject"), codes(rows, "block")
            ends = np.flatnonzero((subject[1:] != subject[:-1]) | (block[1:] != block[:-1])) + 1
            cut = n if batch is None else int(ends[-1]) if len(ends) else 0
            held, n = rows.slice(cut).to_batches(), n - cut
            if not cut:
                continue
            rows, subject = rows.slice(0, cut), subject[:cut]
            new = np.flatnonzero(np.r_[True, subject[1:] != subject[:-1]])
            got = zip(
                rows["subject"].take(pa.array(new)).to_pylist(), np.add.reduceat(rows["in_a"].to_numpy().astype(np.int64), new).tolist(), np.diff(np.r_[new, cut]).tolist(),
                np.add.reduceat(rows["outcome"].to_numpy(), new).tolist(), sums(rows, new), strict=True,
            )
            done = []
            for row in got:  # a subject whose blocks go on in the next rows stays open
                if open_row is not None and open_row[0] == row[0]:
                    row = (row[0], *(a + b for a, b in zip(open_row[1:], row[1:], strict=True)))
                elif open_row is not None:
                    done.append(open_row)
                open_row = row
            if batch is None and open_row is not None:
                done.append(open_row)
                open_row = None
            if done:
                columns = list(zip(*done, strict=True))
                kinds = [rows.schema.field("subject").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["subject", "n_a", "n", "total", "sums"])

    return rows.select("subject", "block", "id", "in_a", "outcome").mapInArrow(run, f"subject {kind.simpleString()}, n_a long, n long, total long, sums array<long>")


def _counted(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """As _drawn() for blocks of any size. rows: with n and of_a of their block. Arm a of a draw is all groups of the hash's first digits
    before the one where it ends, and the first rows of that one; about as many groups as a group has rows."""
    digits = F.greatest(F.lit(1), F.round(F.log(16.0, F.col("n")) / 2)).cast("int")
    rows = rows.withColumn("digits", digits)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col("id")))
    block = ["subject", "block", "draw"]
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("head", F.when(F.col("draw") == 0, F.when(F.col("in_a"), "a").otherwise("b")).otherwise(F.substring(hashed, F.lit(1), F.col("digits"))))
    groups = drawn.groupBy(*block, "head").agg(F.count("*").alias("held"), F.sum("outcome").alias("sum"), F.max("of_a").alias("of_a"), F.max("n").alias("n"))
    before = Window.partitionBy(*block).orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = settled(groups.withColumn("upto", F.sum("held").over(before)))
    full = groups.groupBy(*block).agg(F.sum(F.when(F.col("upto") <= F.col("of_a"), F.col("sum")).otherwise(0)).alias("sum_a"), F.sum("sum").alias("total"), F.max("of_a").alias("n_a"), F.max("n").alias("n"))
    last = groups.where("upto > of_a and upto - held < of_a").select(*block, "head", (F.col("of_a") - F.col("upto") + F.col("held")).alias("rest"))
    last, _ = broadcast_small(settled(last.groupBy("subject", "block").agg(F.collect_list(F.struct("draw", "head", "rest")).alias("last"))))
    some = rows.alias("r").join(last.alias("l"), [F.col("l.subject") == F.col("r.subject"), F.col("l.block").eqNullSafe(F.col("r.block"))]).select("r.*", F.explode("last").alias("l")).select("*", "l.*")
    some = some.withColumn("hash", hashed).where(F.col("head") == F.substring("hash", F.lit(1), F.col("digits")))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("hash", "outcome", "in_a"))
    rest = some.select(*block, "outcome", "rest", place.alias("place")).where(F.col("place") <= F.col("rest")).groupBy(*block).agg(F.sum("outcome").alias("sum_a"))
    zero = F.lit(0).cast("long")
    sums = full.unionByName(rest.select(*block, "sum_a", *(zero.alias(c) for c in ("total", "n_a", "n")))).groupBy(*block).agg(*(F.sum(c).alias(c) for c in ("sum_a", "total", "n_a", "n")))
    told = sums.groupBy("subject", "block").agg(F.max("n_a").alias("n_a"), F.max("n").alias("n"), F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("draw", "sum_a"))), lambda x: x["sum_a"]).alias("sums"))
    return told.drop("block")
