"""Near-duplicate documents by an LSH forest over MinHash signatures (Bawa, Condie and Ganesan, 2005).

1. A pass over the texts gives each document its number of shingles, a 128-bit fingerprint of its shingle set and a
   signature of 128 min-hashes. Documents of equal sets become one class, named by its smallest id.
2. The forest: 12 orders of the signature, of which round one sorts six over the whole corpus by a range shuffle on
   (tree, signature in that order, id); the id splits even groups of thousands. A scan of each sorted partition takes
   the regions whose common prefix has two hashes or more and goes deeper, one hash at a time, only where a region
   holds more than ``BLOCK`` rows. Within a region the signatures say which pairs may reach the threshold.
3. Round one: of each region a spanning forest of its likeliest pairs; they are confirmed on full shingle sets, and their
   components are found. So a group of thousands costs a few pairs for each member.
4. Round two makes the result whole: over all trees and all classes, every likely pair whose ends are still in
   different components is compared on full sets. It has no sorted partitions, whose boundaries cut regions: regions of several
   components are dealt as groups, large ones as blocks, where each block meets the block of the rows outside the region's
   largest component. A group tells the rows that have a likely partner in it, the full sets of these rows are joined to
   them, and the group is compared again on full sets by posting lists of its shingles. It emits a spanning forest
   of its links, so no step emits all pairs.
5. A region with more than a block of rows outside of its largest component is crowded: a template below the threshold, in
   which blocks that meet blocks would grow with the square. The rows of such regions meet once for all trees, on
   the rarest quarter of their shingles (prefixes, Xiao and others, 2011): of two sets alike enough the first common shingle
   in the order of rarity lies so early in both that what follows can still reach the threshold. What a template
   has in common is frequent and comes too late, so its documents don't meet; what moves is a quarter of a row's shingles at most.

A pair at the threshold of 0.75 shares two hashes in one of 12 trees with probability 0.99995, and its signatures agree in
58 % of 128 places at least with probability 0.999995; round two looks at each such pair whatever the partitions are.

Null, empty and blank texts have no set and link with nothing. Rows of one id are one node: they link if any of their
texts does. A null id is no node (component null, not kept). Repeated rows get equal results; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.common import mixed, parts, released, small, small_lists, written
from tidecurve.llm.graph import components

SHINGLE, PERCENT = 5, 75
HASHES, TREES, LEVELS, DEPTH, BLOCK = 128, 12, 8, 2, 1024
STEP = HASHES // TREES  # between the first hashes of two trees
LIKELY = 0.58
#: Sides of a row in a group of round two.
TOLD, ASKS, BOTH = 0, 1, 2
#: Trees that round one sorts and scans.
FIRST = 6
#: Rows of a region that round one holds at once; shingles of the rows of a block of round two; entries of posting lists at once.
HELD, BLOCK_SHINGLES, ENTRIES = 32_768, 1 << 20, 1 << 22
#: Buckets (by their highest bits) in which shingles of crowded regions are counted; the driver and each task hold 8 bytes of each.
BUCKET_BITS = 18

_RANDOM = np.random.default_rng(20)
_WEIGHTS = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HEADS = (np.arange(TREES)[:, None] * STEP + np.arange(DEPTH)).ravel()
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _Words(dict):
    """Hashes of words, kept up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * _WEIGHTS[i]
    return np.unique(mixed(total, k % SHINGLE))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of HASHES min-hashes."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * _A + _B).min(0), out=least)
    return mixed(least).astype(np.uint16)


SIGNED = "key long, n_shingles long, high long, low long, signature binary, sketch binary, heads binary"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        n, high, low, sig, sketch, heads = [], [], [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingle_set(t)
            n.append(len(s))
            high.append(int(mixed(s, 1).sum(dtype=np.uint64).astype(np.int64)))
            low.append(int(mixed(s, 2).sum(dtype=np.uint64).astype(np.int64)))
            x = signature(s)
            sig.append(x.astype(">u2").tobytes() if len(s) else b"")
            heads.append(x[_HEADS].astype(">u2").tobytes() if len(s) else b"")
            sketch.append(x.astype(np.uint8).tobytes() if len(s) else b"")  # eight bits of each hash: enough to compare
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary()), pa.array(heads, pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])


class Groups:
    """What is told of rows sorted by group; a group may go on in the next batch."""

    names, most = ("tree", "a", "b"), 1 << 62

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held: list[tuple[np.ndarray, ...]] = []

    def take(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Scan the whole groups of what is held; the rows of the last one, which may go on, stay held."""
        rows = self.held[0] if len(self.held) == 1 else tuple(np.concatenate(x) for x in zip(*self.held, strict=True))
        n = len(rows[0])
        starts = np.concatenate([[0], np.flatnonzero(self.changes(rows)) + 1])
        ends = np.concatenate([starts[1:], [n]])
        full = last or n - starts[-1] > self.most
        for k in np.flatnonzero(ends - starts > 1):
            if full or ends[k] < n:
                self.group(int(starts[k]), int(ends[k]))
                if len(self.found) > 1000:
                    yield from self.told()
        yield from self.told()
        self.held = [] if last else [tuple(x[n - 1 if full else int(starts[-1]) :].copy() for x in rows)]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = self.read(batch.slice(at, 4096))
                goes_on = bool(self.held) and not self.changes(tuple(np.concatenate([x[-1:], y]) for x, y in zip(self.held[-1], rows, strict=True))).any()
                self.held.append(rows)
                if not goes_on or sum(len(x[0]) for x in self.held) > self.most:  # a group that goes on is only gathered
                    yield from self.take(False)
        if self.held:
            yield from self.take(True)
        pa.default_memory_pool().release_unused()

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            columns = [np.concatenate(x) for x in zip(*self.found, strict=True)]
            self.found = []
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(self.names))


def _bytes(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


class Scan(Groups):
    """Spanning forests of the regions, from rows sorted by (tree, signature in the tree's order, id)."""

    most = HELD

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        tree, levels, sketch, node = batch.columns
        return tree.to_numpy(), _bytes(levels, ">u2", LEVELS).astype(np.uint16), _bytes(sketch, np.uint8, HASHES), node.to_numpy()

    def changes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        self.tree, self.levels, self.sketch, self.node = rows
        return (self.tree[1:] != self.tree[:-1]) | (self.levels[1:, :DEPTH] != self.levels[:-1, :DEPTH]).any(1)

    def group(self, lo: int, hi: int) -> None:
        self.region(lo, hi, DEPTH)

    def block(self, rows: np.ndarray) -> None:
        """A spanning forest of the likeliest pairs of some rows (Prim's)."""
        node, sketch = self.node[rows], self.sketch[rows]
        m = len(rows)
        best, near, out = np.full(m, -1.0), np.zeros(m, int), np.ones(m, bool)
        at, found = 0, []
        for _ in range(m - 1):
            out[at] = False
            alike = np.count_nonzero(sketch == sketch[at], axis=1) / HASHES
            better = out & (alike > best)
            best[better], near[better] = alike[better], at
            at = int(np.where(out, best, -2.0).argmax())
            if best[at] >= LIKELY:
                found.append((near[at], at))
        if found:
            a, b = np.array(found).T
            keep = node[a] != node[b]
            self.found.append((np.full(keep.sum(), self.tree[rows[0]], np.int32), np.minimum(node[a], node[b])[keep], np.maximum(node[a], node[b])[keep]))

    def region(self, lo: int, hi: int, depth: int) -> None:
        if hi - lo <= BLOCK:
            self.block(np.arange(lo, hi))
            return
        if depth == LEVELS:  # alike in all levels: blocks in sorted order, each with the first row and the one before
            for at in range(lo, hi, BLOCK):
                self.block(np.unique(np.concatenate([[lo, max(lo, at - 1)], np.arange(at, min(hi, at + BLOCK))])))
            return
        level = self.levels[lo:hi, depth]
        starts = lo + np.concatenate([[0], np.flatnonzero(level[1:] != level[:-1]) + 1])
        for a, b in zip(starts, [*starts[1:], hi], strict=True):
            self.region(int(a), int(b), depth + 1)
        for at in range(0, len(starts), BLOCK):  # and the parts among each other, by their first rows
            self.block(np.unique(np.concatenate([starts[:1], starts[at : at + BLOCK]])))


class Meet(Groups):
    """The rows with a likely partner of another component in their group, from rows sorted by (region, i, j). Of a pair,
    the first tree in which its ends share a region tells it: ends of one region meet in one group of it at least."""

    names = ("region", "i", "j", "side", "node", "component")

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        region, i, j, side, sketch, heads, node, comp = batch.columns
        return np.stack([region.to_numpy(), i.to_numpy(), j.to_numpy()], 1), side.to_numpy(), _bytes(sketch, np.uint8, HASHES), _bytes(heads, ">u2", TREES, DEPTH), node.to_numpy(), comp.to_numpy()

    def changes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        self.at, self.side, self.sketch, self.heads, self.node, self.comp = rows
        return (self.at[1:] != self.at[:-1]).any(1)

    def group(self, lo: int, hi: int) -> None:
        tree, side = self.at[lo, 0] >> 32, self.side[lo:hi]
        of = lo + np.flatnonzero(side != ASKS)
        sketch, heads, comp, both = self.sketch[of], self.heads[of], self.comp[of], side[of - lo] == BOTH
        wanted = np.zeros(hi - lo, bool)
        for i in lo + np.flatnonzero(side != TOLD):
            j = np.flatnonzero((comp != self.comp[i]) & (~both | (of > i)))
            j = j[np.count_nonzero(sketch[j] == self.sketch[i], axis=1) >= LIKELY * HASHES]
            j = j[(heads[j] == self.heads[i]).all(2).argmax(1) == tree]
            if len(j):
                wanted[i - lo], wanted[of[j] - lo] = True, True
        if wanted.any():
            k = lo + np.flatnonzero(wanted)
            region, i, j = self.at[k].T
            self.found.append((region, i.astype(np.int32), j.astype(np.int32), self.side[k], self.node[k], self.comp[k]))


class Rare(Groups):
    """The rows of different components that share a rare shingle early enough, from rows sorted by (shingle, i, j). The smaller
    set of a pair asks; reach is 7 * (the set's size less the shingle's place): a pair may hold 3 of 7 of both sizes in common."""

    names = Meet.names

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        k, i, j, *rest = (c.to_numpy() for c in batch.columns)
        return np.stack([k, i, j], 1), *rest

    def changes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        self.at, self.side, self.node, self.comp, self.size, self.reach = rows
        return (self.at[1:] != self.at[:-1]).any(1)

    def group(self, lo: int, hi: int) -> None:
        side, comp = self.side[lo:hi], self.comp[lo:hi]
        if (comp == comp[0]).all():
            return
        of = lo + np.flatnonzero(side != ASKS)
        node, comp, size, reach = self.node[of], self.comp[of], self.size[of], self.reach[of]
        wanted = np.zeros(hi - lo, bool)
        for i in lo + np.flatnonzero(side != TOLD):
            least = 3 * (size + self.size[i])
            fits = (comp != self.comp[i]) & (reach >= least) & (self.reach[i] >= least) & ((size > self.size[i]) | ((size == self.size[i]) & (node > self.node[i])))
            if fits.any():
                wanted[i - lo] = True
                wanted[of[fits] - lo] = True
        if wanted.any():
            k = lo + np.flatnonzero(wanted)
            shingle, i, j = self.at[k].T
            self.found.append((shingle, i.astype(np.int32), j.astype(np.int32), self.side[k], self.node[k], self.comp[k]))


class Judge(Groups):
    """Spanning forests of the links between components, from rows (region, i, j, side, node, component, hashes) sorted by group."""

    names = ("a", "b")

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        region, i, j, side, node, comp, hashes = batch.columns
        sets = np.empty(len(hashes), object)
        sets[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in hashes]
        return np.stack([region.to_numpy(), i.to_numpy(), j.to_numpy()], 1), side.to_numpy(), node.to_numpy(), comp.to_numpy(), sets

    def changes(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        self.at, self.side, self.node, self.comp, self.sets = rows
        return (self.at[1:] != self.at[:-1]).any(1)

    def group(self, lo: int, hi: int) -> None:
        side, node, sets = self.side[lo:hi], self.node[lo:hi], self.sets[lo:hi]
        of, size, comp = np.flatnonzero(side != ASKS), np.array([len(x) for x in sets]), self.comp[lo:hi].copy()
        # Posting lists: for each shingle of the rows that are asked, their places among them.
        shingles = np.concatenate(sets[of])
        order = np.argsort(shingles, kind="stable")
        place = np.repeat(np.arange(len(of), dtype=np.int32), size[of])[order]
        known, first, count = np.unique(shingles[order], return_index=True, return_counts=True)
        for i in np.flatnonzero(side != TOLD):
            if (comp[of] == comp[i]).all():
                continue
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            at = at[known[at] == sets[i]]
            shared = np.zeros(len(of), np.int64)
            upto = np.cumsum(count[at])
            for cut in np.split(at, np.flatnonzero(np.diff(upto // ENTRIES)) + 1):
                if n := int(count[cut].sum()):
                    lists = np.repeat(first[cut] - np.cumsum(count[cut]) + count[cut], count[cut]) + np.arange(n)
                    shared += np.bincount(place[lists], minlength=len(of))
            linked = (shared > 0) & (100 * shared >= PERCENT * (size[i] + size[of] - shared)) & (node[of] != node[i])
            for j in of[linked]:
                if comp[j] != comp[i]:
                    self.found.append((np.array([min(node[i], node[j])]), np.array([max(node[i], node[j])])))
                    comp[comp == comp[j]] = comp[i]


def forest(classes: DataFrame) -> DataFrame:
    """Rows of the first trees, sorted within range partitions. classes: node, signature, sketch."""
    order = F.substring(F.concat("signature", "signature"), F.col("tree") * (2 * STEP) + 1, F.lit(2 * LEVELS))
    rows = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(FIRST - 1))).alias("tree")).select("tree", order.alias("levels"), "sketch", "node")
    return rows.repartitionByRange("tree", "levels", "node").sortWithinPartitions("tree", "levels", "node")


def by_region(classes: DataFrame) -> DataFrame:
    """A row of classes for each tree (but for those in its column crowded, if it has one), with its region: tree and first hashes."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    if "crowded" in classes.columns:
        trees = F.array_except(trees, F.coalesce("crowded", F.expr("cast(array() as array<int>)")))
    head = F.substring("heads", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    region = F.col("tree").cast("long") * F.lit(1 << 32) + F.conv(F.hex(head), 16, 10).cast("long")
    return classes.select("*", F.explode(trees).alias("tree")).select(region.alias("region"), "tree", "sketch", "heads", "node", "component", "n_shingles")


def crowded(classes: DataFrame) -> DataFrame:
    """node, component, sketch, heads, crowded of the rows in regions that have more than a block of rows outside of their largest
    component; crowded lists the trees of these regions."""
    rows = by_region(classes)
    kinds = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.min("component").alias("low"), F.max("component").alias("high"))
    large = written(kinds.where((F.col("low") != F.col("high")) & ((F.col("n") > BLOCK) | (F.col("w") > BLOCK_SHINGLES))), "regions")
    inside = rows.join(small(large.select("region")), "region", "left_semi").groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    most = inside.groupBy("region").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "component", "w")).alias("most"))
    outside = (F.col("n") - F.col("most.n") > BLOCK) | (F.col("w") - F.col("most.w") > BLOCK_SHINGLES)
    many = written(most.where(outside).select("region"), "crowded")
    told = rows.join(small(many), "region", "left_semi").groupBy("node", "component", "sketch", "heads").agg(F.sort_array(F.collect_set("tree")).alias("crowded"))
    told = written(told, "crowded")
    released(large, many)
    return told


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of the 2 ** BUCKET_BITS buckets: at least as many as sets hold any one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in parts(batches):
            n += np.bincount((np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    counted = sets.select("hashes").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    total[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return total


RARE = "k long, often boolean, node long, component long, size long, reach long"


def rare_shingles(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """The rarest quarter of each set by (count of its bucket, hash), without those that no other set holds. Rows RARE; often if
    more sets than a block may hold the shingle. sets: node, component, hashes."""
    names = [x.split()[0] for x in RARE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 64):
            found = []
            for node, comp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(hashes, np.uint64)
                n = counts[s >> np.uint64(64 - BUCKET_BITS)]
                first = np.lexsort((s, n))[: len(s) // 4 + 1]
                place = np.flatnonzero(n[first] > 1)
                first = first[place]
                same = np.ones(len(first), np.int64)
                found.append((s[first].view(np.int64), n[first] > BLOCK, same * node, same * comp, same * len(s), 7 * (len(s) - place)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    return sets.select("node", "component", "hashes").mapInArrow(run, RARE)


def rare_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows RARE by groups (k, i, j): a shingle of a block of sets at most is one group; of another the sets that may ask, in blocks i,
    meet all of its sets, in blocks j, if there are several components and any set that asks. And the table of those shingles."""
    asks = F.col("reach") >= 6 * F.col("size")
    columns = ("node", "component", "size", "reach")
    one = rows.where("not often").select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(asks, BOTH).otherwise(TOLD).alias("side"), *columns)
    kinds = rows.where("often").groupBy("k").agg(F.count("*").alias("n"), F.sum(asks.cast("int")).alias("asked"), F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    kinds = written(kinds.where("low <> high and asked > 0").select("k", blocks("asked").alias("askers"), blocks("n").alias("blocks")), "shingles")
    place = F.xxhash64("node")
    i, j = F.pmod(place, "askers").cast("int"), F.pmod(F.shiftright(place, 20), "blocks").cast("int")
    to = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    told = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda x: to(x, j, TOLD))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: to(i, x, ASKS))
    many = rows.where("often").join(small(kinds), "k").select("k", F.explode(F.when(asks, F.concat(told, asking)).otherwise(told)).alias("to"), *columns).select("k", "to.i", "to.j", "to.side", *columns)
    return one.unionByName(many).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j"), kinds


def rare_needed(told: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows as those of needed(), of the rows in crowded regions, written. told: crowded()'s; sets: node, hashes of its nodes."""
    owners = written(told.select("node", "component").distinct(), "owners")
    rows = written(rare_shingles(sets.join(small(owners), "node"), bucket_counts(sets)), "rare")
    dealt, kinds = rare_groups(rows)
    found = written(dealt.mapInArrow(lambda batches: Rare().run(batches), "region long, i int, j int, side int, node long, component long"), "needed")
    released(owners, rows, kinds)
    return found


def groups(classes: DataFrame) -> DataFrame:
    """Rows of the regions (tree and first hashes) that hold several components, by groups (region, i, j). Any pair of
    different components has an end outside of the region's largest component: those rows, in blocks i, ask the
    region's rows, in blocks j. A region of one block is one group, where a row may be BOTH.
    classes: node, component, n_shingles, sketch, heads, and crowded (trees to leave out) if there are any."""
    rows = by_region(classes).drop("tree")
    several = rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region")
    several = written(several, "regions")
    kinds = rows.join(small(several), "region", "left_semi").groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    mixed = kinds.groupBy("region").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "component", "w")).alias("most"))
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    mixed = mixed.withColumn("blocks", blocks(F.col("n"), F.col("w"))).withColumn("askers", F.when(F.col("blocks") > 1, blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"))).otherwise(1))
    mixed = written(mixed.select("region", F.col("most.component").alias("largest"), "askers", "blocks"), "regions")
    # Of regions of more than a block there are few, and only their rows would make large groups in a shuffle.
    large = mixed.where("blocks > 1")
    placed = rows.join(small(large), "region").unionByName(rows.join(small(large), "region", "left_anti").join(small(mixed.where("blocks = 1")), "region")).drop("n_shingles")
    asks, place = F.col("component") != F.col("largest"), F.xxhash64("node", "sketch")
    i, j = F.pmod(place, "askers").cast("int"), F.pmod(F.shiftright(place, 20), "blocks").cast("int")
    to = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    told = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda x: to(x, j, F.lit(TOLD)))
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: to(i, x, F.lit(ASKS)))
    whole = F.array(to(F.lit(0), F.lit(0), F.when(asks, BOTH).otherwise(TOLD)))
    dealt = F.when(F.col("blocks") == 1, whole).when(asks, F.concat(told, asking)).otherwise(told)
    dealt = placed.select("region", F.explode(dealt).alias("to"), "sketch", "heads", "node", "component").select("region", "to.i", "to.j", "to.side", "sketch", "heads", "node", "component")
    return dealt.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")


def likely_pairs(classes: DataFrame) -> DataFrame:
    """Spanning forests of the likely pairs of regions: tree, a, b."""
    return forest(classes).mapInArrow(lambda batches: Scan().run(batches), "tree int, a long, b long")


def needed(classes: DataFrame) -> DataFrame:
    """Rows of groups() that have a likely partner of another component there."""
    return groups(classes).mapInArrow(lambda batches: Meet().run(batches), "region long, i int, j int, side int, node long, component long")


def judged(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between components among the rows of needed(), confirmed on full sets (node, hashes)."""
    placed = rows.join(sets, "node").select("region", "i", "j", "side", "node", "component", "hashes")
    placed = placed.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")
    return placed.mapInArrow(lambda batches: Judge().run(batches), "a long, b long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its shingle set as bytes, for the documents whose key is among the nodes (distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "hashes"])

    return docs.join(small(nodes), docs["key"] == nodes["node"], "left_semi").select("key", "text").mapInArrow(run, "node long, hashes binary")


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, hashes of a, hashes of b) the pairs whose sets are alike enough."""
    for batch in parts(batches):
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):  # buffers, not copies
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= PERCENT * max(len(p), len(q)) else 0
            keep.append(both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable), kept, for each row of docs."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    told = written(docs.mapInArrow(signed, SIGNED), "signed")
    sets = told.where("n_shingles > 0 and key is not null").groupBy("n_shingles", "high", "low", "signature", "sketch", "heads").agg(F.min("key").alias("node"))
    classes = written(sets, "classes")
    first = written(likely_pairs(classes.select("node", "signature", "sketch")).select("a", "b").distinct(), "likely")
    ends = lambda pairs: written(pairs.distinct(), "ends")
    members = written(shingle_sets(docs, ends(first.select(F.explode(F.array("a", "b")).alias("node")))), "sets")
    links = written(confirm(first, members), "links")
    found = written(components(links), "components")
    parted = classes.join(small(found), "node", "left").select("node", "n_shingles", "sketch", "heads", F.coalesce("component", "node").alias("component"))
    told_apart = crowded(parted)
    if told_apart.isEmpty():
        rows = written(needed(parted), "needed")
    else:
        own = written(shingle_sets(docs, ends(told_apart.select("node"))), "sets")
        rare = rare_needed(told_apart, own)
        parted = parted.join(small_lists(told_apart.drop("component")), ["node", "sketch", "heads"], "left")
        rows = written(needed(parted).unionByName(rare), "needed")
        released(own, rare)
    more = written(judged(rows, shingle_sets(docs, ends(rows.select("node")))), "links")
    final = components(links.unionByName(more))
    released(first, members, links, found, told_apart, rows, more)
    named = classes.join(final, "node", "left").select("n_shingles", "high", "low", "node", F.coalesce("component", "node").alias("component"))
    same = [told[c].eqNullSafe(named[c]) for c in ("n_shingles", "high", "low")]
    joined = told.join(named, same[0] & same[1] & same[2], "left").select(told["key"], told["n_shingles"], named["component"])
    component = F.coalesce("component", "key")
    return joined.select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), component).alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
