"""Near-duplicate vectors by a subspace pigeonhole join: cosine of COSINE at least, among vectors of one label.

1. Vectors are cleaned; equal ones of a label become one class with a count.
2. A star is a group of vectors within half the linking angle of a pivot: by the triangle inequality all of them link with one
   another, so a group of near copies of any size costs one comparison a vector. Pivots are the dense places of a bounded sample
   (``SAMPLE`` classes drawn by hash); the sample decides only which pairs are settled this way. A vector
   outside of a star links with all of it, with none of it (both by the angle to the pivot and the star's radius), or is compared with its members.
3. The pigeonhole join takes all vectors in no star. Of unit vectors a cosine of COSINE is a squared distance of 2 - 2 * COSINE, and a
   rotation keeps it. The rotated vector is split into ``BLOCKS`` blocks; of a linked pair one block at least is within that
   block's share of the squared distance, in proportion to its dimensions. Each block is range-joined on a grid of some of its
   dimensions: cells are twice the block's radius wide, so a ball reaches one side of a cell in each dimension only, and of two
   neighbouring cells the lower one's vectors are sent to the upper one. The more vectors a label has, the more dimensions the grid has.
4. Candidates within a block's budget are verified by cosine in double precision; a link counts in the first of its blocks that is
   within budget, so it counts once. Groups emit counts and a spanning forest of their links, never the pairs.

A group of more than ``PART`` rows is dealt in parts that meet each other. For vectors without any structure (independent coordinates)
the grid can't save much: work within a label then grows towards the square of its vectors, in groups of bounded size.

Defined cases: a vector that is null, empty or zero, or holds a null or non-finite component, and a null label, link with nothing (the row is
its own component); vectors of different lengths don't link; repeated rows of one id and vector are one vector; rows of one id and
different vectors share the component and count as vectors of their own; a null id is no node (0 links, null component,
not kept); other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecurve.llm.common import parts, small, written
from tidecurve.llm.graph import components

COSINE, BLOCKS, LEAST_DIMS = 0.93, 8, 4
#: Vectors of a label for each cell of a block's grid that the grid aims at; dimensions of a grid at most; rows of a group beyond which it is dealt in parts.
CELL, GRID, PART = 1024, 8, 2048
#: Classes in the sample that pivots come from, and how many of them a pivot must have within its radius.
SAMPLE, DENSE = 2048, 16
#: Roles of a row in a group: both told and asking, one of these, asking and told of the answer, asking only.
BOTH, TOLD, ASKS, MEETS, ALONE = range(5)
#: Block of groups that compare with a star's members.
STAR = -1
SLACK = 1e-9


@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix: it spreads what coordinates hold evenly over the blocks."""
    return np.linalg.qr(np.random.default_rng(13).normal(size=(dims, dims)))[0]


@cache
def blocks(dims: int) -> list[slice]:
    n = max(1, min(BLOCKS, dims // LEAST_DIMS))
    ends = np.linspace(0, dims, n + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def budget(dims: int, block: slice) -> float:
    """Squared distance that a block may have, in proportion to its dimensions, with room for rounding."""
    return (2 - 2 * COSINE) * (block.stop - block.start) / dims * (1 + SLACK) + SLACK


def units(vectors: list[bytes], item: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), item).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cleaned(batches: Iterator[pa.RecordBatch], item: str) -> Iterator[pa.RecordBatch]:
    """key, label, dims, vector as bytes; the last is null where the vector or its label links with nothing."""
    for batch in parts(batches, 4096):
        lists = batch.column(2)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(n))
        finite, nonzero = (np.append(0, np.cumsum(x)) for x in (np.isfinite(values), np.nan_to_num(values) != 0))
        told = lambda x: x[upto[1:]] - x[upto[:-1]]  # noqa: B023, E731
        ok = (told(finite) == n) & (told(nonzero) > 0) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        raw = values.astype(item)
        vectors = [raw[a:b].tobytes() if good else None for a, b, good in zip(upto[:-1], upto[1:], ok, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), pa.array(vectors, pa.binary())], names=["key", "label", "dims", "vector"])


def pivots(sample: list, item: str) -> list[tuple[str, int, np.ndarray]]:
    """label, dims and unit vector of the centres of dense places of a sample of classes, densest first."""
    found = []
    inner = np.cos(np.arccos(COSINE) / 2)
    for label, dims in sorted({(r["label"], r["dims"]) for r in sample}):
        u = units([bytes(r["vector"]) for r in sample if (r["label"], r["dims"]) == (label, dims)], item)
        near = u @ u.T >= inner
        while (count := near.sum(1)).max() >= DENSE:
            at = int(count.argmax())
            found.append((label, dims, u[at]))
            near[:, near[at]] = False
    return found


def angles(label: np.ndarray, vectors: list[bytes], dims: np.ndarray, centres: list, item: str) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """Rows, stars of their label, and the angle of each row to each star's pivot."""
    for kind in sorted({(c[0], c[1]) for c in centres}):
        rows = np.flatnonzero((label == kind[0]) & (dims == kind[1]))
        if len(rows):
            stars = [i for i, c in enumerate(centres) if c[:2] == kind]
            yield rows, stars, np.arccos(np.clip(units([vectors[i] for i in rows], item) @ np.array([centres[i][2] for i in stars]).T, -1, 1))


def placed(classes: DataFrame, centres: list, item: str) -> DataFrame:
    """classes with star (-1 for none) and the angle to its pivot."""
    most = np.arccos(COSINE) / 2 * (1 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            star, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            vectors = batch.column("vector").to_pylist()
            for rows, stars, a in angles(np.array(batch.column("label").to_pylist(), object), vectors, batch.column("dims").to_numpy(), centres, item):
                best = a.argmin(1)
                near = a[np.arange(len(rows)), best]
                star[rows], angle[rows] = np.where(near <= most, np.array(stars)[best], -1), near
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(star), pa.array(angle)], names=[*batch.schema.names, "star", "angle"])

    return classes.mapInArrow(run, "node long, label string, dims int, vector binary, n long, star int, angle double")


#: What crossings() tells: links that a vector has for sure (a, n); edges (a, b); links that each member of a star (a) has for sure (n); a vector (a) to be compared with a star (b).
SURE, EDGE, ADDED, ASK = range(4)


def crossings(rows: DataFrame, centres: list, stars: dict, item: str) -> DataFrame:
    """kind, a, b, n of the vectors against the stars that they aren't in. stars: n, radius, first (node) by star."""
    widest = np.arccos(COSINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            told: list[tuple[int, int, int, int]] = []
            edges, added = set(), dict.fromkeys(stars, 0)
            node, own, n = (batch.column(c).to_numpy() for c in ("node", "star", "n"))
            for at, of, angle in angles(np.array(batch.column("label").to_pylist(), object), batch.column("vector").to_pylist(), batch.column("dims").to_numpy(), centres, item):
                held = [i for i, s in enumerate(of) if s in stars]
                star = np.array([of[i] for i in held], np.int64)
                if not len(star):
                    continue
                radius, size, first = (np.array([stars[s][k] for s in star]) for k in ("radius", "n", "first"))
                angle, other = angle[:, held], own[at][:, None] != star
                sure = other & (angle + radius <= widest - 1e-7)
                maybe = other & ~sure & (angle - radius <= widest + 1e-7)
                links = (sure * size).sum(1)
                told += [(SURE, int(node[at[i]]), 0, int(links[i])) for i in np.flatnonzero(links)]
                for i, j in zip(*np.nonzero(sure), strict=True):
                    if own[at[i]] < 0:
                        edges.add((int(node[at[i]]), int(first[j])))
                        added[int(star[j])] += int(n[at[i]])
                    else:
                        edges.add((int(stars[int(own[at[i]])]["first"]), int(first[j])))
                told += [(ASK, int(node[at[i]]), int(star[j]), 0) for i, j in zip(*np.nonzero(maybe), strict=True)]
            told += [(EDGE, a, b, 0) for a, b in edges] + [(ADDED, s, 0, k) for s, k in added.items() if k]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True) if told else ([],) * 4, (pa.int8(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "a", "b", "n"])

    return rows.mapInArrow(run, "kind byte, a long, b long, n long")


def cells(x: np.ndarray, radius: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, their cell, and whether it is their own, of the cells that must see a vector. x: coordinates of a block."""
    width = 2 * radius
    cell = np.floor(x[:, :grid] / width).astype(np.int32)
    yield np.arange(len(x)), cell, True
    off = x[:, :grid] - cell * width
    side = np.where(off < radius, -1, 1).astype(np.int32)
    gap = np.minimum(off, width - off) ** 2
    for chosen in product((0, 1), repeat=grid):
        if any(chosen):
            c = np.array(chosen, np.int32)
            leads = side[:, int(c.argmax())] > 0  # the first dimension that changes decides which cell is the upper one
            rows = np.flatnonzero(leads & (gap @ c <= radius**2))
            if len(rows):
                yield rows, cell[rows] + side[rows] * c, False


def grid_rows(rows: DataFrame, item: str) -> DataFrame:
    """node, n, vector of rows (those and label, dims, grid) for each cell (label, block, cell) that sees them, with role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            dims, grid = batch.column("dims").to_numpy(), batch.column("grid").to_numpy()
            vectors = batch.column("vector").to_pylist()
            own = batch.select(["node", "n", "label", "vector"])
            for d, g in sorted(set(zip(dims.tolist(), grid.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (grid == g))
                x = units([vectors[i] for i in at], item) @ rotation(d)
                for b, block in enumerate(blocks(d)):
                    for some, cell, home in cells(x[:, block], np.sqrt(budget(d, block)) * (1 + 1e-6), min(g, block.stop - block.start)):
                        taken = own.take(pa.array(at[some]))
                        key = [f"{d}:".encode() + c.tobytes() for c in cell]
                        k = len(some)
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(k, b, np.int32)), pa.array(key, pa.binary()), pa.array(np.full(k, BOTH if home else MEETS, np.int8))], names=GROUP_COLUMNS)

    return rows.mapInArrow(run, GROUP)


GROUP = "node long, n long, label string, vector binary, block int, cell binary, role byte"
GROUP_COLUMNS = [c.split()[0] for c in GROUP.split(", ")]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of groups with their part (i of those that ask, j of those that are told); groups of more than PART rows on a side are dealt."""
    key = ["label", "block", "cell"]
    told, asking = F.col("role").isin(BOTH, TOLD), F.col("role") != TOLD
    split = lambda side: F.ceil(F.count_if(side) / F.lit(PART)).cast("int")
    large = rows.groupBy(*key).agg(split(asking).alias("is"), split(told).alias("js")).where(F.greatest("is", "js") > 1)
    rows = rows.join(small(written(large, "large")), key, "left")
    place = F.xxhash64("node")
    to = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("byte").alias("role"))
    each = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    i, j = F.pmod(place, F.greatest("is", F.lit(1))), F.pmod(F.shiftright(place, 20), F.greatest("js", F.lit(1)))
    as_told = F.transform(each("is"), lambda x: to(x, j, F.lit(TOLD)))
    as_asking = F.transform(each("js"), lambda x: to(i, x, F.when(F.col("role") == BOTH, ASKS).otherwise(F.col("role"))))
    none = F.lit(0)
    parted = F.when(F.col("is").isNull(), F.array(to(none, none, F.col("role")))).when(F.col("role") == TOLD, as_told).when(F.col("role") == BOTH, F.concat(as_told, as_asking)).otherwise(as_asking)
    return rows.select("node", "n", "vector", *key, F.explode(parted).alias("to")).select("node", "n", "vector", *key, "to.i", "to.j", "to.role")


def linked(item: str):
    """A function of a group's rows: node, other (a node that it is linked with, over some path in the group) and its number of links there."""

    def run(group: pa.Table) -> pa.Table:
        node, n, role = (group.column(c).to_numpy() for c in ("node", "n", "role"))
        block = group.column("block")[0].as_py()
        u = units(group.column("vector").to_pylist(), item)
        d = u.shape[1]
        x = u @ rotation(d) if block != STAR else u
        asking, told = np.flatnonzero(role != TOLD), np.flatnonzero(role <= TOLD)
        count, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(asking), 256):
            ask = asking[at : at + 256]
            if block == STAR:
                keep = u[ask] @ u[told].T >= COSINE - SLACK
            else:
                a, t = x[ask][:, blocks(d)[block]], x[told][:, blocks(d)[block]]
                keep = (a**2).sum(1)[:, None] + (t**2).sum(1) - 2 * (a @ t.T) <= budget(d, blocks(d)[block]) + SLACK
            own = np.isin(role[ask], (BOTH, ASKS))
            keep &= ~own[:, None] | (node[ask][:, None] < node[told])
            i, j = np.nonzero(keep)
            i, j = ask[i], told[j]
            for cut in range(0, len(i), 1 << 16):
                p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                links = np.einsum("ij,ij->i", u[p], u[q]) >= COSINE
                p, q = p[links], q[links]
                if block != STAR and len(p):  # the first block within budget tells the link
                    within = [((x[p][:, s] - x[q][:, s]) ** 2).sum(1) <= budget(d, s) for s in blocks(d)[: block + 1]]
                    first = np.array(within).argmax(0) == block
                    first &= within[block]
                    p, q = p[first], q[first]
                if not len(p):
                    continue
                np.add.at(count, p, n[q])
                both = role[p] != ALONE
                np.add.at(count, q[both], n[p[both]])
                while True:  # the least row that is reached becomes the root
                    least = np.minimum(root[p], root[q])
                    if (root[p] == least).all() and (root[q] == least).all():
                        break
                    for end in (root[p], root[q]):
                        np.minimum.at(root, end, least)
                    root = root[root]
        while (root != root[root]).any():
            root = root[root]
        some = np.flatnonzero((count > 0) | (root != np.arange(len(node))))
        return pa.table({"a": node[some], "b": node[root[some]], "n": count[some]})

    return run


def element(vectors: DataFrame, column: str) -> str:
    """How components are stored: as they are if they are of single precision."""
    return "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept for each row of vectors."""
    item = element(vectors, vector)
    array: Column = F.col(vector) if item == "<f4" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), array.alias("vector"))
    told = rows.mapInArrow(lambda b: cleaned(b, item), "key long, label string, dims int, vector binary")
    told = written(told.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(7), "label", "vector")}), "vectors")
    fit = told.where("vector is not null and key is not null")
    classes = fit.groupBy("label", "dims", "vector").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("key").alias("least"), F.count_distinct("key").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    centres = pivots(classes.orderBy(F.xxhash64("node"), "node", "vector").limit(SAMPLE).collect(), item)
    at = written(placed(classes.select("node", "label", "dims", "vector", "n"), centres, item), "placed")
    stars = {r["star"]: r.asDict() for r in at.where("star >= 0").groupBy("star").agg(F.sum("n").alias("n"), F.max("angle").alias("radius"), F.min("node").alias("first")).collect()}  # SAMPLE / DENSE at most
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame([(int(s), int(x["n"]), int(x["first"])) for s, x in stars.items()], "star int, size long, first long"))
    crossed = written(crossings(at, centres, stars, item), "crossed")

    alone = at.where("star < 0")
    sizes = written(alone.groupBy("label", "dims").agg(F.count("*").alias("rows")), "sizes")
    grid = F.greatest(F.lit(1), F.least(F.lit(GRID), F.ceil(F.log2(F.col("rows") / F.lit(CELL))))).cast("int")
    own = grid_rows(alone.join(small(sizes.withColumn("grid", grid).drop("rows")), ["label", "dims"]).select("node", "n", "label", "dims", "vector", "grid"), item)
    name = lambda star: F.array(F.col(star).cast("string"))[0].cast("binary")
    asked = crossed.where(F.col("kind") == ASK).select(F.col("a").alias("node"), F.col("b").alias("of"))
    told_to = at.join(F.broadcast(asked.select(F.col("of").cast("int").alias("star")).distinct()), "star").select("node", "n", "label", "vector", F.lit(STAR).alias("block"), name("star").alias("cell"), F.lit(TOLD).cast("byte").alias("role"))
    asks = asked.join(at, "node").select("node", "n", "label", "vector", F.lit(STAR).alias("block"), name("of").alias("cell"), F.when(F.col("star") < 0, MEETS).otherwise(ALONE).cast("byte").alias("role"))
    groups = dealt(own.unionByName(told_to).unionByName(asks))
    links = written(groups.groupBy("label", "block", "cell", "i", "j").applyInArrow(linked(item), "a long, b long, n long"), "links")

    of_kind = lambda k, *c: crossed.where(F.col("kind") == k).select(*c)
    counts = links.select(F.col("a").alias("node"), F.col("n").alias("more")).unionByName(of_kind(SURE, F.col("a").alias("node"), F.col("n").alias("more"))).groupBy("node").agg(F.sum("more").alias("more"))
    added = of_kind(ADDED, F.col("a").cast("int").alias("star"), F.col("n").alias("added")).groupBy("star").agg(F.sum("added").alias("added"))
    members = at.where("star >= 0").join(known, "star").select(F.col("node").alias("a"), F.col("first").alias("b"))
    # A row's class by its hashes; the classes of one id are joined.
    rows = told.where("vector is not null and key is not null").select("key", "h1", "h2")
    rows = written(rows.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("key", "node"), "rows")
    several = written(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "several")
    shared = rows.join(small(several), "key").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = written(components(links.select("a", "b").unionByName(of_kind(EDGE, "a", "b")).unionByName(members).unionByName(shared)), "components")
    whole = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    n = F.coalesce("size", "n") - 1 + F.coalesce("added", F.lit(0)) + F.coalesce("more", F.lit(0))
    ends = at.select("node", "star", "n").join(known, "star", "left").join(F.broadcast(added), "star", "left").join(counts, "node", "left").select("node", n.alias("n_links"))
    named = ends.join(whole.select("node", "component"), "node").join(least, "component").select("node", "n_links", "component_id")
    linked_rows = rows.join(named, "node").select("key", "n_links", "component_id")
    rest = told.where("vector is null or key is null").select("key", F.lit(0).alias("n_links"), F.col("key").alias("component_id"))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked_rows.unionByName(rest).select(F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", kept)
