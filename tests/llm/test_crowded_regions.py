"""Templates below the threshold: regions with more than a block of rows outside of their largest component."""

import random
from collections import Counter

import numpy as np
import pytest

from tidecurve.llm import lsh_forest


def template_texts(n, seed, planted=60):
    """n documents of one template, alike in about 0.69, of which some are a changed copy (over the threshold) of another one."""
    rnd = random.Random(seed)
    words = lambda k: [f"{rnd.randrange(16**6):06x}" for _ in range(k)]
    template = words(170)
    docs = [template + words(34 + i % 3) for i in range(n - planted)]
    docs += [[*docs[i][:-10], *words(10)] for i in range(planted)]
    rnd.shuffle(docs)
    return docs


def components_of(docs):
    """Smallest index reachable over all pairs alike enough, by a comparison of all pairs."""
    ids: dict = {}
    sets = [{ids.setdefault(tuple(d[i : i + 5]), len(ids)) for i in range(len(d) - 4)} for d in docs]
    place = {x: k for k, x in enumerate(x for x, n in Counter(x for s in sets for x in s).items() if n > 1)}
    held = np.zeros((len(docs), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s if x in place]] = 1
    size, up, links = np.array([len(s) for s in sets]), list(range(len(docs))), 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for at in range(0, len(docs), 512):
        both = held[at : at + 512] @ held.T
        for a, b in np.argwhere(100 * both >= 75 * (size[at : at + 512, None] + size - both)).tolist():
            if a + at < b:
                links += 1
                x, y = sorted((root(a + at), root(b)))
                up[y] = x
    return [root(i) for i in range(len(docs))], links


def test_what_moves_grows_with_the_rows_and_no_link_is_lost(spark, monkeypatch):
    moved, groups, rare_groups = [], lsh_forest.groups, lsh_forest.rare_groups

    def counted_groups(classes):
        dealt = groups(classes)
        moved.append(dealt.count())
        return dealt

    def counted_rare(rows):
        dealt, kinds = rare_groups(rows)
        moved.append(rows.count() + dealt.count())
        return dealt, kinds

    monkeypatch.setattr(lsh_forest, "groups", counted_groups)
    monkeypatch.setattr(lsh_forest, "rare_groups", counted_rare)
    total = []
    for n in (4096, 8192):
        docs = template_texts(n, n)
        df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(8)
        moved.clear()
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df).collect()}
        total.append(sum(moved))
        assert 0 < total[-1] <= n * 2 * (202 // 4 + 1)  # a quarter of a set, written and dealt
        if n <= 4096:
            want, links = components_of(docs)
            assert links >= 60 and [got[i] for i in range(n)] == want
        else:
            assert len(set(got.values())) == n - 60
    assert total[1] <= 3 * total[0]  # blocks that meet blocks: 4; nearer to 2 as fewer shingles are alone in their bucket


@pytest.mark.parametrize("block", [4, 1024])
def test_rare_shingles_against_all_pairs(spark, monkeypatch, block):
    """Sets of all sizes from few shingles, so that many are frequent: every pair of two components alike enough is told in one group."""
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    rnd = np.random.default_rng(5)
    values = rnd.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    values[:20] = values[0] + np.arange(20, dtype=np.uint64)  # one bucket for twenty of them
    sets = []
    for _ in range(120):
        base = rnd.choice(values, rnd.integers(1, 30), replace=False)
        for _ in range(rnd.integers(1, 4)):
            keep = base[rnd.random(len(base)) < 0.93]
            sets.append(np.unique(np.concatenate([keep, rnd.choice(values, 1)])))
    comp = [int(i - i % 2) if i % 5 == 0 else i for i in range(len(sets))]
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    plain = [set(x.tolist()) for x in sets]
    want = {(a, b) for a in range(len(sets)) for b in range(a) if comp[a] != comp[b] and alike(plain[a], plain[b])}
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, hashes binary")
    told = spark.createDataFrame(list(enumerate(comp)), "node long, component long")
    rows = lsh_forest.rare_needed(told, frame)
    by_group: dict = {}
    for r in rows.collect():
        by_group.setdefault((r.region, r.i, r.j), set()).add(r.node)
    met = {(a, b) for g in by_group.values() for a in g for b in g if b < a}
    assert len(want) > 50 and want <= met
    links = {(r.a, r.b) for r in lsh_forest.judged(rows, frame).collect()}
    assert links <= {(b, a) for a, b in want}

    def roots(pairs):
        up = list(range(len(sets)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in [*pairs, *enumerate(comp)]:
            x, y = sorted((root(a), root(b)))
            up[y] = x
        return [root(i) for i in range(len(sets))]

    assert roots(links) == roots(want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "node long, n_shingles long, sketch binary, heads binary, component long")
    assert lsh_forest.crowded(empty).isEmpty()
    assert lsh_forest.rare_needed(lsh_forest.crowded(empty), spark.createDataFrame([], "node long, hashes binary")).isEmpty()
