"""Fill-in-middle, spelling variants and near-duplicate vectors against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecurve.llm import fim, spelling, vector_join

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(key, text):
    text = text or ""
    words = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(words)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (words[:a], words[a:b], words[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\t\n", "one", " one", "one ", "a b  c\n\nd e \U0001f600x  ", " wide", "<P>x y", "x <M", "<S", "ä ö́ 日本 語", "word " * 30_000, "x" * 200_000, " " * 5_000]


def test_fim_equals_the_plain_version(spark):
    rows = [(10 * i + j, t) for i, t in enumerate(TEXTS) for j in range(10)] + [(None, "a b c d"), (3, "")] + [(7, "same text twice here")] * 2
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, output string, n int")
    told = fim.fill_in_middle(docs)
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in told.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect())
    assert got == Counter((k, *plain_fim(k, t), t or "") for k, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    empty = fim.fill_in_middle(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\nabé€\U0001f600", max_size=40))
def test_runs_find_every_cut(text):
    data = text.encode()
    words = TOKEN.findall(text)
    held = fim.runs(data)
    assert held.n == len(words)
    assert [held.offset(k) for k in range(held.n + 1)] == [len("".join(words[:k]).encode()) for k in range(len(words) + 1)]
    letters = fim.runs(data, "character")
    assert letters.n == len(text)
    assert [letters.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert len(letters.end) <= len(text) and (letters.kind[1:] != letters.kind[:-1]).all()


def plain_words(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def test_variants_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = ["abcde", "aabbcc", "hellooo", "ÀÉstra", "zzzzz", "straße", "ÿÿÿÿÿÿ"]
    rows = [(None, "abcde ABCDE Abcde"), (1, None), (2, ""), (3, "x" * 3000), (4, "x" * 3000 + " " + "x" * 2999), (5, "x" * 3000), (6, "123 -- !!")]
    for k in range(400):
        words = []
        for _ in range(12):
            w = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(0, 2))] = [["a", "b", "É", ""][rng.integers(4)]]
            words.append("".join(w))
        rows.append((100 + k, " ".join(words) + ("." if k % 2 else "\n")))
    rows += [rows[-1]] * 3
    docs = spark.createDataFrame([(k, t, "w", 5) for k, t in rows], "doc_id long, text string, word string, n int")
    got = {tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == plain_variants(rows)
    assert any(r[3] and r[5] != r[3] for r in got)  # forms of forms
    assert spelling.variants(docs.limit(0)).count() == 0


def test_variant_rows_follow_the_letters():
    found = [f"{c}{d}cdefg" for c in "abcdefghij" for d in "abcdefghij"]
    of, kind, high, low = spelling.word_keys(found)
    assert len(of) == len(kind) == len(high) == len(low) <= sum(2 * len(w) + 1 for w in found)
    keys = {}
    for i, k, key in zip(of, kind, zip(high, low, strict=True), strict=True):
        keys.setdefault((key, k == spelling.WILDCARD), []).append(i)
    assert max(map(len, keys.values())) <= 26


def plain_vectors(rows):
    fit = [i for i, (k, v, x) in enumerate(rows) if k is not None and x is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    once = {}
    for i in fit:
        once.setdefault((rows[i][0], rows[i][2], np.array(rows[i][1], np.float32).tobytes()), i)
    nodes = list(once.values())
    links, reach = Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while reach[a] != a:
            a = reach[a]
        return a

    for s, i in enumerate(nodes):
        for j in nodes[s + 1 :]:
            a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(rows[i][0]), find(rows[j][0])))
                reach[q] = p
    name = {i: once[(rows[i][0], rows[i][2], np.array(rows[i][1], np.float32).tobytes())] for i in fit}
    told = Counter()
    for i, (k, *_) in enumerate(rows):
        c = find(k) if i in name else k
        told[k, links[name[i]] if i in name else 0, c, k is not None and k == c] += 1
    return told


def vectors(rng, n, dims=64):
    x = rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, hub = [], vectors(rng, 3)
    near = lambda c, spread: c + spread * vectors(rng, 1)[0]
    for spread in np.linspace(0, 0.75, 240):  # a dense place and all that is around it, up to far beyond the threshold
        rows += [(hub[0] * 3 if spread == 0 else near(hub[0], spread), 1), (near(hub[1], 0.1 + spread / 2), 2)]
    rows += [(near(hub[2], 0.1), 1) for _ in range(60)] + [(near((hub[0] + hub[2]) / np.linalg.norm(hub[0] + hub[2]), 0.2), 1) for _ in range(60)]
    rows += [(x, int(k)) for x, k in zip(vectors(rng, 100), rng.integers(0, 3, 100), strict=True)]
    rows += [(hub[0], 2), (hub[0], None), (np.zeros(64), 1), (vectors(rng, 1, 5)[0], 1), (vectors(rng, 1, 1)[0], 1), (hub[1] * 1e-30, 2), (np.full(64, np.nan), 1)]
    table = [(i, [float(c) for c in v], k) for i, (v, k) in enumerate(rows)]
    table += [(0, table[0][1], 1), (900, table[5][1], 2), (901, table[5][1], 2), (901, table[0][1], 1), (902, None, 1), (903, [], 1), (904, [1.0, None], 1), (None, table[1][1], 2), (None, None, None)]
    df = spark.createDataFrame([(*r, 5, "s") for r in table], "vec_id long, embedding array<float>, label int, star int, component_id string").repartition(5)
    got = Counter(tuple(r) for r in vector_join.near_vectors(df).collect())
    assert got == plain_vectors(table)
    assert vector_join.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [10**9, 4])
def test_vectors_with_and_without_stars_and_parts(spark, monkeypatch, dense):
    monkeypatch.setattr(vector_join, "DENSE", dense)
    monkeypatch.setattr(vector_join, "PART", 40)
    monkeypatch.setattr(vector_join, "CELL", 8)
    rng = np.random.default_rng(8)
    centres = vectors(rng, 12)
    rows = [(i, [float(x) for x in centres[i % 12] + rng.uniform(0.02, 0.3) * vectors(rng, 1)[0]], i % 2) for i in range(360)]
    got = Counter(tuple(r) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == plain_vectors(rows)
    assert sum(n for _, n, *_ in got) > 1000


def test_a_group_of_copies_costs_a_row_each(spark):
    """Near copies of one vector are rows of their star only: none is sent to a cell."""
    rng = np.random.default_rng(1)
    centre = vectors(rng, 1)[0]
    rows = [(i, [float(x) for x in centre + 0.05 * vectors(rng, 1)[0]], 0) for i in range(600)]
    got = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {tuple(r) for r in got.collect()} == {(i, 599, 0, i == 0) for i in range(600)}
    item = "<f4"
    classes = spark.createDataFrame([(i, "0", 64, np.array(v, item).tobytes(), 1) for i, v, _ in rows], "node long, label string, dims int, vector binary, n long")
    sample = classes.orderBy(F.xxhash64("node")).limit(200).collect()
    placed = vector_join.placed(classes, vector_join.pivots(sample, item), item)
    assert placed.where("star < 0").count() == 0
