"""Operators on Spark against brute force, with nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecurve.llm import bpe, chat, common, graph, html_text, licenses, line_dedup, lsh_forest, media, packing, pii, quality


def with_clashes(df):
    return df.withColumn("key", F.lit("k")).withColumn("line", F.lit(1)).withColumn("component", F.lit(2))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_pii_against_regexes(spark):
    rnd = random.Random(5)
    bits = ["a@b.c", "a", "_", "@", ".", "com", "1", "0", "255", "256.", "4111 1111 1111 1111", "é", "😀", " ", "-", "+1 ", "(555) ", "555-1234", "+", "\n", "192.168.0.1"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [None, "", "Dear James Smith, ssn 123-45-6789", "9" * 50_000, "a." * 30_000 + "@"]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.fit(df)
    for row in pii.find(df, model).collect():
        text = texts[row.doc_id] or ""
        want = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0]))
        assert [(s.kind, s.start, s.stop) for s in row.pii if s.base] == [(k, a, b) for a, _, k, b in want]
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert clean[400] is None and clean[401] == "" and "a@b.c" not in "".join(clean[i] for i in range(400))
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s) + 1)
        s[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "é", "😀"])
    return "".join(s)


def test_banded_distance(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("abcd é😀") for _ in range(rnd.randint(0, 40)))
        pairs.append(tuple(sorted((a, edited(rnd, a, rnd.randint(0, 5))), key=len, reverse=True)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.banded_distance(line_dedup.characters(F.col("a")), line_dedup.characters(F.col("b"))).alias("d")).collect():
        assert r.d == min(lev(r.a, r.b), 3)


def line_classes(lines, min_chars=line_dedup.MIN_CHARS):
    """A function from each line to its class, by all pairs; and the number of links."""
    up, links = {x: x for x in lines}, 0

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    counts = {x: Counter(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= 2 and (counts[a] - counts[b]).total() <= 2 and (counts[b] - counts[a]).total() <= 2 and lev(a, b) <= 2:
                up[root(a)] = root(b)
                links += 1
    return root, links


def check_lines(spark, docs, **options):
    spots = sorted({(k, p, x) for k, t in docs for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")})
    lines = sorted({x for *_, x in spots})
    root, links = line_classes(lines, **options)
    first, size, times = {}, Counter(map(root, lines)), Counter(root(x) for *_, x in spots)
    for k, p, x in spots:
        first.setdefault(root(x), (k, p))
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    rows, names = line_dedup.digest(df, **options).collect(), {}
    assert len(rows) == len(docs)
    for r in rows:
        own = [(p, x) for k, p, x in spots if k == r.doc_id]
        gone = [p for p, x in own if first[root(x)] != (r.doc_id, p)]
        assert (r.n_lines, r.dropped, r.n_near) == (len(own), ",".join(map(str, gone)), sum(size[root(x)] > 1 for _, x in own))
        told = dict(c.split(":", 1) for c in r.classes.split(",") if c)
        assert sorted(map(int, told)) == [p for p, x in own if times[root(x)] > 1]
        for p, x in own:
            if str(p) in told:
                assert names.setdefault(root(x), told[str(p)]) == told[str(p)]
    assert len(set(names.values())) == len(names)
    return df, links


def test_lines_against_all_pairs(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh ijkl") for _ in range(rnd.randint(14, 60))) for _ in range(15)]
    docs = [(i, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) if rnd.random() < 0.8 else rnd.choice(["", "  ", "ab"]) for _ in range(rnd.randint(0, 6)))) for i in range(40)]
    docs += [(100, None), (101, ""), (5, docs[5][1])]
    df, _ = check_lines(spark, docs)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert kept[100] is None and kept[101] == ""
    assert line_dedup.digest(df.limit(0)).count() == 0
    check_lines(spark, docs, min_chars=8)


def test_line_families_are_whole_and_cost_a_few_pairs_a_line(spark, monkeypatch):
    """A family of true links, templates whose variants aren't links, and a long line: hot segments, whole classes, few candidates."""
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    family, page, template = text(70), text(40), text(90)
    lines = [edited(rnd, family, rnd.choice([0, 1, 1, 2])) for _ in range(200)] + [f"{page} {i:03d}" for i in range(250)]
    for _ in range(250):  # a word replaced in one or two places
        x = template
        for _ in range(rnd.choice([1, 2])):
            at = rnd.randrange(80)
            x = x[:at] + text(6) + x[at + 6 :]
        lines.append(x)
    lines += [text(50) for _ in range(100)] + ["long " + text(20_000)] * 2 + [edited(rnd, template, 2) for _ in range(5)]
    rnd.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(len(lines) // 4 + 1)]
    paired, plain = [], line_dedup.verified

    def verified(pairs, fuzzy):
        paired.append(pairs.distinct().count())
        return plain(pairs, fuzzy)

    monkeypatch.setattr(line_dedup, "verified", verified)
    monkeypatch.setattr(line_dedup, "BLOCK", 50)
    _, links = check_lines(spark, docs)
    assert links > 15_000 and sum(paired) < 12 * len(lines), (links, paired)


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(25):
        words = [word() for _ in range(rnd.choice([3, 20, 60, 150]))]
        for _ in range(rnd.randint(1, 4)):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 3, 8])):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, None), (901, ""), (902, " \n"), (3, docs[3][1]), (None, docs[3][1]), (903, docs[3][1].upper())]
    sets = {}
    for k, t in docs:
        w = re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ").lower().split(" ")
        w = [] if w == [""] else w
        sets.setdefault(k, set()).update([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    up = {k: k for k in sets if k is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = lsh_forest.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


def few_rows_a_partition(spark, n=64):
    """Settings for many small partitions; returns what they were."""
    settings = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return before


def test_round_two_compares_regions_that_partitions_cut(spark, monkeypatch):
    """One region of thousands of rows, whose partners are its first and last rows in the order of its tree."""
    r = np.random.default_rng(3)
    n, partners = 4000, 40
    sig = r.integers(0, 1 << 16, (n, lsh_forest.HASHES)).astype(np.uint16)
    sig[:, :2] = 7  # the region of the first tree
    sig[n - partners :, 20:] = sig[:partners, 20:]
    sig[:partners, 2], sig[n - partners :, 2] = 0, 65535
    comp = np.where(r.random(n) < 0.6, 1_000_000, np.arange(n))
    comp[:partners], comp[n - partners :] = np.arange(partners), 1_000_000
    heads, sketch = sig[:, lsh_forest._HEADS], sig.astype(np.uint8)
    rows = [(i, 100, sketch[i].tobytes(), heads[i].astype(">u2").tobytes(), int(comp[i])) for i in range(n)]
    classes = spark.createDataFrame(rows, "node long, n_shingles long, sketch binary, heads binary, component long")
    sets = spark.createDataFrame([(i, np.arange(k * 1000, k * 1000 + 100, dtype=np.uint64).tobytes()) for i, k in ((i, i if i < partners else i - n + partners) for i in (*range(partners), *range(n - partners, n)))], "node long, hashes binary")
    want = {(i, n - partners + i) for i in range(partners)}
    before = few_rows_a_partition(spark)
    try:
        for limit in (common.BROADCAST_BYTES, 0):  # regions broadcast or joined by a shuffle
            monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
            needed = lsh_forest.needed(classes)
            assert {r.node for r in needed.collect()} == {x for pair in want for x in pair}
            assert {(x.a, x.b) for x in lsh_forest.judged(needed, sets).collect()} == want
        dealt = lsh_forest.groups(classes).groupBy("region", "i", "j").count()
        assert dealt.agg(F.max("count")).first()[0] <= 2.5 * lsh_forest.BLOCK
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_template_below_the_threshold_in_small_partitions(spark, monkeypatch):
    """2,000 documents of one template, alike in about 0.7, with 100 planted pairs, against all pairs; what moves is counted."""
    rnd = random.Random(8)
    words = lambda n: [f"{rnd.randrange(16**6):06x}" for _ in range(n)]
    template, docs = words(170), []
    for _ in range(1900):
        docs.append(template + words(34))
    for i in range(100):
        docs.append([*docs[i][:-10], *words(10)])
    rnd.shuffle(docs)
    ids: dict = {}
    sets = [{ids.setdefault(tuple(d[i : i + 5]), len(ids)) for i in range(len(d) - 4)} for d in docs]
    often = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    held = np.zeros((len(docs), len(often)), np.float32)
    place = {x: k for k, x in enumerate(often)}
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s if x in place]] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    union = size[:, None] + size - both
    up, below = list(range(len(docs))), (both / union)[:20].ravel()
    links = [(a, b) for a, b in np.argwhere(100 * both >= 75 * union).tolist() if a < b]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert len(links) >= 100 and 0.65 < np.median(below) < 0.72
    counts, plain = [], lsh_forest.needed

    def needed(classes):
        rows = common.written(plain(classes), "needed")
        counts.append(rows.count())
        return rows

    monkeypatch.setattr(lsh_forest, "needed", needed)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    before = few_rows_a_partition(spark, 40)
    try:
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    missed = sum(got[i] != root(i) for i in range(len(docs)))
    assert missed == 0
    assert counts[0] <= 3 * lsh_forest.TREES * len(docs)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_packing(spark):
    docs = [(i, " ".join(["w"] * n)) for i, n in enumerate([0, 1, 5, 5, 9, 40, 41, 100])] + [(50, None), (3, " ".join(["w"] * 5))]
    seqs = packing.sequences(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), window=30)
    rows = packing.pack(seqs, buckets=3, budget=60).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").split()) for _, t in docs)
    batches = {}
    for r in rows:
        assert 0 <= r.padding == r.bound - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), held in batches.items():
        assert len(held) * held[0].bound <= max(60, held[0].bound)
        assert sorted(r.place for r in held) == list(range(len(held)))
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(held) == max(1, 60 // max(held[0].bound, 1))
    assert packing.pack(seqs.limit(0)).count() == 0


def test_encode_and_pack_tokens(spark):
    """Against the tokenizers library; the decoded batches give back every text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, rnd = Tokenizer.from_file(path), random.Random(2)
    texts = ["", None, "été 😀 <|endoftext|> x", "a" * 3000, " ".join(rnd.choice(["the", "theme", "été", "12", "\n\n", "zqx"]) for _ in range(4000))]
    texts += ["".join(rnd.choice("abthe  \n.,1é😀") for _ in range(rnd.randint(0, 80))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (4, "same id")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(0))
    want = sorted(((k if k is not None else -1), tool.encode(t or "", add_special_tokens=False).ids) for k, t in rows)
    encoded = common.written(bpe.encode(df, path), "encoded")
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.ids) for r in encoded.collect()) == want
    back = bpe.decode(encoded, path)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in back.collect()) == sorted(((k if k is not None else -1), t or "") for k, t in rows)
    told = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digest(df, path).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert told == sorted(((k if k is not None else -1), len(ids), sha(",".join(map(str, ids))), sha(t or "")) for k, t in rows for ids in [tool.encode(t or "", add_special_tokens=False).ids])
    empty = bpe.encode(df.limit(0), path)
    assert empty.count() == 0 and bpe.decode(empty, path).count() == 0 and bpe.round_trip_digest(df.limit(0), path).count() == 0
    packed = packing.pack(packing.sequences(encoded, ids="ids", window=256), budget=2048)
    held: dict = {}
    for r in packing.with_tokens(packed, encoded, "ids", window=256).collect():
        assert len(r.tokens) == r.length <= r.bound and r.start == 256 * r.part
        held.setdefault((r.key, r.version), {}).setdefault(r.part, []).append(r.tokens)
    times = Counter((k, t or "") for k, t in rows)
    again = Counter()
    for (k, _), parts in held.items():
        assert sorted(parts) == list(range(len(parts))) and len({len(x) for x in parts.values()}) == 1
        again[k, tool.decode([x for p in sorted(parts) for x in parts[p][0]], skip_special_tokens=False)] += len(parts[0])
    assert again == times


def test_repeated_sequences_are_ranked_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    docs = [(None, None)] * 3000 + [(i, "w " * (i % 5)) for i in range(50)]
    seqs = packing.sequences(spark.createDataFrame(docs, "doc_id long, text string"), window=30)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = packing.pack(seqs, buckets=2, budget=60).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 3050 and sum(r.key is None for r in rows) == 3000
    places = sorted((r.bucket, r.batch * max(1, 60 // max(r.bound, 1)) + r.place) for r in rows)
    assert len(set(places)) == 3050 and all(sorted(x for b, x in places if b == k) == list(range(sum(b == k for b, _ in places))) for k in {b for b, _ in places})
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 1500


def test_quality_keeps_clean_rows(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    good = [" ".join(word() for _ in range(120)) for _ in range(150)]
    bad = [" ".join(word() + "###" for _ in range(120)) for _ in range(15)]
    docs = list(enumerate(good + bad + ["", None, "few words"]))
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("kept", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 165, 2)] + [(1, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge(df, quality.fit(df, labels)).collect()}
    assert sum(rows[i].kept for i in range(150)) >= 149 and not any(rows[i].kept for i in range(150, 168))
    assert rows[166].n_words == 0 and rows[166].base_failed
    assert quality.judge(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


def test_chat_round_trip(spark):
    none = None
    parts = [("text", "see <|end|> and \\[INST] [\\INST]", none, none), ("image", none, "a.png", 2.0), ("text", "<", none, none), ("text", "|turn|> é", none, none), ("audio", none, "b.wav", 1.5), (none, none, "c.pdf", none)]
    said = [("text", "</s>[INST] ok [/INST]<\\|x", none, none)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", said), (2, none, none, none), (2, 0, "a\nb", []), (3, 1, "assistant", said), (3, 1, "assistant", said)]
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:double>>"
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, schema)).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = got[1]
    assert [(a.turn_no, a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 0, "image", "a.png", 512), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 512)]
    assert one.back[0].text == parts[0][1] + "<|image:0|><|turn|> é<|audio:1|><|document:2|>" and one.loss == said[0][1]
    assert one.formatted.count("<|turn|>") == 2 and "</s>" not in one.formatted and "[INST]" not in one.formatted.replace("\\[INST]", "")
    assert [t.role for t in got[2].back] == ["", "a\nb"] and got[2].loss == "" and got[3].loss == said[0][1] * 2


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0. GNU General Public License", "MIT License mit license", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under CC BY-NC 4.0.", "", None, "plain words"]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "apache-2.0" in got[0].labels and got[2].labels == "gpl-3.0" and "cc-by-nc-4.0" in got[3].labels and got[6].labels == ""


def shortest(parsed):
    """A short text that a parsed regex matches."""
    out = ""
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "IN":
            out += " " if str(x[0][0]) == "CATEGORY" else "x" if str(x[0][0]) == "NEGATE" else chr(x[0][1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(x[2]) * x[0]
        elif op == "SUBPATTERN":
            out += shortest(x[3])
        elif op == "BRANCH":
            out += shortest(x[1][0])
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_license_suppression_against_all_pairs(spark):
    """Of all matches of all rules those stay that lie in no other of the same or a better priority (of equal ones the first)."""
    rnd, all_rules = random.Random(12), licenses.rules()
    bits = [shortest(re._parser.parse(r["regex"])) for r in rnd.sample(all_rules, 60)] + ["gnu ", "the ", " license", "mit", "/", " or ", "apache", "\n", ". ", "é😀", " 2.0", "all rights reserved", "licensed under "]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 12))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.detect(df).collect():
        found = sorted((m.start(), -m.end(), r["priority"], r["rule"], r["label"]) for r in all_rules for m in re.finditer(r["regex"], row.text))
        kept = [x for i, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
        assert [(d.start, -d.stop, d.priority, d.rule, d.label) for d in row.detections] == kept, row.text
    long = "word " * 200_000 + "MIT License"
    rows = licenses.scan(spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in rows) == [(0, 0, ""), (1, 200_002, "mit"), (1, 200_002, "mit")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_license_rule_has_a_text_that_fires_it(spark):
    texts = []
    for r in licenses.rules():
        if "(?=" in r["regex"] or "(?<=" in r["regex"]:  # one of two licences: below
            continue
        text = shortest(re._parser.parse(r["regex"]))
        assert re.fullmatch(r["regex"], text), text
        texts += [(r["label"], text), (r["label"], f"So: {text.upper()}, see")]
    notices = [
        ("proprietary", "Copyright 2020 Acme Ltd. All Rights\nReserved."), ("public-domain", "It was released into the public domain."),
        ("public-domain", "We dedicate any and all copyright interest to the\npublic domain."), ("wtfpl", "Terms: wtfpl.net"),
        ("eupl-1.2", "see joinup.ec.europa.eu/collection/eupl for terms"),
        *[(x, f"dual licensed under {t}") for t in ("MIT/Apache-2.0", "Apache-2.0 or MIT", "mit or apache", "MIT and Apache 2.0") for x in ("mit", "apache-2.0")],
        *[(x, f"The code is {t}.") for t in ("MIT/BSD", "bsd/mit", "BSD or mit") for x in ("mit", "bsd")], *[(x, "GPL/BSD terms") for x in ("gpl", "bsd")], ("gpl", "artistic/gpl"), ("gpl", "MIT/GPL"),
        ("mit", "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software"), ("bsd", "Redistribution and use in source and binary\nforms, with or without modification, are permitted"),
        ("lgpl-2.1", "GNU Lesser General Public License v2.1"), ("bsd", "License: BSD"), ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
        ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or any later version."),
    ]
    none = ["overall rights reserved", "some rights reserved", "a public domain", "all rights are reserved", "into the public domains"]
    texts += notices + [(None, t) for t in none]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    missed = [(label, t) for i, (label, t) in enumerate(texts) if (label or "") not in got[i].labels.split(",")]
    assert not missed
    assert all(got[i].score > 0 for i in range(len(texts) - len(none)))


def test_pages_on_spark(spark):
    words = "Some words of the text, a sentence that goes on. " * 5
    htmls = [None, "", f"<nav>Menu</nav><article><p>{words}</p></article>", f"<article><p>{words * 5000}</p>", "<a" * 50_000, f"<nav>Menu</nav><article><p>{words}</p></article>"]
    rows = [(i, f"u{i}" if i else None, h) for i, h in enumerate(htmls)] + [(None, None, htmls[2]), (2, "u2", htmls[2])]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(None))
    got = html_text.extract(df).collect()
    assert got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in got) == sorted((i if i is not None else -1, u or "", (t := html_text.main_text(h)), len(t)) for i, u, h in [((i or None), u, h) for i, u, h in rows])
    assert {r.text for r in got if r.page_id == 2} == {words.strip()} and next(r for r in got if r.page_id == 3).n_chars == len((words * 5000).strip())
    assert html_text.extract(df.limit(0)).count() == 0


def test_media(spark, tmp_path):
    texts = ["", None, "x", "é" * 100, "z" * 5000, "x"]
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    path = f"file://{tmp_path}/media"
    got = {r.doc_id: r for r in media.media_column(df, path=path).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
    stored = {r.key: r.media for r in media.read_media(spark, path).collect()}
    assert all((got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest()) for i in range(len(texts)))
    assert got[2].media_sha256 == got[5].media_sha256 and got[2].feature == got[5].feature
    assert media.read_media(spark, path, range_bytes="700", batch_bytes="100").count() == len(texts)
    archive = max((tmp_path / "media").glob("*.tar"), key=lambda p: p.stat().st_size)
    data = bytearray(archive.read_bytes())
    data[512 + 60] ^= 255
    archive.write_bytes(data)
    told = media.read_media(spark, path, retries="1").collect()
    assert len(told) == len(texts) and sum(r.error is not None for r in told) == 1
    assert media.media_column(df.limit(0), path=f"file://{tmp_path}/none").count() == 0


def test_long_repeated_and_clashing_rows(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(30_000))
    near = " ".join(w if rnd.random() > 0.01 else "other" for w in long.split())
    docs = [(1, long), (2, near), (3, long), (3, long), (4, "x" * 200_000), (None, long), (None, None), (None, None), (5, "")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("n_shingles", F.lit("mine"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in lsh_forest.near_duplicates(df).collect())
    assert got == [(0, 0, False)] * 3 + [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True)]
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    judged = quality.judge(df, quality.fit(df, labels)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in judged) == [(0, 0), (0, 0), (0, 30_000), (1, 30_000), (2, 30_000), (3, 30_000), (3, 30_000), (4, 1), (5, 0)]
    few = quality.fit(df, labels, sample_rows=1)  # a null id that is drawn can't bring all its rows
    assert len(few.forest.trees) >= 0 and quality.judge(df, few).count() == len(docs)


def test_chat_long_and_clashing(spark):
    said = "<|turn|>\\[INST] é" * 20_000
    rows = [(1, 0, "user", said, "mine"), (1, 1, "assistant", said, "mine"), (2, 0, "assistant", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("loss_spans", F.lit(1)).withColumn("attachments", F.lit(2))
    turns = df.withColumn("parts", chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.format_chat(turns).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [t.text for t in got[1].back] == [said, said] and got[1].loss == said and got[2].loss == ""
    assert chat.format_chat(turns.limit(0)).count() == 0


def stage_docs(spark):
    """Documents of the test table with nulls, empty and repeated rows, a null id and columns of clashing names."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.limit(1).first()
    extra = [(None, some.text, "xx", "s", 1), (900_001, None, "xx", "s", None), (900_002, "", "xx", "s", 0), tuple(some), (some.doc_id, "another text of the same id", "xx", "s", 1)]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("key", F.lit("k")).withColumn("kept", F.lit("mine")).withColumn("component", F.lit(7)).withColumn("line", F.lit("l"))


def test_pipeline_stages(spark):
    """Each stage on the same documents, against brute force, or against its operator where a model decides."""
    import corpus_pipeline

    sf, stages = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "repeated_lines", "near_duplicates", "personal_data", "packing"]
    docs = common.written(stage_docs(spark), "docs")
    rows = docs.collect()
    ident = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    out = {}
    for name, stage in list(stages.items())[:-1]:
        told = common.written(stage(spark, docs, sf), name)
        assert told.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        out[name] = sorted(told.collect(), key=ident)
        assert all(r.key == "k" and r.kept == "mine" and r.component == 7 and r.line == "l" for r in out[name])

    judged = quality.judge(docs.select("doc_id", "text"), quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("kept").collect()
    assert sorted((r.doc_id or -1, quality.statistics(r.text)[0]) for r in out["quality_rules"]) == sorted((r.doc_id or -1, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in judged)
    assert not any(quality.statistics(r.text or "")[0][0] < 50 for r in out["quality_rules"])

    worded = lambda x: bool(x.strip(" \t\n\x0b\x0c\r"))
    spots = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "", p, x) for r in rows for p, x in enumerate((r.text or "").split("\n")) if worded(x)}, key=lambda s: (s[0], s[1], s[3]))
    root, _ = line_classes(sorted({s[-1] for s in spots}))
    holders: dict = {}
    for null, k, *_, x in spots:
        holders.setdefault(root(x), (null, k))
    for r in out["repeated_lines"]:
        if r.text is not None and r.doc_id is not None and sum(x.doc_id == r.doc_id for x in rows) == 1:
            given, seen, want = next(x.text for x in rows if x.doc_id == r.doc_id), set(), []
            for x in given.split("\n"):
                if not worded(x) or (holders[root(x)] == (False, r.doc_id) and root(x) not in seen):
                    want.append(x)
                seen.add(root(x) if worded(x) else None)
            assert r.text == "\n".join(want)
    assert len(out["repeated_lines"]) == len(rows) and sum(r.text is None for r in out["repeated_lines"]) == 1

    each: dict = {}
    for r in rows:
        w = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").strip(" ").lower().split(" ")
        each.setdefault(r.doc_id, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w != [""] else set())
    up = {k: k for k in each if k is not None}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in up:
        for b in up:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in each[a] for y in each[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert sorted(map(ident, out["near_duplicates"])) == sorted(ident(r) for r in rows if r.doc_id is None or top(r.doc_id) == r.doc_id)

    texts = {(r.doc_id, r.text) for r in rows}
    for r in out["personal_data"]:
        assert (r.doc_id, r.text) in texts or "[" in r.text
        assert not any(valid("email", m[0]) for m in re.finditer(PATTERNS["email"], r.text or ""))
    assert len(out["personal_data"]) == len(rows)

    packed = stages["packing"](spark, docs, sf)
    assert sum(r.length for r in packed.collect()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert stages["packing"](spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", ["op4_chat", "op9_minhash", "pii_base", "quality_base", "licenses_base", "media_payload"])
def test_sql(spark, name):
    import duckdb

    from tidecurve.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
