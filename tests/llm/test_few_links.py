"""Components of few links: tables are written once a round, and no round is run only to see that nothing changes."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import check_lines, edited
from tidecurve.llm import graph, line_dedup


def components(spark, monkeypatch, links):
    names, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or plain(df, name))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    monkeypatch.setattr(graph, "written", plain)
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in links:
        low, high = sorted((root(x), root(y)))
        up[high] = low
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    return names


def test_few_links_are_written_once_a_round(spark, monkeypatch):
    """Stars take no round; a hub of larger and smaller neighbours, repeated links and two stars with a link take one or two."""
    stars = [(f"a{i % 3}", f"b{i:02d}") for i in range(40)]
    assert components(spark, monkeypatch, stars) == ["edges"]
    assert components(spark, monkeypatch, [*stars, *stars, ("b05", "b06"), *((f"a{i}", "c") for i in range(9))]) == ["edges"] * 3
    assert components(spark, monkeypatch, [("a", "a")]) == ["edges"]


def test_many_links_give_the_same(spark, monkeypatch):
    """Written and joined as tables that aren't broadcast, and broadcast: random graphs with long paths, hubs and loops."""
    rnd = random.Random(3)
    for fits in (lambda df, times=1: False, graph.fits):
        monkeypatch.setattr(graph, "fits", fits)
        name = [f"{rnd.randrange(10**6):06d}" for _ in range(150)]
        links = [(rnd.choice(name), rnd.choice(name)) for _ in range(90)] + list(zip(name[:30], name[1:31], strict=True)) + [(name[50], x) for x in name[60:90]]
        components(spark, monkeypatch, links + links[:20] + [(name[0], name[0])])


def test_lines_take_few_tasks(spark):
    """Tasks of a whole digest, with partitions as they are dealt: 64 for each shuffle, however few rows."""
    rnd = random.Random(9)
    lines = ["".join(rnd.choice("abcdefghijkl mnop") for _ in range(50)) for _ in range(40)]
    docs = [(i, "\n".join([edited(rnd, rnd.choice(lines), rnd.choice([0, 1, 2])), f"the template of every page: {i:03d}"])) for i in range(60)]
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    context, told = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        context.setJobGroup("few", "few")
        line_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).agg(F.count("*")).collect()
        stages = {s for j in told.getJobIdsForGroup("few") for s in told.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
    finally:
        context.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
    check_lines(spark, docs)
    assert tasks <= 2000, tasks
