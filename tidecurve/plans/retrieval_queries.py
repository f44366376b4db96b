"""Named queries of retrieval and of walks over a graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecurve.operators import claims, retrieval

QUERIES, SQLS = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQLS[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE lang <> 'fr'),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
i AS (SELECT term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(len(w)) FROM d)))), 6) AS score FROM q JOIN p USING (term) JOIN i USING (term) GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS word_rank FROM s QUALIFY word_rank <= 100),
c AS (SELECT b.item_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS score
  FROM benchmark b JOIN embeddings f ON f.vec_id = b.item_id CROSS JOIN embeddings e WHERE e.vec_id IN (SELECT doc_id FROM d)),
v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS vector_rank FROM c QUALIFY vector_rank <= 100),
f AS (SELECT item_id AS query_id, doc_id, word_rank, vector_rank, round(coalesce(1 / (60 + word_rank), 0) + coalesce(1 / (60 + vector_rank), 0), 9) AS score FROM a FULL JOIN v USING (item_id, doc_id))
SELECT query_id, doc_id, word_rank, vector_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f QUALIFY rank <= 10
""")
def hybrid_retrieval(spark, sf_dir):
    """Benchmark passages as queries (the vector of the same number is theirs) against all documents but those in French."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text").join(vectors.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    return retrieval.hybrid(_table(spark, sf_dir, "documents"), vectors, queries, where=F.col("lang") != "fr").select("query_id", "doc_id", "word_rank", "vector_rank", "rank")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS source, target FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem WHERE l_returnflag = 'R') WHERE target IS NOT NULL),
w AS (SELECT p_partkey AS start, p_partkey AS node, [p_partkey] AS path FROM part WHERE p_size = 1
  UNION ALL SELECT w.start, e.target, list_append(w.path, e.target) FROM w JOIN e ON e.source = w.node WHERE len(w.path) <= 3 AND NOT list_contains(w.path, e.target))
SELECT start, node, len(path) - 1 AS hops, array_to_string(path, '>') AS path FROM w WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) = 1
""")
def claim_walks(spark, sf_dir):
    """Parts as claims: one supports the next of its order's returned lines; from the parts of size 1 up to three hops."""
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    edges = lines.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("target"))
    told = claims.walks(edges, _table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("start")))
    return told.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))
