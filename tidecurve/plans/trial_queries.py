"""Named queries of comparisons within one subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecurve.operators import trials

DRAWS, SEED = 99, 42

SQL = f"""
WITH x AS (SELECT user_id AS subject, event_id % 7 AS block, event_id AS id, event_type = 'click' AS in_a, CAST(floor(value * 100) AS BIGINT) AS y
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL),
d AS (SELECT x.*, draw, row_number() OVER (PARTITION BY subject, block, draw ORDER BY md5(concat('{SEED}:', draw, ':', id)), id) AS place,
  count(*) FILTER (in_a) OVER (PARTITION BY subject, block, draw) AS of_a FROM x, range(0, {DRAWS + 1}) AS t(draw)),
s AS (SELECT subject, draw, CAST(coalesce(sum(y) FILTER (CASE WHEN draw = 0 THEN in_a ELSE place <= of_a END), 0) AS BIGINT) AS sum_a, CAST(sum(y) AS BIGINT) AS total,
  count(*) FILTER (in_a) AS n_a, count(*) AS n FROM d GROUP BY 1, 2),
w AS (SELECT *, abs(sum_a * n - n_a * total) AS stat, max(abs(sum_a * n - n_a * total)) FILTER (draw = 0) OVER (PARTITION BY subject) AS seen FROM s)
SELECT subject AS user_id, max(n_a) AS n_a, max(n) - max(n_a) AS n_b,
  CAST(max(sum_a) FILTER (draw = 0) AS DOUBLE) / nullif(max(n_a), 0) - CAST(max(total) - max(sum_a) FILTER (draw = 0) AS DOUBLE) / nullif(max(n) - max(n_a), 0) AS diff,
  CAST(count(*) FILTER (stat >= seen) AS DOUBLE) / count(*) AS p_value FROM w GROUP BY 1
"""


def trial_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against all other events of each user, in seven blocks."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("subject"), (F.col("event_id") % 7).alias("block"), F.col("event_id").alias("id"), (F.col("event_type") == "click").alias("in_a"), F.floor(F.col("value") * 100).alias("outcome"))
    return trials.permutation_test(rows, DRAWS, SEED).withColumnRenamed("subject", "user_id")


QUERIES, SQLS = {"trial_permutations": trial_permutations}, {"trial_permutations": SQL}
