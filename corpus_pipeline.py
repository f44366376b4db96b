"""Corpus preparation: quality rules, line deduplication, near-duplicate removal, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; the frame is written as
Parquet in the shared folder and read again as the next stage's docs. All but the last return the columns of documents.
SQL can't state the stages (a forest, an edit join, a signature index, expectation-maximisation): the tests compare them with
brute-force versions, or with what their operator decides where a model is fitted.

Defined cases, for each stage: a null or empty text has no words, so the quality rules reject it (of the other stages a null text
stays null and an empty one empty); rows that repeat an id and a text are one document with equal results; rows of one id and
different texts are judged each by its own text, but near duplicates link them as one node; a row with a null id is in no
group and stays; other columns, also of clashing names, pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecurve.llm import line_dedup, lsh_forest, packing, pii, quality
from tidecurve.llm.common import small, table, written

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # no column of docs is taken for the verdict's
    return quality.judge(rows, model).where("kept").select("row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go; documents stay."""
    return _measured(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id."""
    gone = lsh_forest.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    gone = written(gone, "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(pii.redact(docs, pii.fit(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every sequence of every document with its bucket and batch."""
    return packing.pack(packing.sequences(docs)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
