"""A training corpus in five stages: quality, boilerplate lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it works on all that the one
before it kept. All but the last give the columns of documents, with n_chars of the new text.

Null and empty texts pass the first stages as what they are (a null text is an empty one for
the classifier, has no lines and no copies) and leave the passages' stage empty; packing closes
them with one id. Rows with a null doc_id stay, but never keep a line, copy or passage for
others; repeated rows are judged alike. Texts of any length are worked on whole. An empty
table gives an empty result with the same columns, and other columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, quality
from tidemark.llm._spark import shared_dir, table
from tidemark.llm.jaccard_join import without_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary_path
from tidemark.llm.substring_dedup import dedup_substrings


def _documents(df: DataFrame, text: str) -> DataFrame:
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", size.alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _documents(quality.scored(docs, machine, keep=("lang", "source")).where("predicted = 1"), "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites, but for the first document that has each."""
    return _documents(line_dedup.dedup_lines(docs, keep=("lang",)), "kept_text")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five words, similarity 0.8."""
    return without_near_duplicates(docs.select("doc_id", "text", "lang", "source", "n_chars"), words=5, num=4, den=5)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document has."""
    return _documents(dedup_substrings(docs, window=50, keep=("lang", "source")), "kept_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents, along a Hilbert curve."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]
#: Models and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}
