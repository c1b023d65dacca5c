"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents. A null doc_id is never a duplicate and stays; of rows equal in doc_id and
text one stays; rows of one doc_id with different texts are one document to near_duplicates, linked by any of its texts: all stay or
all go. To repeated_strings they are one document too, which takes nothing from itself. A text whose bytes all repeat elsewhere stays
as an empty text; n_chars follows the text. The other stages judge each row by its own text.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.llm import bpe, decontaminate, minhash, queries, suffix_dedup  # noqa: E402
from tidemark.llm.runtime import cut, table  # noqa: E402
from tidemark.plans.shipping import ship  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    scored = queries.quality_scores(docs, table(spark, sf_dir, "labels"), docs.columns)
    return scored.filter(F.col("score") >= queries.GOOD).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id."""
    ship(spark)
    gone = minhash.near_duplicates(docs, shingle=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that a document with a smaller doc_id holds go from the text."""
    ship(spark)
    out = suffix_dedup.remove_repeats(docs, span=50, digest=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    ship(spark)
    return bpe.round_trip(docs, *queries.vocabulary(), keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("benchmark", benchmark), ("tokens", tokens)]
#: Classifier, exact classes of near-duplicates and byte-pair merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
