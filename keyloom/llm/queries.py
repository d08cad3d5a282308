"""Queries p6 to p8 over the documents, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, packing, subjects

CAPACITY = 4096


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(_documents(spark, d))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Encoded and decoded again; null texts come back empty."""
    return bpe.decode_column(bpe.encode_column(_documents(spark, d)))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.token_counts(_documents(spark, d)), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split."""
    return p7_pack(spark, d).where(F.col("piece") == 1).select("doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in spark.read.parquet(f"{d}/subjects.parquet").select("subject").collect()]
    words = subjects.sentence_words(_documents(spark, d))  # texts are read once
    model = subjects.train(words, spark.read.parquet(f"{d}/subject_labels.parquet"), names)
    return subjects.subject_posteriors(words, model).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject: the composition of the corpus."""
    return p8_found(spark, d).groupBy("subject").agg(F.count_distinct("doc_id").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip, p7_found, p7_pack, p8_found, p8_composition)}

ORACLES = {"p6_round_trip": "select doc_id, coalesce(text, '') as text from documents"}
