"""Registered queries of the document classifiers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import language, quality, toxicity
from monthloom.llm.files import table

ACCEPT = 0.7


def verdicts(scored: DataFrame, held_out) -> DataFrame:
    """Contract columns of a scored table; a document without a key is never held out."""
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"),
                        toxicity.remainder("doc_id", 3) != 1)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Forest:
    return quality.fit(docs, table(spark, sf_dir, "labels"),
                       toxicity.remainder("doc_id", 4) != 2)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return verdicts(scored, toxicity.remainder("doc_id", 4) == 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return verdicts(scored, toxicity.remainder("doc_id", 3) == 1)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = toxicity.remainder("doc_id", 3)
    found = language.predict(docs, language.fit(docs, rest != 1))
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


QUERIES = {"op1_quality": op1_quality, "op8_toxicity": op8_toxicity,
           "op11_language": op11_language}
