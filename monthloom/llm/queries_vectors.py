"""Registered queries of the vector operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.files import table
from monthloom.llm.near_vectors import near_vectors
from monthloom.llm.posting_lists import nearest
from monthloom.llm.whitening import whiten


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_near_vectors": op2_near_vectors, "op3_posting_lists": op3_posting_lists,
           "op13_whitening": op13_whitening}
