"""Registered queries of the text-duplicate operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.dart_minhash import near_texts
from monthloom.llm.files import table
from monthloom.llm.substring_dedup import remove_repeats


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_array": op4_suffix_array, "op9_dart_minhash": op9_dart_minhash}
