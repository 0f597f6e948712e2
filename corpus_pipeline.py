"""Training sequences from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read
again as the next one's documents, so a stage first deletes the intermediate tables of the one
before it: write a stage's result before calling another. All but the last return the columns of
their input. Rows with
null or repeated keys, null or empty texts and extra columns pass through like any others; an
empty table stays empty.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm import quality, toxicity
from monthloom.llm.dart_minhash import near_texts
from monthloom.llm.packing import pack
from monthloom.llm.queries_classifiers import ACCEPT, quality_model, toxicity_model
from monthloom.llm.queries_tokens import tokenizer_file
from monthloom.llm.substring_dedup import remove_repeats
from monthloom.shipping import ship_package
from monthloom.staging import free, stage, staged_paths

#: SQL cannot express the trained classifiers; the tests compare with a brute-force version.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_held: dict[str, list[str]] = {}  # per application, what the latest stage has staged


def _frees_the_one_before(step: Stage) -> Stage:
    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        free(spark, _held.pop(app, []))
        with staged_paths() as paths:
            out = step(spark, docs, sf_dir)
        _held[app] = paths
        return out

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """Key, text and the whole row as one column, so that no extra column can clash with ours."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns])
                       .alias("__row"))


@_frees_the_one_before
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not score as toxic."""
    model = toxicity_model(spark, docs, sf_dir)
    return (toxicity.score(_packed(docs), model, keep=("__row",))
            .filter(F.col("score") < ACCEPT).select("__row.*"))


@_frees_the_one_before
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model(spark, docs, sf_dir)
    return (quality.score(_packed(docs), model, keep=("__row",))
            .filter(F.col("score") >= ACCEPT).select("__row.*"))


@_frees_the_one_before
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest key, a null key last.

    Rows are told apart by a number that the scan gives them, the same in every run; so of rows
    with one key only near copies of each other are dropped."""
    numbered = docs.select(F.monotonically_increasing_id().alias("__id"), "doc_id", "text",
                           F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    classes = stage(near_texts(numbered, key="__id").select("doc_id", "class_id"), "near-classes")
    order = F.struct(F.col("key").isNull(), "key", "id")
    first = (
        numbered.select(F.col("__id").alias("id"), F.col("doc_id").alias("key"))
        .join(classes.withColumnRenamed("doc_id", "id"), "id")
        .groupBy("class_id").agg(F.min(order).alias("first"))
        .select(F.col("first.id").alias("__id"))
    )
    return numbered.join(first, "__id", "left_semi").select("__row.*")


@_frees_the_one_before
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat; ``n_chars`` follows the text."""
    # The text travels once: beside the other columns, not among them as well.
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text",
                       F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"))
    left = remove_repeats(rows, keep=("__row",), as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


@_frees_the_one_before
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 4096 tokens."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeats), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each reads what the one before has written."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
