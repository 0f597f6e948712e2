"""Registered queries of the token operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.byte_pairs import decode, encode
from monthloom.llm.files import table
from monthloom.llm.packing import pack
from monthloom.llm.token_store import TokenStore


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                with_ids=False)


def op7_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = TokenStore(spark, docs, tokenizer_file("byte_bpe_50k.json"))
    return store.get(docs, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op5_packing": op5_packing, "op7_byte_pairs": op7_byte_pairs,
           "op10_token_store": op10_token_store}
