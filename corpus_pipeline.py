"""The documents table made ready for training: five stages, each on what the one before kept.

Rows are told apart by file and row number, never by id. Of repeated rows (one
id, one text, a null id too) one is left, as of any equal texts; rows of one id
with different texts are different documents in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact_dedup, near_dup, packing, suffix_dedup, toxicity
from cadenza.llm.chunks import added_tokens
from cadenza.llm.common import shared_dir, small_batches, staged

#: SQL can't express the learnt scores, the signatures' classes or the packing.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt on these documents and the labels, doesn't reject."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest id."""
    small_batches(spark)
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one row, that with the smallest id; all rows without an id."""
    small_batches(spark)
    return near_dup.keep_one_of_each_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id has."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=0, capacity=2048, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("suffix dedup", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result but the last is written and reread."""
    docs = small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, shared_dir(spark, f"pipeline-{k}"))
    return docs
