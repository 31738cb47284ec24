"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Toxic documents go, of near copies one stays, byte strings that repeat go, sources are mixed to
their weights, and what is left is encoded.  All stages but the last return the columns of
documents.  Every stage gets a written table, so it begins by removing what earlier ones left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsight.llm import bpe, mixing, shingles, suffixes, toxicity
from vecsight.llm.common import forget_tables, small_batches, tables_made
from vecsight.sources.files import scratch_dir


_begun: list[int] = []


def _begin(spark: SparkSession, first: bool = False) -> None:
    """Remove the scratch tables of the stage before (tables of other queries stay); texts go to tasks
    in batches of bounded size."""
    small_batches(spark)
    if _begun and not first:
        forget_tables(spark, _begun[-1])
    _begun[:] = [tables_made()]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    _begin(spark, first=True)
    labels, categories = toxicity.labelled(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.predict(docs, toxicity.fit(docs, labels, categories))
    return judged.where(~F.col("toxic")).select(*[f"`{c}`" for c in docs.columns])


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    _begin(spark)
    return shingles.keep_one(docs, width=5, num=80, den=100)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that start anywhere else."""
    _begin(spark)
    left = suffixes.without_repeats(docs, length=400)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weight of their source takes them."""
    _begin(spark)
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of their decoded bytes."""
    _begin(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # one pass encodes, decodes and digests, so a task holds one vocabulary; the text itself is not kept
    coded = bpe.encode_column(docs.select("doc_id", "lang", "source", F.col("text").alias("ids")), path, public_tokenizers.PATTERN,
                              text="ids", decoded_sha256="decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL cannot express the classifier, the merges of the tokenizer or 400-byte strings of all texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
