"""Derived inputs built from the given tables (see FIXTURES.md, part 2).

Everything here is a lazy DataFrame over the parquet tables, so the work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsight.constants import ALL_MEASURES
from vecsight.operators.ranking import top_k
from vecsight.operators.scoring import score_library
from vecsight.sources.tables import table

ID_COLS = ["subject_id", "study_id", "dicom_id"]


def prompts(spark: SparkSession, sf_dir: str, per_label: int = 4) -> DataFrame:
    """The ``per_label`` vectors with the lowest vec_id of each label."""
    emb = table(spark, sf_dir, "embeddings")
    return (top_k(emb, ["label"], [F.col("vec_id").asc()], per_label, "prompt_id")
            .select("label", F.col("prompt_id").cast("int").alias("prompt_id"), "vec_id",
                    F.col("embedding").alias("qvec")))


def negative_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the prompts of the next label, of the last label those of label 0."""
    p = prompts(spark, sf_dir)
    last = table(spark, sf_dir, "embeddings").agg(F.max("label")).first()[0] or 0
    return p.withColumn("label", ((F.col("label") + last) % (last + 1)).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    rest = emb.join(prompts(spark, sf_dir).select("vec_id"), "vec_id", "left_anti")
    subj = F.floor(F.col("vec_id") / 6).cast("long")
    return rest.select(
        subj.alias("subject_id"),
        F.floor(F.col("vec_id") / 3).cast("long").alias("study_id"),
        F.col("vec_id").alias("dicom_id"),
        "label", "embedding",
        F.when(subj % 10 == 0, "test").when((subj % 10).between(1, 3), "validate")
        .otherwise("train").alias("split"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "subject_id", "study_id", "label", F.lit(1.0).alias("value")).distinct()


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(*ID_COLS, "split")


def label_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("label").distinct()


def scores(spark: SparkSession, sf_dir: str, split: str | None = None,
           measures: tuple = ALL_MEASURES, method: str = "arrow", digits: int = 5,
           prompt_table: DataFrame | None = None) -> DataFrame:
    """``corpus x prompts`` as a long table, rounded to ``digits``."""
    c = corpus(spark, sf_dir)
    if split is not None:
        c = c.where(F.col("split") == split)
    s = score_library(c, prompt_table if prompt_table is not None else prompts(spark, sf_dir),
                      ID_COLS, measures=measures, method=method)
    return s.withColumn("cosine_similarity", F.round("cosine_similarity", digits))
