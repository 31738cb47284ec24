"""Retrieval evaluation.

Inputs are long tables:
  scores    (key columns, label, embedding_type, cosine_similarity)
  truth     (subject_id?, study_id, label, value)   value == 1 is positive
Outputs are long tables (label, embedding_type, [pool], [top_k], value); the
wide accuracy table of the reference is ``reshape.accuracy_wide``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.operators.ranking import first_n, order_desc, slot_counts, top_k, with_slots
from vecsight.sources.files import written


def keep_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """B1."""
    return df.where(F.col(split_col) == F.lit(split))


def keep_splits(df: DataFrame, splits, split_col: str = "split") -> DataFrame:
    """B2."""
    return df.where(F.col(split_col).isin(*splits))


def labels_in_split(truth: DataFrame, split_table: DataFrame, split: str,
                    key: str = "study_id") -> DataFrame:
    """Label rows of the studies that occur in the split (distinct ids, then membership)."""
    ids = keep_split(split_table, split).select(key).distinct()
    return truth.join(ids, key, "left_semi")


def positives(truth: DataFrame, key: str = "study_id", label_col: str = "label",
              value_col: str = "value", value: float = 1) -> DataFrame:
    """Distinct (label, key) with the value (1: present, 0: absent; missing is neither)."""
    return truth.where(F.col(value_col) == value).select(label_col, key).distinct()


def positive_counts(truth: DataFrame, all_labels: DataFrame, key: str = "study_id",
                    label_col: str = "label", value_col: str = "value") -> DataFrame:
    """Distinct positive ids per label; labels without positives get 0."""
    n = (truth.where(F.col(value_col) == 1).groupBy(label_col)
         .agg(F.countDistinct(key).alias("n")))
    return (all_labels.select(label_col).distinct()
            .join(n, label_col, "left")
            .select(label_col, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def pool_scores(scores: DataFrame, method: str, key: str = "study_id",
                score_col: str = "cosine_similarity") -> DataFrame:
    """Pool image scores to the study (missing scores are skipped)."""
    if method == "max":
        agg = F.max(score_col)
    elif method == "mean":
        agg = F.avg(score_col)
    else:
        raise ValueError(f"pool by max or mean, not {method!r}")
    return scores.groupBy(key, "label", "embedding_type").agg(agg.alias(score_col))


def pool_both(scores: DataFrame, key: str = "study_id", score_col: str = "cosine_similarity",
              digits: int | None = None) -> DataFrame:
    """Max and mean pooling in one aggregation, long over a ``pool`` column; ``digits`` rounds
    the pooled scores, which makes ties of scores that differ less."""
    g = scores.groupBy(key, "label", "embedding_type").agg(
        F.max(score_col).alias("max"), F.avg(score_col).alias("mean"))
    out = g.select(key, "label", "embedding_type",
                   F.inline(F.array(F.struct(F.lit("max").alias("pool"), F.col("max").alias(score_col)),
                                    F.struct(F.lit("mean").alias("pool"), F.col("mean").alias(score_col)))))
    if digits is not None:
        out = out.withColumn(score_col, F.round(score_col, digits))
    return out


def study_mean_wide(scores_wide: DataFrame, value_cols: list[str], key: str = "study_id") -> DataFrame:
    """Per-study mean of several wide score columns."""
    return scores_wide.groupBy(key).agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in value_cols])


def _flag_hits(pooled: DataFrame, pos: DataFrame, key: str) -> DataFrame:
    return pooled.join(pos.withColumn("_hit", F.lit(1)), ["label", key], "left") \
        .withColumn("_hit", F.coalesce(F.col("_hit"), F.lit(0)))


def precision_at_n(pooled: DataFrame, pos: DataFrame, n_counts: DataFrame,
                   key: str = "study_id", group_cols=("label", "embedding_type"),
                   score_col: str = "cosine_similarity", scale: float = 1.0,
                   skip_empty: bool = False) -> DataFrame:
    """Hits among the first n (n = positives of the label) divided by n.

    Ties go to the smaller key.  One aggregate counts rows and hits per group and score
    slot; the slots above the n-th row count as a whole and only rows of the slot it
    falls into are ranked, a bounded number of them (see ``ranking.first_n``), whatever n is.
    The flagged scores are written once, so that they are computed once.  Labels missing
    from ``n_counts`` are dropped; n = 0 gives NULL (0/0), or the row is dropped with
    ``skip_empty``.
    """
    group_cols = list(group_cols)
    rows = written(with_slots(_flag_hits(pooled, pos, key), score_col), "ranked")
    slots = written(slot_counts(rows, group_cols, n_counts, hit_col="_hit"), "slots")
    whole = slots.groupBy(*group_cols).agg(
        F.max("n").alias("n"), F.sum(F.when(F.col("_upto") <= F.col("n"), F.col("_slot_hits"))).alias("hits"))
    part = first_n(rows, slots, group_cols, score_col, key, edge_only=True).groupBy(*group_cols).agg(F.sum("_hit").alias("hits"))
    both = whole.unionByName(part.withColumn("n", F.lit(None).cast("long")))
    out = both.groupBy(*group_cols).agg(F.max("n").alias("n"), F.sum("hits").alias("hits"))
    out = out.where(F.col("n").isNotNull()).select(
        *group_cols, F.col("n"),
        (F.try_divide(F.coalesce(F.col("hits"), F.lit(0)).cast("double"), F.col("n").cast("double"))
         * F.lit(scale)).alias("precision"))
    if skip_empty:
        out = out.where(F.col("n") > 0)
    return out


def precision_at_k(pooled: DataFrame, pos: DataFrame, ks, key: str = "study_id",
                   group_cols=("label", "embedding_type"), score_col: str = "cosine_similarity",
                   scale: float = 1.0) -> DataFrame:
    """Hits among the first k divided by k (even if fewer rows exist).

    One ``WindowGroupLimit`` with the largest k serves every k, and every group has a first
    row, so the hits need no second look at the scores for the list of groups.
    """
    group_cols = list(group_cols)
    ks = sorted({int(k) for k in ks})
    flagged = _flag_hits(pooled, pos, key)
    ranked = top_k(flagged, group_cols, order_desc(score_col, key), ks[-1])
    per_k = ranked.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return per_k.groupBy(*group_cols, "top_k").agg(
        (F.sum(F.when(F.col("rank") <= F.col("top_k"), F.col("_hit")).otherwise(0)).cast("double")
         / F.col("top_k") * F.lit(scale)).alias("precision"))


def top_n_overlap(scored: DataFrame, pos: DataFrame, n_counts: DataFrame,
                  key: str = "study_id", tie_col: str | None = None,
                  score_col: str = "cosine_similarity") -> DataFrame:
    """D19 (with G3, H5, H6): 100 * |truth & top-n| / |truth | top-n| per label, 0 if empty.

    The first n rows of ``scored`` (n = positives of the label, ties to the smaller
    ``tie_col``) give a set of ``key`` values that is compared with the positives.
    """
    rows = written(with_slots(scored, score_col), "ranked")
    first = first_n(rows, written(slot_counts(rows, ["label"], n_counts), "slots"), ["label"], score_col, tie_col or key)
    top = first.select("label", key).distinct().withColumn("_top", F.lit(1))
    both = top.join(pos.select("label", key).withColumn("_pos", F.lit(1)), ["label", key], "full")
    agg = both.groupBy("label").agg(
        F.count_if(F.col("_top").isNotNull() & F.col("_pos").isNotNull()).alias("inter"),
        F.count(F.lit(1)).alias("uni"))
    return n_counts.select("label").join(agg, "label", "left").select(
        "label",
        F.coalesce(F.col("inter"), F.lit(0)).cast("long").alias("intersection"),
        F.coalesce(F.col("uni"), F.lit(0)).cast("long").alias("union_size"),
        F.coalesce(F.try_divide(F.col("inter") * F.lit(100.0), F.col("uni").cast("double")),
                   F.lit(0.0)).alias("overlap_pct"))


def pct_above(scores: DataFrame, threshold: float, group_cols=("label",),
              score_col: str = "cosine_similarity") -> DataFrame:
    """100 * rows with score > t / all rows (missing scores stay in the denominator)."""
    return scores.groupBy(*group_cols).agg(
        F.try_divide(F.count_if(F.col(score_col) > F.lit(threshold)) * F.lit(100.0), F.count(F.lit(1)))
        .alias("pct_above"))
