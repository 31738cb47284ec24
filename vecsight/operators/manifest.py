"""Second data set assembly: manifest, queue, ledger, pairing, one-hot labels
(A7, A8, A12, C1, C5-C8, C10, C11, D21, D23, E3, E7, H4, I8, I24, W1).

Every per-series rule is a ``groupBy`` aggregate (partial aggregation before the
shuffle, so a hot series never lands whole in one task) plus equi-joins on the
series key; AQE splits skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsight.functions.text import uid_matches


def _once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs exactly once: one aggregate holds the count and the row."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    return one.where(F.col("_n") == 1).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def manifest(ann: DataFrame, img: DataFrame, key: str = "series_uid") -> DataFrame:
    """C1 + W1: inner join on the series, dropping *every* row of a series that repeats.

    A series appears exactly once in the join iff it has exactly one annotation row
    and one image row, so both sides are reduced to such series first and the join
    is then one-to-one: a hot series never fans out into a many-to-many product.
    """
    return _once(ann, key).join(_once(img, key), key, "inner")


def queue(manifest_df: DataFrame, key: str = "series_uid",
          id_cols=("ann_id", "im_id")) -> DataFrame:
    """H4: annotation ids and image ids stacked into one download queue."""
    return manifest_df.select(key, *id_cols).unpivot([key], list(id_cols), "kind", "obj_id")


def resume(queue_df: DataFrame, ledger: DataFrame, id_col: str = "obj_id") -> DataFrame:
    """C11: what is left of the queue after the done / failed ledger."""
    return queue_df.join(ledger.select(id_col), id_col, "left_anti")


def uid_of(name_col: str = "fname") -> F.Column:
    """I8: the single uid of an annotation name, NULL unless exactly one match."""
    m = uid_matches(name_col)
    return F.when(F.size(m) == 1, F.element_at(m, 1))


def file_checks(files: DataFrame, key: str = "series_uid", name_col: str = "fname",
                suffix: str = ".dcm") -> DataFrame:
    """B15 + C8 + D23: per series, do all names end with the suffix, and is there exactly
    one annotation among them."""
    return files.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.bool_and(F.col(name_col).endswith(suffix)).alias("all_suffix"),
        F.count_if(F.size(uid_matches(name_col)) == 1).alias("n_annotations"),
    ).withColumn("ok", F.col("all_suffix") & (F.col("n_annotations") == 1))


def series_listing(files: DataFrame, key: str = "series_uid", name_col: str = "fname",
                   path_col: str = "fpath") -> DataFrame:
    """Per series its files in name order, as numbered rows (from 0)."""
    w = Window.partitionBy(key).orderBy(name_col, path_col)
    return files.select(key, (F.row_number().over(w) - 1).alias("position"), name_col, path_col)


def report_missing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows aligned with files by key, and which keys have no file or no row (``missing``)."""
    left = rows.select(F.col(key).alias("_k")).distinct().withColumn("_row", F.lit(True))
    right = files.select(F.col(key).alias("_f")).distinct().withColumn("_file", F.lit(True))
    both = left.join(right, F.col("_k").eqNullSafe(F.col("_f")), "full")
    return both.where(F.col("_row").isNull() | F.col("_file").isNull()).select(
        F.coalesce("_k", "_f").alias(key), F.when(F.col("_file").isNull(), "file").otherwise("row").alias("missing"))


def pair_files(files: DataFrame, key: str = "series_uid", name_col: str = "fname",
               path_col: str = "fpath", file_uid_col: str = "sop_uid",
               annotation_names: DataFrame | None = None) -> DataFrame:
    """Pair each series' annotation with its image, by tiers.

    The annotation is the file whose name is in ``annotation_names`` (a table with the column
    ``name_col``); without that table, the one whose name holds exactly one uid.

    1. a file whose path contains the annotation uid;
    2. else, if the series has exactly two files, the other one;
    3. else a file whose own uid equals the annotation uid.
    The annotation itself is never a candidate.  Exactly one file must be found
    at the best tier; otherwise the series is rejected (fpath NULL, reason set).
    """
    f = files.withColumn("_uid", uid_of(name_col))
    if annotation_names is None:
        f = f.withColumn("_ann", F.col("_uid").isNotNull())
    else:
        names = annotation_names.select(name_col).distinct().withColumn("_ann", F.lit(True))
        f = f.join(names, name_col, "left").withColumn("_ann", F.coalesce("_ann", F.lit(False)))
    stats = f.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n_files"),
        F.count_if(F.col("_ann")).alias("_n_ann"),
        F.max(F.when(F.col("_ann"), F.col("_uid"))).alias("image_uid"))
    cands = f.where(~F.col("_ann")).join(stats, key, "right")
    tier = (F.when(F.col(path_col).contains(F.col("image_uid")), 1)
            .when(F.col("_n_files") == 2, 2)
            .when(F.col(file_uid_col) == F.col("image_uid"), 3))
    t = cands.withColumn("_tier", F.when(F.col("_n_ann") == 1, tier))
    g = t.groupBy(key).agg(
        F.first("image_uid").alias("image_uid"),
        F.first("_n_ann").alias("_n_ann"),
        F.min("_tier").alias("tier"),
        F.count_if(F.col("_tier") == 1).alias("_c1"),
        F.count_if(F.col("_tier") == 2).alias("_c2"),
        F.count_if(F.col("_tier") == 3).alias("_c3"),
        F.min_by(path_col, F.coalesce(F.col("_tier"), F.lit(99))).alias("_best"))
    n_best = F.when(F.col("tier") == 1, F.col("_c1")).when(F.col("tier") == 2, F.col("_c2")) \
        .when(F.col("tier") == 3, F.col("_c3")).otherwise(F.lit(0))
    reason = (F.when(F.col("_n_ann") != 1, "annotation count")
              .when(F.col("image_uid").isNull(), "annotation name")
              .when(F.col("tier").isNull(), "no candidate")
              .when(n_best != 1, "ambiguous"))
    return g.select(key, "image_uid",
                    F.when(reason.isNull(), F.col("_best")).alias(path_col),
                    F.when(reason.isNull(), F.col("tier")).alias("tier"),
                    reason.alias("reject_reason"))


def one_hot(pairs: DataFrame, index_cols: list[str], label_col: str, labels: list,
            fill: int = 0) -> DataFrame:
    """E3 + D21: (index, label) rows -> one 0/1 int column per label, missing -> 0."""
    d = pairs.select(*index_cols, label_col).dropDuplicates()
    wide = d.groupBy(*index_cols).pivot(label_col, labels).agg(F.max(F.lit(1)))
    return wide.select(*index_cols, *[F.coalesce(F.col(f"`{lab}`"), F.lit(fill)).cast("int").alias(str(lab))
                                      for lab in labels])


def explode_labels(df: DataFrame, index_cols: list[str], labels_col: str = "labels",
                   out_col: str = "label") -> DataFrame:
    """One row per (file, segment label)."""
    return df.select(*index_cols, F.explode(labels_col).alias(out_col))


def distinct_values(df: DataFrame, col: str) -> list:
    """Distinct values of a column that become column names of a pivot, missing ones left out; Spark
    itself limits a pivot by ``spark.sql.pivotMaxValues`` (a plan with more columns is no plan)."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    vals = df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    if len(vals) > limit:
        raise ValueError(f"{col} has more values than spark.sql.pivotMaxValues ({limit}); use the long form")
    return sorted(r[0] for r in vals)
