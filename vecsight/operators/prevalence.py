"""Label prevalence.

All prevalences of a table are computed in one aggregation (one pass, partial
aggregation before the shuffle); the per-cluster table and its weighted total
row come from one ``rollup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(agg_row: DataFrame, cols: list[str], label_out: str, value_out: str) -> DataFrame:
    return agg_row.unpivot([], cols, label_out, value_out)


def prevalence_percent(df: DataFrame, label_cols: list[str], label_out: str = "Label",
                       value_out: str = "prevalence_pct") -> DataFrame:
    """100 * rows with value == 1 / all rows (missing values stay in the denominator); NULL
    over no rows."""
    agg = df.agg(*[F.try_divide(F.count_if(F.col(c) == 1) * F.lit(100.0), F.count(F.lit(1))).alias(c)
                   for c in label_cols])
    return _long(agg, label_cols, label_out, value_out)


def prevalence_sum(df: DataFrame, key_cols: list[str], label_out: str = "Label",
                   value_out: str = "prevalence_pct") -> DataFrame:
    """Every non-key column, 100 * sum / rows (a column without values sums to 0)."""
    cols = [c for c in df.columns if c not in key_cols]
    agg = df.agg(*[F.try_divide(F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("double") * F.lit(100.0), F.count(F.lit(1))).alias(c)
                   for c in cols])
    return _long(agg, cols, label_out, value_out)


def cluster_prevalence(rows: DataFrame, label_cols: list[str], cluster_col: str = "cluster",
                       total_name: str = "Weighted_Avg") -> DataFrame:
    """Per cluster the share of rows with value == 1 for every label, the
    cluster size, and a total row.

    The total row is the ``rollup`` grand total, which equals the size-weighted
    mean of the cluster prevalences (sum(p * n) / sum(n)).
    """
    aggs = [(F.count_if(F.col(c) == 1) / F.count(F.lit(1))).alias(c) for c in label_cols]
    g = rows.rollup(cluster_col).agg(*aggs, F.count(F.lit(1)).alias("Total_Samples"),
                                     F.grouping(cluster_col).alias("_total"))
    return g.select(
        F.when(F.col("_total") == 1, F.lit(total_name))
        .otherwise(F.col(cluster_col).cast("string")).alias("Cluster"),
        *label_cols, "Total_Samples")


def column_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of every column (the total row included)."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def size_check(prevalence: DataFrame, library: DataFrame, total_name: str = "Weighted_Avg") -> DataFrame:
    """Clustered rows against library rows (a join may drop or multiply rows)."""
    clustered = prevalence.where(F.col("Cluster") != total_name).select(
        F.col("Total_Samples").cast("long").alias("clustered"), F.lit(0).cast("long").alias("library_rows"))
    lib = library.select(F.lit(0).cast("long").alias("clustered"), F.lit(1).cast("long").alias("library_rows"))
    out = clustered.unionByName(lib).agg(F.sum("clustered").alias("clustered"),
                                         F.sum("library_rows").alias("library_rows"))
    return out.withColumn("equal", F.col("clustered") == F.col("library_rows"))
