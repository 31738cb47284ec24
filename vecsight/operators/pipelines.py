"""Model comparison and model grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsight.constants import LABEL_DISPLAY, POOLING_DISPLAY, SKIPPED_POOLING
from vecsight.functions.text import run_name_parts
from vecsight.operators.reshape import union_with_key


def run_display_name(col) -> F.Column:
    """``model_run_3_True_ig_tg`` -> ``True, IG_TG`` (other names are kept)."""
    c = F.col(col) if isinstance(col, str) else col
    _, flag, img, txt = run_name_parts(c)
    parsed = F.concat(F.when(flag, "True").otherwise("False"), F.lit(", "), F.upper(img), F.lit("_"),
                      F.upper(txt))
    return F.when(F.regexp_extract(c, r"^model_run_\d+_", 0) != "", parsed).otherwise(c)


def comparison_view(long: DataFrame, label_col: str = "Label") -> DataFrame:
    """L4 on (Model, label, Pooling Method, Accuracy): B13 skip pooling methods, B11 label display,
    B12 pooling display names, D22 global min / max of the accuracy.

    The comparison table has one row per model, label and method; its min / max use one
    window over it.
    """
    kept = long.where(~F.col("Pooling Method").isin(*SKIPPED_POOLING))
    pooling = F.col("Pooling Method")
    disp = None
    for k, v in POOLING_DISPLAY.items():
        disp = F.when(pooling == k, v) if disp is None else disp.when(pooling == k, v)
    label = F.col(label_col).cast("string")
    for k, v in LABEL_DISPLAY.items():
        label = F.when(label == k, v).otherwise(label)
    out = kept.select(run_display_name("Model").alias("Model"), label.alias(label_col),
                      disp.otherwise(pooling).alias("Pooling"), F.col("Accuracy").cast("double").alias("Accuracy"))
    everything = Window.partitionBy()
    return out.withColumn("y_min", F.min("Accuracy").over(everything)) \
        .withColumn("y_max", F.max("Accuracy").over(everything))


def compare_models(accuracy_tables: dict[str, DataFrame], label_col: str = "Label") -> DataFrame:
    """L3 + L4: wide accuracy tables of several models -> one long comparison table (H2 concat with
    a model key, E2 melt, then ``comparison_view``)."""
    wide = union_with_key(accuracy_tables, "Model")
    value_cols = [c for c in wide.columns if c not in ("Model", label_col)]
    return comparison_view(wide.unpivot(["Model", label_col], value_cols, "Pooling Method", "Accuracy"), label_col)
