"""Reshaping."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_column(label, measure, sep: str = " ") -> str:
    return f"{label}{sep}{measure}"


def scores_to_wide(long: DataFrame, id_cols: list[str], labels: list, measures: list[str],
                   sep: str = " ") -> DataFrame:
    """Long scores -> one column ``"{label} {measure}"`` per pair (the reference's file layout)."""
    names = [score_column(lab, m, sep) for lab in labels for m in measures]
    keyed = long.withColumn("_name", F.concat(F.col("label").cast("string"), F.lit(sep),
                                              F.col("embedding_type")))
    return keyed.groupBy(*id_cols).pivot("_name", names).agg(F.first("cosine_similarity"))


def unpivot_scores(wide: DataFrame, id_cols: list[str], labels: list, measures: list[str],
                   on_missing: str = "error", sep: str = " ") -> DataFrame:
    """E1 (+B10, B16, B17, B19): wide score columns -> long (ids, cosine_similarity, label, embedding_type).

    Label and measure come from the known lists, never from splitting the name
    (labels may contain spaces).  A missing column raises (``error``) or is
    skipped with a warning (``skip``).  Non-numeric values become NULL, NaN too.
    """
    if on_missing not in ("error", "skip"):
        raise ValueError("on_missing must be 'error' or 'skip'")
    present = set(wide.columns)
    pairs, missing = [], []
    for lab in labels:
        for m in measures:
            name = score_column(lab, m, sep)
            if name in present:
                pairs.append((name, lab, m))
            elif on_missing == "error":
                raise ValueError(f"the score table has no column {name!r}")
            else:
                missing.append(name)
    if missing:
        warnings.warn(f"{len(missing)} score columns do not exist and are skipped: {missing[:5]}",
                      stacklevel=2)
    if not pairs:
        raise ValueError("no score column found")
    text = {f.name for f in wide.schema.fields if f.dataType.typeName() == "string"}
    cols = [(F.col(f"`{n}`").try_cast("double") if n in text else F.col(f"`{n}`").cast("double")).alias(n)
            for n, _, _ in pairs]
    lookup = F.create_map(*[x for n, lab, m in pairs
                            for x in (F.lit(n), F.struct(F.lit(lab).alias("label"),
                                                         F.lit(m).alias("embedding_type")))])
    long = wide.select(*id_cols, *cols).unpivot(id_cols, [n for n, _, _ in pairs], "_name", "_value")
    v = F.col("_value")
    return long.select(
        *id_cols,
        F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v).alias("cosine_similarity"),
        F.element_at(lookup, F.col("_name")).alias("_k")).select(
        *id_cols, "cosine_similarity", "_k.label", "_k.embedding_type")


def accuracy_wide(long: DataFrame, value_col: str = "precision",
                  name_parts=("embedding_type", "pool"), suffix: str = "_accuracy",
                  names: list[str] | None = None, label_out: str = "Label") -> DataFrame:
    """One row per label, one column per ``{measure}_{pool}_accuracy``."""
    name = F.concat_ws("_", *[F.col(c).cast("string") for c in name_parts])
    keyed = long.withColumn("_name", F.concat(name, F.lit(suffix)))
    g = keyed.groupBy(F.col("label").alias(label_out))
    return (g.pivot("_name", names) if names else g.pivot("_name")).agg(F.first(value_col))


def scores_struct(long: DataFrame, id_cols: list[str], labels: list, measures: list[str]) -> DataFrame:
    """Two-level header as one struct column per label with one field per measure."""
    per_label = (long.groupBy(*id_cols, "label").pivot("embedding_type", list(measures))
                 .agg(F.first("cosine_similarity")))
    packed = per_label.select(*id_cols, "label",
                              F.struct(*[F.col(f"`{m}`") for m in measures]).alias("_s"))
    return (packed.groupBy(*id_cols).pivot("label", list(labels)).agg(F.first("_s")))


def nested_to_wide(nested: DataFrame, id_cols: list[str], labels: list, measures: list[str], sep: str = " ",
                   digits: int | None = None) -> DataFrame:
    """Rows of ``score_nested`` -> one column ``"{label} {measure}"`` per pair; no shuffle."""
    value = lambda lab, m: F.col(f"`{lab}`")[m] if digits is None else F.round(F.col(f"`{lab}`")[m], digits)
    return nested.select(*id_cols, *[value(lab, m).alias(score_column(lab, m, sep)) for lab in labels for m in measures])


def nested_rows(nested: DataFrame, id_cols: list[str], labels: list, measures: list[str], label_type="string") -> DataFrame:
    """E6 flattened: one row per image and label with a column per measure; no shuffle."""
    rows = F.array(*[F.struct(F.lit(lab).cast(label_type).alias("label"), F.col(f"`{lab}`").alias("s")) for lab in labels])
    return nested.select(*id_cols, F.inline(rows)).select(*id_cols, "label", *[F.col("s")[m].alias(m) for m in measures])


def union_with_key(frames: dict[str, DataFrame], key: str = "model") -> DataFrame:
    """H1/H2: vertical concat that remembers where each row came from."""
    parts = [df.withColumn(key, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack_columns(df: DataFrame, id_cols: list[str], value_cols: list[str],
                  kind_col: str = "kind", value_col: str = "obj_id") -> DataFrame:
    """Several id columns stacked into one (unpivot)."""
    return df.unpivot(id_cols, value_cols, kind_col, value_col)
