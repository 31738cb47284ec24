"""Ranking inside groups.

* ``top_k`` - literal k: ``row_number() <= k`` which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle, so each task keeps k rows per group.
* ``first_n`` - the first n rows of every group, n of any size (precision at n, n =
  positives of the label, can be a large part of the table).  Scores fall into a fixed
  number of slots; one aggregate counts the rows per group and
  slot, a running sum over the slots finds the one that holds the n-th row.  While that slot
  holds more than ``RANKED_AT_ONCE`` rows of a group, it is counted again in finer slots: by
  score between its least and its largest, and where all its scores are equal or missing, by
  ranges of the tie id.  Only the rest is ranked, so that no task ranks more rows than that,
  however many scores of a group are equal; rows equal in score and tie id alone cannot be
  told apart and stay together.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.sources.files import written

#: The most rows of a group that are ranked by a window.
RANKED_AT_ONCE = 100_000


def order_desc(score_col: str, tie_col: str) -> list[Column]:
    """Score descending, missing last, ties to the smaller id."""
    return [F.col(score_col).desc_nulls_last(), F.col(tie_col).asc_nulls_last()]


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= F.lit(int(k)))


SLOTS = 1 << 16


def with_slots(df: DataFrame, score_col: str) -> DataFrame:
    """``df`` with ``_slot``, which rises as scores fall: 0 holds the best, ``SLOTS`` the missing ones.
    The arc tangent puts scores of any size into a fixed range without a look at the others."""
    x = F.col(score_col).cast("double")
    slot = F.floor((F.lit(0.5) - F.atan(x) / F.lit(math.pi)) * SLOTS)
    return df.withColumn("_slot", F.when(x.isNull() | F.isnan(x), SLOTS).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), slot))).cast("int"))


def _same(columns: list[str]) -> Column:
    return reduce(and_, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns))


def slot_counts(rows: DataFrame, group_cols: list[str], n_counts: DataFrame, label_col: str = "label",
                hit_col: str | None = None) -> DataFrame:
    """Per group and slot: ``n`` of its label, ``_before`` and ``_upto`` (rows before the slot and up to
    its end) and ``_slot_hits``.  Labels that ``n_counts`` lacks have no rows."""
    hits = F.sum(hit_col) if hit_col else F.count(F.lit(1))
    counts = rows.groupBy(*group_cols, "_slot").agg(F.count(F.lit(1)).alias("_rows"), hits.alias("_slot_hits"))
    w = Window.partitionBy(*group_cols).orderBy("_slot")
    known = n_counts.select(F.col(label_col).alias("_l"), "n")
    return (counts.join(known, F.col(label_col).eqNullSafe(F.col("_l"))).drop("_l")
            .withColumn("_upto", F.sum("_rows").over(w)).withColumn("_before", F.col("_upto") - F.col("_rows")).drop("_rows"))


def _finer(edge: DataFrame, group_cols: list[str], score_col: str, tie_col: str) -> DataFrame:
    """``edge`` (one slot of every group) with ``_slot`` anew: by score from the largest to the least of
    the group's rows, NaN and missing ones last, or by tie id if the scores do not differ."""
    x, t = F.col(score_col).cast("double"), F.col(tie_col)
    number = F.when(~F.isnan(x), x)
    text = isinstance(edge.schema[tie_col].dataType, (T.StringType, T.CharType, T.VarcharType))
    key = t if text else t.cast("decimal(38,9)")
    stats = edge.groupBy(*group_cols).agg(
        F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count(number).alias("_numbers"),
        F.count_if(F.isnan(x)).alias("_nans"), F.count(F.lit(1)).alias("_all"), F.min(key).alias("_tlo"), F.max(key).alias("_thi"))
    if text:  # the first character in which the ids differ
        stats = stats.withColumn("_same", F.expr(
            "aggregate(sequence(1, greatest(1, least(length(_tlo), length(_thi)))), 0, "
            "(n, i) -> if(n = i - 1 and substring(_tlo, 1, i) = substring(_thi, 1, i), i, n))"))
        by_tie = F.ascii(F.substring(t, F.coalesce("_same", F.lit(0)) + 1, F.lit(1)))
        last = 0x110000
    else:
        place = F.try_divide((key - F.col("_tlo")) * F.lit(SLOTS), F.col("_thi") - F.col("_tlo"))
        by_tie = F.least(F.lit(SLOTS - 1), F.floor(F.coalesce(place, F.lit(0))).cast("int"))
        last = SLOTS
    part = F.try_divide(F.col("_hi") / 2 - x / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    by_score = F.when(x.isNull(), SLOTS + 1).when(F.isnan(x), SLOTS).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), F.floor(F.coalesce(F.nanvl(part, F.lit(0.0)), F.lit(0.0)) * SLOTS))))
    alike = ((F.col("_numbers") == 0) | (F.col("_lo") == F.col("_hi"))) & (
        (F.col("_numbers") == F.col("_all")) | (F.col("_nans") == F.col("_all")) | (F.col("_numbers") + F.col("_nans") == 0))
    finer = F.when(alike, F.when(t.isNull(), last).otherwise(by_tie)).otherwise(by_score).cast("int")
    joined = edge.drop("_slot").alias("l").join(stats.alias("r"), _same(group_cols))
    return joined.withColumn("_finer", finer).select("l.*", F.col("_finer").alias("_slot"))


def _narrowed(edge: DataFrame, group_cols: list[str], score_col: str, tie_col: str, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Of ``edge`` (rows of one slot of every group, of which the first ``_left`` are wanted) the rows
    that have to be ranked, at most ``most`` of a group, and those found to be wanted on the way."""
    sure: list[DataFrame] = []
    before = None
    while True:
        size = edge.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0
        if size <= most or size == before:  # what is left can't be told apart
            return edge, sure
        before = size
        rows = written(_finer(edge, group_cols, score_col, tie_col), "edge")
        w = Window.partitionBy(*group_cols).orderBy("_slot")
        counts = rows.groupBy(*group_cols, "_slot").agg(F.count(F.lit(1)).alias("_rows"), F.first("_left").alias("_want"))
        marks = counts.withColumn("_upto", F.sum("_rows").over(w)).withColumn("_before", F.col("_upto") - F.col("_rows"))
        marks = written(marks.where(F.col("_before") < F.col("_want")), "marks")
        joined = rows.drop("_left").alias("l").join(marks.alias("r"), _same([*group_cols, "_slot"])).select(
            "l.*", (F.col("r._want") - F.col("r._before")).alias("_left"), (F.col("r._upto") <= F.col("r._want")).alias("_all_in"))
        sure.append(joined.where("_all_in").drop("_slot", "_left", "_all_in"))
        edge = written(joined.where("not _all_in").drop("_all_in"), "edge")


def first_n(rows: DataFrame, slots: DataFrame, group_cols: list[str], score_col: str, tie_col: str,
            edge_only: bool = False, most: int = RANKED_AT_ONCE) -> DataFrame:
    """The first n rows of every group (ties to the smaller ``tie_col``), from rows with slots and
    their ``slot_counts``; with ``edge_only`` those of the slot that n falls into.

    Rows of slots that belong to the first n as a whole need no rank.  Both tables are read more
    than once: pass written ones.  No group has more than ``most`` rows ranked by one task."""
    marks = slots.where(F.col("_before") < F.col("n")).select(
        *group_cols, "_slot", (F.col("n") - F.col("_before")).alias("_left"), (F.col("_upto") <= F.col("n")).alias("_whole"),
        (F.col("_upto") - F.col("_before")).alias("_size"))
    joined = rows.alias("l").join(marks.alias("r"), _same([*group_cols, "_slot"])).select("l.*", "r._left", "r._whole")
    edge = joined.where(~F.col("_whole")).drop("_whole")
    parts: list[DataFrame] = [] if edge_only else [joined.where("_whole").drop("_slot", "_left", "_whole")]
    if (marks.where(~F.col("_whole")).agg(F.max("_size")).first()[0] or 0) > most:
        edge, sure = _narrowed(edge, group_cols, score_col, tie_col, most)
        parts += sure
    w = Window.partitionBy(*group_cols).orderBy(*order_desc(score_col, tie_col))
    ranked = edge.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= F.col("_left")).drop("_slot", "_left", "_place")
    return reduce(DataFrame.unionByName, parts, ranked)
