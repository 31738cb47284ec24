"""Contrastive alignment metrics over stored vectors.

InfoNCE of a first set against a second set, both grouped into pairs b:
  logit((b, i), b') = mean_j ( f(b,i) . s(b',j) ) / T        (all vectors unit length)
  loss = mean over first items (b, i) of [ logsumexp_b' logit - logit((b, i), b) ]
The dot product is linear, so mean_j is taken on the second set's vectors first:
one mean vector per pair (a grouped aggregate).  Logits are only formed inside a
contrastive batch (``batch_col``; a missing batch is a batch of its own, none means one
batch).  Items and pair means are dealt into blocks of bounded size, every pair of
blocks of a batch is one small matrix product that leaves one log-sum-exp and, if the
item's own pair is among them, its own logit per item; an aggregate adds these up.  So
no task holds a batch, and one path serves batches of any size.  Items whose pair the
second set lacks have no loss (NULL).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.functions.vectors import l2_normalize
from vecsight.operators.scoring import mean_vector


def _prep(df: DataFrame, pair_col: str, vec_col: str, batch_col: str | None) -> DataFrame:
    b = F.coalesce(F.concat(F.lit("b"), F.col(batch_col).cast("string")), F.lit("-")) if batch_col else F.lit("-")
    return df.select(b.alias("_batch"), F.col(pair_col).alias("_pair"), l2_normalize(vec_col).alias("_v"),
                     *([F.col(batch_col).alias("_own")] if batch_col else []))


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks per batch."""
    return df.groupBy("_batch").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))


def info_nce_items(first: DataFrame, second: DataFrame, temperature: float = 1.0,
                   pair_col: str = "pair", vec_col: str = "vec", batch_col: str | None = None,
                   item_block: int = 4096, pair_block: int = 1024) -> DataFrame:
    """Per first-set item: (batch, pair, loss)."""
    own = ["_own"] if batch_col else []
    f = (_prep(first, pair_col, vec_col, batch_col).groupBy("_batch", *own, "_pair", "_v")
         .agg(F.count(F.lit(1)).alias("_copies"))  # equal items have equal losses: one of them is scored
         .withColumns({"_item": F.xxhash64("_v"), "_pair_text": F.col("_pair").cast("string")}))
    means = mean_vector(_prep(second, pair_col, vec_col, batch_col), ["_batch", "_pair"], "_v", "_m")
    sizes = _blocks(f, item_block, "_ni").join(_blocks(means, pair_block, "_np"), "_batch")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    names = ["_batch", *own, "_pair", "_item", "_copies"]
    items = f.join(sizes, "_batch").select(*names, "_pair_text", "_v", F.pmod("_item", "_ni").alias("_ib"), each("_np").alias("_pb"))
    pairs = means.join(sizes, "_batch").select(
        "_batch", F.col("_pair").cast("string").alias("_pair_text"), "_m", each("_ni").alias("_ib"),
        F.pmod(F.xxhash64("_pair"), F.col("_np")).alias("_pb"))
    t = float(temperature)
    schema = T.StructType([*[items.schema[n] for n in names], T.StructField("_lse", T.DoubleType()),
                           T.StructField("_logit", T.DoubleType())])

    def block(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = some[names].copy()
        if not len(some) or not len(others):
            return out.assign(_lse=None, _logit=None)
        logits = np.stack(some["_v"].to_numpy()) @ np.stack(others["_m"].to_numpy()).T / t
        top = logits.max(axis=1, keepdims=True)
        place = {p: k for k, p in enumerate(others["_pair_text"])}
        at = np.array([place.get(p, -1) for p in some["_pair_text"]])
        out["_lse"] = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
        out["_logit"] = pd.Series(logits[np.arange(len(at)), at], index=out.index).where(at >= 0, None)
        return out

    keys = ("_batch", "_ib", "_pb")
    parts = items.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInPandas(block, schema)
    known = F.when(~F.isnan("_logit"), F.col("_logit"))
    summed = parts.groupBy(*names).agg(F.collect_list("_lse").alias("_l"), F.max(known).alias("_logit"))
    top = F.array_max("_l")
    lse = top + F.log(F.aggregate(F.transform("_l", lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x))
    batch = F.col("_own") if batch_col else F.lit(0)
    return summed.select(batch.alias(batch_col or "batch"), F.col("_pair").alias(pair_col), (lse - F.col("_logit")).alias("loss"),
                         F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_one")).drop("_one")


def info_nce(first: DataFrame, second: DataFrame, temperature: float = 1.0, **kw) -> DataFrame:
    """Mean cross-entropy of every first-set item against its own pair."""
    return info_nce_items(first, second, temperature, **kw).agg(F.avg("loss").alias("loss"))


def _directions(pairs: list[tuple[str, DataFrame, DataFrame]], temperature: float, pair_col: str,
                vec_col: str, batch_col: str | None = None, **kw) -> DataFrame:
    """Several InfoNCE directions in one pass: direction and batch together are the batch key, so
    logits never mix directions; returns (direction, loss)."""
    own = F.to_json(F.struct(F.col(batch_col).alias("b"))) if batch_col else F.lit("")

    def named(name, df):
        return df.select(F.concat(F.lit(name), F.lit("|"), own).alias("_dir"), pair_col, vec_col)

    firsts, seconds = ([named(p[0], p[k]) for p in pairs] for k in (1, 2))
    items = info_nce_items(reduce(DataFrame.unionByName, firsts), reduce(DataFrame.unionByName, seconds),
                           temperature, pair_col=pair_col, vec_col=vec_col, batch_col="_dir", **kw)
    return items.groupBy(F.substring_index("_dir", "|", 1).alias("direction")).agg(F.avg("loss").alias("loss"))


def two_way_local(patch: DataFrame, text: DataFrame, temperature: float = 0.1,
                  pair_col: str = "pair", vec_col: str = "vec", **kw) -> DataFrame:
    """(J6(patch, text) + J6(text, patch)) / 2."""
    d = _directions([("p2t", patch, text), ("t2p", text, patch)], temperature, pair_col, vec_col, **kw)
    return d.agg(F.avg("loss").alias("loss"))


EIGHT_DIRECTIONS = (
    ("local_i_to_local_t", "patch", "chunk"), ("local_t_to_local_i", "chunk", "patch"),
    ("local_i_to_global_t", "patch", "text"), ("local_t_to_global_i", "chunk", "image"),
    ("global_i_to_local_t", "image", "chunk"), ("global_t_to_local_i", "text", "patch"),
    ("global_t_to_global_i", "text", "image"), ("global_i_to_global_t", "image", "text"),
)


def eight_way(sets: dict[str, DataFrame], temperature: float = 1.0, pair_col: str = "pair",
              vec_col: str = "vec", **kw) -> DataFrame:
    """The eight local/global x image/text directions and their mean (``combined``)."""
    d = _directions([(name, sets[a], sets[b]) for name, a, b in EIGHT_DIRECTIONS], temperature,
                    pair_col, vec_col, **kw)
    combined = d.agg(F.lit("combined").alias("direction"), F.avg("loss").alias("loss"))
    return d.unionByName(combined)


def flatten_grid(df: DataFrame, grid_col: str, out_col: str = "vec") -> DataFrame:
    """A patch grid (array of rows of vectors) to one row per patch."""
    rows = df.select("*", F.posexplode(grid_col).alias("_r", "_row")).drop(grid_col)
    return rows.select("*", F.posexplode("_row").alias("_c", out_col)).drop("_row")
