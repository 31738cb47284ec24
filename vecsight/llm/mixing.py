"""Temperature mixing of sources, realised as budgeted block permutations (DataFrame functions only).

A source with token share p gets the weight p ** a / sum(p ** a).  The exponent a lies on a grid
of 0..1 and is found by bisection: the largest exponent whose weights reach the target entropy (a
fraction of the entropy of equal weights), raised if needed to the smallest one for which no
source is repeated more than ``repetition_limit`` times.  Every pass of the bisection asks for
many exponents at once, one aggregate over the table of source totals.

A source's documents are dealt into blocks by a hash of doc_id, as many as its tokens ask for.
Its budget is its weight times the budget; whole epochs take every block, the last epoch takes
blocks in the order of a permutation of that epoch until the budget is spent, and of the block
that does not fit the documents that still fit, in hash order.  Nothing else is dropped, and the
tokens taken fall short of a budget by less than one document's tokens.

Defined results: tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text has none; a null source is
a source of its own; rows that share a doc_id are taken or left together; documents without
tokens go with their block; if no source has tokens, every row is taken once; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecsight.llm.common import cut, set_apart, set_back

WORD = r"[^\x20\x09-\x0D]+"
GRID = 1_000_000


def _number(text: Column) -> Column:
    """60 bits of a hash of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _text(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit("-"))


def _weights(totals: DataFrame, exponents: list[int], ratio: float) -> dict[int, tuple[float, float]]:
    """Per grid exponent: entropy of the weights, and how often the most repeated source is repeated."""
    e = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("k")
    rows = totals.select("p", e).withColumn("a", F.col("k") / F.lit(float(GRID)))
    power = F.pow("p", "a")
    out = rows.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.ln("p")).alias("s"),
                                F.max(F.pow("p", F.col("a") - 1)).alias("r"))
    return {r.k: (math.log(r.z) - r.s / r.z, r.r / r.z * ratio) for r in out.collect()}


def exponent(totals: DataFrame, target: float, limit: float, ratio: float, ways: int = 32) -> int:
    """The exponent on the grid 0..GRID for source shares ``p`` (all above 0)."""
    def last(good) -> int:  # the last grid point that is good; good ones come first; point 0 counts as good
        lo, hi = 0, GRID + 1
        while hi - lo > 1:
            points = sorted({lo + (hi - lo) * i // ways for i in range(1, ways)} - {lo, hi})
            values = _weights(totals, points, ratio)
            lo = max([lo, *(k for k in points if good(*values[k]))])
            hi = min([hi, *(k for k in points if k > lo)])
        return lo

    by_entropy = last(lambda entropy, repeats: entropy >= target)
    start = _weights(totals, [by_entropy], ratio)[by_entropy][1]
    return by_entropy if start <= limit else min(GRID, last(lambda entropy, repeats: repeats > limit) + 1)


def plan(docs: DataFrame, target_entropy: float = 0.98, repetition_limit: float = 4.0, budget_ratio: float = 1.0,
         block_tokens: int = 250_000, seed: int = 0) -> DataFrame:
    """Per source and block: epochs taken whole, whether the next epoch takes it whole, and what is
    left of the budget for it otherwise (null: nothing)."""
    if not 0 < budget_ratio <= repetition_limit:
        raise ValueError("the budget must be above 0 and must not need more repeats than the limit allows")
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(_key("source").alias("s"), _number(F.concat(F.lit(f"{seed}|doc|"), _text("doc_id"))).alias("h"),
                       tokens.alias("t"))
    # fine parts first, whatever number of blocks they are merged to: one scan of the texts
    parts = cut(rows.groupBy("s", (F.col("h") % 65536).alias("part")).agg(F.sum("t").alias("t")), "mix-parts")
    totals = parts.groupBy("s").agg(F.sum("t").alias("total"))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.where("total > 0").withColumn("p", F.col("total") / F.lit(float(everything or 1)))
    if everything:
        shares = cut(shares, "mix-shares")
        n = shares.count()
        a = exponent(shares, target_entropy * math.log(n) - 1e-9, repetition_limit, budget_ratio) / GRID
        z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
        budget = F.floor(F.pow("p", F.lit(a)) / z * (everything * budget_ratio) + 0.5).cast("long")
        shares = shares.select("s", "total", budget.alias("budget"))
    else:
        shares = totals.select("s", F.lit(1).cast("long").alias("total"), F.lit(0).cast("long").alias("budget"))
    shares = shares.withColumns({
        "blocks": F.least(F.lit(65536), F.ceil(F.col("total") / block_tokens)).cast("long"),
        "epochs": F.floor(F.col("budget") / F.col("total")).cast("int")})
    own = totals.select("s").join(shares, "s", "left").select(
        "s", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"), F.coalesce("epochs", F.lit(0)).alias("epochs"),
        F.coalesce(F.col("budget") - F.col("epochs") * F.col("total"), F.lit(0)).alias("rest"))
    blocks = (parts.join(own, "s").groupBy("s", (F.col("part") % F.col("blocks")).alias("block"), "blocks", "epochs", "rest")
              .agg(F.sum("t").alias("t")))
    w = Window.partitionBy("s").orderBy("place", "block")
    return (blocks.withColumn("place", _place(seed, "s", "block", "epochs"))
            .withColumn("upto", F.sum("t").over(w))
            .select("s", "block", "blocks", "epochs", (F.col("upto") <= F.col("rest")).alias("whole"),
                    F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") < F.col("rest")),
                           F.col("rest") - F.col("upto") + F.col("t")).alias("left_over")))


def _place(seed: int, *parts: str) -> Column:
    """Where a block stands in its source's permutation of an epoch."""
    return _number(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """``docs`` as often as they are taken, one row per take, with ``epoch`` (from 0), ``block`` and
    ``place``: sorted by epoch, place and block, a source's rows stand in the order of its epochs'
    block permutations.  Columns of ``docs`` with these names are replaced.

    Documents meet the small table of blocks by source and block, so a source that holds a third
    of all rows is spread over its blocks.
    """
    kept = docs.drop("epoch", "block", "place")
    apart, columns = set_apart(kept, "doc_id", "source", "text")
    blocks = cut(plan(docs, seed=seed, **how), "mix-blocks")
    sizes = blocks.select(F.col("s").alias("__s"), F.col("blocks").alias("__blocks")).distinct()
    hashed = apart.select(*columns, _key("source").alias("__s"),
                         _number(F.concat(F.lit(f"{seed}|doc|"), _text("doc_id"))).alias("__h"))
    own = (hashed.join(sizes, "__s").withColumn("__block", F.col("__h") % 65536 % F.col("__blocks"))
           .join(blocks, (F.col("__s") == F.col("s")) & (F.col("__block") == F.col("block"))))
    times = F.col("epochs") + F.when(F.col("whole"), 1).otherwise(0)
    out = (*columns, "epoch", "block", _place(seed, "s", "block", "epoch").alias("place"))
    taken = own.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).select(*out)
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = _number(F.concat(F.lit(f"{seed}|"), F.col("epochs").cast("string"), F.lit("|"), _text("doc_id")))
    w = Window.partitionBy("s", "block").orderBy("__o", "doc_id")
    fits = (own.where(F.col("left_over").isNotNull()).withColumns({"__t": tokens, "__o": order})
            .withColumn("__upto", F.sum("__t").over(w)).where(F.col("__upto") <= F.col("left_over"))
            .withColumn("epoch", F.col("epochs")).select(*out))
    out_names = [*kept.columns, "epoch", "block", "place"]
    return set_back(taken.unionByName(fits), [*columns, "epoch", "block", "place"], out_names)
