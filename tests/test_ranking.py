"""Distributed ranking against a single-task window (brute force)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecsight.operators.ranking import first_n, order_desc, slot_counts, top_k, with_slots


def _data(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{i % 7}"        # one group holds two thirds of the rows
        score = None if i % 97 == 0 else float(rnd.randint(0, 50))  # many ties and a few NULLs
        rows.append((g, i, score))
    return spark.createDataFrame(rows, "grp string, id long, score double")


def test_first_n_equals_row_number(spark):
    df = _data(spark)
    n = spark.createDataFrame([("hot", 1234), ("g0", 1), ("g1", 0), ("g2", 10_000), ("g3", 7)], "grp string, n long")
    rows = with_slots(df, "score")
    slots = slot_counts(rows, ["grp"], n, "grp")
    w = Window.partitionBy("grp").orderBy(*order_desc("score", "id"))
    want = df.withColumn("rank", F.row_number().over(w)).join(n, "grp").where("rank <= n")
    got = first_n(rows, slots, ["grp"], "score", "id")
    a, b = (sorted(tuple(r) for r in x.select("grp", "id").collect()) for x in (got, want))
    assert a == b
    edge = first_n(rows, slots, ["grp"], "score", "id", edge_only=True)
    whole = slots.where("_upto <= n").groupBy("grp").agg(F.sum("_slot_hits").alias("rows"))
    counts = {r.grp: r["count"] for r in edge.groupBy("grp").count().collect()}
    for r in whole.collect():
        counts[r.grp] = counts.get(r.grp, 0) + r.rows
    assert counts == {r.grp: r["count"] for r in want.groupBy("grp").count().collect()}


def test_top_k(spark):
    df = _data(spark)
    got = top_k(df, ["grp"], order_desc("score", "id"), 5)
    assert got.groupBy("grp").count().where("count > 5").count() == 0
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def _ranked(df, n, groups):
    number = F.when(~F.isnan("score"), F.col("score"))  # NaN counts as missing, before NULL
    w = Window.partitionBy(*groups).orderBy(number.desc_nulls_last(), F.isnan("score").desc(), "id")
    want = df.withColumn("rank", F.row_number().over(w)).join(n, "grp").where("rank <= n")
    return sorted((r.grp, str(r.id)) for r in want.select("grp", "id").collect())


def test_equal_and_missing_scores_are_cut_by_the_tie_id(spark):
    """A third of a group's scores equal, a third missing: no more than ``most`` rows are ranked."""
    rnd = random.Random(5)
    rows = []
    for i in range(6000):
        third = i % 3
        score = 0.25 if third == 0 else None if third == 1 else rnd.choice([0.25 + 1e-9 * rnd.random(), float("nan"), rnd.random()])
        rows.append(("hot", 7 * i * i - 10**12, score))
        if i < 900:
            rows += [("equal", 2**62 + i, 1.0), ("gone", i, None), ("few", i, float(i)), ("inf", i, float("inf") if i % 2 else -1e308)]
    df = spark.createDataFrame(rows, "grp string, id long, score double")
    text = df.withColumn("id", F.concat(F.lit("study/é"), F.col("id").cast("string")))
    for table in (df, text):
        for n_hot in (1, 1500, 2500, 4321, 5999, 10_000):
            n = spark.createDataFrame([("hot", n_hot), ("equal", 450), ("gone", 7), ("few", 333), ("inf", 600)], "grp string, n long")
            slotted = with_slots(table, "score")
            got = first_n(slotted, slot_counts(slotted, ["grp"], n, "grp"), ["grp"], "score", "id", most=100)
            assert sorted((r.grp, str(r.id)) for r in got.select("grp", "id").collect()) == _ranked(table, n, ["grp"])
            if n_hot != 2500:
                break


def test_rest_that_is_ranked_is_bounded(spark):
    from vecsight.operators import ranking

    df = spark.range(50_000).select(F.lit("g").alias("grp"), "id", F.lit(0.5).alias("score"), F.lit(31_234).cast("long").alias("_left"), F.lit(3).alias("_slot"))
    rest, sure = ranking._narrowed(df, ["grp"], "score", "id", 200)
    assert rest.count() <= 200
    left = rest.first()
    assert sum(s.count() for s in sure) + (left._left if left else 0) == 31_234
    same = df.withColumn("id", F.lit(1).cast("long"))  # rows that can't be told apart stay together
    rest, sure = ranking._narrowed(same, ["grp"], "score", "id", 200)
    assert rest.count() == 50_000 and sum(s.count() for s in sure) == 0
