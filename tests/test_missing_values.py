"""Missing-value rules and argument checks."""

import warnings

import pytest
from pyspark.sql import functions as F

from vecsight.functions.text import coerce_double
from vecsight.operators import evaluate as ev
from vecsight.operators import reshape as RS


def test_coerce(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(coerce_double("t")).collect()] == [1.5, None, None, None, None]


def test_unpivot_keeps_missing_and_coerces(spark):
    wide = spark.createDataFrame([(1, "0.5", None), (2, "NaN", "x")], "study_id long, `A m` string, `B m` string")
    long = RS.unpivot_scores(wide, ["study_id"], ["A", "B"], ["m"])
    rows = sorted((r["study_id"], r["label"], r["cosine_similarity"]) for r in long.collect())
    assert rows == [(1, "A", 0.5), (1, "B", None), (2, "A", None), (2, "B", None)]


def test_missing_column_policies(spark):
    wide = spark.createDataFrame([(1, 0.5)], "study_id long, `A m` double")
    with pytest.raises(ValueError):
        RS.unpivot_scores(wide, ["study_id"], ["A", "B"], ["m"], on_missing="error")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        out = RS.unpivot_scores(wide, ["study_id"], ["A", "B"], ["m"], on_missing="skip")
        assert out.count() == 1 and len(w) == 1


def test_pool_method_check(spark):
    df = spark.createDataFrame([(1, "A", "m", 0.1)], "study_id long, label string, embedding_type string, cosine_similarity double")
    with pytest.raises(ValueError):
        ev.pool_scores(df, "median")


def test_pooling_skips_null(spark):
    df = spark.createDataFrame([(1, "A", "m", 0.2), (1, "A", "m", None), (1, "A", "m", 0.4)],
                               "study_id long, label string, embedding_type string, cosine_similarity double")
    assert ev.pool_scores(df, "mean").first()["cosine_similarity"] == pytest.approx(0.3)
    assert ev.pool_scores(df, "max").first()["cosine_similarity"] == 0.4


def test_zero_positives_give_null_precision(spark):
    pooled = spark.createDataFrame([(1, "A", "m", 0.9), (2, "A", "m", 0.1)],
                                   "study_id long, label string, embedding_type string, cosine_similarity double")
    pos = spark.createDataFrame([], "label string, study_id long")
    n = spark.createDataFrame([("A", 0)], "label string, n long")
    r = ev.precision_at_n(pooled, pos, n).first()
    assert r["precision"] is None
    assert ev.precision_at_n(pooled, pos, n, skip_empty=True).count() == 0


def test_precision_at_k_divides_by_k(spark):
    pooled = spark.createDataFrame([(1, "A", "m", 0.9), (2, "A", "m", 0.1)],
                                   "study_id long, label string, embedding_type string, cosine_similarity double")
    pos = spark.createDataFrame([("A", 1), ("A", 2)], "label string, study_id long")
    rows = {r["top_k"]: r["precision"] for r in ev.precision_at_k(pooled, pos, [5, 10]).collect()}
    assert rows == {5: 0.4, 10: 0.2}


def test_nulls_rank_last(spark):
    pooled = spark.createDataFrame([(1, "A", "m", None), (2, "A", "m", 0.1)],
                                   "study_id long, label string, embedding_type string, cosine_similarity double")
    pos = spark.createDataFrame([("A", 2)], "label string, study_id long")
    n = spark.createDataFrame([("A", 1)], "label string, n long")
    assert ev.precision_at_n(pooled, pos, n).first()["precision"] == 1.0


def test_overlap_empty_union_is_zero(spark):
    scored = spark.createDataFrame([], "label string, study_id long, cosine_similarity double")
    pos = spark.createDataFrame([], "label string, study_id long")
    n = spark.createDataFrame([("A", 0)], "label string, n long")
    assert ev.top_n_overlap(scored, pos, n).first()["overlap_pct"] == 0.0


def test_precision_equals_one_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(5)
    rows = [(i, "A" if i % 4 else "B", "m", None if i % 50 == 7 else rnd.choice([float(rnd.randint(0, 20)), rnd.gauss(0, 1e-3), rnd.gauss(0, 1e6)]))
            for i in range(2000)]
    rows += [(None, None, "m", 0.5), (1, None, "m", 0.7)]
    pooled = spark.createDataFrame(rows, "study_id long, label string, embedding_type string, cosine_similarity double")
    pos = spark.createDataFrame([("A", i) for i in range(0, 2000, 3)] + [("B", i) for i in range(0, 2000, 8)] + [("C", 1)],
                                "label string, study_id long")
    n = pos.groupBy("label").count().withColumnRenamed("count", "n").unionByName(spark.createDataFrame([(None, 1)], "label string, n long"))
    got = sorted((tuple(r) for r in ev.precision_at_n(pooled, pos, n).collect()), key=str)
    w = Window.partitionBy("label").orderBy(F.col("cosine_similarity").desc_nulls_last(), "study_id")
    want = (pooled.withColumn("rank", F.row_number().over(w)).join(n, pooled.label.eqNullSafe(n.label)).drop(n.label)
            .where("rank <= n").join(pos.withColumn("h", F.lit(1)), ["label", "study_id"], "left")
            .groupBy("label", "embedding_type", "n").agg((F.coalesce(F.sum("h"), F.lit(0)) / F.col("n")).alias("p")))
    assert got == sorted((tuple(r) for r in want.collect()), key=str)
    assert [g[0] for g in got] == ["A", "B", None]  # C has no scores; a null label keeps its group


def test_equal_scores_and_zero_n(spark):
    pooled = spark.createDataFrame([(i, "A", "m", 0.25) for i in range(50)] + [(1, "B", "m", 0.1)],
                                   "study_id long, label string, embedding_type string, cosine_similarity double")
    pos = spark.createDataFrame([("A", 3), ("A", 30)], "label string, study_id long")
    n = spark.createDataFrame([("A", 10), ("B", 0)], "label string, n long")
    assert sorted(tuple(r) for r in ev.precision_at_n(pooled, pos, n).collect()) == [("A", "m", 10, 0.1), ("B", "m", 0, None)]
    assert [tuple(r) for r in ev.precision_at_n(pooled, pos, n, skip_empty=True).collect()] == [("A", "m", 10, 0.1)]


def test_edge_values(spark):
    from vecsight.functions.vectors import parse_vector_text
    from vecsight.operators import prevalence as pv
    from vecsight.operators.reshape import unpivot_scores
    empty = spark.createDataFrame([], "a int, b int")
    assert [r.prevalence_pct for r in pv.prevalence_percent(empty, ["a", "b"]).collect()] == [None, None]
    assert pv.prevalence_sum(spark.createDataFrame([(1, None)], "k int, a int"), ["k"]).first().prevalence_pct == 0.0
    assert spark.createDataFrame([("[\n0.5  1\n2 ]",)], "t string").select(parse_vector_text("t").alias("v")).first().v == [0.5, 1.0, 2.0]
    wide = spark.createDataFrame([(1, 0.1, "x", "0.5")], "i int, `A m` float, `B m` string, `C m` string")
    got = {r.label: r.cosine_similarity for r in unpivot_scores(wide, ["i"], ["A", "B", "C"], ["m"]).collect()}
    import numpy as np
    assert got == {"A": float(np.float32(0.1)), "B": None, "C": 0.5}
    truth = spark.createDataFrame([(1, "A", 1.0), (2, "A", 0.0), (3, "A", None)], "study_id long, label string, value double")
    assert [r.study_id for r in ev.positives(truth, value=0).collect()] == [2]


def test_shared_folder_is_asked_for_on_a_cluster():
    import pytest
    from vecsight.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
