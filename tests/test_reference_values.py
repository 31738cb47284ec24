"""Values stated in FIXTURES.md (sf0.001) and the flagship entry."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from data_dirs import SF1
from vecsight.operators import contrast as CT
from vecsight.operators import manifest as MF
from vecsight.plans import inputs as I
from vecsight.sources.tables import table


def test_entry_matches_reference_precision(spark):
    got = {r["label"]: r["precision"] for r in E.entry(spark).collect()}
    want = [0.2308, 0.3333, 0.3889, 0.3333, 0.2857, 0.3333, 0.0833, 0.3529, 0.3333, 0.2857]
    assert [got[i] for i in range(10)] == want


def test_info_nce_reference(spark):
    """The stated value is that of the prompts 1-2 against 3-4; the query takes the whole table."""
    p = I.prompts(spark, SF1).select(F.col("label").alias("pair"), F.col("qvec").alias("vec"), "prompt_id")
    out = CT.info_nce(p.where("prompt_id <= 2"), p.where("prompt_id >= 3"), 1.0)
    assert out.first()["loss"] == pytest.approx(2.278758, abs=1e-6)


def test_manifest_counts(spark):
    """The stated value is that of the first lines of the orders; the query takes all lines."""
    first = table(spark, SF1, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey AS series_uid", "l_partkey AS ann_id")
    orders = table(spark, SF1, "orders").selectExpr("o_orderkey AS series_uid", "o_custkey AS im_id")
    assert MF.manifest(first, orders).count() == 475


def test_pairing_tiers(spark):
    rows = E.queries()["pair_files"](spark, SF1).groupBy("tier", "reject_reason").count().collect()
    got = {(r["tier"], r["reject_reason"]): r["count"] for r in rows}
    assert got == {(1, None): 375, (2, None): 375, (3, None): 375, (None, "no candidate"): 375}


def test_notes_kept(spark):
    assert E.queries()["notes_combine"](spark, SF1).count() == 194


def test_one_hot_counts(spark):
    df = E.queries()["one_hot_pivot"](spark, SF1)
    r = df.agg(*[F.sum(c).alias(c) for c in ("A", "N", "R")], F.count(F.lit(1)).alias("n")).first()
    ones = r["A"] + r["N"] + r["R"]
    assert ones == 3287 and 3 * r["n"] - ones == 1132


def test_coerced_non_null(spark):
    df = E.queries()["coerce_numeric"](spark, SF1)
    assert df.where(F.col("value").isNotNull()).count() == 700 and df.count() == 1000


def test_pixel_range(spark):
    r = E.queries()["pixel_rescale"](spark, SF1).agg(F.min("px_min"), F.max("px_max")).first()
    assert r[0] == pytest.approx(-1833.6, abs=0.05) and r[1] == pytest.approx(1989.1, abs=0.05)


def test_bulk_counts(spark):
    pooled = E.queries()["bulk_unpivot_pool"](spark, SF1)
    assert pooled.select("study_id").distinct().count() == 1473
    assert pooled.count() == 1473 * 4 * 2
    n = E.queries()["bulk_precision"](spark, SF1).first()["n"]
    assert n == 1096


def test_precision_bounds(spark):
    for k in ("precision_at_n", "precision_at_k"):
        for r in E.queries()[k](spark, SF1).collect():
            assert r["precision"] is None or 0.0 <= r["precision"] <= 1.0


def test_average_le_max(spark):
    df = E.queries()["score_pooling"](spark, SF1)
    assert df.where(F.col("average_cosine_similarity") > F.col("max_cosine_similarity")).count() == 0


def test_study_max_ge_mean(spark):
    q = E.queries()
    mx = q["study_max"](spark, SF1).withColumnRenamed("cosine_similarity", "mx")
    mn = q["study_mean"](spark, SF1).withColumnRenamed("cosine_similarity", "mn")
    j = mx.join(mn, ["study_id", "label", "embedding_type"])
    assert j.where(F.col("mn") > F.col("mx") + 1e-9).count() == 0


def test_weighted_total_equals_overall(spark):
    rows = E.queries()["cluster_prevalence_rollup"](spark, SF1).collect()
    for label in range(10):
        own = {r["Cluster"]: r for r in rows if r["label"] == label}
        total = own.pop("Weighted_Avg")
        n = sum(r["Total_Samples"] for r in own.values())
        assert total["Total_Samples"] == n
        w = sum(r["prevalence"] * r["Total_Samples"] for r in own.values()) / n
        assert math.isclose(w, total["prevalence"], abs_tol=1e-5)
