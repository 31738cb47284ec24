"""Contrastive metrics, clustering and projection invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from data_dirs import SF1
from vecsight.operators import analytics as AN
from vecsight.operators import contrast as CT
from vecsight.sources.tables import table


def _rows(spark, pairs, n, value, dim=8):
    return spark.createDataFrame([(p, [float(value)] * dim) for p in range(pairs) for _ in range(n)],
                                 "pair int, vec array<double>")


def test_tiny_trial_each_direction_is_ln2(spark):
    sets = {"image": _rows(spark, 2, 1, 0.0), "patch": _rows(spark, 2, 18, 0.0),
            "text": _rows(spark, 2, 1, 1.0), "chunk": _rows(spark, 2, 2, 1.0)}
    rows = CT.eight_way(sets, 1.0).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["loss"] == pytest.approx(math.log(2), abs=1e-9)


def test_info_nce_matches_numpy(spark):
    rng = np.random.default_rng(1)
    f = rng.standard_normal((6, 5))
    s = rng.standard_normal((9, 5))
    fp, sp = [0, 0, 1, 1, 2, 2], [0, 0, 0, 1, 1, 1, 2, 2, 2]
    first = spark.createDataFrame([(p, v.tolist()) for p, v in zip(fp, f)], "pair int, vec array<double>")
    second = spark.createDataFrame([(p, v.tolist()) for p, v in zip(sp, s)], "pair int, vec array<double>")
    fn = f / np.linalg.norm(f, axis=1, keepdims=True)
    sn = s / np.linalg.norm(s, axis=1, keepdims=True)
    logits = np.array([[np.mean(fn[i] @ sn[np.array(sp) == b].T) for b in range(3)] for i in range(6)]) / 0.5
    lse = np.log(np.exp(logits).sum(axis=1))
    want = np.mean(lse - logits[np.arange(6), fp])
    assert CT.info_nce(first, second, 0.5).first()["loss"] == pytest.approx(want, abs=1e-9)
    # the size of the blocks does not matter
    assert CT.info_nce(first, second, 0.5, item_block=2, pair_block=1).first()["loss"] == pytest.approx(want, abs=1e-9)


def test_info_nce_missing_batch_copies_and_unknown_pairs(spark):
    first = spark.createDataFrame([(None, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (5, 1, [0.0, 1.0]), (5, 9, [1.0, 1.0]), (6, 1, [1.0, 0.0])],
                                  "b int, pair int, vec array<double>")
    second = spark.createDataFrame([(None, 1, [1.0, 0.0]), (None, 2, [0.0, 1.0]), (5, 1, [0.0, 2.0])], "b int, pair int, vec array<double>")
    got = sorted((r.b, r.pair, r.loss) if r.b else (0, r.pair, r.loss) for r in CT.info_nce_items(first, second, 1.0, batch_col="b").collect())
    own = math.log(math.exp(1) + 1) - 1
    assert got == [(0, 1, pytest.approx(own)), (0, 1, pytest.approx(own)), (5, 1, pytest.approx(0.0)), (5, 9, None)]


def test_pca_centred(spark):
    out = AN.pca(table(spark, SF1, "embeddings").select("vec_id", "embedding"), "embedding")
    r = out.agg(F.avg("x"), F.avg("y")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1]) < 1e-9


def test_kmeans_sizes_add_up(spark):
    e = table(spark, SF1, "embeddings")
    out, model = AN.kmeans(e, "embedding", k=10, seed=0)
    assert out.count() == e.count()
    assert out.select("cluster").distinct().count() <= 10


def test_covariance_matches_numpy(spark):
    e = table(spark, SF1, "embeddings")
    m = np.array([r["embedding"] for r in e.collect()], dtype=np.float64)
    c = np.cov(m, rowvar=False)
    got = AN.covariance_entries(e, "embedding", m.shape[1]).collect()
    for r in got[:200]:
        assert r["cov"] == pytest.approx(c[r["i"], r["j"]], abs=1e-9)


def test_flatten_patch_grid(spark):
    df = spark.createDataFrame([(0, [[[1.0], [2.0]], [[3.0], [4.0]], [[5.0], [6.0]]])],
                               "pair int, grid array<array<array<double>>>")
    out = CT.flatten_grid(df, "grid")
    assert out.count() == 6 and sorted(r["vec"][0] for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_cluster_size_check_and_means(spark):
    import __spark_entry__ as E
    from vecsight.operators.prevalence import column_means, size_check
    from vecsight.plans import inputs as I
    prev = E.queries()["cluster_prevalence_rollup"](spark, SF1)
    sizes = prev.select("Cluster", "Total_Samples").distinct()
    chk = size_check(sizes, I.corpus(spark, SF1)).first()
    assert chk["clustered"] == chk["library_rows"] and chk["equal"]
    wide = prev.groupBy("Cluster").pivot("label", [0]).agg(F.first("prevalence")).withColumnRenamed("0", "label_0")
    means = column_means(wide, ["label_0"]).first()
    rows = wide.collect()
    assert means["label_0"] == pytest.approx(sum(r["label_0"] for r in rows) / len(rows))


def test_kmeans_cost_not_above_fixed_assignment(spark):
    """The fitted k-means cost is at most the cost of assigning every vector to the
    per-label mean vectors (a valid 10-centre solution)."""
    from vecsight.operators.scoring import mean_vector
    e = table(spark, SF1, "embeddings")
    _, model = AN.kmeans(e, "embedding", k=10, seed=0)
    centres = mean_vector(e, ["label"], "embedding", "centre").withColumnRenamed("label", "cluster")
    fixed = AN.assign_nearest(e, "embedding", centres).agg(F.sum(F.col("dist") * F.col("dist"))).first()[0]
    assert model.summary.trainingCost <= fixed + 1e-9


def test_pca_variance_matches_covariance_eigenvalues(spark):
    """The variance of each projected coordinate equals the top eigenvalues of the sample
    covariance (PCA after centring)."""
    e = table(spark, SF1, "embeddings")
    m = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], dtype=np.float64)
    eig = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    out = AN.pca(e.select("vec_id", "embedding"), "embedding")
    r = out.agg(F.var_samp("x"), F.var_samp("y")).first()
    assert r[0] == pytest.approx(eig[0], rel=1e-6) and r[1] == pytest.approx(eig[1], rel=1e-6)


def test_components_of_wide_vectors(spark):
    """4,096 dimensions, by blocks; the same by the whole covariance where that is small."""
    rng = np.random.default_rng(21)
    basis = np.linalg.qr(rng.standard_normal((4096, 5)))[0]
    x = rng.standard_normal((600, 5)) * [9, 6, 3, 2, 1] @ basis.T + 0.05 * rng.standard_normal((600, 4096)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, v array<double>").repartition(6)
    values, vectors = np.linalg.eigh(np.cov(x @ basis, rowvar=False))
    fitted = AN.principal_components(df, "v", k=3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert fitted.variance == pytest.approx(s[:3] ** 2 / 599, rel=1e-9)
    assert np.abs(np.sum(fitted.vectors * vt[:3].T, axis=0)) == pytest.approx(np.ones(3), abs=1e-9)
    assert (np.take_along_axis(fitted.vectors, np.abs(fitted.vectors).argmax(0)[None], 0) > 0).all()
    got = {r.id: (r.a, r.b) for r in AN.project(df, "v", fitted, ("a", "b", "c")).collect()}
    assert got[-1] == (None, None)
    assert np.array([got[i] for i in range(600)]) == pytest.approx((x - x.mean(0)) @ fitted.vectors[:, :2], abs=1e-8)
    small = df.selectExpr("id", "slice(v, 1, 40) AS v")
    a, b = AN.principal_components(small, "v", k=2), AN.principal_components(small, "v", k=2, gram_dims=8, extra=20, most_passes=400)
    assert a.variance == pytest.approx(b.variance, rel=1e-8) and a.vectors == pytest.approx(b.vectors, abs=1e-6)
    empty = AN.principal_components(df.where("id < -1"), "v")
    assert AN.project(df.where("id < -1"), "v", empty).count() == 0


def test_lloyd_equals_numpy(spark):
    rng = np.random.default_rng(22)
    x = rng.standard_normal((500, 3)) + rng.integers(0, 4, 500)[:, None] * 2
    start = np.concatenate([x[:6], [[1e6, 0, 0]], x[:1]])  # one that is never met, one that repeats
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, v array<double>").repartition(5)
    c = start.copy()
    for _ in range(4):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    got = AN.lloyd(df, "v", AN.Centres(list(range(10, 18)), start), 4)
    assert got.points == pytest.approx(c, abs=1e-10)
    rows = {r.id: (r.cluster, r.dist) for r in AN.assign_nearest(df, "v", got).collect()}
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    assert [rows[i][0] - 10 for i in range(500)] == d.argmin(1).tolist() and rows[-1] == (None, None)
    assert [rows[i][1] for i in range(500)] == pytest.approx(d.min(1).tolist(), abs=1e-9)
