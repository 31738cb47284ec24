import random

import numpy as np

from vecsight.llm import importance, queries, toxicity
from vecsight.llm.common import kth_largest

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, names = toxicity.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    own = labels.where("doc_id % 3 <> 0")
    out = toxicity.predict(docs.where("doc_id % 3 = 0"), toxicity.fit(docs, own, names)).join(
        labels.withColumnRenamed("toxic", "y").drop("low_quality").dropDuplicates(["doc_id"]), "doc_id").toPandas()
    for lang, least in {"en": 0.85, "de": 0.8, "es": 0.8, "fr": 0.8}.items():
        of = out[out.lang == lang]
        assert of[of.y == 1].toxic.mean() > least, lang
    of = out[out.lang == "en"]
    assert of[of.y == 0].toxic.mean() < 0.02  # some of the given labels are noise
    assert out[out.y == 0].toxic.mean() < 0.03


def test_no_feature_is_left_out_for_number():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(2000):  # 1,500 words of one kind of document, 1,500 of the other
        a = i % 2
        rows.append(([float(a)], np.unique(rng.integers(0, 1500, 150) + 1500 * a)))
    chain = toxicity.fit_rows(rows, ["only"])
    assert len(chain.chosen) == 3000
    odds = chain.odds(np.repeat(np.arange(2000), [len(r[1]) for r in rows]), np.concatenate([r[1] for r in rows]), 2000)
    assert ((odds[:, 0] > 0) == (np.arange(2000) % 2 > 0)).all()


def test_pairs_and_dense_columns_fit_alike():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (300, 8)).astype(float)
    y = (x @ rng.standard_normal(8) + rng.standard_normal(300) > 0).astype(float)
    rows, columns = np.nonzero(x[:, :5])
    sparse = toxicity.Logistic(toxicity.Incidence(rows, columns, 5, x[:, 5:]), y)
    dense = toxicity.Logistic(x, y)
    assert np.allclose(sparse.w, dense.w, atol=1e-2) and abs(sparse.b - dense.b) < 1e-2
    slope = x.T @ (1 / (1 + np.exp(-dense.odds(x))) - y) + 0.05 * dense.w
    assert np.abs(slope).max() < 0.05


def test_toxicity_query_is_whole(spark):
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got[["p_low_quality", "p_toxic"]].apply(lambda c: c.between(0, 1).all()).all()


def test_logistic_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 6)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 1).astype(np.float32)
    model = toxicity.Logistic(x, y)
    assert ((model.odds(x) > 0) == (y > 0)).all()
    assert toxicity._best_threshold(np.array([3.0, 2.0, -1.0, -5.0]), np.array([1, 1, 0, 0])) == 0.5
    assert (toxicity.Logistic(x, np.zeros(500)).odds(x) < -5).all()


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        a = rng.random() < 0.5
        rows.append(([float(a), float(a)], np.unique(np.append(rng.integers(0, 40, 5), 100 if a else 101))))
    chain = toxicity.fit_rows(rows, ["first", "second"])
    assert len(chain.models[1].w) == len(chain.chosen) + 1 and chain.models[1].w[-1] > 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in enumerate([None, "", "fine words here", "you scum", "x " * 200_000])] + [(3, "you scum", 0.5, True)],
                                 "doc_id long, text string, p_toxic double, toxic boolean")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1), (3, 0, 1), (None, 0, 1), (4, None, 0)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    out = toxicity.predict(docs, chain)
    assert out.columns == ["doc_id", "text", "p_low_quality", "p_toxic", "toxic"] and out.count() == 6
    none = toxicity.fit(docs, labels.limit(0), ["low_quality", "toxic"])
    assert not any(r.toxic for r in toxicity.predict(docs, none).collect())
    assert toxicity.predict(docs.limit(0), chain).collect() == []


def plain_weights(texts, good, buckets, prior):
    """Counts and log weights with dictionaries, from the operator's own buckets."""
    import pyarrow as pa
    grams = [[] for _ in texts]
    for i, j, ones, first, pairs, first_pair in importance._ngrams(pa.array(texts, pa.string()), buckets):
        for r in range(j - i):
            grams[i + r] = [*ones[first[r]:first[r + 1]].tolist(), *pairs[first_pair[r]:first_pair[r + 1]].tolist()]
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for g, y in zip(grams, good):
        for b in g:
            raw[b] += 1
            target[b] += bool(y)
    pooled = (raw + 1e-3) / (raw + 1e-3).sum()
    ratio = np.log((target + prior * pooled) / (target.sum() + prior)) - np.log((raw + prior * pooled) / (raw.sum() + prior))
    return [ratio[g].sum() for g in grams], [len(g) for g in grams]


def test_importance_against_plain_counts(spark):
    rnd = random.Random(5)
    good = [" ".join(rnd.choice("the of and in to a is that".split()) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    bad = [" ".join(rnd.choice("BUY NOW!!! $$$ click *** win".split()) for _ in range(rnd.randint(1, 80))) for _ in range(50)]
    texts = good + bad + [None, "", "word"]
    docs = spark.createDataFrame([(i, t, 1.0, False) for i, t in enumerate(texts)], "doc_id long, text string, key double, kept boolean")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)] + [(0, 1), (None, 1)], "doc_id long, quality int")
    out = importance.resample(docs, labels, prior=100.0).orderBy("doc_id").collect()
    want, sizes = plain_weights(texts, [i < 150 and i % 2 == 0 for i in range(len(texts))], importance.BUCKETS, 100.0)
    assert np.allclose([r.log_weight for r in out], want) and [r.n_grams for r in out] == sizes
    k = round(len(texts) * 75 / 100)
    assert sum(r.kept for r in out) == k and {r.doc_id for r in out if r.kept} == {r.doc_id for r in sorted(out, key=lambda r: -r.key)[:k]}
    assert np.mean([r.kept for r in out if r.doc_id < 150]) > 0.9 > 0.3 > np.mean([r.kept for r in out if 150 <= r.doc_id < 200])
    again = importance.resample(docs, labels, prior=100.0).orderBy("doc_id").collect()
    assert again == out


def test_importance_reads_all_labels(spark):
    n = 60_000
    texts = [f"w{i % 11} v{i % 13}" for i in range(n)]
    good = [i % 7 == 0 for i in range(n)]
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 11, ' v', id % 13) AS text")
    out = importance.resample(docs, spark.range(n).selectExpr("id AS doc_id", "int(id % 7 = 0) AS quality")).orderBy("doc_id").toPandas()
    want, _ = plain_weights(texts, good, importance.BUCKETS, 10_000.0)
    assert out.kept.sum() == sum(good) and np.allclose(out.log_weight, want, atol=1e-12)


def test_importance_noise_is_gumbel(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'same words' AS text")
    keys = np.array([r.key for r in importance.weigh(docs, np.zeros(importance.BUCKETS)).collect()])
    assert abs(keys.mean() - 0.5772) < 0.03 and abs(keys.var() - np.pi ** 2 / 6) < 0.06


def test_importance_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert importance.resample(empty, labels).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b"), (None, "c " * 300_000)], "doc_id long, text string")
    out = importance.resample(docs, labels).collect()
    assert len(out) == 4 and all(r.kept and r.log_weight == 0 for r in out)


def test_kth_largest(spark):
    rnd = random.Random(1)
    values = [rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 5)), 1e300, -1e-300]) for _ in range(3000)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in (1, 2, 17, 1500, 2999, 3000):
        assert kth_largest(df, "x", k) == ordered[k - 1]
    assert kth_largest(df, "x", 3001) is None and kth_largest(df, "x", 0) is None
