"""Scoring paths agree; prompt blocks beyond the broadcast bound lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from data_dirs import SF1
from vecsight.constants import ALL_MEASURES
from vecsight.operators.scoring import mean_vector, score_library
from vecsight.plans import inputs as I


def _collect(df):
    return sorted((r["dicom_id"], r["label"], r["embedding_type"], round(r["cosine_similarity"], 9))
                  for r in df.collect())


def test_arrow_native_and_blocked_agree(spark):
    c, p = I.corpus(spark, SF1), I.prompts(spark, SF1)
    a = score_library(c, p, I.ID_COLS, measures=ALL_MEASURES, method="arrow")
    b = score_library(c, p, I.ID_COLS, measures=ALL_MEASURES, method="native")
    blocked = score_library(c, p, I.ID_COLS, measures=ALL_MEASURES, method="arrow", max_prompts=8)
    ra, rb, rc = _collect(a), _collect(b), _collect(blocked)
    assert ra == rb == rc
    assert len(ra) == c.count() * 10 * len(ALL_MEASURES)


def test_scores_match_numpy(spark):
    c = I.corpus(spark, SF1).orderBy("dicom_id").limit(5).collect()
    p = I.prompts(spark, SF1).where("label = 3").orderBy("prompt_id").collect()
    q = np.array([r["qvec"] for r in p], dtype=np.float64)
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    avg = q.mean(axis=0)
    avg /= np.linalg.norm(avg)
    lib = spark.createDataFrame([(r["dicom_id"], r["embedding"]) for r in c], "dicom_id long, embedding array<float>")
    s = {(r["dicom_id"], r["embedding_type"]): r["cosine_similarity"] for r in
         score_library(lib, I.prompts(spark, SF1).where("label = 3"), ["dicom_id"]).collect()}
    for r in c:
        v = np.array(r["embedding"], dtype=np.float64)
        sc = qn @ v
        assert s[(r["dicom_id"], "cosine_similarity_2")] == pytest.approx(sc[1], abs=1e-12)
        assert s[(r["dicom_id"], "average_cosine_similarity")] == pytest.approx(sc.mean(), abs=1e-12)
        assert s[(r["dicom_id"], "max_cosine_similarity")] == pytest.approx(sc.max(), abs=1e-12)
        assert s[(r["dicom_id"], "average_embedding")] == pytest.approx(avg @ v, abs=1e-12)


def test_scoring_plan_has_no_join_or_shuffle(spark):
    s = I.scores(spark, SF1)
    plan = s._jdf.queryExecution().executedPlan().toString()
    scoring_part = plan.split("MapInPandas")[0]
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Exchange" not in scoring_part


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 1.0])], "g int, v array<double>")
    got = {r["g"]: r["mean_vec"] for r in mean_vector(df, ["g"], "v").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_search_topk_limit(spark):
    from vecsight.plans.q_retrieval import search_topk
    df = search_topk(spark, SF1, k=3)
    assert df.groupBy("label").agg(F.max("rank").alias("m")).where("m > 3").count() == 0


def _unit_rows(m):
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


def test_label_with_many_prompts_is_scored_in_tiles(spark):
    rng = np.random.default_rng(11)
    images, prompts = rng.standard_normal((40, 6)), rng.standard_normal((10_000, 6))
    few = rng.standard_normal((3, 6))
    lib = [(i, v.tolist()) for i, v in enumerate(images)] + [(0, images[0].tolist()), (99, None)]  # a row that repeats, one without vector
    table = [("many", k + 1, v.tolist()) for k, v in enumerate(prompts)] + [("few", k + 1, v.tolist()) for k, v in enumerate(few)]
    library = spark.createDataFrame(lib, "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(table, "label string, prompt_id int, qvec array<double>")
    measures = ("cosine_similarity_7", "average_embedding", "average_cosine_similarity", "max_cosine_similarity")
    got = {}
    for r in score_library(library, asked, ["id"], measures=measures).collect():
        got.setdefault((r.id, r.label, r.embedding_type), []).append(r.cosine_similarity)
    for label, q in (("many", prompts), ("few", few)):
        s = images @ _unit_rows(q).T
        mean = images @ _unit_rows(q.mean(0, keepdims=True))[0]
        for i in range(len(images)):
            want = {"average_embedding": mean[i], "average_cosine_similarity": s[i].mean(), "max_cosine_similarity": s[i].max(),
                    "cosine_similarity_7": s[i, 6] if len(q) > 6 else None}
            for m, v in want.items():
                assert got[i, label, m] == [pytest.approx(v, abs=1e-12)] * (2 if i == 0 else 1)
    assert not [k for k in got if k[0] == 99]


def test_search_with_many_prompts_and_empty_partitions(spark):
    from vecsight.operators.scoring import search_topk

    rng = np.random.default_rng(12)
    images, prompts = rng.standard_normal((30, 4)), rng.standard_normal((300, 4))
    library = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(images)], "id long, embedding array<double>").repartition(40)
    asked = spark.createDataFrame([("a", k + 1, v.tolist()) for k, v in enumerate(prompts)], "label string, prompt_id int, qvec array<double>")
    best = np.argsort(-(images @ _unit_rows(prompts).T).max(1))[:5].tolist()
    for most in (4096, 64):
        got = search_topk(library, asked, ["id"], 5, "id", measure="max_cosine_similarity", max_prompts=most).orderBy("rank").collect()
        assert [r.id for r in got] == best


def test_nested_rows_need_no_shuffle_and_equal_the_long_table(spark):
    from vecsight.operators import reshape as RS
    from vecsight.operators import scoring as SC

    rng = np.random.default_rng(13)
    library = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 5)))] + [(77, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(f"l {k % 7}", k // 7 + 1, v.tolist()) for k, v in enumerate(rng.standard_normal((25, 5)))],
                                  "label string, prompt_id int, qvec array<double>")
    labels, measures = [f"l {k}" for k in range(8)], ("cosine_similarity_1", "cosine_similarity_4", "average_embedding", "max_cosine_similarity")
    long = {(r.id, r.label, r.embedding_type): r.cosine_similarity for r in score_library(library, asked, ["id"], measures=measures).collect()}
    for most in (4096, 9):  # in one block, in several
        nested = SC.score_nested(library, asked, ["id"], labels, measures, max_prompts=most)
        assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
        rows = nested.collect()
        assert len(rows) == 50 and all(r["l 7"] is None for r in rows)
        flat = {(r.id, x, m): r[x][m] for r in rows for x in labels[:7] for m in measures}
        assert flat == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in long.items()}
    wide = RS.unpivot_scores(RS.nested_to_wide(nested, ["id"], labels, list(measures)), ["id"], labels, list(measures))
    assert {(r.id, r.label, r.embedding_type): r.cosine_similarity for r in wide.collect() if r.label != "l 7"} == flat
    beyond = SC.score_nested(library, asked, ["id"], labels[:7], measures, max_prompts=1).collect()  # labels of more than a block
    assert {(r.id, x, m): r[x][m] for r in beyond for x in labels[:7] for m in measures} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in flat.items()}
    per_prompt = SC.score_nested(library, asked, ["id"], labels, ("cosine_similarity_1", "cosine_similarity_2"))
    pooled = SC.pool_nested(per_prompt, ["id"], labels, ("cosine_similarity_1", "cosine_similarity_2"), asked.schema["label"].dataType)
    assert pooled.count() == 50 * 7
