"""Query keys for scoring, pooling, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsight.constants import (AVG_COSINE, AVG_EMBEDDING, K_VALUES, K_VALUES_PERCENT, MAX_COSINE,
                                POOLED_MEASURES, PROMPT_MEASURES, SECOND_NAMING, THRESHOLD)
from vecsight.operators import evaluate as ev
from vecsight.operators import scoring as sc
from vecsight.operators.manifest import distinct_values
from vecsight.plans import inputs as I
from vecsight.plans.oracle_ctes import with_ctes

QUERIES: dict = {}
SQL: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- scoring
@query("cosine_all")
def cosine_all(spark: SparkSession, sf: str) -> DataFrame:
    return I.scores(spark, sf, measures=PROMPT_MEASURES)


@query("score_arrow")
def score_arrow(spark: SparkSession, sf: str) -> DataFrame:
    """K4 named explicitly: the Arrow matrix-product path (the default, ~10x the JVM-only path)."""
    return I.scores(spark, sf, measures=PROMPT_MEASURES, method="arrow")


@query("score_native")
def score_native(spark: SparkSession, sf: str) -> DataFrame:
    """The JVM-only path (prompt vectors as plan literals); must equal ``score_arrow``."""
    return I.scores(spark, sf, measures=PROMPT_MEASURES, method="native")


SQL["cosine_all"] = with_ctes("""
SELECT subject_id, study_id, dicom_id, label, embedding_type, cosine_similarity
FROM scores_all WHERE embedding_type LIKE 'cosine_similarity_%'""", "scores_all")
SQL["score_arrow"] = SQL["cosine_all"]
SQL["score_native"] = SQL["cosine_all"]


@query("score_pooling")
def score_pooling(spark, sf):
    """D13 from the scorer's own rows: no shuffle of scores."""
    prompts = I.prompts(spark, sf)
    labels = distinct_values(I.label_list(spark, sf), "label")
    s = sc.score_nested(I.corpus(spark, sf), prompts, I.ID_COLS, labels, PROMPT_MEASURES)
    p = sc.pool_nested(s, I.ID_COLS, labels, PROMPT_MEASURES, prompts.schema["label"].dataType)
    return p.select(*I.ID_COLS, "label", F.round(AVG_COSINE, 5).alias(AVG_COSINE),
                    F.round(MAX_COSINE, 5).alias(MAX_COSINE))


SQL["score_pooling"] = with_ctes("""
SELECT subject_id, study_id, dicom_id, label, round(avg(s), 5) AS average_cosine_similarity,
       round(max(s), 5) AS max_cosine_similarity
FROM pscore GROUP BY subject_id, study_id, dicom_id, label""", "pscore")


@query("average_embedding_score")
def average_embedding_score(spark, sf):
    return I.scores(spark, sf, measures=(AVG_EMBEDDING,))


SQL["average_embedding_score"] = with_ctes("""
SELECT subject_id, study_id, dicom_id, label, embedding_type, cosine_similarity
FROM scores_all WHERE embedding_type = 'average_embedding'""", "scores_all")


@query("prompt_polarity_margin")
def prompt_polarity_margin(spark, sf):
    pos = I.scores(spark, sf, measures=(AVG_COSINE,)).select("dicom_id", "label",
                                                             F.col("cosine_similarity").alias("pos"))
    neg = I.scores(spark, sf, measures=(AVG_COSINE,), prompt_table=I.negative_prompts(spark, sf)) \
        .select("dicom_id", "label", F.col("cosine_similarity").alias("neg"))
    m = pos.join(neg, ["dicom_id", "label"])
    return m.groupBy("label").agg(
        F.round(F.avg("pos"), 6).alias("pos_mean"), F.round(F.avg("neg"), 6).alias("neg_mean"),
        F.round(F.avg(F.col("pos") - F.col("neg")), 6).alias("margin"),
        F.count_if(F.col("pos") > F.col("neg")).alias("n_pos_wins"))


SQL["prompt_polarity_margin"] = with_ctes("""
SELECT p.label, round(avg(p.v), 6) AS pos_mean, round(avg(n.v), 6) AS neg_mean,
       round(avg(p.v - n.v), 6) AS margin, count(*) FILTER (WHERE p.v > n.v) AS n_pos_wins
FROM (SELECT dicom_id, label, round(avg(s), 5) AS v FROM pscore GROUP BY ALL) p
JOIN (SELECT dicom_id, CAST((label + m) % (m + 1) AS INTEGER) AS label, round(avg(s), 5) AS v
      FROM pscore, (SELECT max(label) AS m FROM embeddings) GROUP BY dicom_id, pscore.label, m) n
  ON p.dicom_id = n.dicom_id AND p.label = n.label
GROUP BY p.label""", "pscore")


@query("search_topk")
def search_topk(spark, sf, k: int = 10):
    pr = I.prompts(spark, sf).where(F.col("prompt_id") == 1)
    out = sc.search_topk(I.corpus(spark, sf), pr, I.ID_COLS, k, "dicom_id", digits=5)
    return out.select("label", F.col("rank").cast("long").alias("rank"), "dicom_id", "study_id",
                      "cosine_similarity")


SQL["search_topk"] = with_ctes("""
SELECT label, rank, dicom_id, study_id, cosine_similarity FROM (
  SELECT label, dicom_id, study_id, round(s, 5) AS cosine_similarity,
         row_number() OVER (PARTITION BY label ORDER BY round(s, 5) DESC NULLS LAST, dicom_id) AS rank
  FROM pscore WHERE prompt_id = 1) WHERE rank <= 10""", "pscore")


# ---------------------------------------------------------------- pooling
def _study_pool(spark, sf, method):
    s = I.scores(spark, sf)
    return ev.pool_scores(s, method).withColumn("cosine_similarity", F.round("cosine_similarity", 6))


QUERIES["study_max"] = lambda spark, sf: _study_pool(spark, sf, "max")
QUERIES["study_mean"] = lambda spark, sf: _study_pool(spark, sf, "mean")
for _k, _f in (("study_max", "max"), ("study_mean", "avg")):
    SQL[_k] = with_ctes(f"""
SELECT study_id, label, embedding_type, round({_f}(cosine_similarity), 6) AS cosine_similarity
FROM scores_all GROUP BY study_id, label, embedding_type""", "scores_all")

@query("study_mean_wide")
def study_mean_wide(spark, sf):
    """Single prompt per label, wide image table with a column per label of the table, the study
    mean of every label column, one row per study and label."""
    labels = distinct_values(I.label_list(spark, sf), "label")
    pr = I.prompts(spark, sf).where(F.col("prompt_id") == 4)
    s = I.scores(spark, sf, measures=("cosine_similarity_4",), prompt_table=pr)
    wide = s.groupBy(*I.ID_COLS).pivot("label", labels).agg(F.first("cosine_similarity"))
    out = ev.study_mean_wide(wide, [str(lab) for lab in labels])
    return out.unpivot("study_id", [str(lab) for lab in labels], "label", "score").select(
        "study_id", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"))


SQL["study_mean_wide"] = with_ctes("""
SELECT st.study_id, l.label, round(avg(round(s, 5)), 6) AS score
FROM (SELECT DISTINCT study_id FROM pscore) st CROSS JOIN labelset l
LEFT JOIN (SELECT * FROM pscore WHERE prompt_id = 4) p ON p.study_id = st.study_id AND p.label = l.label
GROUP BY st.study_id, l.label""", "pscore", "labelset")


# ---------------------------------------------------------------- evaluation
def _validate_eval_inputs(spark, sf):
    tr = ev.labels_in_split(I.truth(spark, sf), I.split_table(spark, sf), "validate")
    pos = ev.positives(tr)
    n = ev.positive_counts(tr, I.label_list(spark, sf))
    s = I.scores(spark, sf, split="validate", measures=POOLED_MEASURES)
    pooled = ev.pool_both(s, digits=6)
    return pooled, pos, n


@query("split_labels_semi")
def split_labels_semi(spark, sf):
    return ev.labels_in_split(I.truth(spark, sf), I.split_table(spark, sf), "validate")


SQL["split_labels_semi"] = with_ctes("""
SELECT * FROM truth WHERE study_id IN (SELECT DISTINCT study_id FROM corpus WHERE split = 'validate')""",
                                     "truth", "corpus")


@query("positive_counts")
def positive_counts(spark, sf):
    tr = ev.labels_in_split(I.truth(spark, sf), I.split_table(spark, sf), "validate")
    return ev.positive_counts(tr, I.label_list(spark, sf))


_VALIDATE_CTES = [
    ("vtruth", "SELECT * FROM truth WHERE study_id IN (SELECT study_id FROM corpus WHERE split = 'validate')"),
    ("vpos", "SELECT DISTINCT label, study_id FROM vtruth WHERE value = 1"),
    ("ncnt", """SELECT l.label, CAST(count(DISTINCT p.study_id) AS BIGINT) AS n
                FROM labelset l LEFT JOIN vpos p ON l.label = p.label GROUP BY l.label"""),
    ("vscores", """SELECT * FROM scores_all WHERE split = 'validate'
                   AND embedding_type IN ('average_cosine_similarity', 'max_cosine_similarity')"""),
    ("pooled", """SELECT study_id, label, embedding_type, 'max' AS pool, round(max(cosine_similarity), 6) AS score
                  FROM vscores GROUP BY ALL
                  UNION ALL
                  SELECT study_id, label, embedding_type, 'mean', round(avg(cosine_similarity), 6)
                  FROM vscores GROUP BY ALL"""),
    ("ranked", """SELECT p.*, row_number() OVER (PARTITION BY label, embedding_type, pool
                  ORDER BY score DESC NULLS LAST, study_id) AS rk,
                  CASE WHEN q.study_id IS NULL THEN 0 ELSE 1 END AS hit
                  FROM pooled p LEFT JOIN vpos q USING (label, study_id)"""),
]
_EVAL_DEPS = ("truth", "corpus", "labelset", "scores_all")

SQL["positive_counts"] = with_ctes("SELECT label, n FROM ncnt", *_EVAL_DEPS, extra=_VALIDATE_CTES)


@query("precision_at_n")
def precision_at_n(spark, sf):
    pooled, pos, n = _validate_eval_inputs(spark, sf)
    out = ev.precision_at_n(pooled, pos, n, group_cols=("label", "embedding_type", "pool"))
    return out.withColumn("precision", F.round("precision", 6))


SQL["precision_at_n"] = with_ctes("""
SELECT r.label, r.embedding_type, r.pool, n.n,
       round(CAST(sum(CASE WHEN r.rk <= n.n THEN r.hit ELSE 0 END) AS DOUBLE) / nullif(n.n, 0), 6) AS precision
FROM ranked r JOIN ncnt n USING (label) GROUP BY r.label, r.embedding_type, r.pool, n.n""",
                                  *_EVAL_DEPS, extra=_VALIDATE_CTES)


@query("precision_at_k")
def precision_at_k(spark, sf):
    pooled, pos, _ = _validate_eval_inputs(spark, sf)
    out = ev.precision_at_k(pooled, pos, K_VALUES, group_cols=("label", "embedding_type", "pool"))
    return out.withColumn("precision", F.round("precision", 6))


SQL["precision_at_k"] = with_ctes(f"""
SELECT r.label, r.embedding_type, r.pool, k.top_k,
       round(CAST(sum(CASE WHEN r.rk <= k.top_k THEN r.hit ELSE 0 END) AS DOUBLE) / k.top_k, 6) AS precision
FROM ranked r CROSS JOIN (SELECT unnest({list(K_VALUES)}) AS top_k) k
GROUP BY r.label, r.embedding_type, r.pool, k.top_k""", *_EVAL_DEPS, extra=_VALIDATE_CTES)


# image-level percent precision, second naming of the measures, all splits
_IMG_MEASURES = PROMPT_MEASURES + (AVG_EMBEDDING, MAX_COSINE)


def _image_eval_inputs(spark, sf):
    # scores are dealt out by the join key once; counting and ranking both read that
    s = I.scores(spark, sf, measures=_IMG_MEASURES).repartition("label", "dicom_id").select(
        "dicom_id", "label",
        F.coalesce(F.element_at(F.create_map(*[x for kv in SECOND_NAMING.items() for x in map(F.lit, kv)]),
                                F.col("embedding_type")), F.col("embedding_type")).alias("embedding_type"),
        "cosine_similarity")
    c = I.corpus(spark, sf)
    tr = c.select("dicom_id", "label", F.lit(1).alias("value"))
    pos = ev.positives(tr, key="dicom_id")
    n = ev.positive_counts(tr, I.label_list(spark, sf), key="dicom_id")
    return s, pos, n


@query("precision_percent_image")
def precision_percent_image(spark, sf):
    s, pos, n = _image_eval_inputs(spark, sf)
    out = ev.precision_at_n(s, pos, n, key="dicom_id", scale=100.0, skip_empty=True)
    return out.select("label", "embedding_type", F.round("precision", 6).alias("correct_percentage"))


@query("precision_percent_topk")
def precision_percent_topk(spark, sf):
    s, pos, _ = _image_eval_inputs(spark, sf)
    out = ev.precision_at_k(s, pos, K_VALUES_PERCENT, key="dicom_id", scale=100.0)
    return out.select("label", "embedding_type", "top_k", F.round("precision", 6).alias("correct_percentage"))


_NAME_CASE = "CASE embedding_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SECOND_NAMING.items()) + " ELSE embedding_type END"
_IMAGE_CTES = [
    ("iscores", f"""SELECT dicom_id, label, {_NAME_CASE} AS embedding_type, cosine_similarity
                    FROM scores_all WHERE embedding_type <> 'average_cosine_similarity'"""),
    ("ipos", "SELECT DISTINCT label, dicom_id FROM corpus"),
    ("incnt", """SELECT l.label, CAST(count(DISTINCT p.dicom_id) AS BIGINT) AS n
                 FROM labelset l LEFT JOIN ipos p ON l.label = p.label GROUP BY l.label"""),
    ("iranked", """SELECT s.*, row_number() OVER (PARTITION BY label, embedding_type
                   ORDER BY cosine_similarity DESC NULLS LAST, dicom_id) AS rk,
                   CASE WHEN q.dicom_id IS NULL THEN 0 ELSE 1 END AS hit
                   FROM iscores s LEFT JOIN ipos q USING (label, dicom_id)"""),
]
SQL["precision_percent_image"] = with_ctes("""
SELECT r.label, r.embedding_type,
       round(100.0 * sum(CASE WHEN r.rk <= n.n THEN r.hit ELSE 0 END) / n.n, 6) AS correct_percentage
FROM iranked r JOIN incnt n USING (label) WHERE n.n > 0 GROUP BY r.label, r.embedding_type, n.n""",
                                           "scores_all", "corpus", "labelset", extra=_IMAGE_CTES)
SQL["precision_percent_topk"] = with_ctes(f"""
SELECT r.label, r.embedding_type, k.top_k,
       round(100.0 * sum(CASE WHEN r.rk <= k.top_k THEN r.hit ELSE 0 END) / k.top_k, 6) AS correct_percentage
FROM iranked r CROSS JOIN (SELECT unnest({list(K_VALUES_PERCENT)}) AS top_k) k
GROUP BY r.label, r.embedding_type, k.top_k""", "scores_all", "corpus", "labelset", extra=_IMAGE_CTES)


@query("topn_overlap")
def topn_overlap(spark, sf):
    """Single prompt per label; top-n image rows give a study set, compared to the positive studies."""
    tr = ev.labels_in_split(I.truth(spark, sf), I.split_table(spark, sf), "validate")
    pos = ev.positives(tr)
    n = ev.positive_counts(tr, I.label_list(spark, sf))
    pr = I.prompts(spark, sf).where(F.col("prompt_id") == 4)
    s = I.scores(spark, sf, split="validate", measures=("cosine_similarity_4",), prompt_table=pr)
    out = ev.top_n_overlap(s, pos, n, key="study_id", tie_col="dicom_id")
    return out.withColumn("overlap_pct", F.round("overlap_pct", 6))


SQL["topn_overlap"] = with_ctes("""
SELECT l.label, CAST(coalesce(a.inter, 0) AS BIGINT) AS intersection,
       CAST(coalesce(a.uni, 0) AS BIGINT) AS union_size,
       round(coalesce(100.0 * a.inter / nullif(a.uni, 0), 0.0), 6) AS overlap_pct
FROM ncnt l LEFT JOIN (
  SELECT label, count(*) FILTER (WHERE t.study_id IS NOT NULL AND p.study_id IS NOT NULL) AS inter,
         count(*) AS uni
  FROM (SELECT DISTINCT r.label, r.study_id FROM (
          SELECT label, study_id, row_number() OVER (PARTITION BY label
                 ORDER BY round(s, 5) DESC NULLS LAST, dicom_id) AS rk
          FROM pscore WHERE prompt_id = 4 AND split = 'validate') r
        JOIN ncnt USING (label) WHERE r.rk <= ncnt.n) t
  FULL OUTER JOIN vpos p USING (label, study_id) GROUP BY label) a USING (label)""",
                                *_EVAL_DEPS, "pscore", extra=_VALIDATE_CTES)


@query("pct_above_threshold")
def pct_above_threshold(spark, sf):
    pr = I.prompts(spark, sf).where(F.col("prompt_id") == 4)
    s = I.scores(spark, sf, measures=("cosine_similarity_4",), prompt_table=pr)
    return ev.pct_above(s, THRESHOLD).withColumn("pct_above", F.round("pct_above", 6))


SQL["pct_above_threshold"] = with_ctes(f"""
SELECT label, round(100.0 * count(*) FILTER (WHERE round(s, 5) > {THRESHOLD}) / count(*), 6) AS pct_above
FROM pscore WHERE prompt_id = 4 GROUP BY label""", "pscore")
