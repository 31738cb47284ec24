"""Query keys for model comparison, model grid, pipelines, pixels, encoders, IO and bulk runs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight import __version__
from vecsight.constants import (AVG_COSINE, AVG_EMBEDDING, MAX_COSINE, POOLING_DISPLAY,
                                POSITIVE_TEMPLATES, RUN_NAME_PATTERN, SKIPPED_POOLING)
from vecsight.functions.text import fill_template, image_path, run_name_parts
from vecsight.operators import encoders as EN
from vecsight.operators import evaluate as ev
from vecsight.operators import pixels as PX
from vecsight.operators import reshape as RS
from vecsight.operators.manifest import distinct_values
from vecsight.operators.pipelines import compare_models, comparison_view, run_display_name
from vecsight.operators.scoring import score_library
from vecsight.plans import inputs as I
from vecsight.plans.oracle_ctes import with_ctes
from vecsight.sources import files as IO
from vecsight.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- mock models
MODELS = (("model_run_1_True_ig_tg", (1,)), ("model_run_2_False_igl_tg", (1, 2)),
          ("model_run_3_True_igl_tgl", (1, 2, 3, 4)))
_MODEL_MEASURES = (AVG_EMBEDDING, AVG_COSINE, MAX_COSINE)
_ACC_COLS = [f"{m}_{p}_accuracy" for m in _MODEL_MEASURES for p in ("max", "mean")]
STAGE_VERSION = "scores-v1"


def _model_scores(spark, sf, subset) -> DataFrame:
    pr = I.prompts(spark, sf).where(F.col("prompt_id").isin(*subset))
    return I.scores(spark, sf, split="validate", measures=_MODEL_MEASURES, prompt_table=pr)


def _truth_validate(spark, sf):
    tr = ev.labels_in_split(I.truth(spark, sf), I.split_table(spark, sf), "validate")
    return ev.positives(tr), ev.positive_counts(tr, I.label_list(spark, sf))


def _all_model_scores(spark, sf) -> DataFrame:
    """Scores of all models in one pass over the library: the model is part of the prompt key."""
    pr = I.prompts(spark, sf)
    sets = [pr.where(F.col("prompt_id").isin(*subset)).withColumn("label", F.concat(F.lit(f"{k}|"), F.col("label").cast("string")))
            for k, (_, subset) in enumerate(MODELS)]
    s = I.scores(spark, sf, split="validate", measures=_MODEL_MEASURES, prompt_table=reduce(DataFrame.unionByName, sets))
    names = F.array(*[F.lit(name) for name, _ in MODELS])
    return (s.withColumn("model", F.element_at(names, F.substring_index("label", "|", 1).cast("int") + 1))
            .withColumn("label", F.substring_index("label", "|", -1).cast("int")))


def _model_accuracies(spark, sf) -> DataFrame:
    """(Model, Label, Pooling Method, Accuracy) of all models."""
    pos, n = _truth_validate(spark, sf)
    g = _all_model_scores(spark, sf).groupBy("model", "study_id", "label", "embedding_type").agg(
        F.max("cosine_similarity").alias("max"), F.avg("cosine_similarity").alias("mean"))
    pooled = g.select("model", "study_id", "label", "embedding_type", F.inline(F.array(
        F.struct(F.lit("max").alias("pool"), F.round("max", 6).alias("cosine_similarity")),
        F.struct(F.lit("mean").alias("pool"), F.round("mean", 6).alias("cosine_similarity")))))
    p = ev.precision_at_n(pooled, pos, n, group_cols=("model", "label", "embedding_type", "pool"))
    return p.select(F.col("model").alias("Model"), F.col("label").alias("Label"), F.concat_ws(
        "_", "embedding_type", "pool", F.lit("accuracy")).alias("Pooling Method"), F.round("precision", 6).alias("Accuracy"))


def _comparison(out: DataFrame) -> DataFrame:
    return out.select("Model", "Label", "Pooling", F.round("Accuracy", 6).alias("Accuracy"),
                      F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"))


@query("model_compare")
def model_compare(spark, sf):
    return _comparison(comparison_view(_model_accuracies(spark, sf)))


@query("model_files_compare")
def model_files_compare(spark, sf):
    """A3: one result file per model (wide accuracy tables), read back and compared."""
    root = IO.scratch_dir(spark, "results")
    wide = _model_accuracies(spark, sf).groupBy("Model", "Label").pivot("Pooling Method", _ACC_COLS).agg(F.first("Accuracy"))
    wide.write.partitionBy("Model").option("header", "true").csv(root)
    schema = "Label INT, " + ", ".join(f"{c} DOUBLE" for c in _ACC_COLS)
    return _comparison(compare_models({name: IO.read_csv(spark, f"{root}/Model={name}", schema) for name, _ in MODELS}))


def _sql_model_ctes(tag: str, subset) -> list[tuple[str, str]]:
    ids = ", ".join(str(i) for i in subset)
    return [
        (f"pav_{tag}", f"""SELECT label, list_transform(a, lambda x: x / greatest(sqrt(list_sum(
              list_transform(a, lambda y: y * y))), 1e-12)) AS an FROM (
            SELECT label, list(x ORDER BY pos) AS a FROM (SELECT label, pos, avg(x) AS x FROM (
              SELECT label, generate_subscripts(q, 1) AS pos, unnest(q) AS x FROM pnorm WHERE prompt_id IN ({ids}))
            GROUP BY label, pos) GROUP BY label)"""),
        (f"ms_{tag}", f"""
            SELECT study_id, label, 'average_cosine_similarity' AS embedding_type, round(avg(s), 5) AS cs
            FROM pscore WHERE split = 'validate' AND prompt_id IN ({ids}) GROUP BY dicom_id, study_id, label
            UNION ALL
            SELECT study_id, label, 'max_cosine_similarity', round(max(s), 5)
            FROM pscore WHERE split = 'validate' AND prompt_id IN ({ids}) GROUP BY dicom_id, study_id, label
            UNION ALL
            SELECT c.study_id, a.label, 'average_embedding', round(list_dot_product(c.embedding::DOUBLE[], a.an), 5)
            FROM corpus c CROSS JOIN pav_{tag} a WHERE c.split = 'validate'"""),
        (f"pl_{tag}", f"""
            SELECT study_id, label, embedding_type, 'max' AS pool, round(max(cs), 6) AS score FROM ms_{tag} GROUP BY ALL
            UNION ALL SELECT study_id, label, embedding_type, 'mean', round(avg(cs), 6) FROM ms_{tag} GROUP BY ALL"""),
        (f"acc_{tag}", f"""
            SELECT r.label, r.embedding_type, r.pool, n.n,
                   round(CAST(sum(CASE WHEN r.rk <= n.n THEN r.hit ELSE 0 END) AS DOUBLE) / nullif(n.n, 0), 6) AS precision
            FROM (SELECT p.*, row_number() OVER (PARTITION BY label, embedding_type, pool
                         ORDER BY score DESC NULLS LAST, study_id) AS rk,
                         CASE WHEN q.study_id IS NULL THEN 0 ELSE 1 END AS hit
                  FROM pl_{tag} p LEFT JOIN vpos q USING (label, study_id)) r
            JOIN ncnt n USING (label) GROUP BY r.label, r.embedding_type, r.pool, n.n"""),
    ]


_MODEL_DEPS = ("truth", "corpus", "labelset", "pscore", "pnorm")
_VAL = [
    ("vtruth", "SELECT * FROM truth WHERE study_id IN (SELECT study_id FROM corpus WHERE split = 'validate')"),
    ("vpos", "SELECT DISTINCT label, study_id FROM vtruth WHERE value = 1"),
    ("ncnt", """SELECT l.label, CAST(count(DISTINCT p.study_id) AS BIGINT) AS n
                FROM labelset l LEFT JOIN vpos p ON l.label = p.label GROUP BY l.label"""),
]
_ALL_MODEL_CTES = _VAL + [c for i, (_, sub) in enumerate(MODELS) for c in _sql_model_ctes(str(i), sub)]


def _sql_display(col: str) -> str:
    return (f"CASE WHEN regexp_matches({col}, '{RUN_NAME_PATTERN}') THEN "
            f"regexp_extract({col}, '{RUN_NAME_PATTERN}', 2) || ', ' || upper(regexp_extract({col}, "
            f"'{RUN_NAME_PATTERN}', 3)) || '_' || upper(regexp_extract({col}, '{RUN_NAME_PATTERN}', 4)) "
            f"ELSE {col} END")


_POOL_CASE = "CASE pm " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POOLING_DISPLAY.items()) + " ELSE pm END"
SQL["model_compare"] = with_ctes(f"""
SELECT Model, Label, Pooling, round(Accuracy, 6) AS Accuracy, round(min(Accuracy) OVER (), 6) AS y_min,
       round(max(Accuracy) OVER (), 6) AS y_max FROM (
  SELECT {_sql_display('model')} AS Model, CAST(label AS VARCHAR) AS Label, {_POOL_CASE} AS Pooling,
         precision AS Accuracy
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, label, embedding_type || '_' || pool || '_accuracy' AS pm, precision FROM acc_{i}"
    for i, (name, _) in enumerate(MODELS)) + f""")
  WHERE pm NOT IN ({', '.join(f"'{s}'" for s in SKIPPED_POOLING)}))""", *_MODEL_DEPS, extra=_ALL_MODEL_CTES)


SQL["model_files_compare"] = SQL["model_compare"]


@query("model_grid")
def model_grid(spark, sf):
    """L1 + A13: every model's score stage is materialised once (read back on reruns);
    the accuracy of all models is one plan over their union."""
    pos, n = _truth_validate(spark, sf)
    state = IO.input_state(spark, f"{sf.rstrip('/')}/embeddings.parquet")
    staged = []
    for name, subset in MODELS:
        path = IO.stage_dir(spark, STAGE_VERSION, __version__, sf, state, name)
        s = IO.materialize(spark, path, lambda subset=subset: _model_scores(spark, sf, subset))
        staged.append(s.withColumn("model", F.lit(name)))
    scores = reduce(DataFrame.unionByName, staged)
    g = scores.groupBy("model", "study_id", "label", "embedding_type").agg(
        F.max("cosine_similarity").alias("max"), F.avg("cosine_similarity").alias("mean"))
    pooled = g.select("model", "study_id", "label", "embedding_type", F.inline(F.array(
        F.struct(F.lit("max").alias("pool"), F.round("max", 6).alias("cosine_similarity")),
        F.struct(F.lit("mean").alias("pool"), F.round("mean", 6).alias("cosine_similarity")))))
    p = ev.precision_at_n(pooled, pos, n, group_cols=("model", "label", "embedding_type", "pool"))
    return p.select("model", "label", "embedding_type", "pool", "n", F.round("precision", 6).alias("precision"))


SQL["model_grid"] = with_ctes(" UNION ALL ".join(
    f"SELECT '{name}' AS model, label, embedding_type, pool, n, precision FROM acc_{i}"
    for i, (name, _) in enumerate(MODELS)), *_MODEL_DEPS, extra=_ALL_MODEL_CTES)


@query("run_name_parse")
def run_name_parse(spark, sf):
    """I25 over run names derived from orders (finished orders give well-formed names)."""
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("run_"), F.col("o_orderkey").cast("string"))) \
        .otherwise(F.concat(
            F.lit("model_run_"), (F.col("o_orderkey") % 10).cast("string"), F.lit("_"),
            F.when(F.col("o_orderstatus") == "F", "True").otherwise("False"), F.lit("_"),
            F.when(F.col("o_custkey") % 2 == 0, "ig").otherwise("igl"), F.lit("_"),
            F.when(F.col("o_totalprice") > 100000, "tg").otherwise("tgl")))
    n = o.select("o_orderkey", name.alias("name"))
    run, flag, img, txt = run_name_parts("name")
    return n.select("o_orderkey", "name",
                    F.regexp_extract("name", RUN_NAME_PATTERN, 1).try_cast("int").alias("run"),
                    F.when(F.col("name").rlike(RUN_NAME_PATTERN), flag).alias("flag"),
                    F.when(F.col("name").rlike(RUN_NAME_PATTERN), img).alias("image_loss"),
                    F.when(F.col("name").rlike(RUN_NAME_PATTERN), txt).alias("text_loss"),
                    run_display_name("name").alias("display"))


SQL["run_name_parse"] = f"""
SELECT o_orderkey, name, TRY_CAST(regexp_extract(name, '{RUN_NAME_PATTERN}', 1) AS INTEGER) AS run,
       CASE WHEN regexp_matches(name, '{RUN_NAME_PATTERN}') THEN regexp_extract(name, '{RUN_NAME_PATTERN}', 2) = 'True' END AS flag,
       CASE WHEN regexp_matches(name, '{RUN_NAME_PATTERN}') THEN regexp_extract(name, '{RUN_NAME_PATTERN}', 3) END AS image_loss,
       CASE WHEN regexp_matches(name, '{RUN_NAME_PATTERN}') THEN regexp_extract(name, '{RUN_NAME_PATTERN}', 4) END AS text_loss,
       {_sql_display('name')} AS display
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'run_' || o_orderkey ELSE
        'model_run_' || (o_orderkey % 10) || '_' || CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END || '_'
        || CASE WHEN o_custkey % 2 = 0 THEN 'ig' ELSE 'igl' END || '_'
        || CASE WHEN o_totalprice > 100000 THEN 'tg' ELSE 'tgl' END END AS name FROM orders)"""


# ---------------------------------------------------------------- single-prompt pipeline
def _single_prompt_scores(spark, sf):
    c = ev.keep_split(I.corpus(spark, sf), "validate").withColumn(
        "file_path", image_path("files", "subject_id", "study_id", "dicom_id"))
    pr = I.prompts(spark, sf).where(F.col("prompt_id") == 4)
    return score_library(c, pr, I.ID_COLS + ["file_path"], measures=("cosine_similarity_4",)) \
        .withColumn("cosine_similarity", F.round("cosine_similarity", 5))


@query("single_prompt_images")
def single_prompt_images(spark, sf):
    """L5, image table: split -> paths -> one prompt per label, one row per image and label."""
    return _single_prompt_scores(spark, sf).select(*I.ID_COLS, "file_path", "label", "cosine_similarity")


SQL["single_prompt_images"] = with_ctes("""
SELECT subject_id, study_id, dicom_id,
       'files/p' || substr(CAST(subject_id AS VARCHAR), 1, 2) || '/p' || subject_id || '/s' || study_id || '/' || dicom_id || '.jpg' AS file_path,
       label, round(s, 5) AS cosine_similarity
FROM pscore WHERE prompt_id = 4 AND split = 'validate'""", "pscore")


@query("single_prompt_pipeline")
def single_prompt_pipeline(spark, sf):
    """L5, study table: the image table wide over the labels of the table, then the study mean;
    one row per study and label."""
    labels = distinct_values(I.label_list(spark, sf), "label")
    names = [str(lab) for lab in labels]
    images = _single_prompt_scores(spark, sf).groupBy(*I.ID_COLS, "file_path").pivot("label", labels) \
        .agg(F.first("cosine_similarity"))
    study = images.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_images"), *[F.avg(f"`{c}`").alias(c) for c in names])
    return study.unpivot(["study_id", "n_images"], names, "label", "score").select(
        "study_id", "n_images", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"))


SQL["single_prompt_pipeline"] = with_ctes("""
SELECT st.study_id, st.n_images, l.label, round(avg(round(s, 5)), 6) AS score
FROM (SELECT study_id, count(DISTINCT dicom_id) AS n_images FROM pscore WHERE split = 'validate' GROUP BY study_id) st
CROSS JOIN labelset l
LEFT JOIN (SELECT * FROM pscore WHERE prompt_id = 4) p ON p.study_id = st.study_id AND p.label = l.label
GROUP BY st.study_id, st.n_images, l.label""", "pscore", "labelset")


# ---------------------------------------------------------------- pixels
def _pixels(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 4096).alias("px"))


@query("pixel_rescale")
def pixel_rescale(spark, sf):
    p = _pixels(spark, sf).withColumn("u8", PX.to_uint8("px"))
    return p.select("vec_id", F.round(F.array_min("px"), 1).alias("px_min"),
                    F.round(F.array_max("px"), 1).alias("px_max"),
                    F.aggregate("u8", F.lit(0).cast("long"), lambda a, x: a + x).alias("u8_sum"),
                    F.array_max("u8").alias("u8_max"),
                    F.size(F.filter("u8", lambda x: x == 0)).cast("long").alias("n_zero"))


SQL["pixel_rescale"] = """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4096) AS px FROM embeddings),
q AS (SELECT vec_id, px, list_max(px) AS mx FROM p),
u AS (SELECT vec_id, px, CASE WHEN mx > 0 THEN list_transform(px, lambda x:
        CAST(least(floor(greatest(x, 0.0) / mx * 255), 255) AS INTEGER)) END AS u8 FROM q)
SELECT vec_id, round(list_min(px), 1) AS px_min, round(list_max(px), 1) AS px_max,
       CAST(list_sum(u8) AS BIGINT) AS u8_sum, list_max(u8) AS u8_max,
       CAST(len(list_filter(u8, lambda x: x = 0)) AS BIGINT) AS n_zero FROM u"""


@query("pixel_shape_check")
def pixel_shape_check(spark, sf):
    p = _pixels(spark, sf)
    shape = (F.when(F.col("label") == 9, F.array(*[F.lit(x) for x in (4, 4, 3)]))
             .when(F.col("label") % 2 == 0, F.array(F.lit(8), F.lit(8)))
             .otherwise(F.array(*[F.lit(x) for x in (4, 4, 4)])))
    s = p.select("vec_id", "px", shape.alias("shape"))
    return s.select("vec_id", F.size("shape").alias("ndim"), PX.shape_ok("shape").alias("shape_ok"),
                    PX.shape_reason("shape", "px").alias("reason"))


SQL["pixel_shape_check"] = """
SELECT vec_id, CAST(len(shape) AS INTEGER) AS ndim,
       len(shape) = 2 OR (len(shape) = 3 AND shape[3] = 3) AS shape_ok,
       CASE WHEN NOT (len(shape) = 2 OR (len(shape) = 3 AND shape[3] = 3)) THEN 'bad shape'
            WHEN list_product(shape) <> len(embedding) THEN 'size mismatch' END AS reason
FROM (SELECT vec_id, embedding, CASE WHEN label = 9 THEN [4, 4, 3] WHEN label % 2 = 0 THEN [8, 8]
                                     ELSE [4, 4, 4] END AS shape FROM embeddings)"""


# ---------------------------------------------------------------- encoders / decoders
@query("encode_udf")
def encode_udf(spark, sf):
    """K1-K3: documents and prompt texts through one pluggable encoder, then scored."""
    make = EN.hashing_text_encoder(64)
    docs = EN.encode(table(spark, sf, "documents").select("doc_id", "text"), "text", make, "embedding")
    labels = table(spark, sf, "embeddings").select("label").distinct()
    tmpl = F.array(*[F.struct(F.lit(i + 1).alias("prompt_id"), F.lit(t).alias("template"))
                     for i, t in enumerate(POSITIVE_TEMPLATES)])
    prompts = labels.select("label", F.inline(tmpl)).select(
        "label", "prompt_id", fill_template("template", F.concat(F.lit("finding "), F.col("label").cast("string")))
        .alias("prompt"))
    pvec = EN.encode(prompts, "prompt", make, "qvec")
    s = score_library(docs, pvec, ["doc_id"], measures=(MAX_COSINE,))
    return EN.best_label(s, "doc_id").select("doc_id", "label",
                                             F.round("cosine_similarity", 6).alias("cosine_similarity"))


@query("image_encode_scores")
def image_encode_scores(spark, sf):
    """K1, K3, K6: image bytes stored in a table -> decoder -> resize and crop -> encoder -> scores
    of every image against every prompt.  The images are 8 x 16 with the picture in the middle."""
    def as_file(batches):
        for pdf in batches:
            images = [np.pad(np.asarray(px, dtype=np.float64).reshape(8, 8), ((0, 0), (4, 4))) for px in pdf["px"]]
            yield pd.DataFrame({"dicom_id": pdf["vec_id"], "content": [EN.npy_bytes(im) for im in images]})

    path = IO.scratch_dir(spark, "images")
    _pixels(spark, sf).select("vec_id", "px").mapInPandas(as_file, "dicom_id long, content binary").write.parquet(path)
    vectors = EN.encode_images(spark.read.parquet(path), EN.flat_image_encoder(8))
    s = score_library(vectors, I.prompts(spark, sf), ["dicom_id"], measures=(MAX_COSINE,))
    return s.select("dicom_id", "label", F.round("cosine_similarity", 5).alias("cosine_similarity"))


SQL["image_encode_scores"] = with_ctes("""
SELECT e.vec_id AS dicom_id, p.label, round(max(list_dot_product(list_transform(v, lambda x: x / n), p.qn)), 5) AS cosine_similarity
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
      FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 4096) AS v FROM embeddings)) e CROSS JOIN pn p
GROUP BY e.vec_id, p.label""", "pn")


@query("image_resize")
def image_resize(spark, sf):
    """K6: every image, as 4 x 16 pixels, made smaller (2 x 2) and larger (6 x 6): the shorter side
    resized, the middle cut out; one row per pixel."""
    def run(batches):
        for pdf in batches:
            for size in (2, 6):
                cut = [EN.resize_center_crop(np.asarray(px, dtype=np.float64).reshape(4, 16), size).reshape(-1) for px in pdf["px"]]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "size": size, "cut": cut})

    cut = _pixels(spark, sf).select("vec_id", "px").mapInPandas(run, "vec_id long, size int, cut array<double>")
    return cut.select("vec_id", "size", F.posexplode("cut").alias("at", "value")).withColumn("value", F.round("value", 3) + F.lit(0.0))


SQL["image_resize"] = """
WITH w0 AS (SELECT size, old, o, i, greatest(0::DOUBLE, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * (4::DOUBLE / size)) / greatest(4::DOUBLE / size, 1::DOUBLE)) AS w
            FROM (SELECT unnest([2, 6]) AS size), (SELECT unnest([4, 16]) AS old), (SELECT unnest(range(24)) AS o), (SELECT unnest(range(16)) AS i)
            WHERE o < old * size // 4 AND i < old),
w AS (SELECT size, old, o, i, w / sum(w) OVER (PARTITION BY size, old, o) AS w FROM w0 QUALIFY w0.w > 0),
px AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS at, unnest(embedding)::DOUBLE * 4096 AS x FROM embeddings)
SELECT vec_id, v.size, CAST(v.o * v.size + h.o - 3 * v.size // 2 AS INTEGER) AS at, round(sum(x * v.w * h.w), 3) + 0::DOUBLE AS value
FROM px JOIN w v ON v.old = 4 AND v.i = px.at // 16 JOIN w h ON h.old = 16 AND h.size = v.size AND h.i = px.at % 16
WHERE h.o >= 3 * v.size // 2 AND h.o < 3 * v.size // 2 + v.size
GROUP BY vec_id, v.size, v.o, h.o"""


@query("decode_job")
def decode_job(spark, sf):
    """K5 + A14 + A6: write every pixel array as a file, list and decode them back."""
    root = IO.scratch_dir(spark, "decode")
    src = _pixels(spark, sf).select(F.concat(F.lit("series"), F.col("label").cast("string")).alias("folder"),
                                    F.concat(F.lit("img"), F.col("vec_id").cast("string")).alias("name"), "px")
    EN.write_npy_files(src, root, "folder", "name", "px", (8, 8))
    listing = IO.list_files(spark, root, "*.npy")
    dec = EN.decode(IO.read_binary(spark, root, "*.npy"))
    out = dec.join(listing, dec["path"] == listing["file_path"]).withColumn("u8", PX.to_uint8("pixels"))
    return out.select("folder_name", "image_name", "shape", PX.shape_ok("shape").alias("shape_ok"),
                      F.round(F.array_max("pixels"), 1).alias("px_max"),
                      F.aggregate("u8", F.lit(0).cast("long"), lambda a, x: a + x).alias("u8_sum"))


SQL["decode_job"] = """
WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 4096) AS px FROM embeddings),
q AS (SELECT *, list_max(px) AS mx FROM p)
SELECT 'series' || label AS folder_name, 'img' || vec_id || '.npy' AS image_name, [8, 8]::INTEGER[] AS shape,
       true AS shape_ok, round(mx, 1) AS px_max,
       CASE WHEN mx > 0 THEN CAST(list_sum(list_transform(px, lambda x:
            CAST(least(floor(greatest(x, 0.0) / mx * 255), 255) AS INTEGER))) AS BIGINT) END AS u8_sum
FROM q"""


@query("csv_roundtrip")
def csv_roundtrip(spark, sf):
    """A1, A4: the labels table through plain and gzip CSV and back (explicit schema)."""
    root = IO.scratch_dir(spark, "csv")
    lab = table(spark, sf, "labels")
    IO.write_csv(lab, f"{root}/plain")
    IO.write_csv(lab, f"{root}/gz", gzip=True)
    schema = "doc_id BIGINT, quality INT, toxic INT"
    plain = IO.read_csv(spark, f"{root}/plain", schema)
    gz = IO.read_csv(spark, f"{root}/gz", schema)
    both = gz.join(plain.select("doc_id", F.struct("quality", "toxic").alias("_p")), "doc_id")
    return both.select(
        "doc_id", "quality", "toxic",
        ((F.col("_p.quality") == F.col("quality")) & (F.col("_p.toxic") == F.col("toxic"))).alias("same"))


SQL["csv_roundtrip"] = "SELECT doc_id, quality, toxic, true AS same FROM labels"


# ---------------------------------------------------------------- bulk keys (all lineitem rows)
_BULK_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bulk_pooled(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("study_id"), *_BULK_COLS)
    long = RS.stack_columns(li, ["study_id"], _BULK_COLS, "embedding_type", "cosine_similarity")
    g = long.groupBy("study_id", "embedding_type").agg(F.max("cosine_similarity").alias("max"),
                                                       F.avg("cosine_similarity").alias("mean"))
    return g.select("study_id", "embedding_type", F.inline(F.array(
        F.struct(F.lit("max").alias("pool"), F.round("max", 6).alias("cosine_similarity")),
        F.struct(F.lit("mean").alias("pool"), F.round("mean", 6).alias("cosine_similarity")))))


@query("bulk_unpivot_pool")
def bulk_unpivot_pool(spark, sf):
    return _bulk_pooled(spark, sf)


_BULK_SQL = [
    ("bl", " UNION ALL ".join(f"SELECT l_orderkey AS study_id, '{c}' AS embedding_type, {c} AS v FROM lineitem"
                              for c in _BULK_COLS)),
    ("bp", """SELECT study_id, embedding_type, 'max' AS pool, round(max(v), 6) AS cosine_similarity FROM bl GROUP BY ALL
              UNION ALL SELECT study_id, embedding_type, 'mean', round(avg(v), 6) FROM bl GROUP BY ALL"""),
]
SQL["bulk_unpivot_pool"] = with_ctes("SELECT study_id, embedding_type, pool, cosine_similarity FROM bp",
                                     extra=_BULK_SQL)


@query("bulk_precision")
def bulk_precision(spark, sf):
    """D15 over every order: positive studies are orders with a returned line."""
    pooled = _bulk_pooled(spark, sf).withColumn("label", F.lit("R"))
    li = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    pos = li.select(F.lit("R").alias("label"), F.col("l_orderkey").alias("study_id")).distinct()
    n = pos.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    p = ev.precision_at_n(pooled, pos, n, group_cols=("label", "embedding_type", "pool"))
    return p.select("embedding_type", "pool", "n", F.round("precision", 6).alias("precision"))


SQL["bulk_precision"] = with_ctes("""
SELECT r.embedding_type, r.pool, (SELECT count(*) FROM pos) AS n,
       round(CAST(sum(CASE WHEN r.rk <= (SELECT count(*) FROM pos) THEN r.hit ELSE 0 END) AS DOUBLE)
             / (SELECT count(*) FROM pos), 6) AS precision
FROM (SELECT b.*, row_number() OVER (PARTITION BY embedding_type, pool
             ORDER BY cosine_similarity DESC NULLS LAST, b.study_id) AS rk,
             CASE WHEN p.study_id IS NULL THEN 0 ELSE 1 END AS hit
      FROM bp b LEFT JOIN pos p USING (study_id)) r
GROUP BY r.embedding_type, r.pool""", extra=_BULK_SQL + [
    ("pos", "SELECT DISTINCT l_orderkey AS study_id FROM lineitem WHERE l_returnflag = 'R'")])
