"""Query keys for filters, paths, parsing, coercion, prompts and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecsight.constants import NEGATIVE_TEMPLATES, POSITIVE_TEMPLATES, SINGLE_TEMPLATE
from vecsight.functions import text as TX
from vecsight.functions import vectors as V
from vecsight.operators import evaluate as ev
from vecsight.operators.scoring import mean_vector
from vecsight.plans import inputs as I
from vecsight.plans.oracle_ctes import with_ctes
from vecsight.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("split_filter")
def split_filter(spark, sf):
    return ev.keep_split(I.corpus(spark, sf), "validate").select(*I.ID_COLS, "split")


@query("split_set_filter")
def split_set_filter(spark, sf):
    return ev.keep_splits(I.corpus(spark, sf), ["validate", "train"]).select(*I.ID_COLS, "split")


SQL["split_filter"] = with_ctes(
    "SELECT subject_id, study_id, dicom_id, split FROM corpus WHERE split = 'validate'", "corpus")
SQL["split_set_filter"] = with_ctes(
    "SELECT subject_id, study_id, dicom_id, split FROM corpus WHERE split IN ('validate', 'train')", "corpus")


@query("image_path")
def image_path(spark, sf):
    c = I.corpus(spark, sf)
    return c.select("dicom_id", TX.image_path("files", "subject_id", "study_id", "dicom_id")
                    .alias("file_path"))


SQL["image_path"] = with_ctes("""
SELECT dicom_id, 'files/p' || substr(CAST(subject_id AS VARCHAR), 1, 2) || '/p' || subject_id
       || '/s' || study_id || '/' || dicom_id || '.jpg' AS file_path FROM corpus""", "corpus")


@query("path_parts")
def path_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return p.select("page_id", "path", TX.parent_name("path").alias("folder_name"),
                    TX.base_name("path").alias("image_name"))


SQL["path_parts"] = """
SELECT page_id, path, string_split(path, '/')[-2] AS folder_name, string_split(path, '/')[-1] AS image_name
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)"""


@query("metadata_search")
def metadata_search(spark, sf):
    """Equality + membership search, then a second search constrained by its keys."""
    first = (table(spark, sf, "orders")
             .where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
             .select(F.col("o_orderkey").alias("l_orderkey")))
    second = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    return second.join(first, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


SQL["metadata_search"] = """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


@query("vector_text_roundtrip")
def vector_text_roundtrip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding",
                                              V.vector_to_text("embedding", 4).alias("txt"))
    p = e.select("vec_id", "embedding", V.parse_vector_text("txt").alias("parsed"))
    return p.select(
        "vec_id", F.size("parsed").cast("long").alias("n_values"),
        F.round(F.aggregate("parsed", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("checksum"),
        F.round(F.array_max(F.zip_with("parsed", "embedding",
                                       lambda a, b: F.abs(a.cast("double") - F.round(b.cast("double"), 4)))),
                6).alias("max_err"))


SQL["vector_text_roundtrip"] = """
SELECT vec_id, len(embedding) AS n_values,
       round(list_sum(list_transform(embedding, lambda x: CAST(CAST(round(x::DOUBLE, 4) AS FLOAT) AS DOUBLE))), 4) AS checksum,
       round(list_max(list_transform(embedding, lambda x: abs(CAST(CAST(round(x::DOUBLE, 4) AS FLOAT) AS DOUBLE)
                                                          - round(x::DOUBLE, 4)))), 6) AS max_err
FROM embeddings"""


@query("coerce_numeric")
def coerce_numeric(spark, sf):
    e = table(spark, sf, "events")
    m = F.col("event_id") % 10
    txt = (F.when(m == 0, "NaN").when(m == 1, "").when(m == 2, "abc")
           .otherwise(F.regexp_replace("props", "[^0-9]", "")))
    return e.select("event_id", txt.alias("text")).withColumn("value", TX.coerce_double("text"))


SQL["coerce_numeric"] = """
SELECT event_id, text, CASE WHEN isnan(v) THEN NULL ELSE v END AS value FROM (
  SELECT event_id, text, TRY_CAST(text AS DOUBLE) AS v FROM (
    SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN 'abc'
           ELSE regexp_replace(props, '[^0-9]', '', 'g') END AS text FROM events))"""

_TEMPLATE_SETS = (("positive", POSITIVE_TEMPLATES), ("single", SINGLE_TEMPLATE),
                  ("negative", NEGATIVE_TEMPLATES))


@query("prompt_expand")
def prompt_expand(spark, sf):
    """Every label of the library x every template (no join: a literal template array)."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    tmpl = F.array(*[F.struct(F.lit(s).alias("template_set"), F.lit(i + 1).alias("prompt_id"),
                              F.lit(t).alias("template"))
                     for s, ts in _TEMPLATE_SETS for i, t in enumerate(ts)])
    x = labels.select("label", F.inline(tmpl))
    return x.select("label", "template_set", "prompt_id",
                    TX.fill_template("template", F.concat(F.lit("finding "), F.col("label").cast("string")))
                    .alias("prompt"))


SQL["prompt_expand"] = """
SELECT l.label, t.template_set, t.prompt_id, replace(t.template, '{label}', 'finding ' || l.label) AS prompt
FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN (VALUES """ + ", ".join(
    f"('{s}', {i + 1}, '{t}')" for s, ts in _TEMPLATE_SETS for i, t in enumerate(ts)) + \
    ") t(template_set, prompt_id, template)"


@query("l2_normalize")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding",
                                              V.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", F.round(V.l2_norm("embedding"), 6).alias("norm_in"),
                    F.round(V.l2_norm("u"), 6).alias("norm_out"),
                    F.round(F.element_at("u", 1), 6).alias("first_out"),
                    F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_out"))


SQL["l2_normalize"] = """
SELECT vec_id, round(nrm, 6) AS norm_in,
       round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm_out,
       round(u[1], 6) AS first_out, round(list_sum(u), 6) AS sum_out
FROM (SELECT vec_id, nrm, list_transform(e, lambda x: x / greatest(nrm, 1e-12)) AS u FROM (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
  FROM embeddings))"""


@query("mean_vector")
def mean_vector_q(spark, sf):
    m = mean_vector(table(spark, sf, "embeddings"), ["label"], "embedding")
    return m.select("label", F.size("mean_vec").cast("long").alias("dims"),
                    F.round(F.aggregate("mean_vec", F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"),
                    F.round(V.l2_norm("mean_vec"), 6).alias("mean_norm"),
                    F.round(F.element_at("mean_vec", 1), 6).alias("first"))


SQL["mean_vector"] = """
SELECT label, len(m) AS dims, round(list_sum(m), 6) AS mean_sum,
       round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS mean_norm, round(m[1], 6) AS first
FROM (SELECT label, list(x ORDER BY pos) AS m FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""
