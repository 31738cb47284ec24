"""Query keys for reshaping, prevalence, manifest, pairing and one-hot labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecsight.constants import ALL_MEASURES, AVG_EMBEDDING, POOLED_MEASURES
from vecsight.operators import evaluate as ev
from vecsight.operators import manifest as MF
from vecsight.operators import prevalence as PV
from vecsight.operators import reshape as RS
from vecsight.operators.scoring import score_nested
from vecsight.plans import inputs as I
from vecsight.plans.oracle_ctes import with_ctes
from vecsight.plans.q_retrieval import _EVAL_DEPS, _VALIDATE_CTES, precision_at_n
from vecsight.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _labels(spark, sf):
    return MF.distinct_values(I.label_list(spark, sf), "label")


# ---------------------------------------------------------------- reshaping
def _nested(spark, sf, labels, measures=ALL_MEASURES):
    return score_nested(I.corpus(spark, sf), I.prompts(spark, sf), I.ID_COLS, labels, measures)


@query("scores_long")
def scores_long(spark, sf):
    """The wide score table, from the scorer's own rows, and back to long: no shuffle of scores."""
    labels = _labels(spark, sf)
    wide = RS.nested_to_wide(_nested(spark, sf, labels), I.ID_COLS, labels, list(ALL_MEASURES), digits=5)
    return RS.unpivot_scores(wide, I.ID_COLS, labels, list(ALL_MEASURES))


SQL["scores_long"] = with_ctes("""
SELECT subject_id, study_id, dicom_id, cosine_similarity, label, embedding_type FROM scores_all""",
                               "scores_all")


@query("missing_column_policy")
def missing_column_policy(spark, sf):
    """The score file lacks ``average_embedding``; the skip policy warns and goes on."""
    labels = _labels(spark, sf)
    have = [m for m in ALL_MEASURES if m != AVG_EMBEDDING]
    wide = RS.nested_to_wide(_nested(spark, sf, labels, tuple(have)), I.ID_COLS, labels, have, digits=5)
    return RS.unpivot_scores(wide, I.ID_COLS, labels, list(ALL_MEASURES), on_missing="skip")


SQL["missing_column_policy"] = with_ctes("""
SELECT subject_id, study_id, dicom_id, cosine_similarity, label, embedding_type FROM scores_all
WHERE embedding_type <> 'average_embedding'""", "scores_all")

_ACC_NAMES = [f"{m}_{p}_accuracy" for m in POOLED_MEASURES for p in ("max", "mean")]


@query("scores_wide")
def scores_wide(spark, sf):
    """The accuracy table, one row per label."""
    return RS.accuracy_wide(precision_at_n(spark, sf), names=_ACC_NAMES)


SQL["scores_wide"] = with_ctes("SELECT label AS Label, " + ", ".join(
    f"max(CASE WHEN embedding_type = '{m}' AND pool = '{p}' THEN precision END) AS {m}_{p}_accuracy"
    for m in POOLED_MEASURES for p in ("max", "mean")) + """
FROM (SELECT r.label, r.embedding_type, r.pool,
       round(CAST(sum(CASE WHEN r.rk <= n.n THEN r.hit ELSE 0 END) AS DOUBLE) / nullif(n.n, 0), 6) AS precision
      FROM ranked r JOIN ncnt n USING (label) GROUP BY r.label, r.embedding_type, r.pool, n.n)
GROUP BY label""", *_EVAL_DEPS, extra=_VALIDATE_CTES)


@query("scores_struct")
def scores_struct(spark, sf):
    """A struct of measures per label, written by the scorer; flattened to a row per image and label."""
    labels = _labels(spark, sf)
    rows = RS.nested_rows(_nested(spark, sf, labels), I.ID_COLS, labels, list(ALL_MEASURES), "int")
    return rows.select(*I.ID_COLS, "label", *[F.round(m, 5).alias(m) for m in ALL_MEASURES])


SQL["scores_struct"] = with_ctes("SELECT subject_id, study_id, dicom_id, label, " + ", ".join(
    f"max(cosine_similarity) FILTER (WHERE embedding_type = '{m}') AS {m}" for m in ALL_MEASURES)
    + " FROM scores_all GROUP BY subject_id, study_id, dicom_id, label", "scores_all")


# ---------------------------------------------------------------- prevalence
@query("prevalence_labels")
def prevalence_labels(spark, sf):
    p = PV.prevalence_percent(table(spark, sf, "labels"), ["quality", "toxic"])
    return p.withColumn("prevalence_pct", F.round("prevalence_pct", 6))


@query("prevalence_all_columns")
def prevalence_all_columns(spark, sf):
    p = PV.prevalence_sum(table(spark, sf, "labels"), ["doc_id"])
    return p.withColumn("prevalence_pct", F.round("prevalence_pct", 6))


SQL["prevalence_labels"] = " UNION ALL ".join(
    f"SELECT '{c}' AS Label, round(100.0 * count(*) FILTER (WHERE {c} = 1) / count(*), 6) AS prevalence_pct "
    f"FROM labels" for c in ("quality", "toxic"))
SQL["prevalence_all_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS Label, round(100.0 * sum({c}) / count(*), 6) AS prevalence_pct FROM labels"
    for c in ("quality", "toxic"))


def _cluster_table(spark, sf):
    """The prevalence table (a row per cluster and the total row), and its label columns."""
    labels = _labels(spark, sf)
    names = [str(lab) for lab in labels]
    wide = I.truth(spark, sf).groupBy("subject_id", "study_id").pivot("label", labels).agg(F.first("value"))
    rows = I.corpus(spark, sf).select("subject_id", "study_id", F.col("label").alias("cluster")) \
        .join(wide, ["subject_id", "study_id"])
    return PV.cluster_prevalence(rows, names), names


@query("cluster_prevalence_rollup")
def cluster_prevalence_rollup(spark, sf):
    """C2 fan-out join (image rows x study labels), then D8-D10 with the total row; one row per
    cluster and label of the table."""
    p, names = _cluster_table(spark, sf)
    return p.unpivot(["Cluster", "Total_Samples"], names, "label", "prevalence").select(
        "Cluster", "Total_Samples", F.col("label").cast("int").alias("label"), F.round("prevalence", 6).alias("prevalence"))


_CLUSTER_ROWS = ("m", """SELECT c.label AS cluster, l.label, CASE WHEN t.value = 1 THEN 1 ELSE 0 END AS has
                    FROM corpus c CROSS JOIN labelset l LEFT JOIN truth t
                    ON t.subject_id = c.subject_id AND t.study_id = c.study_id AND t.label = l.label""")
SQL["cluster_prevalence_rollup"] = with_ctes("""
SELECT CASE WHEN grouping(cluster) = 1 THEN 'Weighted_Avg' ELSE CAST(cluster AS VARCHAR) END AS Cluster,
       count(*) AS Total_Samples, label, round(count(*) FILTER (WHERE has = 1) / count(*), 6) AS prevalence
FROM m GROUP BY GROUPING SETS ((cluster, label), (label))""", "corpus", "truth", "labelset", extra=[_CLUSTER_ROWS])


@query("cluster_prevalence_means")
def cluster_prevalence_means(spark, sf):
    """D12 over the prevalence table: the mean of every column over all its rows, total row included."""
    p, names = _cluster_table(spark, sf)
    columns = [*names, "Total_Samples"]
    means = PV.column_means(p, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    return means.unpivot([], columns, "column", "mean").withColumn("mean", F.round("mean", 6))


SQL["cluster_prevalence_means"] = with_ctes("""
SELECT CAST(label AS VARCHAR) AS "column", round(avg(prevalence), 6) AS mean FROM p GROUP BY label
UNION ALL SELECT 'Total_Samples', round(avg(n), 6) FROM (SELECT cluster, any_value(n) AS n FROM p GROUP BY cluster, total)""",
    "corpus", "truth", "labelset", extra=[_CLUSTER_ROWS, ("p", """
SELECT cluster, grouping(cluster) AS total, label, count(*) AS n, count(*) FILTER (WHERE has = 1) / count(*) AS prevalence
FROM m GROUP BY GROUPING SETS ((cluster, label), (label))""")])


# ---------------------------------------------------------------- manifest / queue
def _ann(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey").cast("string")
    return li.select(F.col("l_orderkey").alias("series_uid"),
                     F.concat(F.lit("ann-"), k, F.lit("-"), F.col("l_partkey").cast("string")).alias("ann_id"),
                     F.concat(F.lit("a__1.2."), k, F.lit("__seg.dcm")).alias("annotation"))


def _img(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("series_uid"), F.concat(F.lit("img-"), k).alias("im_id"),
        F.concat(F.lit("img_1.2."), k, F.lit(".dcm")).alias("image"))


_MANIFEST_CTES = [
    ("ann", """SELECT l_orderkey AS series_uid, 'ann-' || l_orderkey || '-' || l_partkey AS ann_id,
               'a__1.2.' || l_orderkey || '__seg.dcm' AS annotation FROM lineitem"""),
    ("img", """SELECT o_orderkey AS series_uid, 'img-' || o_orderkey AS im_id,
               'img_1.2.' || o_orderkey || '.dcm' AS image FROM orders"""),
    ("joined", "SELECT * FROM ann JOIN img USING (series_uid)"),
    ("manifest", """SELECT * FROM joined WHERE series_uid IN (
                    SELECT series_uid FROM joined GROUP BY series_uid HAVING count(*) = 1)"""),
    ("q", """SELECT series_uid, 'ann_id' AS kind, ann_id AS obj_id FROM manifest
             UNION ALL SELECT series_uid, 'im_id', im_id FROM manifest"""),
]


@query("manifest_join")
def manifest_join(spark, sf):
    return MF.manifest(_ann(spark, sf), _img(spark, sf))


SQL["manifest_join"] = with_ctes("SELECT series_uid, ann_id, annotation, im_id, image FROM manifest",
                                 extra=_MANIFEST_CTES)


@query("download_queue")
def download_queue(spark, sf):
    return MF.queue(manifest_join(spark, sf))


SQL["download_queue"] = with_ctes("SELECT series_uid, kind, obj_id FROM q", extra=_MANIFEST_CTES)


@query("resume_queue")
def resume_queue(spark, sf):
    """C11: ledger = images of finished orders (already fetched); the rest is still to do."""
    q = download_queue(spark, sf)
    done = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.concat(F.lit("img-"), F.col("o_orderkey").cast("string")).alias("obj_id"))
    return MF.resume(q, done)


SQL["resume_queue"] = with_ctes("""
SELECT series_uid, kind, obj_id FROM q WHERE obj_id NOT IN (
  SELECT 'img-' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""", extra=_MANIFEST_CTES)


# ---------------------------------------------------------------- names, pairing, one-hot
def _names(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey").cast("string")
    ln = F.col("l_linenumber")
    name = (F.when(ln == 1, F.concat(F.lit("a__1.2."), k, F.lit("__seg.dcm")))
            .when(ln == 2, F.concat(F.lit("b__1.2."), k, F.lit("__seg.dcm__3."), k, F.lit("__seg.dcm")))
            .when(ln == 3, F.concat(F.lit("c_"), k, F.lit(".dcm")))
            .otherwise(F.concat(F.lit("d__1."), k, F.lit("."), F.col("l_partkey").cast("string"),
                                F.lit("__segXdcm"))))
    return li.select("l_orderkey", "l_linenumber", name.alias("fname"))


_NAMES_SQL = """SELECT l_orderkey, l_linenumber, CASE l_linenumber
  WHEN 1 THEN 'a__1.2.' || l_orderkey || '__seg.dcm'
  WHEN 2 THEN 'b__1.2.' || l_orderkey || '__seg.dcm__3.' || l_orderkey || '__seg.dcm'
  WHEN 3 THEN 'c_' || l_orderkey || '.dcm'
  ELSE 'd__1.' || l_orderkey || '.' || l_partkey || '__segXdcm' END AS fname FROM lineitem"""
_UID = r"'__([\d\.]*?)__seg.dcm'"


@query("uid_extract")
def uid_extract(spark, sf):
    n = _names(spark, sf)
    from vecsight.functions.text import uid_matches
    return n.select("l_orderkey", "l_linenumber", "fname", F.size(uid_matches("fname")).cast("long").alias("n_matches"),
                    MF.uid_of("fname").alias("uid"))


SQL["uid_extract"] = f"""
SELECT l_orderkey, l_linenumber, fname, len(regexp_extract_all(fname, {_UID}, 1)) AS n_matches,
       CASE WHEN len(regexp_extract_all(fname, {_UID}, 1)) = 1 THEN regexp_extract_all(fname, {_UID}, 1)[1] END AS uid
FROM ({_NAMES_SQL})"""


@query("series_listing")
def series_listing(spark, sf):
    """The files of every series in name order."""
    n = _names(spark, sf).withColumn("fpath", F.concat(F.lit("files/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("fname")))
    out = MF.series_listing(n.withColumnRenamed("l_orderkey", "series_uid"))
    return out.withColumn("position", F.col("position").cast("long"))


SQL["series_listing"] = f"""
SELECT series_uid, row_number() OVER (PARTITION BY series_uid ORDER BY fname, fpath) - 1 AS position, fname, fpath
FROM (SELECT l_orderkey AS series_uid, fname, 'files/' || l_orderkey || '/' || fname AS fpath FROM ({_NAMES_SQL}))"""


@query("missing_files")
def missing_files(spark, sf):
    """Customers aligned with orders by key; customers without an order are reported."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return MF.report_missing(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


SQL["missing_files"] = """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'file' ELSE 'row' END AS missing
FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL"""


@query("absent_ids")
def absent_ids(spark, sf):
    """B3 with the value 0: documents labelled as not toxic."""
    t = table(spark, sf, "labels").select(F.lit("toxic").alias("label"), F.col("doc_id").alias("study_id"), F.col("toxic").alias("value"))
    return ev.positives(t, value=0)


SQL["absent_ids"] = "SELECT DISTINCT 'toxic' AS label, doc_id AS study_id FROM labels WHERE toxic = 0"


@query("cluster_size_check")
def cluster_size_check(spark, sf):
    """Rows of all clusters against the rows of the library."""
    sizes = cluster_prevalence_rollup(spark, sf).select("Cluster", "Total_Samples").distinct()
    return PV.size_check(sizes, I.corpus(spark, sf))


SQL["cluster_size_check"] = with_ctes("""
SELECT CAST(n AS BIGINT) AS clustered, n AS library_rows, true AS equal FROM (
  SELECT count(*) AS n FROM corpus JOIN (SELECT DISTINCT subject_id, study_id FROM truth) USING (subject_id, study_id))""",
                                      "corpus", "truth")


@query("price_column_means")
def price_column_means(spark, sf):
    """Means of several columns of a table."""
    m = PV.column_means(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


SQL["price_column_means"] = "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem"


@query("segment_labels")
def segment_labels(spark, sf):
    """One row per file and segment label (segments of a series: the return flags of an order)."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("labels"))
    return MF.explode_labels(li, ["l_orderkey"])


SQL["segment_labels"] = "SELECT DISTINCT l_orderkey, l_returnflag AS label FROM lineitem WHERE l_returnflag IS NOT NULL"


@query("suffix_check")
def suffix_check(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey").cast("string")
    ln = F.col("l_linenumber")
    fname = (F.when(ln == 1, F.concat(F.lit("a__1.2."), k, F.lit("__seg.dcm")))
             .when(ln == 7, F.concat(F.lit("f"), ln.cast("string"), F.lit(".png")))
             .otherwise(F.concat(F.lit("f"), ln.cast("string"), F.lit(".dcm"))))
    files = li.select(F.col("l_orderkey").alias("series_uid"), fname.alias("fname"))
    return MF.file_checks(files)


SQL["suffix_check"] = f"""
SELECT series_uid, count(*) AS n_files, bool_and(ends_with(fname, '.dcm')) AS all_suffix,
       count(*) FILTER (WHERE len(regexp_extract_all(fname, {_UID}, 1)) = 1) AS n_annotations,
       bool_and(ends_with(fname, '.dcm')) AND count(*) FILTER (WHERE len(regexp_extract_all(fname, {_UID}, 1)) = 1) = 1 AS ok
FROM (SELECT l_orderkey AS series_uid, CASE WHEN l_linenumber = 1 THEN 'a__1.2.' || l_orderkey || '__seg.dcm'
             WHEN l_linenumber = 7 THEN 'f' || l_linenumber || '.png' ELSE 'f' || l_linenumber || '.dcm' END AS fname
      FROM lineitem) GROUP BY series_uid"""


def files_table(spark, sf):
    """Per order: the annotation plus tier-1 / tier-2 / tier-3 / unpairable image files."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("series_uid"))
    k = F.col("series_uid").cast("string")
    m = F.col("series_uid") % 4
    uid = F.concat(F.lit("1.2."), k)
    none = F.lit(None).cast("string")

    def f(name, sop=none):
        return F.struct(name.alias("fname"), sop.alias("sop_uid"))
    others = (F.when(m == 0, F.array(f(F.concat(F.lit("img_"), uid, F.lit(".dcm")))))
              .when(m == 1, F.array(f(F.lit("x0.dcm"))))
              .when(m == 2, F.array(f(F.lit("x1.dcm"), uid), f(F.lit("x2.dcm"))))
              .otherwise(F.array(f(F.lit("x1.dcm")), f(F.lit("x2.dcm")))))
    allf = F.concat(F.array(f(F.concat(F.lit("a__"), uid, F.lit("__seg.dcm")))), others)
    return o.select("series_uid", F.inline(allf)).withColumn(
        "fpath", F.concat(F.lit("dcm/series"), k, F.lit("/"), F.col("fname")))


_FILES_SQL = """
SELECT series_uid, fname, sop_uid, 'dcm/series' || series_uid || '/' || fname AS fpath FROM (
  SELECT o_orderkey AS series_uid, 'a__1.2.' || o_orderkey || '__seg.dcm' AS fname, NULL AS sop_uid FROM orders
  UNION ALL SELECT o_orderkey, 'img_1.2.' || o_orderkey || '.dcm', NULL FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 'x0.dcm', NULL FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 'x1.dcm', '1.2.' || o_orderkey FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT o_orderkey, 'x2.dcm', NULL FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT o_orderkey, 'x1.dcm', NULL FROM orders WHERE o_orderkey % 4 = 3
  UNION ALL SELECT o_orderkey, 'x2.dcm', NULL FROM orders WHERE o_orderkey % 4 = 3)"""


@query("pair_files")
def pair_files(spark, sf):
    return MF.pair_files(files_table(spark, sf))


SQL["pair_files"] = with_ctes("""
SELECT series_uid, image_uid, CASE WHEN reason IS NULL THEN best END AS fpath,
       CASE WHEN reason IS NULL THEN tier END AS tier, reason AS reject_reason
FROM (SELECT *, CASE WHEN n_ann <> 1 THEN 'annotation count' WHEN tier IS NULL THEN 'no candidate'
                     WHEN (CASE tier WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE 0 END) <> 1 THEN 'ambiguous'
                END AS reason
      FROM (SELECT series_uid, any_value(image_uid) AS image_uid, any_value(n_ann) AS n_ann, min(tier) AS tier,
                   count(*) FILTER (WHERE tier = 1) AS c1, count(*) FILTER (WHERE tier = 2) AS c2,
                   count(*) FILTER (WHERE tier = 3) AS c3, arg_min(fpath, coalesce(tier, 99)) AS best
            FROM c GROUP BY series_uid))""", extra=[
    ("files", _FILES_SQL),
    ("f", f"""SELECT *, CASE WHEN len(regexp_extract_all(fname, {_UID}, 1)) = 1
                        THEN regexp_extract_all(fname, {_UID}, 1)[1] END AS uid FROM files"""),
    ("stats", """SELECT series_uid, count(*) AS n_files, count(uid) AS n_ann, max(uid) AS image_uid
                 FROM f GROUP BY series_uid"""),
    ("c", """SELECT s.series_uid, s.image_uid, s.n_ann, f.fpath,
             CASE WHEN s.n_ann = 1 THEN CASE WHEN contains(f.fpath, s.image_uid) THEN 1
                  WHEN s.n_files = 2 THEN 2 WHEN f.sop_uid = s.image_uid THEN 3 END END AS tier
             FROM stats s LEFT JOIN f ON f.series_uid = s.series_uid AND f.uid IS NULL"""),
])


@query("pair_files_by_name")
def pair_files_by_name(spark, sf):
    """The annotation is the file in the set of annotation names; in every third series no
    name is in it, though one looks like an annotation."""
    files = files_table(spark, sf)
    names = files.where((F.col("series_uid") % 3 != 0) & MF.uid_of("fname").isNotNull()).select("fname")
    return MF.pair_files(files, annotation_names=names)


SQL["pair_files_by_name"] = with_ctes("""
SELECT series_uid, image_uid, CASE WHEN reason IS NULL THEN best END AS fpath,
       CASE WHEN reason IS NULL THEN tier END AS tier, reason AS reject_reason
FROM (SELECT *, CASE WHEN n_ann <> 1 THEN 'annotation count' WHEN image_uid IS NULL THEN 'annotation name'
                     WHEN tier IS NULL THEN 'no candidate'
                     WHEN (CASE tier WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE 0 END) <> 1 THEN 'ambiguous'
                END AS reason
      FROM (SELECT series_uid, any_value(image_uid) AS image_uid, any_value(n_ann) AS n_ann, min(tier) AS tier,
                   count(*) FILTER (WHERE tier = 1) AS c1, count(*) FILTER (WHERE tier = 2) AS c2,
                   count(*) FILTER (WHERE tier = 3) AS c3, arg_min(fpath, coalesce(tier, 99)) AS best
            FROM c GROUP BY series_uid))""", extra=[
    ("files", _FILES_SQL),
    ("f0", f"""SELECT *, CASE WHEN len(regexp_extract_all(fname, {_UID}, 1)) = 1
                         THEN regexp_extract_all(fname, {_UID}, 1)[1] END AS uid FROM files"""),
    ("f", """SELECT *, fname IN (SELECT fname FROM f0 WHERE series_uid % 3 <> 0 AND uid IS NOT NULL) AS ann FROM f0"""),
    ("stats", """SELECT series_uid, count(*) AS n_files, count(*) FILTER (WHERE ann) AS n_ann,
                        max(CASE WHEN ann THEN uid END) AS image_uid FROM f GROUP BY series_uid"""),
    ("c", """SELECT s.series_uid, s.image_uid, s.n_ann, f.fpath,
             CASE WHEN s.n_ann = 1 THEN CASE WHEN contains(f.fpath, s.image_uid) THEN 1
                  WHEN s.n_files = 2 THEN 2 WHEN f.sop_uid = s.image_uid THEN 3 END END AS tier
             FROM stats s LEFT JOIN f ON f.series_uid = s.series_uid AND NOT f.ann"""),
])


@query("one_hot_pivot")
def one_hot_pivot(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("series_uid"),
        F.concat(F.lit("1.2."), F.col("l_orderkey").cast("string")).alias("image_uid"),
        F.col("l_returnflag").alias("label"))
    labels = MF.distinct_values(li, "label")
    return MF.one_hot(li, ["series_uid", "image_uid"], "label", labels)


SQL["one_hot_pivot"] = """
SELECT l_orderkey AS series_uid, '1.2.' || l_orderkey AS image_uid,
       CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS A,
       CAST(max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS INTEGER) AS N,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS R
FROM lineitem GROUP BY l_orderkey"""
