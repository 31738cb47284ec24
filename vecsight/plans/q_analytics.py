"""Query keys for clustering, projection, covariance and contrastive metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecsight.operators import analytics as AN
from vecsight.operators import contrast as CT
from vecsight.operators.scoring import mean_vector
from vecsight.plans import inputs as I
from vecsight.plans.oracle_ctes import with_ctes
from vecsight.sources.files import written
from vecsight.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- clustering / projection
@query("kmeans_assign")
def kmeans_assign(spark, sf):
    """Assignment to fixed centres (the per-label mean vectors of the library)."""
    centres = mean_vector(I.corpus(spark, sf), ["label"], "embedding", "centre") \
        .withColumnRenamed("label", "cluster")
    out = AN.assign_nearest(table(spark, sf, "embeddings"), "embedding", centres)
    return out.select("vec_id", "cluster", F.round("dist", 5).alias("dist"))


SQL["kmeans_assign"] = with_ctes("""
SELECT vec_id, cluster, round(dist, 5) AS dist FROM (
  SELECT e.vec_id, c.cluster, list_distance(e.embedding::DOUBLE[], c.centre) AS dist,
         row_number() OVER (PARTITION BY e.vec_id
                            ORDER BY list_distance(e.embedding::DOUBLE[], c.centre), c.cluster) AS rn
  FROM embeddings e CROSS JOIN centres c) WHERE rn = 1""", "corpus", extra=[("centres", """
SELECT label AS cluster, list(x ORDER BY pos) AS centre FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM corpus)
  GROUP BY label, pos) GROUP BY label""")])


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    out, _ = AN.kmeans(table(spark, sf, "embeddings"), "embedding", k=10, seed=0)
    return out.select("vec_id", "cluster")


@query("kmeans_lloyd")
def kmeans_lloyd(spark, sf):
    """Three steps of k-means from fixed centres (the first prompt of every label), then the assignment."""
    start = AN.collect_centres(I.prompts(spark, sf).where("prompt_id = 1").select(F.col("label").cast("long").alias("cluster"), F.col("qvec").alias("centre")))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = AN.assign_nearest(e, "embedding", AN.lloyd(e, "embedding", start, 3))
    return out.select("vec_id", "cluster", F.round("dist", 5).alias("dist"))


def _lloyd_ctes(points: str, start: str, steps: int) -> list[tuple[str, str]]:
    """k-means steps in SQL: ``points`` (id, v) and ``start`` (cluster, c) to the assignment ``assigned``
    (id, cluster, dist)."""
    near = """SELECT id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS dist FROM (
                SELECT p.id, p.v, c.cluster, list_distance(p.v, c.c) AS d FROM pts p CROSS JOIN {c} c) GROUP BY id, v"""
    out = [("pts", points), ("c0", start)]
    for k in range(steps):
        out += [(f"a{k}", near.format(c=f"c{k}")),
                (f"c{k + 1}", f"""SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
                    SELECT cluster, list(x ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS x FROM (
                      SELECT cluster, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{k}) GROUP BY cluster, pos) GROUP BY cluster) n USING (cluster)""")]
    return [*out, ("assigned", near.format(c=f"c{steps}"))]


def _chain(ctes: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)


SQL["kmeans_lloyd"] = "WITH " + _chain(_lloyd_ctes(
    "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings",
    "SELECT label::BIGINT AS cluster, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY label", 3)) + """
SELECT id AS vec_id, cluster, round(dist, 5) AS dist FROM assigned"""


def _with_variance(df, fitted):
    for j, name in enumerate(("x", "y")):
        df = df.withColumn(name, F.round(name, 6)).withColumn(f"var_{name}", F.round(F.lit(float(fitted.variance[j])), 6))
    return df


@query("pca_2d")
def pca_2d(spark, sf):
    """Coordinates on the first two principal components, with the variances along them."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    fitted = AN.principal_components(e, "embedding")
    return _with_variance(AN.project(e, "embedding", fitted), fitted).select("vec_id", "x", "y", "var_x", "var_y")


def _pca_ctes(vectors: str, squarings: int = 16) -> list[tuple[str, str]]:
    """The first two principal components in SQL, from ``vectors`` (id, v): the covariance matrix is
    squared again and again, which leaves the projector on its first eigenvector; the second one
    after that one is taken out.  ``xy`` (id, x, y), ``vars`` (var_x, var_y)."""
    out = [("vecs", vectors),
           ("u", "SELECT id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vecs"),
           ("mu", "SELECT i, avg(x) AS m FROM u GROUP BY i"),
           ("m1", "SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM u a JOIN u b USING (id) GROUP BY a.i, b.i")]
    for k in (1, 2):
        out.append((f"s{k}_0", f"SELECT i, j, v / (SELECT sum(v) FROM m{k} WHERE i = j) AS v FROM m{k}"))
        for n in range(1, squarings + 1):
            out.append((f"t{k}_{n}", f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{k}_{n - 1} a JOIN s{k}_{n - 1} b ON a.j = b.i GROUP BY a.i, b.j"))
            out.append((f"s{k}_{n}", f"SELECT i, j, v / (SELECT sum(v) FROM t{k}_{n} WHERE i = j) AS v FROM t{k}_{n}"))
        last = f"s{k}_{squarings}"
        out += [(f"r{k}", f"SELECT i, v FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)"),
                (f"e{k}", f"SELECT i, v / sqrt((SELECT sum(v * v) FROM r{k})) * (SELECT sign(arg_max(v, abs(v))) FROM r{k}) AS v FROM r{k}"),
                (f"l{k}", f"SELECT sum(a.v * m.v * b.v) AS l FROM m{k} m JOIN e{k} a ON a.i = m.i JOIN e{k} b ON b.i = m.j")]
        if k == 1:
            out.append(("m2", "SELECT m.i, m.j, m.v - (SELECT l FROM l1) * a.v * b.v AS v FROM m1 m JOIN e1 a ON a.i = m.i JOIN e1 b ON b.i = m.j"))
    return [*out, ("vars", "SELECT round((SELECT l FROM l1), 6) AS var_x, round((SELECT l FROM l2), 6) AS var_y"),
            ("xy", "SELECT id, sum((x - m) * e1.v) AS x, sum((x - m) * e2.v) AS y FROM u JOIN mu USING (i) JOIN e1 USING (i) JOIN e2 USING (i) GROUP BY id")]


_OWN_VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
SQL["pca_2d"] = "WITH " + _chain(_pca_ctes(_OWN_VECTORS)) + """
SELECT id AS vec_id, round(x, 6) AS x, round(y, 6) AS y, var_x, var_y FROM xy CROSS JOIN vars"""


@query("kmeans_pca")
def kmeans_pca(spark, sf):
    """J4 + J5: k-means on the 2-D projection, five steps from the ten lowest ids; the coordinates +
    cluster table."""
    p = AN.pca(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    xy = written(p.select("vec_id", "x", "y", F.array("x", "y").alias("xy")), "projection")
    first = xy.orderBy("vec_id").limit(10).collect()
    start = AN.Centres([r.vec_id for r in first], np.array([r.xy for r in first]))
    out = AN.assign_nearest(xy, "xy", AN.lloyd(xy, "xy", start, 5))
    return out.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster")


SQL["kmeans_pca"] = "WITH " + _chain([*_pca_ctes(_OWN_VECTORS), *_lloyd_ctes(
    "SELECT id, [x, y] AS v FROM xy", "SELECT id AS cluster, [x, y] AS c FROM xy ORDER BY id LIMIT 10", 5)]) + """
SELECT id AS vec_id, round(v[1], 6) AS x, round(v[2], 6) AS y, cluster FROM assigned"""


@query("pca_joint")
def pca_joint(spark, sf):
    """J3 + H7: two libraries stacked with a source column, one projection, split by source."""
    a = I.corpus(spark, sf).select(F.col("dicom_id").alias("id"), F.lit("library").alias("source"),
                                   "embedding")
    b = I.prompts(spark, sf).select(F.col("vec_id").alias("id"), F.lit("prompts").alias("source"),
                                    F.col("qvec").alias("embedding"))
    both = a.unionByName(b)
    fitted = AN.principal_components(both, "embedding")
    return _with_variance(AN.project(both, "embedding", fitted), fitted).select("id", "source", "x", "y", "var_x", "var_y")


SQL["pca_joint"] = with_ctes("SELECT id, source, round(x, 6) AS x, round(y, 6) AS y, var_x, var_y FROM xy JOIN src USING (id) CROSS JOIN vars",
                             "corpus", "prompts", extra=[
    ("src", """SELECT dicom_id AS id, 'library' AS source, embedding::DOUBLE[] AS v FROM corpus
               UNION ALL SELECT vec_id, 'prompts', qvec::DOUBLE[] FROM prompts"""),
    *_pca_ctes("SELECT id, v FROM src")]).replace(" AS (", " AS MATERIALIZED (")


@query("covariance_check")
def covariance_check(spark, sf):
    e = table(spark, sf, "embeddings")
    dims = e.select(F.max(F.size("embedding"))).first()[0]
    return AN.covariance_entries(e, "embedding", int(dims)).select(
        "i", "j", (F.round("cov", 6) + F.lit(0.0)).alias("cov"))


SQL["covariance_check"] = """
WITH u AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i,
                  unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + CAST(0 AS DOUBLE) AS cov FROM u a JOIN u b USING (vec_id)
GROUP BY a.i, b.i"""


# ---------------------------------------------------------------- contrastive metrics
# pairs of four neighbouring vectors (image, text, chunk, patch), batches of 64 pairs
_PART = {"image": (0,), "text": (1,), "chunk": (2,), "patch": (3,), "first": (0, 1), "second": (2, 3)}


def _set(spark, sf, part, vec=None):
    e = table(spark, sf, "embeddings").where((F.col("vec_id") % 4).isin(*_PART[part]))
    return e.select(F.floor(F.col("vec_id") / 256).cast("long").alias("batch"), F.floor(F.col("vec_id") / 4).cast("long").alias("pair"),
                    (F.col("embedding") if vec is None else vec).alias("vec"))


def _part_sql(part: str, vec: str = "embedding::DOUBLE[]") -> str:
    return (f"SELECT vec_id // 256 AS batch, vec_id // 4 AS pair, vec_id AS item, {vec} AS q FROM embeddings "
            f"WHERE vec_id % 4 IN ({', '.join(map(str, _PART[part]))})")


def _cut_sql(part: str) -> str:
    """Every vector of a set cut into four of equal width, the last one filled up with zeros."""
    return f"""SELECT batch, pair, item * 4 + k AS item, list_slice(list_resize(q, 4 * w, 0), k * w + 1, (k + 1) * w) AS q
              FROM (SELECT *, CAST(ceil(len(q) / 4) AS BIGINT) AS w FROM ({_part_sql(part)})), (SELECT unnest(range(4)) AS k)"""


_SET_SQL = {part: _part_sql(part) for part in _PART} | {"patches": _cut_sql("first"), "words": _cut_sql("second")}


def _sql_info_nce(first: str, second: str, t: float) -> str:
    norm = ("SELECT batch, pair, item, list_transform(q, lambda x: x / greatest(sqrt(list_sum("
            "list_transform(q, lambda y: y * y))), 1e-12)) AS v FROM ({s})")
    return f"""(WITH fn AS ({norm.format(s=_SET_SQL[first])}), sn AS ({norm.format(s=_SET_SQL[second])}),
 sm AS (SELECT batch, pair, list(x ORDER BY pos) AS m FROM (SELECT batch, pair, pos, avg(x) AS x FROM (
          SELECT batch, pair, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM sn) GROUP BY batch, pair, pos) GROUP BY batch, pair),
 lg AS (SELECT fn.pair AS p, fn.item, sm.pair AS q, list_dot_product(fn.v, sm.m) / {t} AS logit
        FROM fn JOIN sm USING (batch)),
 li AS (SELECT p, item, ln(sum(exp(logit - mx))) + mx - max(CASE WHEN q = p THEN logit END) AS loss
        FROM (SELECT *, max(logit) OVER (PARTITION BY p, item) AS mx FROM lg) GROUP BY p, item, mx)
 SELECT avg(loss) FROM li)"""


def _info_nce(spark, sf, temperature):
    out = CT.info_nce(_set(spark, sf, "first"), _set(spark, sf, "second"), temperature, batch_col="batch")
    return out.select(F.round("loss", 6).alias("loss"))


QUERIES["info_nce"] = lambda spark, sf: _info_nce(spark, sf, 1.0)
QUERIES["info_nce_sharp"] = lambda spark, sf: _info_nce(spark, sf, 0.07)
SQL["info_nce"] = f"SELECT round({_sql_info_nce('first', 'second', 1.0)}, 6) AS loss"
SQL["info_nce_sharp"] = f"SELECT round({_sql_info_nce('first', 'second', 0.07)}, 6) AS loss"


@query("local_loss_two_way")
def local_loss_two_way(spark, sf):
    out = CT.two_way_local(_set(spark, sf, "first"), _set(spark, sf, "second"), 0.1, batch_col="batch")
    return out.select(F.round("loss", 6).alias("loss"))


SQL["local_loss_two_way"] = (f"SELECT round(({_sql_info_nce('first', 'second', 0.1)} + "
                             f"{_sql_info_nce('second', 'first', 0.1)}) / 2, 6) AS loss")


def _flat_grid(spark, sf, part):
    """The vectors of a set as 2 x 2 grids of patches that cover all components (the last patch is
    filled up with zeros), one row per patch."""
    width = F.ceil(F.size("embedding") / 4).cast("int")
    whole = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 4 * width - F.size("embedding")))
    patch = lambda k: F.slice(whole, width * k + 1, width)
    grid = _set(spark, sf, part, F.array(F.array(patch(0), patch(1)), F.array(patch(2), patch(3)))).withColumnRenamed("vec", "grid")
    return CT.flatten_grid(grid, "grid").select("batch", "pair", "vec")


@query("patch_grid_loss")
def patch_grid_loss(spark, sf):
    """J11 + J9: the vectors of the first set as grids of patches, flattened, against the words of
    their pair, which are the vectors of the second set cut the same way; all rows and components."""
    out = CT.two_way_local(_flat_grid(spark, sf, "first"), _flat_grid(spark, sf, "second"), 0.1, batch_col="batch")
    return out.select(F.round("loss", 6).alias("loss"))


SQL["patch_grid_loss"] = (f"SELECT round(({_sql_info_nce('patches', 'words', 0.1)} + "
                          f"{_sql_info_nce('words', 'patches', 0.1)}) / 2, 6) AS loss")


@query("contrast_eight_way")
def contrast_eight_way(spark, sf):
    sets = {part: _set(spark, sf, part) for part in ("image", "text", "chunk", "patch")}
    out = CT.eight_way(sets, 1.0, batch_col="batch")
    return out.select("direction", F.round("loss", 6).alias("loss"))


SQL["contrast_eight_way"] = (
    "SELECT direction, round(loss, 6) AS loss FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS direction, {_sql_info_nce(a, b, 1.0)} AS loss" for name, a, b in CT.EIGHT_DIRECTIONS)
    + ") UNION ALL SELECT 'combined', round(avg(loss), 6) FROM (" + " UNION ALL ".join(
        f"SELECT {_sql_info_nce(a, b, 1.0)} AS loss" for _, a, b in CT.EIGHT_DIRECTIONS) + ")")
