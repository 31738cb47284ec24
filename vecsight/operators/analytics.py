"""Clustering and projection of vector libraries.

All are iterations of one pass each over the vectors, with one matrix product per Arrow batch and
partial sums per task; the driver holds the model (k centres, d x k components) and, for vectors
of bounded width, their covariance.  ``kmeans`` (random start) is the pyspark.ml estimator.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.constants import MAX_BROADCAST_ROWS


def _as_vector(df: DataFrame, vec_col: str, out: str = "_features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec_col).cast("array<double>")))


def kmeans(df: DataFrame, vec_col: str, k: int = 10, seed: int = 0, out_col: str = "cluster",
           max_iter: int = 20) -> tuple[DataFrame, object]:
    """K-means (k-means|| init), returns (rows + cluster id, model)."""
    x = _as_vector(df, vec_col)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol=out_col).fit(x)
    return model.transform(x).drop("_features"), model


#: Up to so many dimensions the covariance is summed up as a whole (8 MB); beyond, in blocks.
GRAM_DIMS = 1024


@dataclass
class Components:
    """A fitted projection: mean (d), vectors (d x k, largest variance first) and their variances.
    The sign of a vector is that which makes its largest entry (the first of equal ones) positive."""

    mean: np.ndarray
    vectors: np.ndarray
    variance: np.ndarray


def _rows_of(column: pa.Array) -> np.ndarray:
    """A list column without missing lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows (key int, vec binary of doubles) added up per key: by task, then by key over the tasks."""
    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("vec"), strict=True):
                vec = np.frombuffer(raw.as_buffer(), np.float64)
                sums[key] = sums[key] + vec if key in sums else vec
        if sums:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.int32()), "vec": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = parts.repartition(8, "key").mapInArrow(total, "key int, vec binary")
    return {r.key: np.frombuffer(bytes(r.vec), np.float64) for r in out.collect()}


def _products(vectors: DataFrame, mean: np.ndarray, q: np.ndarray | None, piece: int = 1 << 17) -> np.ndarray:
    """Sum over the rows x (one column of lists) of (x - mean)(x - mean)^T q, or without q of the
    outer products alone.  A task keeps one sum and sends it in pieces, so that they are added up
    by several tasks."""
    sent = vectors.sparkSession.sparkContext.broadcast((mean, q))
    d, wide = len(mean), len(mean) if q is None else q.shape[1]

    def partial(batches):
        mean, q = sent.value
        total = np.zeros((d, wide))
        for batch in batches:
            if batch.num_rows:
                x = _rows_of(batch.column(0)) - mean
                total += x.T @ (x if q is None else x @ q)
        flat = total.reshape(-1)
        for k, lo in enumerate(range(0, len(flat), piece)):
            yield pa.RecordBatch.from_pydict({"key": pa.array([k], pa.int32()), "vec": pa.array([flat[lo:lo + piece].tobytes()], pa.binary())})

    sums = _summed(vectors.mapInArrow(partial, "key int, vec binary"))
    return np.concatenate([sums[k] for k in sorted(sums)]).reshape(d, wide) if sums else np.zeros((d, wide))


def _signed(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def principal_components(df: DataFrame, vec_col: str, k: int = 2, center: bool = True, gram_dims: int = GRAM_DIMS,
                         extra: int = 30, most_passes: int = 60, tolerance: float = 1e-9, seed: int = 0) -> Components:
    """Directions of largest variance of the vectors.

    One pass counts and averages.  Up to ``gram_dims`` dimensions one more pass sums the covariance,
    whose eigenvectors the driver takes.  Wider vectors go by randomised block power iteration: a
    block of k + ``extra`` directions, random at first, is multiplied by the covariance (one pass,
    d x (k + extra) numbers a task) and made orthogonal, until the first k directions hold to
    ``tolerance``; the driver solves a problem of the block's size only.  Missing vectors are
    left out; without any there are no components.
    """
    own = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
    grouped = own.select(F.lit(0).alias("one"), array_to_vector("v").alias("f")).groupBy("one")
    stats = grouped.agg(F.count("f").alias("n"), Summarizer.mean(F.col("f")).alias("m")).first()
    if stats is None:
        return Components(np.zeros(0), np.zeros((0, k)), np.zeros(k))
    mean, n = stats.m.toArray(), max(stats.n - 1, 1)
    if not center:
        mean = np.zeros_like(mean)
    d = len(mean)
    k = min(k, d)
    if d <= gram_dims:
        values, vectors = np.linalg.eigh(_products(own, mean, None) / n)
        return Components(mean, _signed(vectors[:, ::-1][:, :k]), np.maximum(values[::-1][:k], 0))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + extra))))[0]
    for _ in range(most_passes):
        y = _products(own, mean, q) / n
        values, inner = np.linalg.eigh(q.T @ y)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        found = q @ inner
        off = np.linalg.norm(y @ inner - found * values, axis=0)
        if (off <= tolerance * max(values[0], 1e-300)).all():
            break
        q = np.linalg.qr(y)[0]
    return Components(mean, _signed(found), np.maximum(values, 0))


def project(df: DataFrame, vec_col: str, fitted: Components, out_cols=("x", "y")) -> DataFrame:
    """``df`` with the coordinates of its vectors in a double column per component (missing for a
    missing vector); narrow, one product per batch."""
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    names = list(out_cols[:fitted.vectors.shape[1]])
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches):
        f = sent.value
        for batch in batches:
            column = batch.column("__v")
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            xy, none = np.zeros((batch.num_rows, len(names))), np.ones(batch.num_rows, bool)
            if len(there):
                xy[there] = (_rows_of(column.take(pa.array(there))) - f.mean) @ f.vectors
                none[there] = False
            out = batch.drop_columns(["__v"])
            yield pa.RecordBatch.from_arrays([*out.columns, *[pa.array(xy[:, j], mask=none) for j in range(len(names))]], schema.names)

    return kept.withColumn("__v", F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)


def pca(df: DataFrame, vec_col: str, k: int = 2, out_cols=("x", "y"), center: bool = True) -> DataFrame:
    """``df`` with the coordinates of its centred vectors on their first ``k`` principal components."""
    return project(df, vec_col, principal_components(df, vec_col, k, center), out_cols)


@dataclass
class Centres:
    """Centres (k x d) with their ids, in the order of the ids."""

    ids: list
    points: np.ndarray

    def nearest(self, x: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Per row the position of its nearest centre (of equal ones the first) and the squared distance."""
        best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for lo in range(0, len(self.ids), block):
            c = self.points[lo:lo + block]
            d = (c * c).sum(axis=1) - 2 * (x @ c.T)
            near = d.argmin(axis=1)
            less = d[np.arange(len(x)), near] < best
            at[less], best[less] = lo + near[less], d[np.arange(len(x)), near][less]
        diff = x - self.points[at]
        return at, (diff * diff).sum(axis=1)


def collect_centres(centres: DataFrame, id_col: str = "cluster", centre_col: str = "centre") -> Centres:
    """The centre table on the driver: the model of any k-means is k x d numbers."""
    rows = sorted(centres.select(id_col, centre_col).collect(), key=lambda r: r[0])
    return Centres([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))


def lloyd(df: DataFrame, vec_col: str, start: Centres, steps: int) -> Centres:
    """``steps`` steps of k-means from given centres.  A step is one pass: every batch is compared
    with the broadcast centres by matrix products, a task leaves a count and a sum per centre it has
    met, and these are added up.  A centre without rows stays where it is."""
    own = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"))
    now = start
    for _ in range(steps):
        sent = df.sparkSession.sparkContext.broadcast(now)

        def partial(batches, sent=sent):
            centres = sent.value
            sums = np.zeros((len(centres.ids), centres.points.shape[1] + 1))
            for batch in batches:
                if batch.num_rows:
                    x = _rows_of(batch.column(0))
                    at, _ = centres.nearest(x)
                    order = np.argsort(at, kind="stable")
                    met, first = np.unique(at[order], return_index=True)
                    sums[met, 1:] += np.add.reduceat(x[order], first)
                    sums[:, 0] += np.bincount(at, minlength=len(sums))
            met = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_pydict({"key": pa.array(met.astype(np.int32)), "vec": pa.array([sums[j].tobytes() for j in met], pa.binary())})

        points = now.points.copy()
        for j, total in _summed(own.mapInArrow(partial, "key int, vec binary")).items():
            points[j] = total[1:] / total[0]
        now = Centres(now.ids, points)
    return now


def assign_nearest(df: DataFrame, vec_col: str, centres: DataFrame | Centres, id_col: str = "cluster",
                   centre_col: str = "centre") -> DataFrame:
    """J1 assignment step: nearest centre by Euclidean distance, ties to the smaller id (columns
    ``id_col`` and dist; missing for a missing vector).  The centres are broadcast."""
    fitted = centres if isinstance(centres, Centres) else collect_centres(centres, id_col, centre_col)
    kind = T.LongType() if isinstance(centres, Centres) else centres.schema[id_col].dataType
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    kept = df.drop(id_col, "dist")
    schema = T.StructType([*kept.schema.fields, T.StructField(id_col, kind), T.StructField("dist", T.DoubleType())])

    def run(batches):
        c = sent.value
        ids = np.array(c.ids, dtype=object)
        for batch in batches:
            column = batch.column("__v")
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            found, dist, none = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if len(there) and len(ids):
                at, sq = c.nearest(_rows_of(column.take(pa.array(there))))
                found[there], dist[there], none[there] = ids[at], np.sqrt(sq), False
            out = batch.drop_columns(["__v"])
            arrow = pa.array(found.tolist(), {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind.simpleString()))
            yield pa.RecordBatch.from_arrays([*out.columns, arrow, pa.array(dist, mask=none)], schema.names)

    return kept.withColumn("__v", F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)


def covariance_entries(df: DataFrame, vec_col: str, dims: int) -> DataFrame:
    """Sample covariance of the vector components as (i, j, cov).

    Each Arrow batch contributes one partial Gram matrix X^T X, its column sums
    and its row count (one numpy product per batch); the partials are summed as
    vectors by ``Summarizer`` (a regular partial + final aggregate), so only
    d*d numbers per batch leave a task.  cov = (G - n m m^T) / (n - 1).
    """
    if dims * dims > MAX_BROADCAST_ROWS:
        raise ValueError("dimension too large for a dense covariance")
    d = dims
    schema = "n long, s array<double>, g array<double>"

    def partial(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            yield pd.DataFrame({"n": [len(X)], "s": [X.sum(axis=0)], "g": [(X.T @ X).reshape(-1)]})

    parts = df.select(vec_col).mapInPandas(partial, schema)
    tot = parts.agg(F.sum("n").alias("n"),
                    Summarizer.sum(array_to_vector("s")).alias("s"),
                    Summarizer.sum(array_to_vector("g")).alias("g"))
    tot = tot.select("n", vector_to_array("s").alias("s"), vector_to_array("g").alias("g"))
    e = tot.select("n", "s", F.posexplode("g").alias("k", "sxy"))
    i = (F.col("k") / d).cast("int")
    j = (F.col("k") % d).cast("int")
    n = F.col("n").cast("double")
    return e.select(i.alias("i"), j.alias("j"),
                    ((F.col("sxy") - F.element_at("s", i + 1) * F.element_at("s", j + 1) / n)
                     / (n - 1)).alias("cov"))
