"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``sample`` vectors, in hash order of their ids) the graph of nearest
neighbours is cut into parts of equal size by recursive bisection: a smoothed random vector over
the graph is cut at its median, then pairs of vertices are swapped while that lowers the number of
edges cut.  A small network learns to predict, from a vector, the parts of its neighbours.  Every
row is indexed in its most probable part; a query visits its most probable parts and the rows
there are ranked by exact distance.  How many parts are visited is read off the sample: as many
as hold ``recall`` of the sample's own neighbours.  The number of parts follows from the sample
(``least`` of its vectors a part), so small and large tables are searched the same way.

Parts are searched in blocks of bounded size on both sides, so a part that holds a third of all
rows is many tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part; distances only exist between vectors of equal length, and vectors of another length than
the sample's most frequent one are searched exhaustively among themselves; a row is never its own
neighbour, rows that repeat its id are; a null id comes last among ties and is never a query;
fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecsight.llm.common import cut, schema_with
from vecsight.llm.vectors import groups, matrix, packed, unpack


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of every row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    square = (x * x).sum(1)
    for lo in range(0, len(x), 512):
        d = square[None, :] - 2 * (x[lo:lo + 512] @ x.T)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo:lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(edges: np.ndarray, n: int, rng) -> np.ndarray:
    """Sides (0/1, equal halves) of n vertices joined by ``edges`` (pairs)."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = rng.standard_normal(n)
    for _ in range(60):  # smooth over the graph, away from the constant vector
        x = 0.5 * x + 0.5 * np.bincount(a, x[b], n) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) or 1
    side = np.zeros(n, np.int64)
    side[np.argsort(x, kind="stable")[n // 2:]] = 1
    for _ in range(20):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right), max(1, n // 50))
        good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not good:
            break
        trial = side.copy()
        trial[left[:good]], trial[right[:good]] = 1, 0
        if (trial[a] != trial[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = trial
    return side


def partition(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Balanced parts (a power of two of them) of the vertices of a neighbour graph."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    edges = np.stack([np.repeat(np.arange(n), k), graph.ravel()], 1)
    label = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        new = label * 2
        for p in range(done):
            own = np.flatnonzero(label == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = place[edges]
            new[own] += _bisect(inside[(inside >= 0).all(1)], len(own), rng)
        label, done = new, done * 2
    return label


class Router:
    """A network with one hidden layer from a vector to part probabilities."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        x = ((x - self.center) / self.scale).astype(np.float32)
        soft = soft.astype(np.float32)
        d, p = x.shape[1], soft.shape[1]
        self.weights = [rng.standard_normal((d, hidden)).astype(np.float32) * np.float32((2 / d) ** 0.5), np.zeros(hidden, np.float32),
                        rng.standard_normal((hidden, p)).astype(np.float32) * np.float32((1 / hidden) ** 0.5), np.zeros(p, np.float32)]
        first, second, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for epoch in range(epochs):
            rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                b = order[lo:lo + 256]
                h = np.maximum(x[b] @ self.weights[0] + self.weights[1], 0)
                delta = (_softmax(h @ self.weights[2] + self.weights[3]) - soft[b]) / len(b)
                back = (delta @ self.weights[2].T) * (h > 0)
                slopes = [x[b].T @ back, back.sum(0), h.T @ delta, delta.sum(0)]
                t += 1
                for w, g, m, v in zip(self.weights, slopes, first, second):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (rate / (1 - 0.9 ** t) * m / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def odds(self, x: np.ndarray) -> np.ndarray:
        x = ((x - self.center) / self.scale).astype(np.float32)
        return np.maximum(x @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, parts: int, recall: float, k: int = 10, seed: int = 0) -> tuple[Router, int]:
    """The router of a sample, and how many parts a query visits."""
    k = min(k, len(x) - 1)
    graph = neighbour_graph(x, k)
    label = partition(graph, parts, seed)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1.0 / (k + 1))
    soft[np.arange(len(x)), label] += 1.0 / (k + 1)
    # visits are judged on vectors that the judging router has not seen
    held = np.arange(len(x)) % 5 == 0
    odds = Router(x[~held], soft[~held], seed=seed).odds(x)
    rank = np.argsort(np.argsort(-odds[held], axis=1), axis=1)
    place = odds.argmax(1)[graph[held]]
    need = np.take_along_axis(rank, place, 1)  # per neighbour: how many parts are visited before its own
    visits = next(m for m in range(1, parts + 1) if (need < m).mean() >= recall or m == parts)
    return Router(x, soft, seed=seed), visits


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = 4096, least: int = 64,
           recall: float = 0.95, block: int = 4096, seed: int = 0) -> DataFrame:
    """The k nearest rows of every row for which ``is_query`` (over vec_id) holds: query_id, rank,
    vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    rows = cut(packed(vectors).where("raw IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
               .withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    ids = rows.select("vec_id", "row").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "row").limit(sample).select("row")
    some = sorted(rows.join(F.broadcast(ids), "row").select("row", "dim", "raw").collect(), key=lambda r: r.row)
    dims = [r.dim for r in some]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    own = [r.raw for r in some if r.dim == dim]
    parts = 1
    while parts * 2 * least <= len(own):
        parts *= 2
    router, visits = fit(matrix(own), parts, recall, k, seed) if parts > 1 else (None, 1)
    model = spark.sparkContext.broadcast(router)  # a fixed number of weights

    def route(batches):
        net = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column("dim"))
            fits = dims == dim
            # a row is indexed in its first part; only a query needs all that it visits
            many = np.where(fits & np.asarray(batch.column("asks")), visits, 1)
            best = np.repeat(-dims[:, None].astype(np.int64) - 1, visits, 1)  # other lengths: a part of their own
            if fits.any():
                best[fits] = 0 if net is None else np.argsort(
                    -net.odds(matrix(batch.column("raw").filter(pa.array(fits)))), axis=1, kind="stable")[:, :visits]
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(best[np.arange(visits) < many[:, None]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "parts"])

    routed = cut(rows.mapInArrow(route, schema_with(rows, "parts array<bigint>")), "routed")
    index = routed.select("row", "vec_id", "raw", F.col("parts")[0].alias("part"))
    asked = routed.where("asks").select("row", "vec_id", "raw", F.explode("parts").alias("part"))
    sizes = (index.groupBy("part").agg(F.ceil(F.count("*") / block).alias("row_blocks"))
             .join(asked.groupBy("part").agg(F.ceil(F.count("*") / block).alias("query_blocks")), "part"))
    each = lambda column: F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))
    at = lambda column: F.pmod(F.xxhash64("row"), F.col(column))
    left = index.join(sizes, "part").select("part", at("row_blocks").alias("rb"), each("query_blocks").alias("qb"),
                                            F.lit(False).alias("asks"), "row", "vec_id", "raw")
    right = asked.join(sizes, "part").select("part", each("row_blocks").alias("rb"), at("query_blocks").alias("qb"),
                                             F.lit(True).alias("asks"), "row", "vec_id", "raw")

    def nearest(batches):
        for table in groups(batches, 3):
            asks = np.asarray(table.column("asks"))
            if asks.all() or not asks.any():
                continue
            here, there = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
            ids, number = here.column("vec_id").to_pylist(), np.asarray(here.column("row"))
            tie = np.array([np.iinfo(np.int64).max if i is None else i for i in ids])
            x = matrix(here.column("raw"))
            out: list[list] = [[], [], [], [], []]
            for row, query, raw in zip(*(there.column(c).to_pylist() for c in ("row", "vec_id", "raw")), strict=True):
                gap = x - unpack(raw)
                score = np.sqrt((gap * gap).sum(1))
                score[number == row] = np.inf
                near = np.flatnonzero(score <= np.partition(score, min(k, len(score)) - 1)[min(k, len(score)) - 1])
                for p in near[np.lexsort((tie[near], score[near]))][:k]:
                    if number[p] != row:
                        for column, value in zip(out, (row, query, int(number[p]), ids[p], float(score[p]))):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.float64())],
                                                 ["query_row", "query_id", "row", "vec_id", "score"])

    found = (left.unionByName(right).repartition("part", "rb", "qb").sortWithinPartitions("part", "rb", "qb")
             .mapInArrow(nearest, "query_row long, query_id long, row long, vec_id long, score double"))
    w = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
