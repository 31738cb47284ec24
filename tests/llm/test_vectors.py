import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vecsight.llm import ann, forest, queries

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<double>, label int, raw string, node int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", 1) for i, v in zip(ids, vectors)], SCHEMA)


def planted(seed, n, d, group, low, high):
    """Groups around random centres, at cosines between low and high to their centre."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // group):
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        out.append(c)
        for _ in range(group - 1):
            o = rng.standard_normal(d)
            o -= (o @ c) * c
            o /= np.linalg.norm(o)
            cos = rng.uniform(low, high)
            out.append(rng.uniform(0.5, 3) * (cos * c + math.sqrt(1 - cos * cos) * o))
    return np.array(out)


def links(ids, v, least):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(1))
        if (new == label).all():
            return sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), label))
        label = new


@pytest.mark.parametrize(("group", "low", "leaf"), [(2, 0.9, 200), (40, 0.97, 100), (300, 0.995, 100)])
def test_dedup_against_all_pairs(spark, group, low, leaf):
    v = planted(group, 1500, 32, group, low, 0.999)
    ids = np.random.default_rng(1).permutation(len(v)) * 3
    got = sorted(tuple(r) for r in forest.near_duplicates(frame(spark, ids.tolist(), v), leaf=leaf).collect())
    want = links(ids, v, 0.9)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.995 * there  # and none below the threshold:
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and (found < there or got == want)


def test_dedup_of_a_large_diffuse_cluster(spark, tmp_path):
    """A third of 60,000 vectors at cosines of about 0.92, leaves of 2,000: no cut may part them."""
    rng = np.random.default_rng(5)
    n, d, k = 60_000, 64, 20_000
    v = rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1)[:, None]
    centre = v[-1]
    v[:k] -= np.outer(v[:k] @ centre, centre)
    v[:k] = math.sqrt(0.92) * centre + math.sqrt(0.08) * v[:k] / np.linalg.norm(v[:k], axis=1)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(v)}), tmp_path / "v.parquet", row_group_size=10_000)
    got = forest.near_duplicates(spark.read.parquet(f"{tmp_path}/v.parquet")).toPandas().sort_values("vec_id").n_links.to_numpy()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = np.concatenate([(u[i:i + 2000] @ u.T >= 0.9).sum(1) - 1 for i in range(0, n, 2000)])
    print("recall of links", got.sum() / want.sum())
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()


def test_deeper_trees_are_more():
    assert forest.trees_for(3, 0.12, math.sqrt(0.2)) == 8 < forest.trees_for(15, 0.12, math.sqrt(0.2)) < forest.trees_for(20, 0.12, math.sqrt(0.2))


def test_dedup_query_against_all_pairs(spark):
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = sorted(tuple(r) for r in queries.op4_embedding_dedup(spark, SF).collect())
    assert got == links(p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float), 0.9)


def test_dedup_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, [2, 0]), (2, [1, 0]), (3, [0, 0]), (4, None), (5, [1, None]), (6, [nan, 1]), (7, [inf, 1]), (8, []), (9, [1, 0, 0]),
            (None, [0, 1]), (10, [0, 1e200]), (11, [1e-200, 0]), (3, None)]
    got = sorted((tuple(r) for r in forest.near_duplicates(frame(spark, *zip(*rows))).collect()), key=str)
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 3)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), (None, 1, 10, False), (10, 1, 10, True), *lone], key=str)
    assert forest.near_duplicates(frame(spark, [], [])).collect() == []


def nearest(ids, v, q, k):
    score = np.sqrt(((v - v[q]) ** 2).sum(1))
    score[q] = np.inf
    return [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, score))[:k] if j != q]


def test_search_query_recall(spark, monkeypatch):
    seen, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, parts, *a: seen.append((parts, (out := fit(x, parts, *a))[1])) or out)
    p = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, v = p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float)
    got = {}
    for r in sorted(queries.op10_learned_partitions(spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    at = {int(i): k for k, i in enumerate(ids)}
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = sum(len({x for x, _ in nearest(ids, v, at[q], 10)} & {x for x, _ in found}) for q, found in got.items())
    assert hits >= 0.9 * 10 * len(got)
    print("recall", hits / 10 / len(got), "parts and visits", seen)
    assert len(seen) == 1 and seen[0][0] >= 4 and 1 <= seen[0][1] < seen[0][0]  # through parts, not by a full scan
    for q, found in got.items():
        assert all(math.isclose(s, np.linalg.norm(v[at[x]] - v[at[q]]), rel_tol=1e-12) for x, s in found)
        assert found == sorted(found, key=lambda r: (r[1], r[0])) and len(found) == 10


def test_search_routes_clustered_vectors_to_few_parts(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((16, 24)) * 4
    v = centres[rng.integers(0, 16, 6000)] + rng.standard_normal((6000, 24))
    router, visits = ann.fit(v[:3000], 8, 0.95)
    assert visits <= 4
    df = frame(spark, range(6000), v)
    got = ann.search(df, F.col("vec_id") % 50 == 0, sample=3000, least=375, block=300).collect()
    ids = np.arange(6000)
    hits = sum(len({x for x, _ in nearest(ids, v, q, 10)} & {r.vec_id for r in got if r.query_id == q}) for q in range(0, 6000, 50))
    assert hits >= 0.9 * 10 * 120


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((8, 10))[np.repeat(np.arange(8), 100)] * 6 + rng.standard_normal((800, 10))
    graph = ann.neighbour_graph(v, 8)
    label = ann.partition(graph, 8)
    assert np.bincount(label).tolist() == [100] * 8
    assert (label[graph] == label[:, None]).mean() > 0.8


def test_search_edges(spark):
    nan = float("nan")
    rows = [(0, [0, 0.5]), (100, [1, 1]), (100, [1, 1]), (1, [1, 1]), (2, None), (3, [0, 0]), (200, [nan, 1]), (300, [1, 2, 3]), (4, [1, 2, 4]),
            (None, [1, 1]), (5, [1, None]), (400, [])]
    got = sorted((tuple(r) for r in ann.search(frame(spark, *zip(*rows)), F.col("vec_id") % 100 == 0, k=3).collect()), key=str)
    far = math.sqrt(1.25)
    twin = [(100, 1, 1, 0.0), (100, 2, 100, 0.0), (100, 3, None, 0.0)]
    assert got == sorted([(0, 1, 1, far), (0, 2, 100, far), (0, 3, 100, far), *twin, *twin, (300, 1, 4, 1.0)], key=str)
    assert ann.search(frame(spark, [], []), F.col("vec_id") % 100 == 0).collect() == []
    lonely = frame(spark, [0], [[1, 2]])
    assert ann.search(lonely, F.col("vec_id") % 100 == 0).collect() == []
