"""Toxicity by a classifier chain.

The categories are predicted one after the other by logistic models over the hashed words and
word beginnings that a document holds.  Each model also reads the log odds of all earlier
categories; in training these come from models that have not seen the document (out of fold),
so a later model learns how far an earlier one can be trusted.  The threshold of the last
category is the one that is best (F1) on its out-of-fold predictions.

The chain is fitted on at most ``sample`` labelled documents, taken in hash order of their ids;
scoring covers every document and its whole text, shuffles nothing and holds one batch.

Defined results: a null or empty text has no features and gets the models' intercepts; rows with
a null label take no part in fitting, repeated labels of an id count as its largest; a category
without both kinds of labels is predicted at its rate, and then nothing is rejected; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import U64, Fingerprints, schema_with, text_pieces

SPACE = 1 << 24
_BEGINNINGS = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def _features(column, weights=None):
    """(row, feature) pairs of the lowered texts: every word and its first 4, 5 and 6 bytes (a shorter
    word stands for its beginnings, so that all words weigh alike), hashed.
    With ``weights``, only features that have one.  Each pair comes once."""
    for i, j, data, offsets in text_pieces(column):
        n = len(data)
        ink = _LETTER[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(ink & ~(np.concatenate([[False], ink[:-1]]) & ~edge[:n]))
        ends = np.flatnonzero(ink & ~(np.concatenate([ink[1:], [False]]) & ~edge[1:])) + 1
        rows = np.searchsorted(offsets, starts, "right") - 1
        prints = Fingerprints(data)
        pairs = []
        for most in (*_BEGINNINGS, None):
            found = (prints.of(starts, ends if most is None else np.minimum(ends, starts + most)) + U64(most or 0)) % U64(SPACE)
            r = rows
            if weights is not None:
                used = weights[found]
                found, r = found[used], r[used]
            pairs.append((r.astype(U64) << U64(24)) | found)
        both = np.unique(np.concatenate(pairs))
        yield i, j, (both >> U64(24)).astype(np.int64), (both & U64(SPACE - 1)).astype(np.int64)


class Incidence:
    """A matrix of ones at (row, column) pairs, with dense columns to the right of them."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, width: int, dense: np.ndarray):
        self.rows, self.columns, self.width, self.dense = rows, columns, width, dense
        self.shape = (len(dense), width + dense.shape[1])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.columns], len(self.dense)) + self.dense @ w[self.width:]

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times a vector."""
        return np.concatenate([np.bincount(self.columns, v[self.rows], self.width), self.dense.T @ v])

    def squares(self, weight: np.ndarray) -> np.ndarray:
        """Weighted sums of the squares of every column."""
        return np.concatenate([np.bincount(self.columns, weight[self.rows], self.width), (self.dense ** 2).T @ weight])

    def of(self, keep: np.ndarray) -> Incidence:
        """Some rows, numbered anew."""
        own = keep[self.rows]
        return Incidence((np.cumsum(keep) - 1)[self.rows[own]], self.columns[own], self.width, self.dense[keep])

    def beside(self, dense: np.ndarray) -> Incidence:
        """With further dense columns."""
        return Incidence(self.rows, self.columns, self.width, np.column_stack([self.dense, dense]))


def _plain(x) -> Incidence:
    none = np.zeros(0, np.int64)
    return x if isinstance(x, Incidence) else Incidence(none, none, 0, np.asarray(x, float))


class Logistic:
    """A linear model with intercept, fitted by Newton steps with an L2 penalty; the steps are found by
    conjugate gradients over the pairs, so the number of features isn't bounded by a dense matrix."""

    def __init__(self, x: Incidence | np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 10, steps: int = 40):
        x = _plain(x)
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
        self.w, self.b = np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
        if not 0 < y.sum() < len(y):
            return
        full = x.beside(np.ones(x.shape[0]))
        ridge = np.full(full.shape[1], penalty)
        ridge[-1] = 1e-6
        theta = np.append(self.w, self.b)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(full.times(theta), -30, 30)))
            slope = full.back(p - y) + ridge * theta
            weight = np.maximum(p * (1 - p), 1e-4)
            scale = full.squares(weight) + ridge
            move, left = np.zeros_like(theta), slope.copy()
            eased = left / scale
            way, size = eased.copy(), left @ eased
            goal = 1e-4 * size
            for _ in range(steps):
                if size <= goal or size == 0:
                    break
                bent = full.back(weight * full.times(way)) + ridge * way
                far = size / (way @ bent)
                move += far * way
                left -= far * bent
                eased = left / scale
                size, before = left @ eased, size
                way = eased + size / before * way
            theta = theta - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-9))
            if np.abs(move).max() < 1e-3:
                break
        self.w, self.b = theta[:-1], float(theta[-1])

    def odds(self, x: Incidence | np.ndarray) -> np.ndarray:
        return _plain(x).times(self.w) + self.b


class Chain:
    """Fitted models of all categories over the chosen features."""

    def __init__(self, categories, chosen, models, threshold):
        self.categories, self.chosen, self.models, self.threshold = categories, chosen, models, threshold

    def used(self) -> np.ndarray:
        """Which features have a weight, to look at no others."""
        out = np.zeros(SPACE, bool)
        out[self.chosen] = True
        return out

    def odds(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Log odds (documents x categories) from (row, feature) pairs of chosen features."""
        at, out, m = np.searchsorted(self.chosen, features), np.zeros((n, len(self.models))), len(self.chosen)
        for k, model in enumerate(self.models):
            out[:, k] = np.bincount(rows, model.w[at], n) + model.b + _squash(out[:, :k]) @ model.w[m:]
        return out


def _squash(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds, -8, 8) / 4


def _best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Log odds between two neighbours that give the best F1; of equal ones the widest gap."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    gap = np.append(odds[order][:-1] - odds[order][1:], 0.0)
    best = max((i for i in range(len(y)) if gap[i] > 0 or i == len(y) - 1), key=lambda i: (f1[i], gap[i]))
    return float(odds[order][best] - gap[best] / 2)


def fit_rows(rows: list[tuple[list[float], np.ndarray]], categories: list[str], least: float = 4.0,
             folds: int = 3, penalty: float = 2.0) -> Chain:
    """Fit the chain on (labels, features) of a bounded number of documents; every feature takes part
    whose count among the positives is more than ``least`` standard deviations from chance."""
    n = len(rows)
    y = np.array([r[0] for r in rows], np.float32).reshape(n, len(categories))
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r[1]) for r in rows]) if n else np.zeros(0, np.int32)
    flat = np.concatenate([r[1] for r in rows]).astype(np.int32) if n else np.zeros(0, np.int32)
    del rows
    names, seen = np.unique(flat, return_counts=True)
    often = seen > 2  # rarer features are never chosen
    names, seen = names[often], seen[often]
    place = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    kept = names[place] == flat if len(names) else np.zeros(len(flat), bool)
    flat, owner = place[kept].astype(np.int32), owner[kept]
    del place, kept
    chosen = np.zeros(len(names), bool)
    for k in range(len(categories)):  # features by how far their share among the positives is from chance
        positive = np.bincount(flat, y[owner, k], len(names)) if n else seen
        rate = y[:, k].mean() if n else 0.0
        score = np.abs(positive - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
        chosen |= score > least
    column = np.cumsum(chosen) - 1
    kept = chosen[flat]
    x = Incidence(owner[kept].astype(np.int64), column[flat[kept]], int(chosen.sum()), np.zeros((n, 0)))
    chosen = names[chosen]
    fold, models, apart = np.arange(n) % folds, [], np.zeros((n, len(categories)))
    for k in range(len(categories)):
        for f in range(folds):
            out = fold == f
            apart[out, k] = Logistic(x.of(~out), y[~out, k], penalty).odds(x.of(out))
        models.append(Logistic(x, y[:, k], penalty))
        x = x.beside(_squash(apart[:, k]))
    both = n and 0 < y[:, -1].sum() < n
    return Chain(categories, chosen, models, _best_threshold(apart[:, -1], y[:, -1]) if both else float("inf"))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = 6_000) -> Chain:
    """Fit on ``labels`` (doc_id and one 0/1 column per category, in chain order) and their texts."""
    own = (labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *categories])).groupBy("doc_id")
           .agg(*[F.max(c).cast("double").alias(c) for c in categories])
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
           .select(F.col("doc_id").alias("__id"), F.array(*categories).alias("labels")))

    def run(batches):
        for batch in batches:
            for i, j, rows, features in _features(batch.column("text")):
                at = np.searchsorted(rows, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").slice(i, j - i), batch.column("labels").slice(i, j - i),
                     pa.array([features[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                    ["id", "labels", "features"])

    pairs = docs.join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select(
        "__id", "labels", F.lower(F.col("text").cast("string")).alias("text"))
    # rows that repeat an id come once: at most ``sample`` rows reach the driver
    rows = (pairs.mapInArrow(run, "id long, labels array<double>, features binary").groupBy("id")
            .agg(F.max(F.struct("features", "labels")).alias("r")).select("id", "r.*").collect())
    rows.sort(key=lambda r: hash((r.id * 2654435761) % 2**31))
    return fit_rows([(r.labels, np.frombuffer(r.features, "<i4")) for r in rows], categories)


def predict(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with a probability ``p_<category>`` each and whether the document is rejected
    (``toxic``); columns with these names are replaced."""
    spread = docs.sparkSession.sparkContext.broadcast(chain)  # its size is bounded by the sample it was fitted on
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.drop(*names, "toxic")

    def run(batches):
        chain = spread.value
        used = chain.used()
        for batch in batches:
            odds = np.zeros((batch.num_rows, len(names)))
            for i, j, rows, features in _features(batch.column("__lower"), used):
                odds[i:j] = chain.odds(rows, features, j - i)
            out = batch.drop_columns(["__lower"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *(pa.array(1 / (1 + np.exp(-odds[:, k]))) for k in range(len(names))),
                 pa.array(odds[:, -1] > chain.threshold)], [*out.schema.names, *names, "toxic"])

    schema = schema_with(kept, ", ".join(f"`{n}` double" for n in names) + ", toxic boolean")
    return kept.withColumn("__lower", F.lower(F.col(f"`{text}`").cast("string"))).mapInArrow(run, schema)


def labelled(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The chain of the ``labels`` table: low quality first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"]
