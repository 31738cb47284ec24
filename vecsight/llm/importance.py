"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words) are counted over all
documents: the target model over the documents labelled as good, the raw model over everything.
A document's log weight is the sum of log(target / raw) over its n-grams.  Adding Gumbel noise
to the log weights and taking the k largest is sampling without replacement in proportion to
the weights; the noise is a hash of (seed, doc_id), so a run can be repeated.

Both models are smoothed by ``prior`` times the pooled distribution, so n-grams that the labelled
documents lack weigh by how much text there is, not by chance.

Defined results: a null or empty text has log weight 0; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lowered; rows that share doc_id and text share their key; documents tied with the k-th key are
kept; without labelled documents the target model equals the raw one and the sample is uniform;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import U64, Fingerprints, add_up, cut, few, kth_largest, mix, schema_with, text_pieces, word_spans

BUCKETS = 1 << 16
_SLICES = 8


def _ngrams(column, buckets: int):
    """For runs of rows: (first row, end row, buckets of the n-grams, start of each row's in them)."""
    for i, j, data, offsets in text_pieces(column):
        starts, ends, first = word_spans(data, offsets)
        words = Fingerprints(data, lowered=True).of(starts, ends)
        pairs = mix(words[:-1] * U64(3) + words[1:]) if len(words) > 1 else words[:0]
        inner = np.ones(len(pairs), bool)
        inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] - 1] = False
        kept = np.cumsum(np.concatenate([[0], inner]))  # pairs kept before each word
        yield i, j, words % U64(buckets), first, pairs[inner] % U64(buckets), kept[np.minimum(first, len(pairs))]


def counts(docs: DataFrame, target: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all rows and of the rows whose ``target`` is true; every task sends one
    vector per model, so what is shuffled grows with the tasks and not with the text."""
    def run(batches):
        sums = np.zeros((2, buckets))
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False))
            for i, j, ones, first, pairs, first_pair in _ngrams(batch.column(0), buckets):
                sums[0] += np.bincount(ones, minlength=buckets) + np.bincount(pairs, minlength=buckets)
                for r in np.flatnonzero(good[i:j]):
                    own = np.concatenate([ones[first[r]:first[r + 1]], pairs[first_pair[r]:first_pair[r + 1]]])
                    np.add.at(sums[1], own, 1)
        parts = sums.reshape(2 * _SLICES, -1)
        yield pa.RecordBatch.from_pydict({"key": pa.array(range(len(parts)), pa.int32()),
                                          "vec": pa.array([p.tobytes() for p in parts], pa.binary())})

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(target).cast("boolean").alias("good"))
    got = add_up(rows.mapInArrow(run, "key int, vec binary"))
    none = np.zeros(buckets // _SLICES)
    both = np.concatenate([got.get(k, none) for k in range(2 * _SLICES)]).reshape(2, buckets)
    return both[0], both[1]


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    pooled = (raw + 1e-3) / (raw + 1e-3).sum()
    model = lambda c: (c + prior * pooled) / (c.sum() + prior)
    return np.log(model(target)) - np.log(model(raw))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """(doc_id, log_weight, n_grams, key): one row per row of ``docs``, nothing is shuffled."""
    spread = docs.sparkSession.sparkContext.broadcast(ratio)  # one double per bucket, a fixed number

    def run(batches):
        weights = spread.value
        for batch in batches:
            logs, sizes = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, ones, first, pairs, first_pair in _ngrams(batch.column("text"), len(weights)):
                for values, at in ((ones, first), (pairs, first_pair)):
                    upto = np.concatenate([[0.0], np.cumsum(weights[values])])
                    logs[i:j] += upto[at[1:]] - upto[at[:-1]]
                    sizes[i:j] += at[1:] - at[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("noise"), pa.array(logs), pa.array(sizes)],
                                             ["doc_id", "noise", "log_weight", "n_grams"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", uniform.alias("noise"), F.col("text").cast("string").alias("text"))
    schema = schema_with(rows.select("doc_id", "noise"), "log_weight double, n_grams bigint")
    return (rows.mapInArrow(run, schema)
            .withColumn("key", F.col("log_weight") - F.log(-F.log("noise"))).drop("noise"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, prior: float = 10_000.0,
             seed: int = 0) -> DataFrame:
    """One row per document: log_weight, key and whether the document is ``kept``.

    ``labels`` (doc_id, quality) names target documents by quality 1.  k is ``share`` of all
    documents; by default the share of target documents among the labelled ones.  All labels
    count; the ids of target documents are sent to every task if counted to be few, else joined by
    a shuffle.
    """
    marks = (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("__good")))
    marked = docs.select("doc_id", "text").join(few(marks.where("__good")), "doc_id", "left")
    raw, target = counts(marked, "__good")
    if share is None:
        n, good = marks.where("__good IS NOT NULL").agg(F.count("*"), F.sum(F.col("__good").cast("long"))).first()
        share = good / n if n else 1.0
    scored = cut(weigh(docs.select("doc_id", "text"), log_ratio(raw, target, prior), seed), "importance")
    least = kth_largest(scored, "key", round(share * scored.count()))
    return scored.withColumn("kept", F.lit(False) if least is None else F.col("key") >= F.lit(least))
