"""Scoring a vector library against a prompt table.

Every image is scored against every prompt.  The prompt table is small and its
size is checked: it is collected in blocks of at most ``MAX_PROMPTS_PER_BLOCK``
vectors, and each block is shipped to the executors once (broadcast variable or
plan literal).  The library is never shuffled and never joined: each partition
of the library is scored by one matrix product per Arrow batch (``arrow``) or
by JVM array expressions (``native``).  Labels beyond one block are scored in
further passes over the library, so the bound never drops prompts.  A label with more
prompts than a block is cut into tiles: every tile leaves a mergeable state per image
(sum, count and largest of its similarities), and one aggregate merges them; its mean
prompt vector is a sum of the vectors made by Spark.

``score_nested`` returns the scores of an image as one row with a struct per label, as the
scorer holds them: wide, long, two-level and pooled tables follow from it without a shuffle.

Measures per (image, label), for prompt vectors q_1..q_m of the label:
  cosine_similarity_i       = v . norm(q_i)
  average_cosine_similarity = mean_i cosine_similarity_i
  max_cosine_similarity     = max_i cosine_similarity_i
  average_embedding         = v . norm(mean_i q_i)
The image side is used as stored (library vectors are unit length).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.constants import (ALL_MEASURES, AVG_COSINE, AVG_EMBEDDING, MAX_COSINE, MAX_PROMPTS_PER_BLOCK, NORM_EPS)
from vecsight.functions.vectors import dot

MAX_NATIVE_PROMPTS = 256   # prompt vectors become plan literals on the JVM-only path
MAX_OUT_ROWS = 500_000     # rows per pandas frame yielded by the Arrow scorer


@dataclass
class PromptBlock:
    labels: list            # distinct labels of the block, sorted
    prompt_label: np.ndarray  # label index of every prompt row
    prompt_pos: np.ndarray    # prompt number inside its label (cosine_similarity_<n>)
    qn: np.ndarray            # normalised prompt vectors, P x d
    avg: np.ndarray           # normalised mean prompt vector per label, L x d


def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.maximum(n, NORM_EPS)


def _label_blocks(prompts: DataFrame, label_col: str, max_prompts: int) -> tuple[list[list], list[tuple]]:
    """Labels in blocks of at most ``max_prompts`` prompt rows, and the labels (with their count) that
    alone have more.  Only the per-label prompt counts reach the driver, a part at a time.
    """
    blocks, cur, size, large = [], [], 0, []
    for r in prompts.groupBy(label_col).count().orderBy(label_col).toLocalIterator():
        c = r["count"]
        if c > max_prompts:
            large.append((r[label_col], c))
            continue
        if cur and size + c > max_prompts:
            blocks.append(cur)
            cur, size = [], 0
        cur.append(r[label_col])
        size += c
    if cur:
        blocks.append(cur)
    return blocks, large


def _block_from_rows(rows, labels: list, label_col: str, prompt_col: str, vec_col: str) -> PromptBlock:
    lab_index = {lab: i for i, lab in enumerate(labels)}
    q = np.array([np.asarray(r[vec_col], dtype=np.float64) for r in rows])
    pl = np.array([lab_index[r[label_col]] for r in rows])
    pos = np.array([int(r[prompt_col]) for r in rows], dtype=np.int64)
    avg = np.stack([q[pl == j].mean(axis=0) for j in range(len(labels))])
    return PromptBlock(list(labels), pl, pos, _normalise(q), _normalise(avg))


def _of_labels(prompts: DataFrame, labels: list, label_col: str) -> DataFrame:
    wanted = F.col(label_col).isin([x for x in labels if x is not None])
    return prompts.where(wanted | F.col(label_col).isNull() if None in labels else wanted)


def collect_block(prompts: DataFrame, labels: list, label_col: str, prompt_col: str,
                  vec_col: str) -> PromptBlock:
    rows = _of_labels(prompts, labels, label_col).select(label_col, prompt_col, vec_col).orderBy(label_col, prompt_col).collect()
    return _block_from_rows(rows, labels, label_col, prompt_col, vec_col)


def prompt_blocks(prompts: DataFrame, label_col: str, prompt_col: str, vec_col: str,
                  max_prompts: int) -> tuple[list[PromptBlock], list[tuple]]:
    """The prompt table in broadcastable blocks (one bounded collect when it fits in one block,
    otherwise label blocks collected one at a time), and the labels, with their number of
    prompts, that have more than a block."""
    small = (prompts.select(label_col, prompt_col, vec_col).limit(max_prompts + 1)
             .collect())
    if len(small) <= max_prompts:
        first = lambda x: (x is not None, x)  # noqa: E731  a missing label is a label of its own
        rows = sorted(small, key=lambda r: (first(r[label_col]), r[prompt_col]))
        labels = sorted({r[label_col] for r in rows}, key=first)
        return [_block_from_rows(rows, labels, label_col, prompt_col, vec_col)] if rows else [], []
    blocks, large = _label_blocks(prompts, label_col, max_prompts)
    return [collect_block(prompts, labels, label_col, prompt_col, vec_col) for labels in blocks], large


def _measure_matrix(block: PromptBlock, S: np.ndarray, V: np.ndarray, measure: str) -> np.ndarray:
    """n x L matrix of one measure."""
    L = len(block.labels)
    n = S.shape[0]
    if measure not in (AVG_COSINE, MAX_COSINE, AVG_EMBEDDING):
        i = int(measure.rsplit("_", 1)[1])
        out = np.full((n, L), np.nan)
        sel = np.where(block.prompt_pos == i)[0]
        out[:, block.prompt_label[sel]] = S[:, sel]
        return out
    if measure == AVG_EMBEDDING:
        return V @ block.avg.T
    out = np.full((n, L), np.nan)
    for j in range(L):
        cols = S[:, block.prompt_label == j]
        out[:, j] = cols.mean(axis=1) if measure == AVG_COSINE else cols.max(axis=1)
    return out


def _arrow_scores(library: DataFrame, block: PromptBlock, id_cols: list[str], emb_col: str,
                  measures: tuple, names: dict, label_type: T.DataType) -> DataFrame:
    sc = library.sparkSession.sparkContext
    bc = sc.broadcast(block)
    id_fields = [library.schema[c] for c in id_cols]
    out_schema = T.StructType(id_fields + [
        T.StructField("label", label_type, True),
        T.StructField("embedding_type", T.StringType(), False),
        T.StructField("cosine_similarity", T.DoubleType(), True),
    ])
    out_names = [names.get(m, m) for m in measures]

    def score(batches):
        b = bc.value
        L = len(b.labels)
        labels = np.array(b.labels, dtype=object)
        # input rows per output frame, so one yielded frame holds at most MAX_OUT_ROWS rows
        step = max(1, MAX_OUT_ROWS // max(1, L * len(measures)))
        for whole in batches:
            for lo in range(0, len(whole), step):
                pdf = whole.iloc[lo:lo + step].reset_index(drop=True)
                V = np.stack(pdf[emb_col].to_numpy()).astype(np.float64)
                S = V @ b.qn.T
                parts = []
                for m, name in zip(measures, out_names):
                    M = _measure_matrix(b, S, V, m)          # n x L
                    part = pdf[id_cols].loc[pdf.index.repeat(L)].reset_index(drop=True)
                    part["label"] = np.tile(labels, len(pdf))
                    part["embedding_type"] = name
                    part["cosine_similarity"] = M.reshape(-1)
                    parts.append(part)
                out = pd.concat(parts, ignore_index=True)
                out["cosine_similarity"] = out["cosine_similarity"].where(
                    ~np.isnan(out["cosine_similarity"].to_numpy()), None)
                yield out

    return library.select(*id_cols, emb_col).mapInPandas(score, out_schema)


def _native_scores(library: DataFrame, block: PromptBlock, id_cols: list[str], emb_col: str,
                   measures: tuple, names: dict, label_type: T.DataType) -> DataFrame:
    """JVM-only path: prompt vectors become plan literals, dot products are array lambdas."""
    def lit_vec(v):
        return F.array(*[F.lit(float(x)) for x in v])

    structs = []
    emb = F.col(emb_col)
    for j, lab in enumerate(block.labels):
        sel = np.where(block.prompt_label == j)[0]
        per_prompt = {int(block.prompt_pos[p]): dot(emb, lit_vec(block.qn[p])) for p in sel}
        for m in measures:
            if m not in (AVG_COSINE, MAX_COSINE, AVG_EMBEDDING):
                i = int(m.rsplit("_", 1)[1])
                val = per_prompt.get(i, F.lit(None).cast("double"))
            elif m == AVG_EMBEDDING:
                val = dot(emb, lit_vec(block.avg[j]))
            elif m == AVG_COSINE:
                val = reduce(lambda a, b: a + b, per_prompt.values()) / F.lit(float(len(sel)))
            elif m == MAX_COSINE:
                val = F.greatest(*per_prompt.values()) if len(sel) > 1 else list(per_prompt.values())[0]
            else:
                raise ValueError(f"unknown measure {m}")
            structs.append(F.struct(F.lit(lab).cast(label_type).alias("label"),
                                    F.lit(names.get(m, m)).alias("embedding_type"),
                                    val.alias("cosine_similarity")))
    return library.select(*id_cols, F.inline(F.array(*structs)))


def _tile_states(library: DataFrame, q: np.ndarray, id_cols: list[str], emb_col: str) -> DataFrame:
    """Per image the state of one tile of normalised prompt vectors: sum, count and largest similarity."""
    bc = library.sparkSession.sparkContext.broadcast(q)
    keys = library.select(*id_cols, F.xxhash64(emb_col).alias("_image"), F.col(emb_col).alias("_vec"))

    def states(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            S = _vectors(batch.column("_vec")) @ bc.value.T
            kept = batch.drop_columns(["_vec"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(S.sum(axis=1)), pa.array(np.full(len(S), S.shape[1])), pa.array(S.max(axis=1))],
                                             [*kept.schema.names, "_sum", "_count", "_max"])

    schema = T.StructType([*keys.drop("_vec").schema.fields, *T.StructType.fromDDL("_sum double, _count bigint, _max double").fields])
    return keys.mapInArrow(states, schema)


def _tiled_scores(library: DataFrame, prompts: DataFrame, label, count: int, id_cols: list[str], emb_col: str, label_col: str,
                  prompt_col: str, vec_col: str, measures: tuple, names: dict, label_type: T.DataType, max_prompts: int) -> list[DataFrame]:
    """Scores of a label with more prompts than a block, tile by tile; prompts are dealt to tiles by a
    hash, half a block each on average."""
    own = _of_labels(prompts, [label], label_col).select(prompt_col, vec_col)
    parts = []
    pooled = [m for m in measures if m in (AVG_COSINE, MAX_COSINE)]
    single = [m for m in measures if m not in pooled]
    if single:  # the prompts asked for by number, and the mean vector
        wanted = {int(m.rsplit("_", 1)[1]) for m in single if m != AVG_EMBEDDING}
        rows = own.where(F.col(prompt_col).isin(sorted(wanted))).collect() if wanted else []
        d = len(own.select(vec_col).first()[0])
        q = np.array([r[vec_col] for r in rows], np.float64).reshape(-1, d)
        avg = np.array([mean_vector(own.withColumn("_all", F.lit(0)), ["_all"], vec_col).first()["mean_vec"]])
        block = PromptBlock([label], np.zeros(len(rows), int), np.array([int(r[prompt_col]) for r in rows], np.int64), _normalise(q), _normalise(avg))
        parts.append(_arrow_scores(library, block, id_cols, emb_col, tuple(single), names, label_type))
    if pooled:
        tiles = -(-2 * count // max_prompts)
        tile = F.pmod(F.xxhash64(prompt_col, vec_col), F.lit(tiles))
        states = []
        for k in range(tiles):
            q = np.array([r[vec_col] for r in own.where(tile == k).select(vec_col).collect()], np.float64)
            if len(q):
                states.append(_tile_states(library, _normalise(q), id_cols, emb_col))
        merged = reduce(DataFrame.unionByName, states).groupBy(*id_cols, "_image").agg(
            F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"), F.max("_max").alias("_max"))
        value = {AVG_COSINE: F.col("_sum") / F.col("_count"), MAX_COSINE: F.col("_max")}
        rows = F.array(*[F.struct(F.lit(label).cast(label_type).alias("label"), F.lit(names.get(m, m)).alias("embedding_type"),
                                  value[m].alias("cosine_similarity")) for m in pooled])
        # images that repeat have met in one group: each gets its rows
        copies = F.flatten(F.array_repeat(rows, (F.col("_count") / F.lit(count)).cast("int")))
        parts.append(merged.select(*id_cols, F.inline(copies)))
    return parts


def score_library(library: DataFrame, prompts: DataFrame, id_cols: list[str],
                  emb_col: str = "embedding", label_col: str = "label",
                  prompt_col: str = "prompt_id", vec_col: str = "qvec",
                  measures: tuple = ALL_MEASURES, names: dict | None = None,
                  method: str = "arrow", max_prompts: int = MAX_PROMPTS_PER_BLOCK) -> DataFrame:
    """Long score table ``id_cols + (label, embedding_type, cosine_similarity)``."""
    names = names or {}
    for m in measures:
        if m not in ALL_MEASURES and not re.fullmatch(r"cosine_similarity_\d+", m):
            raise ValueError(f"unknown measure {m!r}")
    label_type = prompts.schema[label_col].dataType
    if method == "native":
        max_prompts = min(max_prompts, MAX_NATIVE_PROMPTS)
    lib = library.where(F.col(emb_col).isNotNull())
    fn = _arrow_scores if method == "arrow" else _native_scores
    blocks, large = prompt_blocks(prompts, label_col, prompt_col, vec_col, max_prompts)
    parts = [fn(lib, block, id_cols, emb_col, measures, names, label_type) for block in blocks]
    for label, count in large:
        parts += _tiled_scores(lib, prompts, label, count, id_cols, emb_col, label_col, prompt_col, vec_col, measures, names,
                               label_type, max_prompts)
    if not parts:
        raise ValueError("empty prompt table")
    return reduce(DataFrame.unionByName, parts)


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column without missing lists as a matrix in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Blocks of prompts that a task of the nested scorer holds together.
NESTED_BLOCKS = 16


def score_nested(library: DataFrame, prompts: DataFrame, id_cols: list[str], labels: list, measures: tuple = ALL_MEASURES,
                 emb_col: str = "embedding", label_col: str = "label", prompt_col: str = "prompt_id",
                 vec_col: str = "qvec", max_prompts: int = MAX_PROMPTS_PER_BLOCK) -> DataFrame:
    """One row per image: ``id_cols`` and for each of ``labels`` a struct column (named by the label)
    with a double per measure, missing for a label without prompts.  No shuffle: the scorer
    writes what it holds.  Beyond ``NESTED_BLOCKS`` blocks of prompts, or with a label of more
    than one block, the structs are put together from the long table."""
    lib = library.where(F.col(emb_col).isNotNull())
    own = _of_labels(prompts, list(labels), label_col)
    blocks, large = prompt_blocks(own, label_col, prompt_col, vec_col, max_prompts)
    fields = [T.StructField(m, T.DoubleType()) for m in measures]
    schema = T.StructType([*[lib.schema[c] for c in id_cols], *[T.StructField(str(x), T.StructType(fields)) for x in labels]])
    if large or len(blocks) > NESTED_BLOCKS:
        from vecsight.operators.reshape import scores_struct

        return scores_struct(score_library(library, own, id_cols, emb_col, label_col, prompt_col, vec_col, measures), id_cols, labels, list(measures))
    sent = library.sparkSession.sparkContext.broadcast(blocks)

    def score(batches):
        place = {(b, x): j for b, block in enumerate(sent.value) for j, x in enumerate(block.labels)}
        of_label = {x: (b, j) for (b, x), j in place.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            V = _vectors(batch.column(emb_col))
            values = [{m: _measure_matrix(block, S, V, m) for m in measures} for block in sent.value for S in (V @ block.qn.T,)]
            structs = []
            for x in labels:
                b, j = of_label.get(x, (None, None))
                columns = [pa.nulls(len(V), pa.float64()) if b is None else pa.array(values[b][m][:, j], mask=np.isnan(values[b][m][:, j])) for m in measures]
                structs.append(pa.StructArray.from_arrays(columns, list(measures), mask=pa.array(np.full(len(V), b is None))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_cols], *structs], schema.names)

    return lib.select(*id_cols, emb_col).mapInArrow(score, schema)


def pool_prompt_scores(scores: DataFrame, key_cols: list[str]) -> DataFrame:
    """D13 on a long per-prompt table: mean and max per (image, label) over all its prompts."""
    g = scores.where(F.col("embedding_type").rlike(r"^cosine_similarity_\d+$")) \
        .groupBy(*key_cols, "label")
    return g.agg(F.avg("cosine_similarity").alias(AVG_COSINE),
                 F.max("cosine_similarity").alias(MAX_COSINE))


def pool_nested(nested: DataFrame, id_cols: list[str], labels: list, measures: tuple, label_type: T.DataType) -> DataFrame:
    """D13 on the rows of ``score_nested`` (per-prompt ``measures``): mean and max per (image, label) over
    the prompts there are, without a shuffle; labels without prompts have no row."""
    def pooled(x):
        own = F.filter(F.array(*[F.col(f"`{x}`")[m] for m in measures]), lambda v: v.isNotNull())
        total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
        return F.struct(F.lit(x).cast(label_type).alias("label"), F.try_divide(total, F.size(own)).alias(AVG_COSINE), F.array_max(own).alias(MAX_COSINE))

    return nested.select(*id_cols, F.inline(F.array(*[pooled(x) for x in labels]))).where(F.col(MAX_COSINE).isNotNull())


def mean_vector(df: DataFrame, group_cols: list[str], vec_col: str,
                out_col: str = "mean_vec") -> DataFrame:
    """Element-wise mean of the vectors of each group.

    One aggregation buffer per group, combined before the shuffle; groups without a vector are left out.
    """
    own = df.where(F.col(vec_col).isNotNull()).select(
        *group_cols, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    return (own.groupBy(*group_cols).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(*group_cols, vector_to_array("_m").alias(out_col)))


def _arrow_candidates(library: DataFrame, block: PromptBlock, id_cols: list[str], emb_col: str, measure: str,
                      k: int, slack: float, label_type: T.DataType) -> DataFrame:
    """Per Arrow batch and label the rows that can be among the k best: those within ``slack`` of the
    batch's k-th score (missing scores only if a batch has fewer than k)."""
    bc = library.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([library.schema[c] for c in id_cols] + [
        T.StructField("label", label_type, True), T.StructField("cosine_similarity", T.DoubleType(), True)])

    def best(batches):
        b = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            V = np.stack(pdf[emb_col].to_numpy()).astype(np.float64)
            M = _measure_matrix(b, V @ b.qn.T, V, measure)
            parts = []
            for j, label in enumerate(b.labels):
                x = np.where(np.isnan(M[:, j]), -np.inf, M[:, j])
                least = np.partition(x, len(x) - k)[len(x) - k] if len(x) > k else -np.inf
                at = np.flatnonzero(x >= least - slack)
                part = pdf[id_cols].iloc[at].copy()
                part["label"] = label
                part["cosine_similarity"] = pd.Series(M[at, j], index=part.index).where(~np.isnan(M[at, j]), None)
                parts.append(part)
            yield pd.concat(parts, ignore_index=True)

    return library.select(*id_cols, emb_col).mapInPandas(best, schema)


def search_topk(library: DataFrame, prompts: DataFrame, id_cols: list[str], k: int,
                tie_col: str, measure: str = "cosine_similarity_1", digits: int | None = None,
                emb_col: str = "embedding", label_col: str = "label", prompt_col: str = "prompt_id",
                vec_col: str = "qvec", max_prompts: int = MAX_PROMPTS_PER_BLOCK) -> DataFrame:
    """For each query label, the k best images (ties to the smaller ``tie_col``).

    ``digits`` rounds the score before ranking (ties are then decided on the rounded score).
    Every Arrow batch sends only what can be among the k best; a literal k then plans as a
    partial ``WindowGroupLimit``.
    """
    lib = library.where(F.col(emb_col).isNotNull())
    slack = 0.0 if digits is None else 10.0 ** -digits
    label_type = prompts.schema[label_col].dataType
    blocks, large = prompt_blocks(prompts, label_col, prompt_col, vec_col, max_prompts)
    parts = [_arrow_candidates(lib, block, id_cols, emb_col, measure, int(k), slack, label_type) for block in blocks]
    for label, count in large:
        rows = _tiled_scores(lib, prompts, label, count, id_cols, emb_col, label_col, prompt_col, vec_col, (measure,), {}, label_type, max_prompts)
        parts += [r.select(*id_cols, "label", "cosine_similarity") for r in rows]
    if not parts:
        raise ValueError("empty prompt table")
    s = reduce(DataFrame.unionByName, parts)
    if digits is not None:
        s = s.withColumn("cosine_similarity", F.round("cosine_similarity", digits))
    w = Window.partitionBy("label").orderBy(F.col("cosine_similarity").desc_nulls_last(),
                                            F.col(tie_col).asc())
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(int(k)))
