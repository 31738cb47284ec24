"""Packing token pieces into sequences of a fixed capacity by best-two-fit.

Sequences are filled one at a time: greedily with the longest unpacked piece that still fits;
when none fits, the smallest piece of the sequence is exchanged for the two unpacked pieces that
fill the gap left by it best, if they fill more than it did, as often as that helps.  Pieces below
a sixth of the capacity are not used for that: they fill gaps at the end better than others.

Pieces of one length are alike, so the rule needs only how many there are of each length: a
histogram of as many numbers as the capacity, whatever the number of pieces.  A filling found is
used as often as the counts allow, which is what filling one by one would do; each filling uses
up a length or the copies of it in reach, so there are at most capacity x ln(capacity) different
ones (about 7,100 at 1,024).  That list, of bounded size, is sent to every task.  The pieces
themselves are numbered within their length: in their task first, then by a running sum over the
tasks' counts; number and length name sequence and offset.  No task holds all pieces of a length.

Token ids are those of the ``tokenizers`` library for the given file.  Where its model is plain
byte-level BPE (checked when it is read), ids come from ``tiktoken`` over the same vocabulary,
which is about four times as fast and was compared with it on every code point and on long runs;
texts that hold the string of a special token go through ``tokenizers`` itself.

Defined results: a null or empty text is the end token alone; texts are taken whole; equal rows
are packed like different ones; an empty table gives no rows; further columns of ``docs`` are not
looked at.  A piece whose length is null or not within 1..capacity has no place (nulls).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsight.llm.common import cut, schema_with

_loaded: dict = {}


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if ids are in the order of the merges and the model has no further rules."""
    split = model.get("pre_tokenizer") or {}
    bpe = model["model"]
    plain = (bpe.get("type") == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
             "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")) and model.get("normalizer") is None
             and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True))
    if not plain:
        return None
    # the byte alphabet of such files: printable bytes stand for themselves, the others for 256, 257, ...
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in bpe["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]]
    made = [bpe["vocab"]["".join(m)] for m in merges]
    in_order = all(a < b for a, b in zip(made, made[1:]))
    return ranks if in_order and len(set(made)) + 256 == len(ranks) else None


def _encoder(path: str, pattern: str):
    """A function text -> ids (uint32 array); the vocabulary is read once per Python worker."""
    if (path, pattern) in _loaded:
        return _loaded[path, pattern]
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model.get("added_tokens", [])]
    ranks, whole = _byte_ranks(model), []
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(text: str) -> np.ndarray:
        if fast is not None and not any(s in text for s in special):
            return fast.encode_to_numpy(text, disallowed_special=())
        if not whole:
            whole.append(tokenizers.Tokenizer.from_file(path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    _loaded[path, pattern] = encode
    return encode


def token_pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int = 1024, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The ids of every text, closed by ``end_id``, in pieces of at most ``capacity``: key, piece (from
    0), start, length, ids (little-endian 32-bit integers).  A longer text is cut so that all pieces
    but its first are full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                row, piece, start, ids = [], [], [], []
                for k, t in enumerate(some.column("__text")):
                    own = np.concatenate([encode(t.as_py() or "").astype("<u4"), end])
                    edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for j, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(k)
                        piece.append(j)
                        start.append(a)
                        ids.append(own[a:b].tobytes())
                length = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(key).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     length, pa.array(ids, pa.binary())], [key, "piece", "start", "length", "ids"])

    own = docs.select(key, F.col(f"`{text}`").cast("string").alias("__text"))
    return own.mapInArrow(run, schema_with(own.select(key), "piece int, start bigint, length bigint, ids binary"))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings for ``counts[n]`` pieces of every length n up to ``capacity``: (pieces by length, how
    many sequences are filled so), in the order they are made."""
    left = np.zeros(capacity + 1, np.int64)
    left[:len(counts)] = counts[:capacity + 1]
    left[0] = 0
    out = []
    while len(lengths := np.flatnonzero(left)):
        used: dict[int, int] = {}
        gap = capacity
        for x in lengths[::-1].tolist():  # the longest that fits, as often as it fits
            if n := min(gap // x, int(left[x])):
                used[x] = n
                gap -= n * x
        while sum(used.values()) > 1:
            s = min(used)
            room = gap + s
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            free[:capacity // 6] = 0
            some = np.flatnonzero(free[:room + 1])
            if not len(some):
                break
            mate = np.searchsorted(some, np.minimum(room - some, some), "right") - 1
            mate -= (mate >= 0) & (some[mate] == some) & (free[some] < 2)
            both = np.where(mate >= 0, some + some[mate], 0)
            k = len(both) - 1 - int(np.argmax(both[::-1]))  # equally good pairs: the one with the longest piece
            if both[k] <= s:
                break
            used[s] -= 1
            for x in (int(some[k]), int(some[mate[k]])):
                used[x] = used.get(x, 0) + 1
            used = {x: n for x, n in used.items() if n}
            gap = room - int(both[k])
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((used, times))
    return out


def _places(fillings: list[tuple[dict[int, int], int]], capacity: int) -> np.ndarray:
    """Rows (length, first number, how many in a sequence, first sequence, offset) by length and number."""
    rows, taken, sequence = [], [0] * (capacity + 1), 0
    for used, times in fillings:
        offset = 0
        for x in sorted(used, reverse=True):
            rows.append((x, taken[x], used[x], sequence, offset))
            taken[x] += used[x] * times
            offset += used[x] * x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length", tag: str = "pieces") -> DataFrame:
    """``pieces`` with sequence_id and offset (columns of these names are replaced): sequences of at
    most ``capacity``, gapless, as few as best-two-fit needs.  The rows are written once, with their
    number within their length and task, so that all later steps see the same numbers."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = pieces.select(*[f"`{c}`" for c in columns]).withColumn("__n", F.col(f"`{length}`").cast("long"))
    own = own.withColumn("__n", F.when(F.col("__n").between(1, capacity), F.col("__n")).otherwise(0).cast("int"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = batch.column("__n").to_numpy()
            order = np.argsort(n, kind="stable")
            firsts = np.searchsorted(n[order], np.arange(capacity + 1))
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - firsts[n[order]]
            nth += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(nth)],
                                             [*batch.schema.names, "__task", "__nth"])

    rows = cut(own.mapInArrow(number, schema_with(own, "__task int, __nth bigint")), tag)
    parts = rows.where("__n > 0").groupBy("__n", "__task").agg((F.max("__nth") + 1).alias("__count"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("__n").agg(F.sum("__count").alias("c")).collect():  # at most ``capacity`` rows
        counts[r["__n"]] = r.c
    places = rows.sparkSession.sparkContext.broadcast(_places(best_two_fit(counts, capacity), capacity))
    before = F.sum("__count").over(Window.partitionBy("__n").orderBy("__task")) - F.col("__count")
    joined = rows.join(parts.select("__n", "__task", before.alias("__before")), ["__n", "__task"], "left")
    joined = joined.select(*[f"`{c}`" for c in columns], "__n", (F.col("__before") + F.col("__nth")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, first, each, sequence, offset = places.value.T if len(places.value) else np.zeros((5, 1), np.int64)
        keys = (x << 50) + first
        for batch in batches:
            n = batch.column("__n").to_numpy().astype(np.int64)
            rank = batch.column("__rank").fill_null(0).to_numpy()
            k = np.maximum(np.searchsorted(keys, (n << 50) + rank, "right") - 1, 0)
            nth = rank - first[k]
            none = n == 0
            kept = batch.drop_columns(["__n", "__rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence[k] + nth // np.maximum(each[k], 1), mask=none),
                 pa.array(offset[k] + nth % np.maximum(each[k], 1) * n, mask=none)], [*kept.schema.names, "sequence_id", "offset"])

    return joined.mapInArrow(place, schema_with(joined.drop("__n", "__rank"), "sequence_id bigint, offset bigint"))


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packed sequences: sequence_id, length, their ids (little-endian 32-bit integers) and the
    members (key, piece, offset), from ``pack`` of ``token_pieces``; a group holds one sequence."""
    members = F.array_sort(F.collect_list(F.struct("offset", "piece", key, "ids")))
    rows = packed.where("sequence_id is not null").groupBy("sequence_id").agg(members.alias("m"), F.sum("length").alias("length"))
    return rows.select("sequence_id", "length", F.expr("aggregate(m, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
                       F.expr(f"transform(m, x -> struct(x.`{key}`, x.piece, x.offset))").alias("members"))
