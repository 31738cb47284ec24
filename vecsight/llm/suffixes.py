"""Removal of repeated byte strings by distributed prefix doubling.

The rank of a position for a length is the fingerprint of the bytes that start there, so ranks of
different tasks compare without renumbering and a rank for a doubled length is a pair of ranks.
Spark shuffles (rank, position) and counts; positions whose rank is unique leave, the others are
ranked anew with a doubled length, up to the threshold: half the threshold first, then all of it.

Not every position takes part in the first round.  Of the half-length ranks of every window of the
threshold's length the least is selected (some 2 in every half window), and two equal windows
select the same; so a window repeats only if its selected rank does.  What comes to the next
rounds are ranges of windows around a selected position: first all that may select it, then cells of
15 neighbours, then single windows.  All windows of a range share its core; if the core's rank is
unique, none of them repeats, and if the rank of all bytes they reach is not, all of them do.  Of
ranges with the same bytes one goes on for all, and only if the core has other surroundings too.
The cores grow from half the threshold to all of it.

Equal texts are one text with a count: with two of them all their windows repeat.

Defined results: a null text is empty; a text shorter than the threshold keeps all bytes; matches
never cross rows; rows that repeat an id are rows of their own; extra columns are kept or ignored
as the caller asks; an empty table gives no rows.  Memory is some 80 bytes per byte of the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import U64, Fingerprints, cut, few, has_bit, mix, schema_with, set_apart, set_back, set_bits, text_pieces

_EMPTY = hashlib.sha256(b"").hexdigest()


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _selected(prints: Fingerprints, offsets: np.ndarray, length: int, ranges: bool = False):
    """Positions selected in some window of ``length`` bytes of a row, and their half-length ranks;
    with ``ranges`` also the first and last window that selects each (its leftmost least rank)."""
    half = length // 2
    total = int(offsets[-1])
    none = np.zeros(0, int)
    if total < length:
        return none, np.zeros(0, U64), none, none
    ranks = prints.every(half)
    width = length - half + 1
    least = _least(ranks, width)  # by start of the window
    ends = offsets[1:]
    starts = np.arange(len(least))
    row_end = ends[np.searchsorted(ends, starts, "right")]
    least[starts + length > row_end] = 0  # no window of one row; 0 selects nothing
    padded = np.zeros(len(least) + 2 * (width - 1), U64)
    padded[width - 1:width - 1 + len(least)] = least
    most = ~_least(~padded, width)  # the largest of the least ranks of the windows that hold a position
    at = np.flatnonzero((ranks == most[:len(ranks)]) & (ranks > 0))
    if not ranges or not len(at):
        return at, ranks[at], at, at
    starts = np.flatnonzero(least)
    pick = np.searchsorted(at, starts)
    wrong = np.flatnonzero(ranks[at[pick]] != least[starts])
    while len(wrong):
        pick[wrong] += 1
        wrong = wrong[ranks[at[pick[wrong]]] != least[starts[wrong]]]
    edge = np.flatnonzero(np.diff(pick, prepend=-1))
    first, last = np.full(len(at), -1), np.full(len(at), -2)
    first[pick[edge]] = starts[edge]
    last[pick[edge]] = starts[np.append(edge[1:], len(starts)) - 1]
    return at, ranks[at], first, last


def _digest(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _scan(batches, length: int, bits, columns: list[str], all_texts: bool):
    """First pass (no ``bits``): ranks of the selected positions.  Second pass: every row with its
    digests, and with its text and the selected positions whose rank may repeat.  Equal texts of a
    task are scanned once."""
    seen: set = set()
    for batch in batches:
        for i, j, data, offsets in text_pieces(batch.column("__bytes")):
            own = [data[a:b] for a, b in zip(offsets, offsets[1:])]
            digests = [_digest(x) for x in own]
            fresh = np.array([x not in seen and not seen.add(x) for x in digests], bool)
            if len(seen) > 200_000:
                seen.clear()
            prints = Fingerprints(data)
            at, ranks, first, last = _selected(prints, offsets, length, bits is not None)
            row = np.searchsorted(offsets, at, "right") - 1
            kept = fresh[row]
            if bits is None:
                yield pa.RecordBatch.from_arrays([pa.array(ranks[kept].view(np.int64))], ["key"])
                continue
            kept &= has_bit(bits, ranks)
            at, ranks, row, first, last = (x[kept] for x in (at, ranks, row, first, last))
            half = length // 2
            left = np.minimum(at - offsets[row], length - half)
            right = np.minimum(offsets[row + 1] - at, length)
            around = mix(prints.of(at - left, at + right) + left.astype(U64) * U64(1 << 32) + right.astype(U64))
            cuts = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in
                     ((at - offsets[row]).astype(np.int32), ranks.view(np.int64), around.view(np.int64),
                      (at - first).astype(np.int32), (at - last).astype(np.int32))]
            some = np.zeros(j - i, bool)
            some[row] = True
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in columns), pa.array(np.diff(offsets)), pa.array(digests, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in own]),
                 pa.array([x.tobytes() if all_texts or k else None for x, k in zip(own, some)], pa.binary()), *lists],
                [*columns, "__n", "__c", "__sha", "__data", "__at", "__rank", "__around", "__far", "__near"])


_CELL = 15


def _known(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Runs (starts, ends) of the windows 0..n-1 covered by [lo, hi) ranges."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, np.clip(lo, 0, n), 1)
    np.add.at(steps, np.clip(np.maximum(lo, hi), 0, n), -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)))


def _cells(batches, length: int):
    """Per text: runs of windows known to repeat, and the cells of the positions that go on: their
    number (16 * position + cell), the rank of the core and of all bytes reached.  Codes: 1 all
    windows of the range repeat, 2 the same and it goes on for its like, 3 not known."""
    half = length // 2
    count = half // _CELL + 1
    for batch in batches:
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column("__data")[k].as_py(), np.uint8)
            codes = batch.column("codes")[k].values
            at, code, far, near = (np.asarray(codes.field(f)).astype(np.int64) for f in ("at", "code", "far", "near"))
            sure = code < 3
            runs = _known(len(data) - length + 1, at[sure] - half, at[sure] + 1)
            on = code > 1
            at, far, near = at[on], far[on], near[on]
            cell = np.arange(count)[None, :]
            hold = ((cell * _CELL <= far[:, None]) & (cell * _CELL + _CELL > near[:, None])).nonzero()
            x, j = at[hold[0]], hold[1]
            late, early = x - j * _CELL, x - np.minimum(j * _CELL + _CELL - 1, half)  # last and first window
            prints = Fingerprints(data)
            lo, hi = np.maximum(early, 0), np.minimum(late + length, len(data))
            core = mix(prints.of(late, early + length) + j.astype(U64))
            reach = mix(prints.of(lo, hi) + (lo - early).astype(U64) * U64(1 << 32) + (late + length - hi).astype(U64) + j.astype(U64) * U64(1 << 48))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__c").slice(k, 1), *(pa.array([v]) for v in (
                    runs[::2].astype(np.int32), runs[1::2].astype(np.int32), x * 16 + j, core.view(np.int64), reach.view(np.int64)))],
                ["__c", "lo", "hi", "at", "rank", "around"])


def _windows(batches, length: int):
    """Per text: runs of windows of cells that repeat, and (start, rank) of the windows of cells that
    go on."""
    half = length // 2
    for batch in batches:
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column("__data")[k].as_py(), np.uint8)
            codes = batch.column("codes")[k].values
            at, code = np.asarray(codes.field("at")), np.asarray(codes.field("code"))
            x, j = at // 16, at % 16
            late, early = x - j * _CELL, x - np.minimum(j * _CELL + _CELL - 1, half)
            n = len(data) - length + 1
            runs = _known(n, early[code < 3], late[code < 3] + 1)
            on = code > 1
            asks = np.unique((early[on][:, None] + np.arange(_CELL)[None, :])[np.arange(_CELL)[None, :] <= (late - early)[on][:, None]])
            asks = asks[(asks >= 0) & (asks < n)]
            ranks = Fingerprints(data).of(asks, asks + length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__c").slice(k, 1), *(pa.array([v]) for v in (
                    runs[::2].astype(np.int32), runs[1::2].astype(np.int32), asks, ranks.view(np.int64)))],
                ["__c", "lo", "hi", "at", "key"])


def _codes(places: DataFrame, more: list[str]) -> DataFrame:
    """(__c, codes) of ranges (__c, at, rank, around, and columns that come along): ranges whose rank is
    unique are left out."""
    alike = places.groupBy("rank", "around").agg(F.count("*").alias("n"), F.min(F.struct("__c", "at")).alias("first"))
    kinds = alike.groupBy("rank").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all")
    code = F.when(F.col("n") == 1, 3).when((F.col("kinds") > 1) & (F.struct("__c", "at") == F.col("first")), 2).otherwise(1)
    coded = places.join(alike.join(kinds, "rank"), ["rank", "around"]).withColumn("code", code)
    return coded.groupBy("__c").agg(F.collect_set(F.struct("at", "code", *more)).alias("codes"))


def _removed(batches, length: int):
    """Per text: the maximal runs of bytes covered by repeated windows, and what is left."""
    for batch in batches:
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column("__data")[k].as_py(), np.uint8)
            lo, hi = (np.asarray(batch.column(x)[k].values).astype(np.int64) for x in ("lo", "hi"))
            runs = _known(len(data), lo, hi - 1 + length)  # starts lo..hi-1 cover the bytes lo..hi-2+length
            gone = np.zeros(len(data), bool)
            for a, b in zip(runs[::2], runs[1::2]):
                gone[a:b] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("__c").slice(k, 1), pa.array([runs[::2].astype(np.int32)]), pa.array([runs[1::2].astype(np.int32)]),
                 pa.array([int(gone.sum())]), pa.array([hashlib.sha256(data[~gone].tobytes()).hexdigest()])],
                ["__c", "starts", "ends", "n_removed", "kept_sha256"])


def find_repeats(docs: DataFrame, columns: list[str], text: str = "text", length: int = 400,
                 all_texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the rows (``columns``, __n, __c, __sha, __data), how many rows hold each text that
    two rows hold (__c, copies), and per text with repeats (__c, starts, ends, n_removed, kept_sha256)."""
    if length < 2 or length % 2 or length // 2 // _CELL >= 16:
        raise ValueError("an even threshold of 2 to 478 bytes")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("__bytes"))
    sc = docs.sparkSession.sparkContext
    ranks = rows.select("__bytes").mapInArrow(lambda b: _scan(b, length, None, [], False), "key bigint")
    bits = sc.broadcast(set_bits(ranks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")))  # 8 MB, whatever the input
    kept = schema_with(rows.drop("__bytes"), "__n bigint, __c bigint, __sha string, __data binary, __at array<int>, "
                                             "__rank array<bigint>, __around array<bigint>, __far array<int>, __near array<int>")
    scanned = cut(rows.mapInArrow(lambda b: _scan(b, length, bits.value, columns, all_texts), kept), "scanned")
    copies = scanned.groupBy("__c").agg(F.count("*").alias("copies")).where("copies > 1")
    held = scanned.where(F.size("__at") > 0)
    texts = held.select("__c", "__data")
    fields = {"at": "__at", "rank": "__rank", "around": "__around", "far": "__far", "near": "__near"}
    places = held.select("__c", F.explode(F.arrays_zip(*fields.values())).alias("x")).select(
        "__c", *[F.col(f"x.{old}").alias(new) for new, old in fields.items()])
    cells = cut(texts.join(_codes(places, ["far", "near"]), "__c").mapInArrow(
        lambda b: _cells(b, length), "__c bigint, lo array<int>, hi array<int>, at array<bigint>, rank array<bigint>, around array<bigint>"), "cells")
    places = cells.select("__c", F.explode(F.arrays_zip("at", "rank", "around")).alias("x")).select("__c", "x.*")
    windows = cut(texts.join(_codes(places, []), "__c").mapInArrow(
        lambda b: _windows(b, length), "__c bigint, lo array<int>, hi array<int>, at array<bigint>, key array<bigint>"), "windows")
    asked = windows.select("__c", F.explode(F.arrays_zip("at", "key")).alias("x")).select("__c", "x.*")
    twice = asked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    single = asked.join(twice, "key").select("__c", F.col("at").cast("int").alias("lo"), (F.col("at") + 1).cast("int").alias("hi"))
    runs = single
    for table in (cells, windows):
        zipped = F.explode(F.arrays_zip("lo", "hi")).alias("x")
        runs = runs.unionByName(table.select("__c", zipped).select("__c", "x.lo", "x.hi"))
    runs = runs.groupBy("__c").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    found = texts.join(runs, "__c").select("__c", "__data", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi")).mapInArrow(
        lambda b: _removed(b, length), "__c bigint, starts array<int>, ends array<int>, n_removed bigint, kept_sha256 string")
    return scanned, copies, cut(found.dropDuplicates(["__c"]), "removed")


def removal_digests(docs: DataFrame, key: str = "doc_id", length: int = 400) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_kept, n_spans, kept_sha256."""
    rows, copies, found = find_repeats(docs, [key], length=length)
    joined = rows.select(key, "__n", "__c", "__sha").join(copies, "__c", "left").join(found, "__c", "left")
    whole = (F.col("copies") > 1) & (F.col("__n") >= length)
    pick = lambda all_gone, part, none: F.when(whole, all_gone).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("bigint")
    removed = pick(F.col("__n"), F.col("n_removed"), zero)
    return joined.select(key, F.col("__n").alias("n_bytes"), removed.alias("n_removed"), (F.col("__n") - removed).alias("n_kept"),
                         pick(F.lit(1), F.size("starts"), zero).cast("bigint").alias("n_spans"),
                         pick(F.lit(_EMPTY), F.col("kept_sha256"), F.col("__sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (a character cut in two goes whole)."""
    own, names = set_apart(docs, text)
    others = [n for n in names if n != text]
    rows, copies, found = find_repeats(own, others, text, length, all_texts=True)
    whole = (F.col("copies") > 1) & (F.col("__n") >= length)
    rows = rows.join(few(cut(copies, "copies")), "__c", "left")
    # a text of which a task has scanned an equal one carries no positions: it is in ``copies``, or whole
    plain = rows.where(F.size("__at") == 0).withColumns({"starts": F.lit(None).cast("array<int>"), "ends": F.lit(None).cast("array<int>")})
    cut_up = rows.where(F.size("__at") > 0).join(found.select("__c", "starts", "ends"), "__c", "left")
    columns = [*others, "__n", "__data", "copies", "starts", "ends"]
    joined = (plain.select(*columns).unionByName(cut_up.select(*columns))
              .select(*others, "__data", F.when(whole, F.array(F.lit(0))).otherwise(F.col("starts")).alias("__lo"),
                      F.when(whole, F.array(F.col("__n").cast("int"))).otherwise(F.col("ends")).alias("__hi")))

    def taken_out(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, out = batch.slice(at, 500), []
                for raw, lo, hi in zip(*(some.column(c).to_pylist() for c in ("__data", "__lo", "__hi")), strict=True):
                    cuts = [0, *(x for pair in zip(lo or [], hi or []) for x in pair), len(raw)]
                    out.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode("utf-8", "ignore"))
                left = some.drop_columns(["__data", "__lo", "__hi"])
                yield pa.RecordBatch.from_arrays([*left.columns, pa.array(out, pa.string())], [*left.schema.names, text])

    schema = schema_with(joined.drop("__data", "__lo", "__hi"), f"`{text}` string")
    return set_back(joined.mapInArrow(taken_out, schema), names, docs.columns)
