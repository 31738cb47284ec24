"""Periodic runs of words, found by a sparse diagonal dynamic program, and texts without the repetitions.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
max(least, 2 * q) words that no neighbouring word extends.  For every word its earlier
occurrences name lags; a lag that was active at the word before has its match length raised, one
that was not begins, and one that is not named any more ends: if its length suffices, its run is
emitted there and then.  Words are taken in blocks, all lags of a block at once in numpy; what is
active at the end of a block (lag, begin) is carried into the next.

What keeps the lags sparse, without losing a run:

* A run of period d holds at least max(least - d, d) matches at lag d.  Lags are treated in classes
  [g, 8g), the first one [1, least); in a class an occurrence counts only if the g words that end
  there are equal, not just the last one (g = least / 2 in the first class).  A stretch of g words
  that is not periodic itself begins at most once in g / 2 words, so a word has at most 16 such
  occurrences in reach of its class.
* Stretches of g words that are periodic lie in a run of a period of at most g / 2, which a lower
  class has found.  Their occurrences in that same run are multiples of its period and can only
  find the same run again (two periods that overlap by their sum share their divisor), so they
  are left out.

Hence the work is in proportion to words x classes (their number is logarithmic in the longest
text); only a text made of many separate long runs of the same words needs more.  Memory is that
of the words of one text, or of a piece of many short ones.

Words are compared by 64-bit fingerprints of their bytes (see ``common``).  Defined results: a
null or empty text has no words and no runs; words are as they are written (no lower case); equal
rows give equal results; columns of ``docs`` stay as they are, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import Fingerprints, mix, schema_with, text_pieces, word_spans

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


class _Grams:
    """Fingerprints of all stretches of g words that end at a word; ``codes`` are those of the words."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, down = np.full(n, _ODD, np.uint64), np.full(n, _ODD_INVERSE, np.uint64)
        up[:1] = down[:1] = 1
        self.down = np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * np.cumprod(up, dtype=np.uint64), out=self.sums[1:])

    def ending(self, at: np.ndarray, g: int) -> np.ndarray:
        return mix((self.sums[at + 1] - self.sums[at + 1 - g]) * self.down[at + 1 - g])


def _covered(runs: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    """For every word of ``at`` the first gram end of the run of a period of at most g / 2 that holds
    the g words up to it, or a huge number."""
    out = np.full(len(at), np.iinfo(np.int64).max)
    own = runs[(runs[:, 2] * 2 <= g) & (runs[:, 1] >= g)]
    if len(own):  # a gram lies in one such run only: two of them would share a smaller period
        begin = own[:, 0] + g - 1
        order = np.argsort(begin, kind="stable")
        k = np.searchsorted(begin[order], at, "right") - 1
        inside = (k >= 0) & (at < (own[:, 0] + own[:, 1])[order][k])
        out[inside] = begin[order][k[inside]]
    return out


def _class_runs(grams: _Grams, first: np.ndarray, g: int, low: int, high: int, least: int, known: np.ndarray,
                block: int) -> np.ndarray:
    """Runs (start, length, period) with a period in [low, high); ``first``: the first word of the
    text of every word; ``known``: the runs with smaller periods."""
    n = len(first)
    ends = np.arange(g - 1, n)
    ends = ends[ends - first[ends] >= g - 1]  # the gram lies in one text
    if not len(ends):
        return np.empty((0, 3), np.int64)
    keys = mix(grams.ending(ends, g) + first[ends].view(np.uint64) * np.uint64(_ODD))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    group, at = group[many], ends[order[many]]  # by gram, then by place
    if not len(at):
        return np.empty((0, 3), np.int64)
    place = group * np.int64(n) + at
    by_word = np.argsort(at, kind="stable")
    words = at[by_word]
    upto = np.minimum(words - low, _covered(known, words, g) - 1)  # the last earlier occurrence that counts
    base = group[by_word] * np.int64(n)
    lo = np.searchsorted(place, base + np.maximum(words - high + 1, 0))
    hi = np.maximum(np.searchsorted(place, base + np.maximum(upto, -1), "right"), lo)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return np.empty((0, 3), np.int64)
    words, lo, hi = words[some], lo[some], hi[some]
    out: list[np.ndarray] = []
    lags, begins = np.empty(0, np.int64), np.empty(0, np.int64)  # active at the end of the last block
    last = -2
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    i = 0
    while i < len(words) or len(lags):
        j = min(len(words), max(i + 1, int(np.searchsorted(total, total[i] + block, "right")) - 1))
        count = hi[i:j] - lo[i:j]
        here = np.repeat(words[i:j], count)
        lag = here - at[np.repeat(lo[i:j] - (total[i:j] - total[i]), count) + np.arange(len(here))]
        by_lag = np.argsort(lag * np.int64(n) + here, kind="stable")
        here, lag = here[by_lag], lag[by_lag]
        opens = np.ones(len(here), bool)
        opens[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)
        closes = np.append(opens[1:], True)[:len(here)]
        lag, begin, end = lag[opens], here[opens], here[closes]
        if len(lags):  # a carried lag goes on if it is named by the very next word
            k = np.searchsorted(lags, lag)
            k[k == len(lags)] = 0
            goes_on = (lags[k] == lag) & (begin == last + 1)
            begin = np.where(goes_on, begins[k], begin)
            over = np.ones(len(lags), bool)
            over[k[goes_on]] = False
            out.append(np.stack([lags[over], begins[over], np.full(over.sum(), last)], 1))
        last = int(words[j - 1]) if j > i else last
        active = (end == last) & (j < len(words))
        out.append(np.stack([lag[~active], begin[~active], end[~active]], 1))
        lags, begins = lag[active], begin[active]
        i = j
    lag, begin, end = np.concatenate(out).T
    matches = end - begin + g
    enough = matches >= np.maximum(least - lag, lag)
    lag, begin, matches = lag[enough], begin[enough], matches[enough]
    return np.stack([begin - g + 1 - lag, matches + lag, lag], 1)


def word_runs(codes: np.ndarray, first: np.ndarray, least: int = 12, block: int = 1 << 21) -> np.ndarray:
    """All runs of texts given as word codes one behind the other, as rows (start, length, period) by
    start, then period; ``first`` names for every word the first word of its text.  ``block``: so
    many occurrences are looked at together."""
    found = np.empty((0, 3), np.int64)
    if len(codes) < least:
        return found
    longest = int(np.bincount(first).max())
    grams = _Grams(codes)
    low, g = 1, max(1, least // 2)
    while 2 * low <= longest and g < longest:
        high = least if low == 1 else 8 * low
        found = np.concatenate([found, _class_runs(grams, first, g, low, high, least, found, block)])
        # a stretch found at several lags has the smallest of them as its period
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        found = found[keep]
        low = g = high
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _piece(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the rows of one piece (word numbers within their row), the index of every row's first
    run, the words per row, and the collapsed texts as bytes with their offsets."""
    starts, ends, firsts = word_spans(data, offsets)
    per_row = np.diff(firsts)
    first = np.repeat(firsts[:-1], per_row)
    runs = word_runs(Fingerprints(data).of(starts, ends), first, least)
    dropped = np.zeros(len(starts) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    # a kept word keeps its bytes and, unless it is the last one kept of its row, the byte behind it as a space
    row = np.repeat(np.arange(len(per_row)), per_row)[kept]
    lo, hi = starts[kept], ends[kept]
    behind = np.zeros(len(row), bool)
    behind[:-1] = row[1:] == row[:-1]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[lo] += 1
    np.add.at(edge, hi + behind, -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    text = data.copy()
    text[hi[behind]] = 0x20
    sums = np.concatenate([[0], np.cumsum(mask)])
    row_of_run = np.searchsorted(firsts, runs[:, 0], "right") - 1 if len(runs) else np.empty(0, np.int64)
    runs[:, 0] -= firsts[row_of_run]
    return runs, np.searchsorted(row_of_run, np.arange(len(per_row) + 1)), per_row, text[mask], sums[offsets]


def collapse_runs(docs: DataFrame, text: str = "text", least: int = 12, runs: str = "runs", n_words: str = "n_words",
                  collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with its periodic runs (``runs``: an array of start, length, period in words, by start,
    then period), its number of words, and ``collapsed``: its words without those that lie behind the
    first period of a run, joined by one space.

    Narrow: nothing is shuffled, and a task holds one text or one piece of many short ones.
    """
    added = [runs, n_words, collapsed]
    own = docs.withColumn("__text", F.col(f"`{text}`").cast("string")).drop(*added)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.drop_columns(["__text"])
            for lo, hi, data, offsets in text_pieces(batch.column("__text")):
                found, of_row, words, left, ends = _piece(data, offsets, least)
                fields = [pa.array(found[:, k]) for k in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(of_row.astype(np.int32)),
                                                 pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                texts = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(left.tobytes()))
                yield pa.RecordBatch.from_arrays([*kept.slice(lo, hi - lo).columns, lists, pa.array(words), texts.cast(pa.string())],
                                                 [*kept.schema.names, *added])

    return own.mapInArrow(find, schema_with(own.drop("__text"), f"`{runs}` {RUNS}, `{n_words}` bigint, `{collapsed}` string"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``collapse_runs``: key, n_runs, the longest run (ties: smallest start, then
    period) with its exponent in thousandths, SHA-256 of the listed runs and of the collapsed text."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.select(key, "runs", "collapsed", best.alias("__best"))
            .select(key, F.size("runs").cast("long").alias("n_runs"), F.col("__best.s").alias("start"),
                    (-F.col("__best.l")).alias("length"), F.col("__best.p").alias("period"),
                    F.expr("(-__best.l * 1000) div __best.p").alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
