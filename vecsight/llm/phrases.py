"""Phrase collocations: counts of word sequences by double-array tries, scored by their best cut.

1. Words are counted per language (Apriori's first level); those below the least count are out.
2. Candidates.  A phrase can reach the least count only if its words do, and if the hash bucket of
   each pair and triple in it does: one pass adds up bucket counts (2**26 buckets a level, each held
   up to 15 only), packed as integers by range of buckets, so that reducers add arrays.  The second
   pass lists the sequences in the texts that pass both tests, by word keys; what is listed is safe
   (nothing that could reach the count is missing), not exact.  It goes over all rows in three
   rounds, a small share first, and a round skips what the ones before have listed: so frequent
   sequences are listed by a few tasks instead of all.
3. The candidates, cut by a hash into shards of at most ``SHARD`` of them, become double-array tries,
   built in tasks, a shard each.  A symbol of the trie is half of a word's number in the shard, so a
   node has children in a short range and few slots stay empty.  A shard is broadcast (its size is
   bounded by SHARD, not by the input), and one pass over the texts advances the states of all text
   positions at once, level by level; counts of accepting states are ``bincount``s, which Spark sums
   over the tasks.  More candidates mean more shards, each with a pass of its own.
   Texts of more than ``DEALT`` words fill the buckets, and their shards would become too many passes.
   There pairs alone are added up, in 2**32 buckets that only reducers hold.  One pass then deals the
   text positions whose pair is frequent, with the words that follow, to shards by their first two
   words.  A shard, of bounded size, is a task's: it lists the candidates among its positions, builds
   their trie and advances the positions through it.  So the passes over the texts stay three.
4. Scores, the drop rule and ranks are joins and windows over the counted phrases.

Phrases lie within a piece: text is lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces
and those at spaces and tabs into words.  Everything is per language; a null one is ``und``.

Words are compared by 64-bit fingerprints of language and word (see ``common``).  Defined results: a
null or empty text has no words; texts are taken whole; equal rows count as often as they occur; an
empty table gives no rows; further columns are not looked at.  Scores are exact while
1,000,000 * a * a stays below 10**38.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecsight.llm.common import Fingerprints, cut, has_bit, mix, set_bits, small_batches, text_pieces

#: Candidates of a shard: the most that is broadcast at once is about 40 bytes for each.
SHARD = 1 << 20
BUCKET_BITS = 26
#: Sequences that a round of the listing knows from the rounds before, 8 bytes each; others are listed again.
KNOWN = 1 << 22
#: Texts of more words are counted by dealt positions, in a shard for each so many words; a task deals so many at a time.
DEALT, DEALT_WORDS, DEALT_HELD = 1 << 26, 1 << 22, 1 << 21
_PAIR_BITS, _PAIR_RANGE, _PAIR_FOLD = 32, 1 << 24, 4
_ROUNDS = (0, 1, 8, 64)  # a row's place among 64, by a hash of it, says its round
_RANGE = 1 << 20
_HELD = 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


class Piece:
    """The words of a run of rows: start and end of each, its row, its key, and whether the next word
    follows it in the same piece of text (``linked``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        n = len(data)
        gap = _GAP[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = True
        after[edges - 1] = True
        self.data = data
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), self.starts)
        self.linked = np.zeros(len(self.starts), bool)
        self.linked[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[1:] == breaks[:-1])
        words = Fingerprints(data, lowered=True).of(self.starts, self.ends)
        self.keys = mix(words + langs[self.row] * _STEP) if len(words) else words

    def text_of(self, words: np.ndarray) -> pa.Array:
        lo, n = self.starts[words], self.ends[words] - self.starts[words]
        at = np.concatenate([[0], np.cumsum(n)])
        raw = _LOWER[self.data[np.repeat(lo - at[:-1], n) + np.arange(at[-1])]]
        return pa.StringArray.from_buffers(len(words), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Piece, np.ndarray]]:
    """Pieces of about 0.7 MB with the language of every row (as a number of this batch) and its names."""
    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()], np.uint64)
        rows = of_lang[names.indices.to_numpy()] if len(of_lang) else np.empty(0, np.uint64)
        for lo, hi, data, offsets in text_pieces(batch.column("text")):
            piece = Piece(data, offsets, rows[lo:hi])
            if len(piece.starts):
                yield piece, batch.column("lang").slice(lo, hi - lo)


def _apart(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def word_counts(own: DataFrame) -> DataFrame:
    """(lang, word, key, n), and a row with a null word per language that counts all its words."""
    def count(batches):
        for piece, langs in _pieces(batches):
            _, first, n = np.unique(piece.keys, return_index=True, return_counts=True)
            total = np.bincount(piece.row, minlength=len(langs))
            rows = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([langs.take(pa.array(piece.row[first])), langs.take(pa.array(rows))]),
                 pa.concat_arrays([piece.text_of(first), pa.nulls(len(rows), pa.string())]),
                 pa.array(np.concatenate([piece.keys[first], np.zeros(len(rows), np.uint64)]).view(np.int64)),
                 pa.array(np.concatenate([n, total[rows]]))], ["lang", "word", "key", "n"])

    counted = own.mapInArrow(count, "lang string, word string, key bigint, n bigint")
    return counted.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


def _hashes(keys: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """For sequences of 2, 3, ... words, the hash of the one that starts at every word."""
    out = keys
    for k in range(1, levels):
        out = mix(out[:-1] * _STEP + keys[k:])
        yield out


def _frequent(piece: Piece, words: np.ndarray) -> np.ndarray:
    return has_bit(words, piece.keys.view(np.int64))


def bucket_bits(own: DataFrame, words, longest: int, least: int) -> np.ndarray:
    """One bit per bucket of the sequences of 2 to ``longest`` words that all are frequent: whether at
    least ``least`` (up to 15 are told apart) fall into it.  2**BUCKET_BITS buckets a length."""
    ranges = (1 << BUCKET_BITS) // _RANGE
    least = min(least, _HELD)

    def count(batches):
        held = np.zeros((longest - 1) << BUCKET_BITS, np.uint8)
        for piece, _ in _pieces(batches):
            ok = _frequent(piece, words.value)
            some = ok
            for level, h in enumerate(_hashes(piece.keys, longest)):
                some = some[:-1] & piece.linked[level:-1] & ok[level + 1:]
                at = (h[some] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (level << BUCKET_BITS)
                at, n = np.unique(at, return_counts=True)
                held[at] = np.minimum(held[at] + np.minimum(n, _HELD), _HELD)
        for r in range((longest - 1) * ranges):
            part = held[r * _RANGE:(r + 1) * _RANGE]
            if len(at := np.flatnonzero(part)):
                packed = at.astype("<u4") << 4 | part[at]
                yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "packed": pa.array([packed.tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column("r").to_pylist(), batch.column("packed"), strict=True):
                packed = np.frombuffer(raw.as_buffer(), "<u4")
                total = sums.setdefault(r, np.zeros(_RANGE, np.uint8))
                at = packed >> 4
                total[at] = np.minimum(total[at] + (packed & 15).astype(np.uint8), _HELD)
        for r, total in sums.items():
            yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    parts = own.mapInArrow(count, "r int, packed binary")
    # each reducer holds a few ranges of a megabyte
    summed = parts.repartition(16 * (longest - 1), "r").mapInArrow(add, "r int, bits binary")
    out = np.zeros((longest - 1) << (BUCKET_BITS - 3), np.uint8)
    step = _RANGE >> 3
    for r in summed.toLocalIterator():
        out[r.r * step:(r.r + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def _sequence_hashes(rows: DataFrame, most: int) -> np.ndarray:
    """The hashes, ascending, of at most ``most`` sequences of (k1, k2, ...)."""
    def hashes(batches):
        for batch in batches:
            keys = [batch.column(k) for k in range(batch.num_columns)]
            out = keys[0].to_numpy().view(np.uint64)
            for k in keys[1:]:
                own = k.fill_null(0).to_numpy().view(np.uint64)
                out = np.where(k.is_valid().to_numpy(zero_copy_only=False), mix(out * _STEP + own), out)
            yield pa.RecordBatch.from_pydict({"h": pa.array([out.tobytes()], pa.binary())})

    parts, n = [np.zeros(0, np.uint64)], 0
    for r in rows.mapInArrow(hashes, "h binary").toLocalIterator():
        parts.append(np.frombuffer(r.h, np.uint64)[:most - n])
        n += len(parts[-1])
        if n >= most:
            break
    return np.sort(np.concatenate(parts))


def _within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in ``known`` (ascending)."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def candidates(own: DataFrame, words, buckets, longest: int, most_known: int = KNOWN) -> DataFrame:
    """Word keys (k1, k2, ... ; null beyond the last) of every sequence of 2 to ``longest`` words in the
    texts whose words and buckets are frequent."""
    names = [f"k{k + 1}" for k in range(longest)]

    def passing(piece: Piece):
        ok = some = _frequent(piece, words.value)
        bits = buckets.value
        before = None
        for level, h in enumerate(_hashes(piece.keys, longest)):
            some = some[:-1] & piece.linked[level:-1] & ok[level + 1:]
            at = np.flatnonzero(some)
            b = (h[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (level << BUCKET_BITS)
            passed = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
            some = np.zeros(len(some), bool)
            some[at[passed]] = True
            if before is not None:  # the sequence without its first word must pass as well
                some &= before[1:]
            before = some
            at = np.flatnonzero(some)
            yield level + 2, at, h[at]

    def lister(known) -> Callable:
        def listed(batches):
            seen = np.zeros(1 << 21, np.uint64)  # sequences that this task has listed, by slot: repeats mostly end here
            for piece, _ in _pieces(batches):
                for n, at, h in passing(piece):
                    h, first = np.unique(h, return_index=True)
                    at = at[first]
                    slot = (h & np.uint64(len(seen) - 1)).astype(np.int64)
                    new = (seen[slot] != h) & ~_within(h, known.value)
                    seen[slot[new]] = h[new]
                    at = at[new]
                    if len(at):
                        columns = [pa.array(piece.keys[at + k].view(np.int64)) if k < n else pa.nulls(len(at), pa.int64()) for k in range(longest)]
                        yield pa.RecordBatch.from_arrays(columns, names)
        return listed

    spark = own.sparkSession
    known, out, over = np.zeros(0, np.uint64), None, False
    share = F.pmod(F.xxhash64("lang", "text"), F.lit(_ROUNDS[-1]))
    for lo, hi in zip(_ROUNDS, _ROUNDS[1:]):
        before = spark.sparkContext.broadcast(known)  # at most 8 * ``most_known`` bytes
        mine = own.where((share >= lo) & (share < hi))
        found = cut(mine.mapInArrow(lister(before), ", ".join(f"{n} bigint" for n in names)).distinct(), "listed")
        before.unpersist()
        out = found if out is None else out.unionByName(found)
        if hi < _ROUNDS[-1]:
            known = np.sort(np.concatenate([known, _sequence_hashes(found, most_known - len(known))]))
            over |= len(known) >= most_known
    return cut(out.distinct(), "candidates") if over else out


def pair_bits(own: DataFrame, words, least: int) -> np.ndarray:
    """Bits for the pairs of words that both are frequent, by the upper bits of their hash: whether one of
    the buckets of a bit (there are 2**_PAIR_BITS, 2**_PAIR_FOLD of them a bit) has ``least`` pairs (up to
    15 are told apart).  A task sends what it has met, a reducer holds one range of buckets at a time."""
    least = min(least, _HELD)
    ranges = (1 << _PAIR_BITS) // _PAIR_RANGE

    def packed(parts):
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(at.astype(np.int64), np.arange(ranges + 1) * _PAIR_RANGE)
        value = (at & np.uint32(_PAIR_RANGE - 1)) << np.uint32(4) | np.minimum(n, _HELD).astype(np.uint32)
        filled = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_pydict({"r": pa.array(filled.astype(np.int32)),
                                           "packed": pa.array([value[cuts[r]:cuts[r + 1]].tobytes() for r in filled], pa.binary())})

    def count(batches):
        parts, n = [], 0
        for piece, _ in _pieces(batches):
            ok = _frequent(piece, words.value)
            some = ok[:-1] & piece.linked[:-1] & ok[1:]
            parts.append((next(_hashes(piece.keys, 2))[some] >> np.uint64(64 - _PAIR_BITS)).astype(np.uint32))
            n += len(parts[-1])
            if n > 2 * DEALT_HELD:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    def folded(r, total):
        hit = (total >= least).reshape(-1, 1 << _PAIR_FOLD).any(1)
        return pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "bits": pa.array([np.packbits(hit, bitorder="little").tobytes()], pa.binary())})

    def add(batches):
        now, total = None, None
        for batch in batches:
            for r, raw in zip(batch.column("r").to_pylist(), batch.column("packed"), strict=True):
                if r != now:
                    if now is not None:
                        yield folded(now, total)
                    now, total = r, np.zeros(_PAIR_RANGE, np.uint8)
                own = np.frombuffer(raw.as_buffer(), np.uint32)
                at = own >> np.uint32(4)
                total[at] = np.minimum(total[at] + (own & np.uint32(15)).astype(np.uint8), _HELD)
        if now is not None:
            yield folded(now, total)

    parts = own.mapInArrow(count, "r int, packed binary").repartition(64, "r").sortWithinPartitions("r")
    out = np.zeros((1 << _PAIR_BITS - _PAIR_FOLD) >> 3, np.uint8)
    step = len(out) // ranges
    for r in cut(parts.mapInArrow(add, "r int, bits binary"), "pair-bits").toLocalIterator():
        out[r.r * step:(r.r + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def _listed(columns: list[np.ndarray], times: np.ndarray, least: int) -> list[np.ndarray]:
    """Candidates among the beginnings, of two words or more, of sequences that occur ``times``: first,
    second, ... words (0: none).  Those whose bucket has fewer than ``least`` are not among them."""
    found = []
    h = columns[0]
    bits = max(10, (4 * len(times)).bit_length())
    at = np.arange(len(times))
    for k, column in enumerate(columns[1:], 1):
        on = column[at] != 0
        at = at[on]
        h = mix(h[on] * _STEP + column[at])
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        passed = np.flatnonzero(np.bincount(bucket, weights=times[at], minlength=1 << bits)[bucket] >= least)
        row = at[passed[np.unique(h[passed], return_index=True)[1]]]
        found.append([c[row] if j <= k else np.zeros(len(row), np.uint64) for j, c in enumerate(columns)])
    return [np.concatenate(x) for x in zip(*found)]


def dealt_counts(own: DataFrame, words, pairs, longest: int, least: int, shards: int) -> DataFrame:
    """(k1, k2, ..., a) of every sequence of 2 to ``longest`` words whose count a reaches ``least`` (and of some
    others): text positions whose pair is frequent go to shards by their first two words."""
    names = [f"k{k + 1}" for k in range(longest)]

    def packed(held):
        pair, *columns = (np.concatenate(x) for x in zip(*held))
        h = pair
        for column in columns[2:]:
            h = mix(h * _STEP + column)
        _, row, times = np.unique(h, return_index=True, return_counts=True)
        order = np.argsort(pair[row], kind="stable")  # by shard, and equal pairs together
        row, times = row[order], times[order].astype(np.uint32)
        shard = (pair[row] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.searchsorted(shard.astype(np.int64), np.arange(shards + 1))
        filled = np.flatnonzero(np.diff(cuts))
        parts = [*(c[row] for c in columns), times]
        return pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *(pa.array([p[cuts[s]:cuts[s + 1]].tobytes() for s in filled], pa.binary()) for p in parts)],
                                          ["shard", *names, "times"])

    def deal(batches):
        held, n = [], 0
        for piece, _ in _pieces(batches):
            ok = _frequent(piece, words.value)
            h = next(_hashes(piece.keys, 2))
            at = np.flatnonzero(ok[:-1] & piece.linked[:-1] & ok[1:])
            b = (h[at] >> np.uint64(64 - _PAIR_BITS + _PAIR_FOLD)).astype(np.int64)
            at = at[(pairs.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]
            pair = np.zeros(len(piece.keys), bool)
            pair[at] = True
            columns, on = [piece.keys[at], piece.keys[at + 1]], np.ones(len(at), bool)
            for k in range(2, longest):  # a further word if the pair that it ends is frequent
                on &= pair[np.minimum(at + k - 1, len(pair) - 1)]
                columns.append(np.where(on, piece.keys[np.minimum(at + k, len(pair) - 1)], np.uint64(0)))
            held.append((h[at], *columns))
            n += len(at)
            if n > DEALT_HELD:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def counted(parts):
        columns = [np.concatenate([np.frombuffer(p[k], np.uint64) for p in parts]) for k in range(longest)]
        times = np.concatenate([np.frombuffer(p[-1], np.uint32) for p in parts]).astype(np.int64)
        found = _listed(columns, times, least)
        if len(found[0]):
            total = Trie.build(found).totals(columns, times, len(found[0]))
            yield pa.RecordBatch.from_arrays([*(pa.array(f.view(np.int64), mask=f == 0) for f in found), pa.array(total)], [*names, "a"])

    def count(batches):
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and held:
                    yield from counted(held)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield from counted(held)

    places = own.mapInArrow(deal, ", ".join(["shard int", *(f"{n} binary" for n in names), "times binary"]))
    return places.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, ", ".join([*(f"{n} bigint" for n in names), "a bigint"]))


class Trie:
    """A double array: from state s the symbol c leads to t = base[s] + c if check[t] == s.  A word
    is two symbols, the upper and lower half of its number (from 1) in the alphabet."""

    def __init__(self, alphabet: np.ndarray, bits: int, base: np.ndarray, check: np.ndarray, answer: np.ndarray):
        self.alphabet, self.bits, self.base, self.check = alphabet, bits, base, check
        self.answer = answer  # per state the row it accepts, else -1

    @classmethod
    def build(cls, sequences: list[np.ndarray]) -> Trie:
        """The trie of distinct rows of word keys (uint64; 0: no word)."""
        rows = np.stack(sequences, 1)
        alphabet = np.unique(rows[rows != 0])
        symbols = np.where(rows != 0, np.searchsorted(alphabet, rows) + 1, 0).astype(np.int32)
        bits = max(1, (len(alphabet).bit_length() + 1) // 2)
        digits = np.stack([x for k in range(rows.shape[1]) for x in (symbols[:, k] >> bits, symbols[:, k] & ((1 << bits) - 1))], 1)
        used = np.repeat(rows != 0, 2, axis=1)
        order = np.lexsort(digits.T[::-1])
        d, u = digits[order], used[order]
        # arcs: the distinct prefixes of every depth; a node is the prefix an arc goes out from
        node = np.zeros(len(d), np.int32)  # of every row, the prefix read so far
        node_at = [node]
        arcs_from, arcs_by, arcs_to, n_nodes = [], [], [], 1
        for depth in range(d.shape[1]):
            here = u[:, depth]
            new = np.zeros(len(d), bool)
            new[here] = True
            prev = np.flatnonzero(here)
            if not len(prev):
                node_at.append(np.full(len(d), -1, np.int32))
                continue
            same = (node[prev[1:]] == node[prev[:-1]]) & (d[prev[1:], depth] == d[prev[:-1], depth])
            new[prev[1:][same]] = False
            number = (np.cumsum(new) - 1 + n_nodes).astype(np.int32)
            child = np.where(here, number, np.int32(-1))
            arcs_from.append(node[new])
            arcs_by.append(d[new, depth])
            arcs_to.append(number[new])
            n_nodes += int(new.sum())
            node = child
            node_at.append(child)
        source, symbol, target = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (arcs_from, arcs_by, arcs_to))
        bases, size = _place(source, symbol, 1 << bits)
        state = np.zeros(n_nodes, np.int64)  # the root is state 0
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        slots = bases[source] + symbol if len(source) else source
        state[target] = slots
        check[slots] = state[source]
        has_arcs = np.flatnonzero(bases >= 0)
        base[state[has_arcs]] = bases[has_arcs]
        last = np.stack(node_at, 1)[np.arange(len(d)), u.sum(1)] if len(d) else np.zeros(0, np.int64)
        answer = np.full(size, -1, np.int32)
        answer[state[last]] = order
        return cls(alphabet, bits, base, check, answer)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of words in the alphabet, 0 if they are not in it."""
        if not len(self.alphabet):
            return np.zeros(len(keys), np.int64)
        k = np.searchsorted(self.alphabet, keys)
        k[k == len(self.alphabet)] = 0
        return np.where(self.alphabet[k] == keys, k + 1, 0)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one symbol, -1 where there is none."""
        t = np.minimum(self.base[states] + symbols, len(self.check) - 1)
        return np.where(self.check[t] == states, t, -1)

    def accepted(self, keys: np.ndarray, linked: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """The rows accepted at any of the words, level by level: all words' states advance together."""
        own, of = np.unique(keys, return_inverse=True)
        number = self.numbers(own)[of]
        low = (1 << self.bits) - 1
        at = np.flatnonzero((number > 0) & linked)
        states = np.zeros(len(at), np.int64)
        for level in range(longest):
            for shift, mask in ((self.bits, -1), (0, low)):
                states = self.step(states, number[at + level] >> shift & mask)
                live = states >= 0
                at, states = at[live], states[live]
            rows = self.answer[states]
            yield rows[rows >= 0]
            if level + 1 < longest:
                on = np.flatnonzero(linked[at + level] & (number[np.minimum(at + level + 1, len(number) - 1)] > 0))
                at, states = at[on], states[on]

    def totals(self, columns: list[np.ndarray], times: np.ndarray, rows: int) -> np.ndarray:
        """How often each of ``rows`` rows is accepted from the first word on of sequences, of which
        ``columns`` has the first, second, ... words (0: none) and ``times`` how often each occurs."""
        out = np.zeros(rows, np.int64)
        low = (1 << self.bits) - 1
        at = np.arange(len(times))
        states = np.zeros(len(at), np.int64)
        for column in columns:
            number = self.numbers(column)
            on = number[at] > 0
            at, states = at[on], states[on]
            for shift, mask in ((self.bits, -1), (0, low)):
                states = self.step(states, number[at] >> shift & mask)
                live = states >= 0
                at, states = at[live], states[live]
            row = self.answer[states]
            hit = row >= 0
            np.add.at(out, row[hit], times[at[hit]])
        return out


def _place(source: np.ndarray, symbol: np.ndarray, span: int) -> tuple[np.ndarray, int]:
    """A base for every node that has arcs (others -1) so that base + symbol is unique over all arcs
    and never 0, and the size of the array.  Nodes with many arcs are placed first, one after the
    other where they fit; those with few at random places, all at once, again until none collides."""
    if not len(source):
        return np.full(1, -1, np.int64), 1
    order = np.argsort(source, kind="stable")
    source, symbol = source[order], symbol[order]
    begin = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
    count = np.diff(np.append(begin, len(source)))
    bases = np.full(int(source.max()) + 1, -1, np.int64)
    size = int(len(source) * 1.6) + 2 * span + 2
    taken = np.zeros(size, bool)
    taken[0] = True
    rng = np.random.default_rng(1)
    by_size = np.argsort(-count, kind="stable")
    large = by_size[count[by_size] > 16]
    front = 1
    for k in large.tolist():
        own = symbol[begin[k]:begin[k] + count[k]]
        tried = front
        while True:
            if tried + 64 + span > len(taken):
                taken = np.append(taken, np.zeros(max(len(taken) // 2, 64 + span), bool))
            free = np.flatnonzero(~taken[np.arange(tried, tried + 64)[:, None] + own].any(1))
            if len(free):
                break
            tried += 64
            if tried > front + 64 * 40:  # crowded: begin later from now on
                front += span // 4
        bases[source[begin[k]]] = tried + free[0]
        taken[tried + free[0] + own] = True
    for n in range(min(16, int(count.max())), 0, -1):
        todo = np.flatnonzero(count == n)
        own = symbol[begin[todo][:, None] + np.arange(n)]
        rounds = 0
        while len(todo):
            if n == 1:  # any free slot does
                free = np.flatnonzero(~taken[span:]) + span
                if len(free) < len(todo):
                    taken = np.append(taken, np.zeros(len(todo) + span, bool))
                    continue
                at = free[:len(todo)] - own[:, 0]
                done = np.ones(len(todo), bool)
            else:
                at = rng.integers(1, len(taken) - span, len(todo))
                slots = at[:, None] + own
                owner = np.full(len(taken), -1, np.int32)
                owner[slots] = np.arange(len(todo), dtype=np.int32)[:, None]
                done = (~taken[slots] & (owner[slots] == np.arange(len(todo))[:, None])).all(1)
            bases[source[begin[todo[done]]]] = at[done]
            taken[at[done][:, None] + own[done]] = True
            todo, own = todo[~done], own[~done]
            rounds += 1
            if rounds % 20 == 0:  # too full for so many arcs
                taken = np.append(taken, np.zeros(len(taken) // 4, bool))
    return bases, len(taken)


def trie_counts(own: DataFrame, found: DataFrame, longest: int, shard: int = SHARD) -> DataFrame:
    """``found`` (k1, k2, ...) with ``a``, how often each sequence occurs in the texts."""
    names = found.columns
    spark = own.sparkSession
    n = found.count()
    shards = -(-n // shard)
    parts = []
    for s in range(shards):
        mine = found.where(F.pmod(F.xxhash64(*names), F.lit(shards)) == s) if shards > 1 else found
        built = cut(mine.repartition(1).mapInArrow(_built, ", ".join([*(f"{k} bigint" for k in names), "number int", "part int", "trie binary"])), "trie")
        raw = built.where("part is not null").select("part", "trie").collect()  # bounded by ``shard``
        trie = spark.sparkContext.broadcast(b"".join(bytes(r.trie) for r in sorted(raw, key=lambda r: r.part)))
        del raw
        counts = cut(own.mapInArrow(_counter(trie, longest), "number int, n bigint").groupBy("number").agg(F.sum("n").alias("a")), "counts")
        trie.unpersist()
        parts.append(built.join(counts, "number").select(*names, "a"))
    if not parts:
        return found.withColumn("a", F.lit(0).cast("bigint"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _built(batches):
    """One shard of candidates as a trie: its rows, numbered, and rows with the parts of the arrays."""
    got = pa.Table.from_batches(list(batches))
    if not got.num_rows:
        return
    keys = [got.column(c).combine_chunks().fill_null(0).to_numpy().view(np.uint64) for c in got.column_names]
    trie = Trie.build(keys)
    head = np.array([len(trie.alphabet), trie.bits, len(trie.base), got.num_rows], np.int64)
    raw = b"".join(x.tobytes() for x in (head, trie.alphabet, trie.base, trie.check, trie.answer))
    columns = [got.column(c).combine_chunks() for c in got.column_names]
    names = [*got.column_names, "number", "part", "trie"]
    for lo in range(0, got.num_rows, 100_000):
        some = [c.slice(lo, 100_000) for c in columns]
        n = len(some[0])
        yield pa.RecordBatch.from_arrays([*some, pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    for k, lo in enumerate(range(0, len(raw), 1 << 20)):
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in columns], pa.nulls(1, pa.int32()), pa.array([k], pa.int32()),
                                          pa.array([raw[lo:lo + (1 << 20)]], pa.binary())], names)


def read_trie(raw: bytes) -> tuple[Trie, int]:
    """The trie of ``_built`` without a copy of its arrays, and how many rows it accepts."""
    n, bits, size, rows = np.frombuffer(raw, np.int64, 4)
    at = 32 + 8 * n
    arrays = [np.frombuffer(raw, np.int32, size, at + 4 * size * k) for k in range(3)]
    return Trie(np.frombuffer(raw, np.uint64, n, 32), int(bits), *arrays), int(rows)


def _counter(raw, longest: int, held: int = 1 << 21) -> Callable:
    """Counts of the accepted rows of a task: a ``bincount`` for about ``held`` accepted at a time."""
    def count(batches):
        trie, rows = read_trie(raw.value)
        total = np.zeros(rows, np.int64)
        found, n = [], 0
        for piece, _ in _pieces(batches):
            for some in trie.accepted(piece.keys, piece.linked, longest):
                found.append(some)
                n += len(some)
            if n > held:
                total += np.bincount(np.concatenate(found), minlength=rows)
                found, n = [], 0
        if found:
            total += np.bincount(np.concatenate(found), minlength=rows)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 18):
            some = at[lo:lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["number", "n"])
    return count


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3,
                  shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, key, n) of the frequent words and, with a null word, of all words
    of a language; and (k1, k2, ..., a) of every phrase of 2 to ``longest`` words with a >= ``least``."""
    own = _apart(docs, text, lang)
    spark = docs.sparkSession
    small_batches(spark)
    words = cut(word_counts(own).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    frequent = spark.sparkContext.broadcast(set_bits(words.where("word is not null").select("key")))
    total = words.where("word is null").agg(F.sum("n")).first()[0] or 0
    if total > DEALT:
        pairs = spark.sparkContext.broadcast(pair_bits(own, frequent, least))  # 32 MB, whatever the input
        counted = dealt_counts(own, frequent, pairs, longest, least, -(-total // DEALT_WORDS))
    else:
        buckets = spark.sparkContext.broadcast(bucket_bits(own, frequent, longest, least))
        counted = trie_counts(own, candidates(own, frequent, buckets, longest), longest, shard)
    return words, cut(counted.where(F.col("a") >= least), "phrases")


def _with_score(rows: DataFrame, a: str, left: str, right: str, out: str) -> DataFrame:
    """floor(1,000,000 * a * a / (left * right)), in decimals of 38 digits."""
    return rows.withColumn(out, F.expr(
        f"cast((cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * cast(1000000 as decimal(7,0)))"
        f" div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0))) as bigint)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000,
                 shard: int = SHARD) -> DataFrame:
    """Phrases of 2 and 3 words with their counts and score: lang, rank, phrase, a, l, r, n, score.

    The score of a cut into a first part (count l) and a rest (count r) is
    floor(1,000,000 * a * a / (l * r)); the cut with the lowest counts, ties to the earlier one.  Pairs
    inside a triple with at least ``share`` percent of their count are dropped, then the first
    ``top`` of every language kept, by score, count, phrase.
    """
    words, phrases = phrase_counts(docs, text, lang, least, 3, shard)
    single = words.where("word is not null")
    of = lambda k, *more: single.select(F.col("key").alias(k), F.col("word").alias(f"w{k[1:]}"), F.col("n").alias(f"f{k[1:]}"), *more)
    pairs = phrases.where("k3 is null").select("k1", "k2", "a")
    triples = phrases.where("k3 is not null").select("k1", "k2", "k3", "a")
    inner = triples.select("k1", "k2", "a").unionByName(triples.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "a"))
    inside = inner.groupBy("k1", "k2").agg(F.max("a").alias("longer"))
    kept = pairs.join(inside, ["k1", "k2"], "left").where(f"longer is null or 100 * longer < {int(share)} * a")
    two = kept.join(of("k1", "lang"), "k1").join(of("k2"), "k2")
    two = _with_score(two, "a", "f1", "f2", "score").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    three = (triples.join(pairs.select("k1", "k2", F.col("a").alias("f12")), ["k1", "k2"])
             .join(pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("a").alias("f23")), ["k2", "k3"])
             .join(of("k1", "lang"), "k1").join(of("k2"), "k2").join(of("k3"), "k3"))
    three = _with_score(_with_score(three, "a", "f1", "f23", "s1"), "a", "f12", "f3", "s2")
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = two.unionByName(three).withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    some = rows.withColumn("__place", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.where("word is null").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
