"""N-gram Jaccard join by signature trees: sets of word shingles whose similarity reaches num/den.

1. Routing.  A pair that links differs in at most d = (den - num) / num of its smaller set's
   shingles.  The range of shingle fingerprints is cut into more segments than that, the same ones
   for all sets of a size class; a set emits a key for each of its first d + 1 segments that are
   not empty (d for its own size).  Of the segments up to the first that two linked sets share, all
   others differ, so both emit that one.  Sets near a class border emit for both classes.
   Shingles that very many documents hold (by a sketch of fixed size, counted over all rows) are
   left out of the segments, which is safe as the others differ no more; a set with too few
   segments left emits its prefix as well (the smallest fingerprints, as many as two linked sets
   must share one of).
2. Keys held by two different sets give candidate edges to the smallest set of the key, and the
   components of these edges are candidate groups: all links lie inside them.  A first signature
   tree over short bitmaps (256 bytes a set, more for large ones) drops sets without a possible partner and splits the
   groups, so that only few sets are shipped whole; large groups are split by size class, the largest
   key by key.
3. Every group is cut into blocks of bounded size.  Over a block a signature tree is built: leaves
   hold a bitmap of their shingles, inner nodes the OR of their children and the range of sizes.  A
   dual traversal drops node pairs whose sizes or whose largest possible overlap (common bits plus
   the shingles that share a bit) cannot reach the threshold; what is left is compared exactly.
4. Between blocks, leaders of the classes found are joined the same way; then every set outside the
   largest class of its group is carried to the blocks that hold one of its keys.  A signature tree
   over bitmaps alone goes before, and only sets that it lets link to another class are sent whole.

Equal sets are one class from the start, so copies are never paired.  The result is the connected
component of every row; links between different sets are verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import U64, Fingerprints, cut, few, free_shuffles, has_bit, mix, schema_with, set_apart, set_back, set_bits, text_pieces, word_spans
from vecsight.llm.components import components

_STEPS = [U64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                           0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(column, width: int):
    """For runs of rows: (first row, end row, fingerprints of the distinct shingles row by row and
    ascending, start of each row's in them)."""
    if not 1 <= width <= len(_STEPS):
        raise ValueError(f"shingles of 1 to {len(_STEPS)} words")
    for i, j, data, offsets in text_pieces(column):
        starts, ends, first = word_spans(data, offsets)
        words = Fingerprints(data, lowered=True).of(starts, ends)
        n = np.diff(first)
        row = np.repeat(np.arange(j - i), n)
        total = np.zeros(len(words), U64)
        for k in range(width):
            part = words[k:] * _STEPS[k]
            total[:len(part)] += part
        left = first[row + 1] - np.arange(len(words))  # words from here to the end of the row
        whole = left >= width
        tokens, owner = mix(total[whole]), row[whole]
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):  # the whole sequence as one shingle, told apart by its length
            own = [mix((words[first[r]:first[r + 1]] * np.array(_STEPS[:n[r]])).sum(keepdims=True) + U64(n[r]))[0] for r in short]
            tokens, owner = np.concatenate([tokens, np.array(own, U64)]), np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        yield i, j, tokens, np.searchsorted(owner, np.arange(j - i + 1))


class Threshold:
    """num/den as integers, with what follows for sizes."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a threshold above 0 and at most 1")
        self.num, self.den = num, den
        bounds = [self._apart_from()]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * 7 // 4 + 1)
        self.bounds = np.array(bounds)  # upper ends of the size classes; sets up to the first link only if equal

    def _apart_from(self) -> int:
        return -(-self.num // max(1, self.den - self.num)) - 1 if self.den > self.num else 1 << 41

    def differs(self, size):
        """The most shingles in which a linking pair differs, of which the smaller set has ``size``."""
        return size * (self.den - self.num) // self.num

    def least(self, size):
        """The least size that can link to ``size``."""
        return -(-size * self.num // self.den)

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def overlap(self, both):
        """The least overlap of a linking pair with ``both`` shingles in total."""
        return -(-self.num * both // (self.num + self.den))


def _starts_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` given by their starts (none empty)."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def digests(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One fingerprint per set, whatever the order; 0 for an empty set."""
    size = np.diff(at)
    out = np.zeros(len(size), U64)
    full = size > 0
    out[full] = mix(_starts_sum(mix(tokens ^ _STEPS[0]), at[:-1][full]) + size[full].astype(U64)) | U64(1)
    return out.view(np.int64)


SKETCH = 1 << 20


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(7)).astype(np.int64) & (SKETCH - 1)


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Of a table of one text column: which of a fixed number of counters hold a shingle of very many rows.  Every task counts all
    its rows, up to 255 a counter, so that it sends one byte per counter."""
    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, tokens, _ in shingle_sets(batch.column(0), width):
                counts += np.bincount(_counter(tokens), minlength=SKETCH)
        own = np.minimum(counts, 255).astype(np.uint8).reshape(8, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([x.tobytes() for x in own])], ["key", "vec"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[key] = sums.get(key, 0) + np.frombuffer(raw, np.uint8).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()])], ["key", "vec"])

    rows = texts.mapInArrow(run, "key int, vec binary").repartition(8, "key").mapInArrow(total, "key int, vec binary")
    parts = {r.key: np.frombuffer(r.vec, np.int64) for r in rows.collect()}
    if not parts:
        return np.zeros(SKETCH, bool)
    return _stand_out(np.concatenate([parts[k] for k in range(8)]))


def _stand_out(counts: np.ndarray) -> np.ndarray:
    """Which counters hold far more than the others do.  However many rare shingles share a counter, their
    sums lie close together, so the bound goes by their spread: it grows with the root of the input."""
    middle, upper = np.percentile(counts, (50, 84))
    return counts >= max(64, min(4 * counts.mean(), middle + 8 * max(upper - middle, 1)))


def routing_keys(tokens: np.ndarray, at: np.ndarray, t: Threshold, rows: np.ndarray, common: np.ndarray):
    """(row, key) of the sets of ``rows``; ``common`` marks the counters of common shingles."""
    size = np.diff(at)
    salted = mix(tokens ^ _STEPS[1])
    rare = ~common[_counter(tokens)]
    low, high = np.searchsorted(t.bounds, t.least(size)), np.searchsorted(t.bounds, size)
    out_rows, out_keys = [], []
    wanted = np.zeros(len(size), bool)
    wanted[rows] = True
    for down in (0, 1, 2):
        level = high - down
        own = np.flatnonzero(wanted & (level >= np.maximum(low, 1)))
        if not len(own):
            continue
        top = t.bounds[level[own]]
        parts = t.differs(top) + 2 + top // 25
        counts = size[own]
        span = np.repeat(at[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        which = np.repeat(np.arange(len(own)), counts)
        kept = rare[span]
        span, which = span[kept], which[kept]
        segment = ((tokens[span] >> U64(32)) * parts[which].astype(U64)) >> U64(32)
        edge = np.ones(len(span), bool)
        edge[1:] = (segment[1:] != segment[:-1]) | (which[1:] != which[:-1])
        starts = np.flatnonzero(edge)
        sums, owner = _starts_sum(salted[span], starts), which[starts]
        filled = np.bincount(owner, minlength=len(own))
        need = t.differs(counts) + 1
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(filled) - filled, filled)
        sent = nth < need[owner]
        owner, sums, segment = owner[sent], sums[sent], segment[starts][sent]
        out_keys.append(mix(sums + segment * _STEPS[2] + level[own][owner].astype(U64) * _STEPS[3]))
        out_rows.append(own[owner])
        for r in own[filled < need]:
            order = np.argsort(~rare[at[r]:at[r + 1]], kind="stable")  # rare shingles first, then by fingerprint
            prefix = tokens[at[r]:at[r + 1]][order][:size[r] - int(t.least(size[r])) + 1]
            out_keys.append(mix(prefix + _STEPS[4]))
            out_rows.append(np.full(len(prefix), r))
    if not out_keys:
        return np.zeros(0, int), np.zeros(0, np.int64)
    return np.concatenate(out_rows), np.concatenate(out_keys).view(np.int64)


def bitmap(tokens: np.ndarray, bits: int, deep: int = 1) -> tuple[np.ndarray, int]:
    """The bitmap of a set and its number of shingles without a bit of their own.  A shingle belongs
    to one of bits / deep buckets; the k-th shingle of a bucket sets the bucket's k-th bit, up to
    ``deep``.  Common bits plus spare shingles thus bound an overlap, and the OR of bitmaps bounds
    that of any of their sets."""
    bucket = np.sort(((tokens >> U64(20)) % U64(bits // deep)).astype(np.int64))
    rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
    own = rank < deep
    where = bucket[own] * deep + rank[own]
    out = np.zeros(bits, bool)
    out[where] = True
    return np.packbits(out).view(U64), len(tokens) - len(where)


class SignatureTree:
    """Bitmaps and size ranges over sets, level by level from the leaves (ordered by ``near``, a
    value that similar sets tend to share, then by size)."""

    FAN = 8

    def __init__(self, maps: np.ndarray, size: np.ndarray, spare: np.ndarray, near: np.ndarray):
        self.order = np.lexsort((size, near))
        self.levels = [(maps[self.order], size[self.order], size[self.order], spare[self.order])]
        while len(self.levels[-1][0]) > 1:
            maps, lo, hi, spare = self.levels[-1]
            at = np.arange(0, len(maps), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at)))

    @classmethod
    def over(cls, sets: list[np.ndarray]) -> SignatureTree:
        size = np.array([len(s) for s in sets])
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(size) + 1)), 9, 14))
        maps, spare = zip(*(bitmap(s, bits) for s in sets))
        # near copies share their smallest fingerprint as a rule: they become neighbours
        return cls(np.stack(maps), size, np.array(spare), np.array([s[0] for s in sets]))

    def admitted(self, level: int, a: np.ndarray, b: np.ndarray, t: Threshold) -> np.ndarray:
        """Which node pairs of a level may hold a linking pair."""
        maps, lo, hi, spare = self.levels[level]
        good = (hi[a] >= t.least(lo[b])) & (hi[b] >= t.least(lo[a]))
        at = np.flatnonzero(good)
        for k in range(0, len(at), 4096):
            some = at[k:k + 4096]
            x, y = a[some], b[some]
            most = np.bitwise_count(maps[x] & maps[y]).sum(1).astype(int) + np.minimum(spare[x], spare[y])
            good[some] = most >= t.overlap(lo[x] + lo[y])
        return good

    def up(self, values: np.ndarray, join: np.ufunc) -> list[np.ndarray]:
        """``values`` of the leaves, in the tree's order, joined level by level."""
        out = [values]
        while len(out[-1]) > 1:
            out.append(join.reduceat(out[-1], np.arange(0, len(out[-1]), self.FAN)))
        return out

    def pairs(self, t: Threshold, chunk: int = 2048, wanted=None):
        """Pairs of leaves (positions in the tree's order) that survive the dual traversal, in runs of
        bounded length: at most ``chunk`` node pairs are opened at a time.  Node pairs of a level that
        ``wanted`` (level, a, b) denies are not followed."""
        step = np.arange(self.FAN)
        todo = [(len(self.levels) - 1, np.zeros(1, int), np.zeros(1, int))]
        while todo:
            level, a, b = todo.pop()
            if not level:
                yield a, b
                continue
            if len(a) > chunk:
                todo.append((level, a[chunk:], b[chunk:]))
                a, b = a[:chunk], b[:chunk]
            level -= 1
            n = len(self.levels[level][0])
            x = a[:, None, None] * self.FAN + step[None, :, None]
            y = b[:, None, None] * self.FAN + step[None, None, :]
            x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
            inner = (x < n) & (y < n) & (x <= y if level else x < y)
            x, y = x[inner], y[inner]
            if wanted is not None:
                asked = wanted(level, x, y)
                x, y = x[asked], y[asked]
            good = self.admitted(level, x, y, t)
            if good.any():
                todo.append((level, x[good], y[good]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (smallest position reachable, per position) after adding the edges a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def join_block(classes: list[int], sets: list[np.ndarray], t: Threshold,
               probes: set[int] | None = None) -> list[tuple[int, int]]:
    """Of the classes of one block (a class per set; sets of a class are connected already) those that
    links connect to a smaller one: (class, smallest class it reaches).  Every link is verified, and
    one that connects nothing new is not looked at.  With ``probes``, only pairs that hold one of
    these classes are."""
    if len(sets) < 2:
        return []
    tree = SignatureTree.over(sets)
    classes, sets = ([v[k] for k in tree.order] for v in (classes, sets))
    above = {c: c for c in classes}

    def root(c):
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    for x, y in (xy for a, b in tree.pairs(t) for xy in zip(a.tolist(), b.tolist())):
        if probes is not None and classes[x] not in probes and classes[y] not in probes:
            continue
        a, b = root(classes[x]), root(classes[y])
        if a != b:
            s, r = sets[x], sets[y]
            if t.links(len(np.intersect1d(s, r, assume_unique=True)), len(s), len(r)):
                above[max(a, b)] = min(a, b)
    return [(c, root(c)) for c in above if root(c) != c]


def _by_group(batches, columns: int):
    """Groups of rows whose first ``columns`` columns agree, from batches sorted by them."""
    held, key = [], None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                if row[:columns] != key:
                    if held:
                        yield held
                    held, key = [], row[:columns]
                held.append(row)
    if held:
        yield held


_SHORT_BITS, _SHORT_DEEP = 2048, 8  # least bits; a byte of the short bitmap is a bucket
_UNARY = np.packbits(np.arange(8) < np.arange(9)[:, None], axis=1)[:, 0]
#: Candidate groups of up to so many sets are split by short bitmaps first, as a whole or (above the
#: first number) by size class; larger ones key by key.
REFINED, REFINED_BY_SIZE = 4096, 1 << 16


def _short_bits(level: int, t: Threshold) -> int:
    """The bits of the short bitmaps of a size class: two a shingle of its largest sets, in bounds."""
    return int(min(max(_SHORT_BITS, 2 << int(t.bounds[level] - 1).bit_length()), MOST_BITS))


def _folded(raw: list[bytes], n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Short bitmaps folded to ``bits`` (the same as if made with so many), and their spare shingles."""
    out = []
    for x in raw:
        held = np.frombuffer(x, np.uint8)
        if 8 * len(held) > bits:
            held = _UNARY[np.minimum(np.bitwise_count(held).reshape(-1, bits // 8).sum(0), _SHORT_DEEP)]
        out.append(held)
    maps = np.stack(out).view(U64)
    return maps, n - np.bitwise_count(maps).sum(1).astype(int)


def _refine(rows: DataFrame, t: Threshold) -> DataFrame:
    """(c, grp): the parts that possible links hold together inside every grp of (grp, c, n,
    short), named by one of their sets; sets without a possible partner are left out."""
    def run(batches):
        for group in _by_group(batches, 1):
            own = list({r[1]: r for r in group}.values())
            c, n = (np.array([r[k] for r in own]) for k in (1, 2))
            maps, spare = _folded([r[3] for r in own], n, _SHORT_BITS)
            tree = SignatureTree(maps, n, spare, n)
            label = np.arange(len(own))
            for a, b in tree.pairs(t):
                label = join_labels(label, a, b)
            c = c[tree.order]
            kept = np.bincount(label, minlength=len(label))[label] > 1
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]), pa.array(c[label[kept]])], ["c", "grp"])

    return (rows.select("grp", "c", "n", "short").repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(run, "c long, grp long"))


def _possible_edges(rows: list[tuple], t: Threshold, bits: int):
    """Batches (a, b) that connect those of (c, n, short) which may link, by a signature tree over their
    short bitmaps folded to ``bits``."""
    own = list({r[0]: r for r in rows}.values())
    if len(own) < 2:
        return
    c, n = (np.array([r[k] for r in own]) for k in (0, 1))
    maps, spare = _folded([r[2] for r in own], n, bits)
    tree = SignatureTree(maps, n, spare, n)
    label = np.arange(len(own))
    sides = [tree.up(label, np.minimum), tree.up(label, np.maximum)]

    def wanted(level, a, b):  # not one part already
        least, most = (x[level] for x in sides)
        return np.minimum(least[a], least[b]) != np.maximum(most[a], most[b])

    for a, b in tree.pairs(t, wanted=wanted):
        if (label[a] != label[b]).any():
            label = join_labels(label, a, b)
            sides[:] = tree.up(label, np.minimum), tree.up(label, np.maximum)
    c = c[tree.order]
    other = label != np.arange(len(label))
    if other.any():
        yield pa.RecordBatch.from_arrays([pa.array(c[label[other]]), pa.array(c[other])], ["a", "b"])


def _refine_by_size(rows: DataFrame, t: Threshold) -> DataFrame:
    """``_refine`` for large groups: a size class of a group at a time.  A set comes to all classes in
    which it may link, so two that link meet in that of the smaller one."""
    def classed(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            low, high = np.searchsorted(t.bounds, t.least(n)), np.searchsorted(t.bounds, n)
            times = high - low + 1
            row = np.repeat(np.arange(len(n)), times)
            level = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([out.columns[0], pa.array(level), *out.columns[1:]], ["grp", "level", *out.schema.names[1:]])

    def run(batches):
        for group in _by_group(batches, 2):
            yield from _possible_edges([r[2:] for r in group], t, _short_bits(group[0][1], t))

    spread = rows.select("grp", "c", "n", "short").mapInArrow(classed, "grp long, level long, c long, n long, short binary")
    edges = spread.repartition("grp", "level").sortWithinPartitions("grp", "level").mapInArrow(run, "a long, b long")
    return components(cut(edges, "refined-edges")).select(F.col("node").alias("c"), F.col("component").alias("grp"))


def _refine_by_key(rows: DataFrame, keys: DataFrame, t: Threshold) -> DataFrame:
    """``_refine`` for groups of any size: the sets that hold a key of (c, key) at a time, as two that link
    share one.  Of keys that the same sets hold, as those of near copies mostly are, one is looked at."""
    def run(batches):
        for group in _by_group(batches, 1):
            yield from _possible_edges([r[1:] for r in group], t, 8 * min(len(r[3]) for r in group))

    own = rows.select("c", "n", "short").dropDuplicates(["c"])
    held = cut(keys.select("key", "c").join(rows.select("c"), "c", "left_semi").distinct(), "large-keys")
    holders = held.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    once = holders.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    edges = (held.join(once, "key", "left_semi").join(own, "c").select("key", "c", "n", "short").repartition("key")
             .sortWithinPartitions("key").mapInArrow(run, "a long, b long"))
    return components(cut(edges, "refined-edges")).select(F.col("node").alias("c"), F.col("component").alias("grp"))


#: Bits of the bitmaps that decide which sets are sent to other blocks: four a shingle of the group's
#: mean set, within these bounds; larger sets only have looser bounds.
LEAST_BITS, MOST_BITS, _LONG_DEEP = 1 << 11, 1 << 16, 2


def _long_maps(members: DataFrame) -> DataFrame:
    """(c, n, spare, near, map): of every set of (c, bits, tokens) its smallest fingerprint, which near
    copies tend to share, and its bitmap, a sixteenth of its size as a rule."""
    def run(batches):
        for batch in batches:
            c, bits, tokens = (batch.column(x) for x in ("c", "bits", "tokens"))
            sets = [np.frombuffer(x, U64) for x in tokens.to_pylist()]
            maps, spare = zip(*(bitmap(x, b, _LONG_DEEP) for x, b in zip(sets, bits.to_pylist()))) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([c, pa.array([len(x) for x in sets], pa.int64()), pa.array(spare, pa.int64()),
                                              pa.array([int(x[:1].view(np.int64)[0]) for x in sets], pa.int64()),
                                              pa.array([m.tobytes() for m in maps], pa.binary())], ["c", "n", "spare", "near", "map"])

    return members.select("c", "bits", "tokens").mapInArrow(run, "c long, n long, spare long, near long, map binary")


def _possible(rows: DataFrame, maps: DataFrame, t: Threshold) -> DataFrame:
    """``rows`` (grp, block, c, cls, probe, ...) without the sets that, by a signature tree over their
    bitmaps, can link to no set of another class in their block; pairs without a probe don't count."""
    def run(batches):
        for group in _by_group(batches, 2):
            own = list({r[2]: r for r in group}.values())
            if len(own) < 2:
                continue
            c, cls, probe, n, spare, near = (np.array([r[k] for r in own]) for k in range(2, 8))
            tree = SignatureTree(np.stack([np.frombuffer(r[8], U64) for r in own]), n, spare, near)
            c, cls, probe = c[tree.order], cls[tree.order], probe[tree.order]
            least, most, probes = tree.up(cls, np.minimum), tree.up(cls, np.maximum), tree.up(probe, np.logical_or)

            def wanted(level, a, b):  # some probe, and not one class only
                apart = np.minimum(least[level][a], least[level][b]) != np.maximum(most[level][a], most[level][b])
                return apart & (probes[level][a] | probes[level][b])

            kept = np.zeros(len(own), bool)
            for a, b in tree.pairs(t, wanted=wanted):
                kept[a] = kept[b] = True
            if kept.any():
                left = int(kept.sum())
                yield pa.RecordBatch.from_arrays([pa.array([own[0][0]] * left, pa.int64()), pa.array([own[0][1]] * left, pa.int64()),
                                                  pa.array(c[kept])], ["grp", "block", "c"])

    left = (rows.select("grp", "block", "c", "cls", "probe").join(maps, "c")
            .select("grp", "block", "c", "cls", "probe", "n", "spare", "near", "map").repartition("grp", "block")
            .sortWithinPartitions("grp", "block").mapInArrow(run, "grp long, block long, c long"))
    return rows.join(left, ["grp", "block", "c"], "left_semi")


def _join_groups(rows: DataFrame, t: Threshold) -> DataFrame:
    """(blocks, a, b): the classes a that links inside a (grp, block) connect to a smaller class b, of
    (grp, block, blocks, c, cls, probe, tokens)."""
    def run(batches):
        for group in _by_group(batches, 2):
            own = list({r[3]: r for r in group}.values())  # copies of a set come once
            probes = {r[4] for r in own if r[5]}
            links = join_block([r[4] for r in own], [np.frombuffer(r[6], U64) for r in own], t, probes)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([own[0][2]] * len(links), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*links))],
                                                 ["blocks", "a", "b"])

    return (rows.select("grp", "block", F.col("blocks").cast("long").alias("blocks"), "c", "cls", "probe", "tokens")
            .repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(run, "blocks long, a long, b long"))


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``cls``: the component of ``c`` in ``found``, itself if it has none."""
    return (rows.drop("cls").join(found.select(F.col("node").alias("c"), "component"), "c", "left")
            .withColumn("cls", F.coalesce("component", "c")).drop("component"))


def _with_tokens(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (with a column c) and the tokens of their sets; sets that are not asked for stay where they are."""
    asked = few(rows.select("c").distinct())
    return tokens.join(asked, "c", "left_semi").join(rows, "c")


def _cross_blocks(members: DataFrame, keys: DataFrame, links: DataFrame, found: DataFrame, t: Threshold,
                  block: int) -> DataFrame:
    """More links for groups of several blocks; ``keys`` (c, key) are the keys that two sets hold.
    ``members`` is a written table, a row a set; sets are sent only where a bitmap lets them link."""
    tokens = members.select("c", "tokens")
    maps = cut(_long_maps(members), "maps")
    slim = cut(members.drop("tokens", "bits"), "slim")
    spread = _with_class(slim, found)
    for _ in range(4):  # leaders of the classes, until that joins no more
        leaders = spread.where("c = cls")
        counts = leaders.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
        leaders = cut(leaders.join(counts, "grp").withColumn("blocks", F.ceil(F.col("n") / block))
                      .withColumn("block", F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks"))).withColumn("probe", F.lit(True)), "leading")
        leaders = cut(_possible(leaders, maps, t), "leaders-possible")
        free_shuffles(leaders.sparkSession)
        more = cut(_join_groups(_with_tokens(leaders, tokens), t), "leaders")
        free_shuffles(more.sparkSession)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        spread = _with_class(slim, components(links))
    spread = cut(spread, "spread")
    free_shuffles(spread.sparkSession)
    sizes = spread.groupBy("grp", "cls").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("grp").agg(F.max(F.struct("n", "cls")).alias("top"), F.count("*").alias("classes"))
    tops = tops.where("classes > 1").select("grp", F.col("top.cls").alias("top"))
    rest = cut(spread.join(tops, "grp"), "rest")
    keys = cut(keys.join(rest.select("c", "grp", "block", (F.col("cls") != F.col("top")).alias("probe")).distinct(), "c"), "rest-keys")
    at = keys.select("grp", "key", F.col("block").alias("other")).distinct()
    visits = keys.where("probe").join(at, ["grp", "key"]).where("block <> other").select("c", "other").distinct()
    carried = rest.where("cls <> top").join(visits, "c")
    stay = rest.withColumn("probe", F.col("cls") != F.col("top"))
    both = cut(stay.select("grp", "block", "blocks", "c", "cls", "probe").unionByName(
        carried.select("grp", F.col("other").alias("block"), "blocks", "c", "cls", F.lit(True).alias("probe"))), "places")
    # a block without a probe has nothing to compare
    probed = both.where("probe").select("grp", "block").distinct()
    both = cut(_possible(both.join(probed, ["grp", "block"], "left_semi"), maps, t), "places-possible")
    free_shuffles(spread.sparkSession)
    return links.unionByName(cut(_join_groups(_with_tokens(both, tokens), t), "cross"))


def classes(docs: DataFrame, columns: list[str], width: int, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (``columns``, n_shingles, c: the class of equal sets), written once, and
    the component of every class that links to another (c, component).

    Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words than
    ``width`` has one shingle, all of them; a null text or one without words has none and links with
    nothing (its c is 0); equal sets link, repeated rows too; an empty table gives no rows.
    """
    t = Threshold(num, den)
    # the text comes along once: under its own name if it is kept, else as a column that goes
    column = "text" if "text" in columns else "__text"
    texts = docs.select(*[F.col(f"`{x}`") for x in columns], *([] if column == "text" else [F.col("text").cast("string").alias(column)]))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts.select(column), width))  # 1 MB, whatever the input

    def keys_of(batches):
        seen: set = set()
        for batch in batches:
            for i, j, tokens, at in shingle_sets(batch.column(column), width):
                c = digests(tokens, at)
                fresh = [r for r, x in enumerate(c.tolist()) if x not in seen and not seen.add(x)]  # copies emit once a task
                rows, keys = routing_keys(tokens, at, t, np.array(fresh, int), common.value)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c[rows])], ["key", "c"])
                if len(seen) > 200_000:
                    seen.clear()

    rows = texts.select(column).mapInArrow(keys_of, "key long, c long")
    shared = cut(rows.groupBy("key").agg(F.min("c").alias("hub"), F.max("c").alias("other"))
                 .where("hub <> other").select("key", "hub"), "shared-keys")
    free_shuffles(docs.sparkSession)
    passing = docs.sparkSession.sparkContext.broadcast(set_bits(shared))  # 8 MB, whatever the input

    def sets_of(batches):
        bits = passing.value
        seen: set = set()
        for batch in batches:
            for i, j, tokens, at in shingle_sets(batch.column(column), width):
                c = digests(tokens, at)
                fresh = [r for r, x in enumerate(c.tolist()) if x not in seen and not seen.add(x)]
                owner, keys = routing_keys(tokens, at, t, np.array(fresh, int), common.value)
                hit = has_bit(bits, keys)
                owner, keys = owner[hit], keys[hit]
                order = np.argsort(owner, kind="stable")
                owner, keys = owner[order], keys[order]
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                held = [tokens[at[r]:at[r + 1]] if cuts[r + 1] > cuts[r] else None for r in range(j - i)]
                levels = np.searchsorted(t.bounds, np.diff(at)).tolist()
                short = [None if x is None else bitmap(x, _short_bits(k, t), _SHORT_DEEP)[0].tobytes() for x, k in zip(held, levels)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(i, j - i) for x in columns), pa.array(np.diff(at).astype(np.int64)), pa.array(c),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(keys)),
                     pa.array(short, pa.binary())],
                    [*columns, "n_shingles", "c", "keys", "short"])
                if len(seen) > 200_000:
                    seen.clear()

    schema = schema_with(texts.drop("__text"), "n_shingles bigint, c bigint, keys array<bigint>, short binary")
    sets = cut(texts.mapInArrow(sets_of, schema), "sets")
    held = sets.where("short IS NOT NULL")
    keys = cut(held.select("c", F.explode("keys").alias("key")).join(shared, "key"), "keys")
    edges = keys.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"))
    groups = components(edges).select(F.col("node").alias("c"), F.col("component").alias("grp"))
    counts = groups.groupBy("grp").agg(F.count("*").alias("members"))
    groups = cut(groups.join(counts, "grp"), "candidates")
    short = held.select("c", F.col("n_shingles").alias("n"), "short").join(groups, "c")
    refined = _refine(short.where(F.col("members") <= REFINED), t)
    by_size = (F.col("members") > REFINED) & (F.col("members") <= REFINED_BY_SIZE)
    if not groups.where(by_size).isEmpty():
        refined = refined.unionByName(_refine_by_size(short.where(by_size), t))
    largest = F.col("members") > REFINED_BY_SIZE
    if not groups.where(largest).isEmpty():
        refined = refined.unionByName(_refine_by_key(short.where(largest), keys, t))
    groups = cut(refined, "refined")
    weights = held.groupBy("c").agg(F.max("n_shingles").alias("n"))
    sizes = (groups.join(weights, "c").groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
             .select("grp", F.ceil(F.greatest(F.col("members") / block, F.col("n") / (4 << 20))).alias("blocks"),
                     F.least(F.greatest(F.pow(F.lit(2), F.ceil(F.log2(4 * F.col("n") / F.col("members")))), F.lit(LEAST_BITS)),
                             F.lit(MOST_BITS)).cast("long").alias("bits")))
    placed = cut(groups.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks"))), "groups")
    free_shuffles(docs.sparkSession)
    asked = docs.sparkSession.sparkContext.broadcast(set_bits(placed.select(F.col("c").alias("key"))))  # 8 MB, whatever the input

    def tokens_of(batches):
        bits = asked.value
        seen: set = set()
        for batch in batches:
            for i, j, tokens, at in shingle_sets(batch.column(column), width):
                c = digests(tokens, at)
                fresh = [r for r in np.flatnonzero((c != 0) & has_bit(bits, c)).tolist() if c[r] not in seen and not seen.add(c[r])]
                yield pa.RecordBatch.from_arrays([pa.array(c[fresh]), pa.array([tokens[at[r]:at[r + 1]].tobytes() for r in fresh], pa.binary())], ["c", "tokens"])
                if len(seen) > 200_000:
                    seen.clear()

    # only the sets of candidate groups are carried whole, each once; they are made from the texts again, not kept meanwhile
    members = texts.select(column).mapInArrow(tokens_of, "c long, tokens binary").dropDuplicates(["c"])
    members = cut(members.join(placed, "c").withColumns({"cls": F.col("c"), "probe": F.lit(True)}), "members")
    free_shuffles(docs.sparkSession)
    links = cut(_join_groups(members, t), "links")
    free_shuffles(docs.sparkSession)
    # the links of a group of one block are whole: its classes are known
    found = links.where("blocks = 1").select(F.col("a").alias("c"), F.col("b").alias("component"))
    if not placed.where("blocks > 1").isEmpty():
        links = links.where("blocks > 1")
        links = _cross_blocks(members.where("blocks > 1"), keys.drop("hub"), links, components(links), t, block)
        found = found.unionByName(components(links).select(F.col("node").alias("c"), "component"))
    return sets.drop("keys", "short"), found


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id of its
    component, itself included).  See ``classes``; a row without shingles is its own component; null
    ids are left out of the smallest id, a component of null ids only has a null id; extra columns
    are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, found = classes(docs, ["doc_id"], width, num, den, block)
    joined = rows.join(found, "c", "left").withColumn("cls", F.coalesce("component", "c"))
    least = joined.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("component_id"))
    full = joined.where("n_shingles > 0").join(least, "cls").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(joined.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a fingerprint of the file and place of every row, so that each scan finds
    the same ones; a table that does not come straight from Parquet files is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if not plan.nodeName().startswith("LogicalRelation") or "_metadata" in list(plan.schema().fieldNames()):
        docs = cut(docs, "documents")
    return docs.withColumn("__row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = 2048) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest doc_id (a null id comes
    last, of rows that share it any one).  Rows without shingles all stay.  Texts are read again
    for the result, not carried along."""
    apart, names = set_apart(docs, "doc_id", "text")
    own = _numbered(apart)
    rows, found = classes(own.select("doc_id", "text", "__row"), ["doc_id", "__row"], width, num, den, block)
    joined = (rows.where("n_shingles > 0").select("__row", "doc_id", "c").join(found, "c", "left")
              .select("__row", "doc_id", F.coalesce("component", "c").alias("cls")))
    first = joined.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("first"))
    gone = few(cut(joined.join(first, "cls").where("__row <> first").select("__row"), "gone"))
    return set_back(own.join(gone, "__row", "left_anti"), names, docs.columns)
