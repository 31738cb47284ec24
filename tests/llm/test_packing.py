import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vecsight.llm import packing, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-two-fit as it is told: one sequence at a time over the list of unpacked pieces."""
    left, out = sorted(lengths), []
    while left:
        mine, gap = [], capacity
        for x in left[::-1]:
            if x <= gap:
                mine.append(x)
                gap -= x
        for x in mine:
            left.remove(x)
        while len(mine) > 1:
            s = min(mine)
            pairs = [(a + b, max(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(left[:i]) if a + b <= gap + s and min(a, b) >= capacity // 6]
            if not pairs or max(pairs)[0] <= s:
                break
            both, _, i, j = max(pairs)
            mine.remove(s)
            a, b = left[i], left[j]
            for x in (a, b):
                left.remove(x)
                mine.append(x)
            left = sorted([*left, s])
            gap += s - both
        out.append(sorted(mine))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_fillings_are_those_of_one_by_one(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 20, 50])
    lengths = [rnd.choice([rnd.randint(1, capacity), rnd.randint(1, 1 + capacity // 3), 3, capacity // 2]) for _ in range(rnd.choice([0, 1, 9, 90]))]
    made = packing.best_two_fit(np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(1, int), capacity)
    got = [sorted(x for x, n in used.items() for _ in range(n)) for used, times in made for _ in range(times)]
    assert got == one_by_one(lengths, capacity)


@pytest.mark.parametrize(("hot", "over"), [(0, 1.005), (30, 1.005), (300, 1.04), (513, 1.5)])
def test_fillings_of_many_pieces(hot, over):
    """A billion pieces need no more time than their lengths, and hardly a sequence more than there
    must be; where half as many again have one length, its multiples leave gaps."""
    rng = np.random.default_rng(3)
    counts = np.concatenate([[0], rng.integers(0, 2_000_000, 1024)])
    if hot:
        counts[hot] += counts.sum() // 2
    made = packing.best_two_fit(counts, 1024)
    total = int((counts * np.arange(1025)).sum())
    assert len(made) < 7_200
    assert sum(t for _, t in made) <= -(-total // 1024) * over
    back = np.zeros(1025, np.int64)
    for used, times in made:
        assert sum(x * n for x, n in used.items()) <= 1024
        for x, n in used.items():
            back[x] += n * times
    assert (back == counts).all()


def whole(rows, capacity):
    """Sequences are gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_best_two_fit(spark, SF).collect()
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    library = Tokenizer.from_file(PATH)
    assert set(own) == set(docs)
    for doc_id, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        assert sorted(own[doc_id]) == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    total = sum(r.length for r in rows)
    assert whole(rows, 1024) <= -(-total // 1024) * 1.005


def test_edges_and_sequences(spark):
    texts = [None, "", "a", "<|endoftext|> x <|endoftext|>", " \n\t  é日本 🎉", "word " * 5000, "the end " * 511 + "the", "b" * 70_000, "a", "a"]
    df = spark.createDataFrame([(i if i < 8 else 2, t, 5, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int, __n int")
    packed = packing.pack(packing.token_pieces(df, PATH, public_tokenizers.PATTERN, end_id=2, capacity=64), capacity=64)
    rows = packed.collect()
    assert whole(rows, 64) <= -(-sum(r.length for r in rows) // 64) + 1
    library = Tokenizer.from_file(PATH)
    ids = defaultdict(dict)
    for r in rows:
        ids[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts[:8]):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for _, own in sorted(ids[i].items()) for x in own] == want
        assert all(len(own) == 64 for k, own in ids[i].items() if k)
    made = packing.sequences(packed).collect()
    for s in made:
        assert len(s.ids) == 4 * s.length
        for m in s.members:
            own = ids[m.doc_id][m.piece]
            assert np.frombuffer(s.ids, "<u4").tolist()[m.offset:m.offset + len(own)] == own
    assert sum(len(s.members) for s in made) == len(rows)
    empty = spark.createDataFrame([], df.schema)
    assert packing.pack(packing.token_pieces(empty, PATH, public_tokenizers.PATTERN, 2)).count() == 0


def test_pack_of_any_table(spark):
    rnd = random.Random(8)
    rows = [(i, 700 if i % 3 == 0 else rnd.randint(1, 1024), "s", 9) for i in range(3000)] + [(-1, None, "s", 9), (-2, 0, "s", 9), (-3, 5000, "s", 9)]
    df = spark.createDataFrame(rows, "id long, size int, sequence_id string, __task int").drop("__task").repartition(7)
    got = packing.pack(df, length="size").withColumnRenamed("size", "length").collect()
    assert sorted((r.id, r.length) for r in got if r.id >= 0) == sorted(r[:2] for r in rows[:3000])
    assert all(r.sequence_id is None and r.offset is None for r in got if r.id < 0)
    least = -(-sum(r[1] for r in rows[:3000]) // 1024)
    assert whole([r for r in got if r.id >= 0], 1024) <= 1.3 * least
