import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vecsight.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every run of a list of words: for each period the maximal stretches, the smallest period of each."""
    out = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length >= max(least, 2 * q):
                out.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapse(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(collapse(words, found)))


def made(rnd, letters, n):
    words = []
    while len(words) < n:
        kind = rnd.random()
        if kind < 0.4:
            words += [rnd.choice(letters) for _ in range(rnd.randint(1, 30))]
        elif kind < 0.8:
            period = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 6, 7, 11, 12, 13, 30, 100]))]
            words += (period * 40)[:rnd.randint(1, 4 * len(period) + 14)]
        elif words:
            lo = rnd.randrange(len(words))
            words += words[lo:lo + rnd.randint(1, 150)]
    return words[:n]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
@pytest.mark.parametrize("block", [3, 50, 1 << 21])
def test_runs_against_brute_force(letters, block):
    rnd = random.Random(len(letters) * block)
    texts = [made(rnd, letters, rnd.choice([0, 1, 11, 12, 13, 40, 200, 700])) for _ in range(25)]
    codes = np.concatenate([np.array([hash(w) for w in t], np.int64) for t in texts]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first = np.repeat(starts[:-1], np.diff(starts)).astype(np.int64)
    want = [(s + lo, n, q) for lo, t in zip(starts, texts) for s, n, q in brute(t)]
    assert [tuple(map(int, r)) for r in runs.word_runs(codes, first, block=block)] == want


def test_work_on_one_word_repeated(monkeypatch):
    """Occurrences inside a known run are not looked at again: the work does not grow with the square."""
    codes, first = np.full(200_000, 7, np.uint64), np.zeros(200_000, np.int64)
    assert runs.word_runs(codes, first).tolist() == [[0, 200_000, 1]]
    mixed = np.tile(np.array([1, 1, 2, 1, 3, 1, 1], np.uint64), 30_000)
    assert [0, 210_000, 7] in runs.word_runs(mixed, np.zeros(len(mixed), np.int64)).tolist()


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect())
    assert got == sorted(contract(*d) for d in docs)


def test_edges(spark, tables):
    rnd = random.Random(5)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 50), (4, "x " * 50), (-7, "é日 b " * 9),
            (30, " ".join(made(rnd, ["w%d" % i for i in range(9)], 4000))), (31, "a\x0bb\x0cc " * 7), (32, "a b " * 13)]
    rows += [(i, " ".join(made(rnd, "abcdef", 60))) for i in range(100, 140)]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, w int")
    sf, _ = tables(documents=df)
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()), key=str)
    plain = [contract(i, t) if i is not None else (None, *contract(1, t)[1:]) for i, t in rows]
    assert zlib.crc32(b"1") % 10
    assert got == sorted(plain, key=str)
    whole = runs.collapse_runs(df).collect()[4]
    assert (whole.w, whole.n_words, whole.collapsed, whole.runs[0].asDict()) == (1, 50, "x", {"start": 0, "length": 50, "period": 1})
    empty = spark.createDataFrame([], df.schema)
    assert runs.digests(runs.collapse_runs(empty)).count() == 0
