import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vecsight.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        steps = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                steps[p] += 1
                steps[p + length] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone]).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, length):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, at int, __c string")
    got = sorted((tuple(r) for r in suffixes.removal_digests(df, length=length).drop("n_kept").collect()), key=str)
    assert got == brute(rows, length)


@pytest.mark.parametrize(("length", "letters"), [(40, "ab"), (40, "abcdefgh é日"), (400, "abcdefgh é")])
def test_against_brute_force(spark, length, letters):
    rnd = random.Random(length + len(letters))
    piece = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [piece(rnd.choice([length - 1, length, length + 1, 2 * length, 5 * length])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [piece(rnd.randint(0, 2 * length))]
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            whole = rnd.choice(shared)
            lo = rnd.choice([0, 0, rnd.randrange(len(whole))])
            parts += [whole[lo:], piece(rnd.choice([0, 1, length]))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, "x" * (3 * length)), (102, "xy" * length), (103, "x" * (length - 1))]
    check(spark, rows, length)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op8_suffix_dedup(spark, SF).drop("n_kept").collect()), key=str)
    assert got == brute([tuple(d) for d in docs], 400)


def test_edges(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(300_000))
    check(spark, [(1, None), (2, ""), (3, "short"), (3, "short"), (None, "k" * 399), (4, long), (5, "é" + long[1000:2000]), (6, long[5000:5399])], 400)
    assert suffixes.removal_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        suffixes.removal_digests(spark.createDataFrame([], "doc_id long, text string"), length=401)


def test_texts_without_repeats(spark):
    rnd = random.Random(4)
    piece = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    same, a, b = piece(600), piece(300), piece(300)
    rows = [(1, a + same, 7), (2, same + b, 8), (3, "p" * 100, None), (4, same, 9), (4, same, 9), (5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts int")
    got = sorted((tuple(r) for r in suffixes.without_repeats(df).collect()), key=str)
    assert got == sorted([(1, a, 7), (2, b, 8), (3, "p" * 100, None), (4, "", 9), (4, "", 9), (5, "", 1)], key=str)


def test_planted_passages_of_sixty_words(spark):
    """A passage of 60 words that two documents share goes if it has 400 bytes, and stays with fewer;
    documents that share nothing lose nothing."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain = lambda: " ".join(word(rnd.randint(2, 9)) for _ in range(150))
    long, short = " ".join(word(7) for _ in range(60)), " ".join(word(4) for _ in range(60))
    assert len(long) >= 400 > len(short)
    rows = [(k, f"{plain()}\n{long}\n{plain()}") for k in range(3)] + [(10 + k, f"{plain()}\n{short}\n{plain()}") for k in range(3)]
    rows += [(20 + k, plain()) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.n_kept) for r in suffixes.removal_digests(df).collect()}
    for doc_id, text in rows:
        removed = len(long) + 2 if doc_id < 3 else 0  # with the line breaks around it, which repeat as well
        assert got[doc_id] == (removed, int(removed > 0), len(text) - removed)
