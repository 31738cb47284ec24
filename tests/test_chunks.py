"""Hand examples and a plain-Python model of the chunking rules."""

import random

from pyspark.sql import functions as F

from vecsight.functions import chunks as CH
from vecsight.functions.text import sentences, words


def even_model(sents, m):
    n = len(sents)
    if n < m:
        return sents + [" ".join(sents)] * (m - n)
    q, r = divmod(n, m)
    out, start = [], 0
    for i in range(m):
        size = q + 1 if i < r else q
        out.append(" ".join(sents[start:start + size]))
        start += size
    return out


def overlap_model(sents, text, m, o):
    if len(sents) <= m:
        w = text.split()
        c = len(w) // m
        out = []
        for i in range(m):
            s = max(0, i * c - i * o)
            out.append(" ".join(w[s:min(s + c + o, len(w))]))
        return out
    c = len(sents) // m
    out = []
    for i in range(m):
        s, e = i * c, i * c + c
        if i < m - 1:
            e = min(e + 1, len(sents))
        t = " ".join(sents[s:e])
        if i > 0:
            t = " ".join(out[-1].split()[-o:]) + " " + t
        out.append(t)
    return out


def _sentences_df(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return df.select("id", "t", sentences(F.col("t")).alias("s"))


def test_even_examples(spark):
    eight = " ".join(f"S{i}." for i in range(8))
    four = " ".join(f"S{i}." for i in range(4))
    df = _sentences_df(spark, [eight, four]).select("id", CH.even_chunks(F.col("s"), 6).alias("c"))
    got = {r["id"]: r["c"] for r in df.collect()}
    assert [len(x.split()) for x in got[0]] == [2, 2, 1, 1, 1, 1]
    assert got[1] == ["S0.", "S1.", "S2.", "S3.", four, four]


def test_overlap_word_branch_tail_loss(spark):
    text = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(text,)], "t string")
    got = CH.overlap_chunks(df, "t", "c", 6, 5).first()["c"]
    w = text.split()
    assert got == [" ".join(w[5 * i:5 * i + 15]) for i in range(6)]
    assert "w40" not in " ".join(got)


def test_overlap_sentence_branch_drops_leftovers(spark):
    text = " ".join(f"Sentence number {i}." for i in range(11))
    df = spark.createDataFrame([(text,)], "t string")
    got = CH.overlap_chunks(df, "t", "c", 6, 5).first()["c"]
    assert got[-1].endswith("Sentence number 5.")
    assert "number 10." not in " ".join(got)


def test_random_texts_match_model(spark):
    rnd = random.Random(7)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    texts = []
    for _ in range(60):
        n = rnd.randint(0, 30)
        parts = []
        for _ in range(n):
            parts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 9))) + rnd.choice([".", "!", "?", "..."]))
        texts.append(("\n" if rnd.random() < 0.3 else " ").join(parts))
    df = _sentences_df(spark, texts)
    even = df.select("id", "s", CH.even_chunks(F.col("s"), 6).alias("c")).collect()
    for r in even:
        assert r["c"] == even_model(list(r["s"]), 6)
    over = CH.overlap_chunks(df, "t", "c", 6, 5).collect()
    for r in over:
        assert r["c"] == overlap_model(list(r["s"]), r["t"], 6, 5)


def test_words_python_split(spark):
    df = spark.createDataFrame([("  a  b\n\tc ",), ("",), ("   ",)], "t string")
    got = [r[0] for r in df.select(words(F.col("t"))).collect()]
    assert got == [["a", "b", "c"], [], []]
