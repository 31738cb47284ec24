import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vecsight.llm import phrases, queries

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, share=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], a)
        ranked = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    got = queries.op13_collocations(spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


@pytest.mark.parametrize("shard", [60, 1 << 21])
def test_edges_and_shards(spark, shard):
    rnd = random.Random(2)
    words = ["a", "B", "b\x01", "É", "é", "日本", "c-d", "the", "of", "x" * 300, "w1", "w2", "w3"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0c"]
    rows = [("".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 3, 50]))), rnd.choice(["en", "en", "de", None, "", "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (None, None), (" \t.,", "xx"), ("the of " * 20_000, "en"), ("the of", "fr")] + [("a a a a", "es")] * 9
    df = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, word int, n int").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5, top=40, shard=shard).collect())
    assert got == brute(rows, least=5, top=40)
    assert phrases.collocations(spark.createDataFrame([], df.schema)).count() == 0


def test_trie_counts_all_sequences():
    rng = np.random.default_rng(4)
    keys = rng.integers(1, 1 << 63, 3000).astype(np.uint64)
    text = keys[np.minimum(rng.zipf(1.3, 60_000), 3000) - 1]
    linked = rng.random(len(text)) < 0.8
    linked[-1] = False
    want = Counter()
    for i in range(len(text) - 1):
        if linked[i]:
            want[int(text[i]), int(text[i + 1]), 0] += 1
            if i + 2 < len(text) and linked[i + 1]:
                want[int(text[i]), int(text[i + 1]), int(text[i + 2])] += 1
    asked = [p for k, p in enumerate(want) if k % 3] + [(int(keys[5]), 99, 0), (99, 98, 97)]
    rows = np.array(asked, np.uint64)
    trie = phrases.Trie.build([rows[:, 0], rows[:, 1], rows[:, 2]])
    assert sorted(trie.answer[trie.answer >= 0].tolist()) == list(range(len(rows)))
    assert len(trie.base) < 4 * len(rows) + 10_000
    got = np.bincount(np.concatenate(list(trie.accepted(text, linked, 3))), minlength=len(rows))
    assert got.tolist() == [want[p] for p in asked]


@pytest.mark.parametrize("most_known", [7, 1 << 22])
def test_sequences_are_listed_by_few_tasks(spark, monkeypatch, most_known):
    """Listing takes some rows a sequence, not one for every task that holds it; what a round doesn't know is listed again, not lost."""
    from pyspark.sql import DataFrame

    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice("abcdefghijkl") for _ in range(100)), rnd.choice(["en", None])) for _ in range(640)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(16)
    listed, made, cut, own = [], [], phrases.cut, phrases.candidates

    def counting(table, tag):
        plan = table._jdf.queryExecution().analyzed()
        if tag in ("listed", "candidates") and "mapinarrow" in plan.toString().lower():
            rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().head())
            listed.append(DataFrame(rows, spark).count())
        return cut(table, tag)

    monkeypatch.setattr(phrases, "cut", counting)
    monkeypatch.setattr(phrases, "candidates", lambda *a: made.append(own(*a, most_known)) or made[0])
    got = sorted(tuple(r) for r in phrases.collocations(df, least=10, top=2000).collect())
    assert got == brute(rows)
    assert made[0].count() == made[0].distinct().count()
    if most_known > 7:
        assert 0 < sum(listed) < 4 * made[0].count()


@pytest.mark.parametrize("held", [50, 1 << 21])
def test_dealt_positions_against_brute_force(spark, monkeypatch, held):
    """Texts of many words are gone over three times, whatever the number of candidates."""
    monkeypatch.setattr(phrases, "DEALT", 100)
    monkeypatch.setattr(phrases, "DEALT_WORDS", 3000)
    monkeypatch.setattr(phrases, "DEALT_HELD", held)
    monkeypatch.setattr(phrases, "trie_counts", None)  # a pass a shard
    rnd = random.Random(8)
    words = ["a", "B", "b\x01", "É", "é", "日本", "c-d", "the", "of", "x" * 300, *(f"w{k}" for k in range(60))]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0c"]
    rows = [("".join(rnd.choice(words[:rnd.choice([4, 70])]) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 3, 90]))), rnd.choice(["en", "en", "de", None, "", "und"]))
            for _ in range(300)]
    rows += [(None, "en"), ("", "en"), (None, None), (" \t.,", "xx"), ("the of " * 5_000, "en"), ("the of", "fr")] + [("a a a a", "es")] * 9
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least in (5, 20):  # below and above what a bucket tells apart
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=60).collect())
        assert got == brute(rows, least=least, top=60)


@pytest.mark.parametrize("longest", [2, 4])
def test_dealt_counts_of_other_lengths(spark, monkeypatch, longest):
    monkeypatch.setattr(phrases, "DEALT_WORDS", 500)
    rnd = random.Random(9)
    df = spark.createDataFrame([(" ".join(rnd.choice("abcd") for _ in range(40)), "en") for _ in range(100)], "text string, lang string").repartition(3)
    want = sorted((tuple(r) for r in phrases.phrase_counts(df, longest=longest)[1].collect()), key=str)
    monkeypatch.setattr(phrases, "DEALT", 0)
    assert sorted((tuple(r) for r in phrases.phrase_counts(df, longest=longest)[1].collect()), key=str) == want
