import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsight.llm import queries, shingles
from vecsight.llm.components import components

SF = "/root/testdata/sf0.001"


def sets_of(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1)) if len(words) >= width
                   else frozenset([tuple(words)] if words else []))
    return out


def brute(rows, width, num, den):
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets = sets_of([t for _, t in rows], width)
    kinds = list(dict.fromkeys(sets))
    at, holders, above = {s: k for k, s in enumerate(kinds)}, defaultdict(list), list(range(len(kinds)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for k, s in enumerate(kinds):
        for j, common in Counter(j for x in s for j in holders[x]).items():
            if den * common >= num * (len(s) + len(kinds[j]) - common):
                a, b = root(k), root(j)
                above[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(k)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = root(at[s])
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(root(at[s])) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def check(spark, rows, width, num, den, block=512):
    df = spark.createDataFrame([(i, t, 1, "c", "k") for i, t in rows], "doc_id long, text string, c int, keys string, cls string")
    got = sorted((tuple(r) for r in shingles.near_duplicates(df, width, num, den, block).collect()), key=str)
    assert got == brute(rows, width, num, den)


def corpus(seed, n, vocabulary, copies):
    """Texts with near copies of all degrees, a shared passage and a hot group."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = " ".join(rnd.choice(words) for _ in range(12))
    out = []
    for _ in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 5, 8, 20, 60, 150]))]
        if rnd.random() < 0.3:
            text = passage.split() + text
        out.append(text)
        for _ in range(rnd.choice([0, 0, 1, copies])):
            twin = list(text)
            for _ in range(rnd.randint(0, max(1, len(twin) // 12))):
                twin[rnd.randrange(len(twin))] = rnd.choice(words)
            out.append(twin)
    hot = [rnd.choice(words) for _ in range(40)]
    for _ in range(len(out) // 2):
        twin = list(hot)
        if rnd.random() < 0.5:
            twin[rnd.randrange(40)] = rnd.choice(words)
        out.append(twin)
    rnd.shuffle(out)
    return [(i, rnd.choice([" ", "  ", "\t\n"]).join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("width", "num", "block"), [(4, 85, 512), (5, 80, 8)])
def test_against_brute_force(spark, width, num, block):
    check(spark, corpus(width, 120, 30, 6), width, num, 100, block)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op3_ngram_jaccard(spark, SF).collect()), key=str)
    assert got == brute([tuple(d) for d in docs], 4, 85, 100)


def test_edges(spark):
    long = " ".join(f"v{k % 5000}x{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " more"), (9, "É é É é É"),
            (10, "é é é é é"), (11, "a b c d"), (11, "a b c d"), (11, "other words are here"), (None, "a b c d"), (None, "x y z q"), (None, None)]
    check(spark, rows, 4, 85, 100)
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert shingles.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one_keeps_the_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(5, text, "x"), (3, text + " end", "y"), (3, text + " end", "y"), (None, text, "z"), (7, None, "n"), (7, None, "n"), (9, "alone in here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string")
    got = sorted((tuple(r) for r in shingles.keep_one(df).collect()), key=str)
    assert got == sorted([rows[1], rows[4], rows[5], rows[6]], key=str)


def test_tree_bounds_hold():
    rng = np.random.default_rng(5)
    t = shingles.Threshold(80, 100)
    base = [rng.integers(1, 1 << 63, rng.integers(1, 300)).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(s) for s in base]
    sets += [np.unique(np.concatenate([s[: -max(1, len(s) // 15)], rng.integers(1, 1 << 63, 2).astype(np.uint64)])) for s in sets]
    tree = shingles.SignatureTree.over(sets)
    found = {(min(p), max(p)) for a, b in tree.pairs(t, 3) for p in zip(tree.order[a].tolist(), tree.order[b].tolist())}
    for i in range(len(sets)):
        for j in range(i):
            if t.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                assert (j, i) in found
    for s in sets:
        bits, spare = shingles.bitmap(s, 512, 8)
        assert int(np.bitwise_count(bits).sum()) + spare == len(s)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            above[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_are_known_again_in_files_and_out_of_them(spark, tmp_path):
    rows = [(k % 7, "one two three four five six seven", k, "m") for k in range(20)] + [(None, "a b", 1, "m"), (3, None, 2, "m"), (3, None, 2, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int, _metadata string").repartition(4)
    df.write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    for table in (df, read, read.select("text", "doc_id", "__row", "_metadata"), read.unionByName(read.where("doc_id < 0"))):
        got = shingles.keep_one(table)
        assert got.columns == table.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(0, rows[0][1]), (None, "a b"), (3, None), (3, None)], key=str)
    twice = read.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    assert shingles.keep_one(twice).where("text IS NOT NULL").count() == 2


def test_large_groups_are_split_by_size(spark, monkeypatch):
    """Sets that only share passages make one large candidate group; those without a possible partner are not carried whole."""
    monkeypatch.setattr(shingles, "REFINED", 8)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(400)] for _ in range(3)]
    texts = [passages[k % 3] + [word() for _ in range(700 if k % 2 else 3000)] + passages[(k + 1) % 3] for k in range(40)]
    for k, words in enumerate(texts[:6]):  # near copies, and longer ones near the least similarity
        texts.append(words[:-20] + [word() for _ in range(20)])
        texts.append(words + [word() for _ in range(len(words) * (24 if k % 2 else 26) // 100)])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    carried, cut = [], shingles.cut
    monkeypatch.setattr(shingles, "cut", lambda df, tag: [r := cut(df, tag), tag == "members" and carried.append(r.count())][0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in shingles.near_duplicates(df, 5, 80, 100).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)
    linked = Counter(c for _, _, c in got)
    assert sum(n for n in linked.values() if n > 1) <= carried[0] <= 24


@pytest.mark.parametrize(("width", "num", "block"), [(4, 85, 512), (5, 80, 8)])
def test_by_size_against_brute_force(spark, monkeypatch, width, num, block):
    monkeypatch.setattr(shingles, "REFINED", 1)
    check(spark, corpus(width + 20, 120, 30, 6), width, num, 100, block)


@pytest.mark.parametrize(("width", "num", "block"), [(4, 85, 512), (5, 80, 8)])
def test_by_key_against_brute_force(spark, monkeypatch, width, num, block):
    monkeypatch.setattr(shingles, "REFINED", 1)
    monkeypatch.setattr(shingles, "REFINED_BY_SIZE", 1)
    check(spark, corpus(width + 30, 120, 30, 6), width, num, 100, block)


def test_largest_groups_are_split_by_key(spark, monkeypatch):
    """Of a group above all bounds, sets that only share passages are not carried whole."""
    monkeypatch.setattr(shingles, "REFINED", 4)
    monkeypatch.setattr(shingles, "REFINED_BY_SIZE", 8)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(400)] for _ in range(3)]
    texts = [passages[k % 3] + [word() for _ in range(700 if k % 2 else 3000)] + passages[(k + 1) % 3] for k in range(40)]
    texts += [words[:-20] + [word() for _ in range(20)] for words in texts[:6]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    carried, cut = [], shingles.cut
    monkeypatch.setattr(shingles, "cut", lambda df, tag: [r := cut(df, tag), tag == "members" and carried.append(r.count())][0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in shingles.near_duplicates(df, 5, 80, 100).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)
    assert 12 <= carried[0] <= 20


def test_common_shingles_stand_out_of_full_counters():
    """A shingle of 1,000 rows is common also where every counter holds as many rare ones."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(1200, shingles.SKETCH)
    counts[:50] += 1000
    common = shingles._stand_out(counts)
    assert common[:50].all()
    assert common.sum() < 60
    assert not shingles._stand_out(np.zeros(shingles.SKETCH, int)).any()
    assert not shingles._stand_out(np.full(shingles.SKETCH, 255 * 40)).any()
