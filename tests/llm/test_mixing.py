import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vecsight.llm import mixing, queries


def docs(spark, sizes, seed=0, words=(1, 60)):
    rnd = random.Random(seed)
    rows = [(f"s{s}" if s else None, " ".join(["w"] * rnd.randint(*words))) for s, n in enumerate(sizes) for _ in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame([(i, s, t, "e", 5, 9) for i, (s, t) in enumerate(rows)],
                                 "doc_id long, source string, text string, epoch string, s int, blocks int")


@pytest.mark.parametrize("sizes", [(30, 900, 100, 5), (1, 400, 400, 400, 3000), (0, 50), (200, 1, 1, 1, 1, 1, 1, 1)])
def test_query_equals_sql(spark, tables, sizes):
    folder, con = tables(documents=docs(spark, sizes).drop("epoch", "s", "blocks"))
    got = sorted((r.doc_id, r.source, r.epoch, r.block, r.place) for r in queries.op6_mixing(spark, folder).collect())
    want = con.sql(queries.OP6_SQL).project("doc_id, source, epoch, block, place").fetchall()
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in sorted(want, key=lambda r: (r[0], str(r[1]), r[2], r[3], r[4]))]


def test_weights_budgets_and_repeats(spark):
    df = docs(spark, (40, 3000, 300, 30), seed=3)
    tokens = {r.doc_id: (r.source, len(r.text.split())) for r in df.collect()}
    total = Counter()
    for s, n in tokens.values():
        total[s] += n
    for entropy, limit in ((0.8, 50.0), (0.98, 50.0), (0.98, 2.0), (0.0, 2.0)):
        out = mixing.mix(df, target_entropy=entropy, repetition_limit=limit, block_tokens=500).collect()
        takes = defaultdict(list)
        for r in out:
            takes[r.doc_id].append(r.epoch)
        assert all(sorted(e) == list(range(len(e))) for e in takes.values())  # each epoch takes a document once
        got = Counter()
        for d, e in takes.items():
            got[tokens[d][0]] += len(e) * tokens[d][1]
        everything = sum(total.values())
        # weights by plain bisection over the exponent
        def weights(a):
            p = {s: (n / everything) ** a for s, n in total.items()}
            return {s: x / sum(p.values()) for s, x in p.items()}
        def h(a):
            return -sum(w * math.log(w) for w in weights(a).values())
        def repeats(a):
            return max(weights(a)[s] * everything / total[s] for s in total)
        lo, hi = 0.0, 1.0
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if h((lo + hi) / 2) >= entropy * math.log(len(total)) else (lo, (lo + hi) / 2)
        a = 1.0 if h(1.0) >= entropy * math.log(len(total)) else lo
        if repeats(a) > limit:
            lo, hi = a, 1.0
            for _ in range(60):
                lo, hi = ((lo + hi) / 2, hi) if repeats((lo + hi) / 2) > limit else (lo, (lo + hi) / 2)
            a = hi
        for s, w in weights(a).items():
            assert w * everything - 61 <= got[s] <= w * everything + 1 + 1e-4 * everything
            assert max(len(e) for d, e in takes.items() if tokens[d][0] == s) <= math.ceil(limit) + 1


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, "a", None), (2, None, ""), (None, "b", " "), (3, "", None)], schema)
    assert sorted(map(str, (r[:3] for r in map(tuple, mixing.mix(same).collect())))) == sorted(map(str, map(tuple, same.collect())))
    twins = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, "b", "long " * 100_000)], schema)
    counts = Counter((r.doc_id, r.epoch) for r in mixing.mix(twins).collect())
    assert all(n == 2 for (d, _), n in counts.items() if d == 1)
    kept = mixing.mix(docs(spark, (3, 4)))
    assert kept.columns == ["doc_id", "source", "text", "s", "blocks", "epoch", "block", "place"]
    assert {(r.s, r.blocks) for r in kept.collect()} == {(5, 9)}
    with pytest.raises(ValueError):
        mixing.mix(same, budget_ratio=5.0)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(docs(spark, (5, 20)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_block_order_is_a_permutation_per_epoch(spark):
    out = mixing.mix(docs(spark, (0, 400, 20)), repetition_limit=60.0, block_tokens=50).where("source = 's2'")
    per = out.select("epoch", "block", "place").distinct().groupBy("epoch").agg(F.sort_array(F.collect_list(F.struct("place", "block"))).alias("o")).collect()
    orders = [tuple(x.block for x in r.o) for r in sorted(per, key=lambda r: r.epoch)][:-1]
    assert len(orders) > 1 and len({tuple(sorted(o)) for o in orders}) == 1 and len(set(orders)) > 1
