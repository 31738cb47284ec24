import hashlib
import subprocess
import sys
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from test_shingles import brute as components_of
from test_suffixes import brute as removals_of

import corpus_pipeline
from vecsight.llm import bpe, queries, toxicity
from vecsight.sources.files import scratch_dir

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def all_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "byte_bpe"]
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_toxicity_rejects_and_keeps(spark, stages):
    labels, names = toxicity.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    judged = toxicity.predict(stages[0], toxicity.fit(stages[0], labels, names))
    assert all_rows(stages[1]) == all_rows(judged.where("NOT toxic").select(*COLUMNS))
    assert 0 < judged.where("toxic").count() < judged.count() / 3


def test_one_of_each_group_stays(stages):
    before = all_rows(stages[1])
    wanted = {i for i, _, c in components_of([(r[0], r[1]) for r in before], 5, 80, 100) if i == c}
    assert all_rows(stages[2]) == [r for r in before if r[0] in wanted]


def test_repeated_strings_go(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    removals = {r[0]: r for r in removals_of([(i, r.text) for i, r in before.items()], 400)}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        _, n, gone, _, digest = removals[r.doc_id]
        if not gone:
            assert r.text == before[r.doc_id].text
        left = r.text.encode()
        assert n - gone - 8 <= len(left) <= n - gone and r.n_chars == len(r.text)
        if len(left) == n - gone:
            assert hashlib.sha256(left).hexdigest() == digest


def test_mixing_equals_sql(stages, tmp_path):
    stages[3].write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = Counter(r[0] for r in con.sql(queries.OP6_SQL).project("doc_id").fetchall())
    assert Counter(r.doc_id for r in stages[4].select("doc_id").collect()) == want
    known = {r.doc_id: r for r in stages[3].collect()}
    assert all(r == known[r.doc_id] for r in stages[4].collect())


def test_encoding_equals_library(stages):
    ranks = bpe.PrefixBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = Counter((r.doc_id, r.text) for r in stages[4].collect())
    want = Counter((i, tuple(theirs.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.elements())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in stages[5].collect()) == want


def test_run_is_the_stages(spark, stages):
    assert all_rows(corpus_pipeline.run(spark, SF)) == all_rows(stages[-1])


def test_stages_take_nulls_and_repeats(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of text here", "en", "a", 23),
            (None, "some words of text here", "en", "a", 23), (3, "x " * 100_000, "en", "b", 200_000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_dir(spark, name)
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        got = Counter(r.doc_id for r in docs.collect())
        assert got == (Counter({1: 2, 2: 1, None: 1, 3: 1}) if data else Counter())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('vecsight.llm', 'corpus_pipeline')):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'precision_at_n' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
            "assert set(e.oracle_sql()) <= set(e.queries())\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/root/repo")
