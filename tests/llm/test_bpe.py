import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from vecsight.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mine():
    return bpe.PrefixBPE(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(mine):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


def test_random_texts(mine, theirs):
    rnd = random.Random(7)
    kinds = ["aabbccde ", "the of and ing tion ", "éßñçöü ", "日本語テキスト", "🙂👍🏽‍", " \t\n\r ", "0123456789", "!?.,;:#$%&", "абвгд ", "\x00\x7f́"]
    for _ in range(3000):
        text = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 80)))
        assert mine.encode(text) == theirs.encode_ordinary(text), repr(text)
        assert mine.decode(mine.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 2000, " " * 3000, "!" * 2000, "\n" * 500 + "x", "the" * 1500, "é" * 1000, ""])
def test_long_pieces(mine, theirs, text):
    assert mine.encode(text) == theirs.encode_ordinary(text)


def test_appends_and_edits_keep_the_prefix_table(mine):
    rnd = random.Random(3)
    for _ in range(200):
        piece = bytes(rnd.choice(b"thenadiotrs") for _ in range(rnd.randint(1, 40)))
        table: list[int] = []
        for end in range(1, len(piece) + 1):  # byte by byte
            before = list(table)
            mine.extend(piece[:end], table)
            assert table[:end - 1] == before and mine.read(table) == mine.read(mine.extend(piece[:end], []))
        for end in range(len(piece) + 1):  # any prefix can be read off
            assert mine.read(table, end) == mine.read(mine.extend(piece[:end], []))
        lo = rnd.randint(0, len(piece))
        hi = rnd.randint(lo, len(piece))
        new, edited = mine.edit(piece, table, lo, hi, b"ing")
        assert new == piece[:lo] + b"ing" + piece[hi:] and edited == mine.extend(new, [])


def want(text, theirs):
    ids = theirs.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_library(spark, theirs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, SF).collect()}
    assert got == {d.doc_id: want(d.text, theirs) for d in docs}


def test_edges(spark, theirs):
    texts = [None, "", "x " * 300_000, "same", "same", "﻿​", "a" * 50_000]
    docs = spark.createDataFrame([(i // 2, t, [1], "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, PATH, P.PATTERN).collect())
    assert got == sorted((i // 2, *want(t, theirs)) for i, t in enumerate(texts))
    coded = bpe.encode_column(docs, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    back = bpe.decode_column(coded, PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.ids == theirs.encode_ordinary(r.text or "") for r in back)
    assert bpe.encode_digests(docs.limit(0), PATH, P.PATTERN).collect() == []
    nulls = bpe.decode_column(spark.createDataFrame([(None,)], "ids array<int>"), PATH, P.PATTERN).first()
    assert bytes(nulls.decoded) == b""
