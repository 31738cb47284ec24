import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vecsight.llm import queries, warc
from vecsight.sources.files import scratch_dir

SCHEMA = "page_id long, url string, html string, id string, record_type int, payload string"


def page_rows():
    long = "x" * 99 + "é"  # 101 bytes
    out = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, long), (4, "u 4\r\nX: y", "short"), (5, "u5", "short"),
           (6, "u6", None), (7, "u7", ""), (8, "u8", "y" * 99), (9, "u9", "y" * 99), (10, "u10", "z" * 100), (0, "u0", "z" * 100),
           (11, "u11", "\x1f\x8b\x08 in the text " * 50), (2, "http://a/2", long)]
    rnd = random.Random(1)
    out.append((12, "u12", "".join(chr(rnd.randrange(32, 50000)) for _ in range(300_000))))
    return [(*r, "clash", 7, "clash") for r in out]


def test_query_equals_sql_on_edge_cases(spark, tables):
    folder, con = tables(pages=spark.createDataFrame(page_rows(), SCHEMA))
    got = sorted(map(tuple, queries.op1_warc(spark, folder).collect()), key=str)
    want = sorted(con.sql(queries.OP1_SQL).fetchall(), key=str)
    assert got == want
    assert {(r[0], r[3], r[4]) for r in got} >= {(1, "response", None), (2, "revisit", 1), (5, "response", None), (9, "response", None),
                                                 (10, "revisit", 0), (0, "response", None)}


def test_headers_of_any_length(spark, tables):
    rnd = random.Random(2)
    url = "".join(chr(rnd.randrange(33, 127)) for _ in range(2 << 20))
    folder, con = tables(pages=spark.createDataFrame([(1, url, "text"), (2, "u", "more")], "page_id long, url string, html string"))
    assert sorted(map(tuple, queries.op1_warc(spark, folder).collect())) == sorted(con.sql(queries.OP1_SQL).fetchall())


def test_empty_table(spark, tables):
    folder, _ = tables(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert queries.op1_warc(spark, folder).collect() == []


def test_archives_are_gzip_members_and_any_split_size_reads_them_once(spark):
    df = spark.createDataFrame(page_rows(), SCHEMA).select(
        F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    path = scratch_dir(spark, "warc-test")
    warc.write(warc.mark_revisits(df, "id", "payload"), path)
    wanted = sorted(r.id for r in df.collect())
    for split in (997, 50_000, 1 << 24):
        back = warc.read(spark, path, split).select("id", "digest", "record_type", F.sha2("payload", 256).alias("own")).collect()
        assert sorted(r.id for r in back) == wanted
        assert all(r.digest == r.own for r in back if r.record_type == "response")
    plain = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(path).collect() if r.length)
    assert plain.count(b"WARC/1.1\r\n") == len(wanted)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a" * 200), (5, "a" * 200), (None, "b" * 200)], "id long, p string")
    got = {(r.id, r.record_type, r.refers_to) for r in
           warc.mark_revisits(df.select("id", F.encode("p", "UTF-8").alias("p")), "id", "p").collect()}
    assert got == {(None, "revisit", 5), (5, "response", None), (None, "response", None)}


@pytest.mark.parametrize("noise", [b"", b"\x1f\x8b\x08\x00junk", warc.MAGIC, warc.MAGIC * 3 + b"\x00" * 40])
def test_scan_skips_false_magic(noise):
    record = warc._member("response", 1, "u", "d", None, 3, b"abc")
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = other.compress(b"no record") + other.flush()
    data = noise + record + plain + noise + record
    found = [r for lo in range(0, len(data), 17) for r in warc.scan(io.BytesIO(data), lo, min(lo + 17, len(data)))]
    assert [(r[1], r[-1]) for r in found] == [(1, b"abc")] * 2


def test_member_whose_length_has_a_high_byte(spark):
    big = spark.range(1).select(F.col("id"), F.lit("u").alias("uri"), F.encode(F.expr("repeat('0123456789abcdef', 1100000)"), "UTF-8").alias("payload"))
    path = scratch_dir(spark, "warc-big")
    warc.write(warc.mark_revisits(big, "id", "payload"), path)
    assert [r.n for r in warc.read(spark, path).select(F.length("payload").alias("n")).collect()] == [17_600_000]
