"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecsight.llm import ann, bpe, forest, importance, maintext, mixing, packing, phrases, runs, shingles, suffixes, toxicity, warc
from vecsight.llm.common import table
from vecsight.sources.files import scratch_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back by byte ranges, digest the payloads."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    path = scratch_dir(spark, "warc")
    warc.write(warc.mark_revisits(pages, "id", "payload"), path)
    back = F.col("record_type") == "response"
    return warc.read(spark, path).select(
        F.col("id").alias("page_id"),
        F.when(back, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(back, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    return maintext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 4-word shingles and its component at 85 of 100."""
    return shingles.near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.9, its component and whether it is kept."""
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log importance weight, its Gumbel key and whether it is kept."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every take of every document: source, epoch, block and the block's place in the permutation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "epoch", "block", "place")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s, coalesce(doc_id::VARCHAR, '-') AS k,
         ('0x' || substr(md5('0|doc|' || coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT % 65536 AS part,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t
  FROM documents),
totals AS (SELECT s, sum(t)::BIGINT AS total FROM d GROUP BY s),
shares AS (SELECT s, total, total::DOUBLE / sum(total) OVER () AS p FROM totals WHERE total > 0),
grid AS (SELECT k, sum(pow(p, k / 1e6)) AS z, sum(pow(p, k / 1e6) * (k / 1e6) * ln(p)) AS e, max(pow(p, k / 1e6 - 1)) AS r
         FROM shares, (SELECT unnest(range(1000001)) AS k) GROUP BY k),
by_entropy AS (SELECT coalesce(max(k), 0) AS k FROM grid
               WHERE ln(z) - e / z >= 0.98 * ln((SELECT count(*) FROM shares)) - 1e-9),
chosen AS (SELECT CASE WHEN (SELECT r / z FROM grid WHERE k = (SELECT k FROM by_entropy)) <= 4 THEN (SELECT k FROM by_entropy)
                  ELSE (SELECT min(k) FROM grid WHERE r / z <= 4) END AS k),
budgets AS (SELECT s, total, floor(pow(p, c.k / 1e6) / g.z * (SELECT sum(total) FROM shares) + 0.5)::BIGINT AS budget
            FROM shares, chosen c JOIN grid g USING (k)),
own AS (SELECT t.s, coalesce(least(65536, ceil(total / 250000.0)), 1)::BIGINT AS blocks,
               coalesce(budget // total, 0) AS epochs, coalesce(budget % total, 0) AS rest
        FROM (SELECT s FROM totals) t LEFT JOIN budgets USING (s)),
placed AS (SELECT d.*, o.epochs, o.rest, d.part % o.blocks AS block FROM d JOIN own o USING (s)),
blocks AS (SELECT s, block, epochs, rest, sum(t) AS bt,
                  ('0x' || substr(md5('0|' || s || '|' || block || '|' || epochs), 1, 15))::BIGINT AS place
           FROM placed GROUP BY s, block, epochs, rest),
summed AS (SELECT *, sum(bt) OVER (PARTITION BY s ORDER BY place, block) AS upto FROM blocks),
takes AS (SELECT p.doc_id, p.source, p.s, p.block, unnest(range(p.epochs + (b.upto <= b.rest)::INT)) AS epoch
          FROM placed p JOIN summed b USING (s, block)),
edge AS (SELECT p.*, b.rest - b.upto + b.bt AS left_over,
                sum(p.t) OVER (PARTITION BY p.s, p.block ORDER BY
                  ('0x' || substr(md5('0|' || p.epochs || '|' || p.k), 1, 15))::BIGINT, p.doc_id) AS upto_doc
         FROM placed p JOIN summed b USING (s, block) WHERE b.upto > b.rest AND b.upto - b.bt < b.rest),
taken AS (SELECT doc_id, source, s, block, epoch FROM takes
          UNION ALL SELECT doc_id, source, s, block, epochs FROM edge WHERE upto_doc <= left_over)
SELECT doc_id, source, epoch::INTEGER AS epoch, block,
       ('0x' || substr(md5('0|' || s || '|' || block || '|' || epoch), 1, 15))::BIGINT AS place
FROM taken
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and whether it is rejected as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels, categories = toxicity.labelled(table(spark, sf_dir, "labels"))
    chain = toxicity.fit(docs, labels, categories)
    return toxicity.predict(docs, chain).drop("text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else."""
    return suffixes.removal_digests(table(spark, sf_dir, "documents"), length=400)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the round trip through the decoder."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                              public_tokenizers.PATTERN)


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by Euclidean distance, of every row whose vec_id is divisible by 100."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces of at most 1,024 with their place in as few sequences as it needs."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.PATTERN, end_id=2, capacity=1024)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and digests of them and of the text without them.

    Of a document whose id has a CRC-32 divisible by 10, the words from number a on are first
    replaced by repetitions of the p words from a.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.where(drawn % 10 == 0).select("doc_id", F.expr(r"regexp_extract_all(coalesce(text, ''), '([^\\x20\\x09-\\x0D]+)', 1)").alias("w"))
    words = words.select("doc_id", "w", F.size("w").alias("n"), F.floor(drawn / 10).alias("g"))
    words = words.withColumn("a", F.expr("cast(g % greatest(n, 1) as int)"))
    words = words.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    repeated = words.select("doc_id", F.array_join(again, " ").alias("text"))
    rest = docs.where(F.coalesce(drawn % 10 != 0, F.lit(True)))
    return runs.digests(runs.collapse_runs(rest.unionByName(repeated)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language by the score of their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, share=50, top=2000)


QUERIES = {"op1_warc": op1_warc, "op2_main_text": op2_main_text, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_embedding_dedup": op4_embedding_dedup,
           "op5_importance": op5_importance, "op6_mixing": op6_mixing,
           "op7_toxicity": op7_toxicity, "op8_suffix_dedup": op8_suffix_dedup, "op9_byte_bpe": op9_byte_bpe, "op10_learned_partitions": op10_learned_partitions,
           "op11_best_two_fit": op11_best_two_fit, "op12_periodic_runs": op12_periodic_runs, "op13_collocations": op13_collocations}
SQL = {"op1_warc": OP1_SQL, "op6_mixing": OP6_SQL}
