"""Query keys for notes: combine, sentence statistics, even and overlap chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecsight.constants import NUM_CHUNKS, OVERLAP_WORDS
from vecsight.functions import chunks as CH
from vecsight.functions.text import sentences, strip
from vecsight.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
M, O = NUM_CHUNKS, OVERLAP_WORDS


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def notes(spark, sf):
    """(study, findings, impression) from documents: the text cut in the middle, impression first;
    if one section is missing (every 7th, every other 5th id) the other holds the whole text, so every
    text is read; both are missing for a null text only."""
    d = table(spark, sf, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    no_findings, no_impression = F.col("doc_id") % 7 == 0, (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 7 != 0)
    return d.select(F.col("doc_id").alias("study"),
                    F.when(no_findings, F.lit(None)).when(no_impression, F.col("text"))
                    .otherwise(F.substring("text", half + 1, F.length("text"))).alias("findings"),
                    F.when(no_impression, F.lit(None)).when(no_findings, F.col("text"))
                    .otherwise(F.substring("text", F.lit(1), half)).alias("impression"))


_NOTES_SQL = """SELECT doc_id AS study,
       CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text
            ELSE substring(text, CAST(length(text) // 2 AS INTEGER) + 1) END AS findings,
       CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN NULL WHEN doc_id % 7 = 0 THEN text
            ELSE substring(text, 1, CAST(length(text) // 2 AS INTEGER)) END AS impression FROM documents"""


def combined(spark, sf):
    """I14 + I15 + B14: findings, blank line, impression; stripped; empty notes dropped."""
    n = notes(spark, sf)
    c = strip(F.concat(F.coalesce("findings", F.lit("")), F.lit("\n\n"), F.coalesce("impression", F.lit(""))))
    return n.select("study", c.alias("combined")).where(F.col("combined") != "")


def full_note(spark, sf, null_text: str = "nan"):
    """Impression, blank line, findings; a missing section prints as ``null_text``."""
    n = notes(spark, sf)
    return n.select("study", F.concat(F.coalesce("impression", F.lit(null_text)), F.lit("\n\n"),
                                      F.coalesce("findings", F.lit(null_text))).alias("full_note"))


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_COMBINED_SQL = f"""SELECT study, {_STRIP.format(x="coalesce(findings, '') || chr(10) || chr(10) || coalesce(impression, '')")}
  AS combined FROM notes"""
_FULL_SQL = "SELECT study, coalesce(impression, 'nan') || chr(10) || chr(10) || coalesce(findings, 'nan') AS full_note FROM notes"


def sql_sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), "
            f"lambda s: {_STRIP.format(x='s')}), lambda s: s <> '')")


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


@query("notes_combine")
def notes_combine(spark, sf):
    return combined(spark, sf)


SQL["notes_combine"] = f"""WITH notes AS ({_NOTES_SQL})
SELECT study, combined FROM ({_COMBINED_SQL}) WHERE combined <> ''"""


@query("sentence_stats")
def sentence_stats(spark, sf):
    """I16 + D14: sentence count per note: mean, population std, max, min."""
    n = full_note(spark, sf).select(F.size(sentences("full_note")).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("avg_sentences"),
                 F.round(F.stddev_pop("n"), 6).alias("std_sentences"),
                 F.max("n").alias("max_sentences"), F.min("n").alias("min_sentences"))


SQL["sentence_stats"] = f"""WITH notes AS ({_NOTES_SQL}), fn AS ({_FULL_SQL}),
c AS (SELECT CAST(len({sql_sentences('full_note')}) AS INTEGER) AS n FROM fn)
SELECT round(avg(n), 6) AS avg_sentences, round(stddev_pop(n), 6) AS std_sentences,
       max(n) AS max_sentences, min(n) AS min_sentences FROM c"""


@query("chunk_even")
def chunk_even(spark, sf):
    c = combined(spark, sf)
    ch = c.select("study", "combined", CH.even_chunks(sentences("combined"), M).alias("_c"))
    return ch.select("study", "combined", *CH.chunk_columns(F.col("_c"), M))


def _sql_even(i: int) -> str:
    even = (f"array_to_string(list_slice(s, q * {i} + least({i}, r) + 1, "
            f"q * {i} + least({i}, r) + q + (CASE WHEN {i} < r THEN 1 ELSE 0 END)), ' ')")
    short = f"CASE WHEN {i} < n THEN s[{i + 1}] ELSE array_to_string(s, ' ') END"
    return f"CASE WHEN n >= {M} THEN {even} ELSE {short} END AS chunk_{i + 1}"


SQL["chunk_even"] = f"""WITH notes AS ({_NOTES_SQL}),
c AS (SELECT * FROM ({_COMBINED_SQL}) WHERE combined <> ''),
s AS (SELECT study, combined, s, len(s) AS n, len(s) // {M} AS q, len(s) % {M} AS r
      FROM (SELECT study, combined, {sql_sentences('combined')} AS s FROM c))
SELECT study, combined, {', '.join(_sql_even(i) for i in range(M))} FROM s"""


@query("chunk_overlap")
def chunk_overlap(spark, sf):
    f = full_note(spark, sf)
    ch = CH.overlap_chunks(f, "full_note", "_c", M, O)
    return ch.select("study", "full_note", *CH.chunk_columns(F.col("_c"), M, prefix="chunk"))


def _sql_overlap() -> str:
    word_parts, texts = [], []
    for i in range(M):
        st = f"greatest(c * {i} - {i * O}, 0)"
        en = f"least({st} + c + {O}, nW)"
        word_parts.append(f"array_to_string(list_slice(W, {st} + 1, {en}), ' ')")
        sst = f"cs * {i}"
        sen = f"least({sst} + cs + 1, nS)" if i < M - 1 else f"{sst} + cs"
        texts.append(f"array_to_string(list_slice(S, {sst} + 1, {sen}), ' ')")
    sent_parts = [texts[0]]
    for i in range(1, M):
        prev = "flatten([" + ", ".join(sql_words(t) for t in texts[:i]) + "])"
        last = f"list_slice({prev}, greatest(len({prev}) - {O - 1}, 1), len({prev}))"
        sent_parts.append(f"array_to_string({last}, ' ') || ' ' || {texts[i]}")
    cols = [f"CASE WHEN nS <= {M} THEN {w} ELSE {s} END AS chunk{i + 1}"
            for i, (w, s) in enumerate(zip(word_parts, sent_parts))]
    return ", ".join(cols)


SQL["chunk_overlap"] = f"""WITH notes AS ({_NOTES_SQL}), fn AS ({_FULL_SQL}),
x AS (SELECT study, full_note, {sql_sentences('full_note')} AS S,
             {sql_words(_STRIP.format(x='full_note'))} AS W FROM fn),
y AS (SELECT *, len(S) AS nS, len(W) AS nW, len(W) // {M} AS c, len(S) // {M} AS cs FROM x)
SELECT study, full_note, {_sql_overlap()} FROM y"""
