"""Note chunking as array expressions (I17, I18, E8); one narrow stage, no shuffle.

even chunks (m parts): with n sentences and n >= m, part i holds
  sentences[i*q + min(i, r) : +q + (1 if i < r)]   (q = n div m, r = n mod m);
with n < m: the n sentences, then the whole text (sentences joined) repeated.

overlap chunks (m parts, o words), S = sentences, W = whitespace words:
  |S| <= m: c = |W| div m, part i = W[max(0, i*c - i*o) : min(start + c + o, |W|)]
  else:     c = |S| div m, text_i = S[i*c : i*c + c + (1 if i < m-1)] (capped), and for
            i > 0 the last o words of part i-1 are put in front with one space.
  Part i-1 already carries its own prefix, so its last o words are the last o words
  of words(text_0) ++ ... ++ words(text_{i-1}); this removes the sequential fold.
  Leftover |S| mod m sentences are not covered (as in the original); ``keep_tail``
  extends the last part to the end instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecsight.functions.text import sentences, words


def _join(arr: Column) -> Column:
    return F.array_join(arr, " ")


def even_chunks(sents: Column, m: int = 6) -> Column:
    n = F.size(sents)
    q = F.floor(n / F.lit(m)).cast("int")
    r = (n % F.lit(m)).cast("int")
    parts = []
    for i in range(m):
        start = q * F.lit(i) + F.least(F.lit(i), r)
        size = q + F.when(F.lit(i) < r, 1).otherwise(0)
        even = _join(F.slice(sents, start + 1, size))
        short = F.when(F.lit(i) < n, F.element_at(sents, i + 1)).otherwise(_join(sents))
        parts.append(F.when(n >= m, even).otherwise(short))
    return F.array(*parts)


def _last(arr: Column, o: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(o - 1), F.lit(1)), o)


def overlap_chunks(df: DataFrame, text_col: str, out_col: str = "chunks", m: int = 6, o: int = 5,
                   keep_tail: bool = False) -> DataFrame:
    """Adds ``out_col`` (array of m strings).

    Staged projections; the sentence split runs once per row.  The whole text is split
    into words only for short notes (the word branch).  The prefix of part i is the last
    o words of parts 0..i-1; every sentence holds at least one word, so the last o words
    of a part lie in its last o sentences and only those are split.
    """
    keep = [c for c in df.columns]
    x = df.select(*keep, sentences(F.col(text_col)).alias("_S"))
    S = F.col("_S")
    nS = F.size(S)
    short = nS <= m
    y = x.select(*keep, "_S", short.alias("_short"),
                 F.when(short, words(F.col(text_col))).alias("_W"))
    W = F.col("_W")
    nW = F.size(W)
    c = F.floor(nW / F.lit(m)).cast("int")
    word_parts = []
    for i in range(m):
        start = F.greatest(c * F.lit(i) - F.lit(i * o), F.lit(0))
        end = F.least(start + c + F.lit(o), nW)
        word_parts.append(_join(F.slice(W, start + 1, F.greatest(end - start, F.lit(0)))))
    cs = F.floor(nS / F.lit(m)).cast("int")
    texts, tails = [], []
    for i in range(m):
        start = cs * F.lit(i)
        if i < m - 1:
            end = F.least(start + cs + F.lit(1), nS)
        else:
            end = nS if keep_tail else start + cs
        length = F.greatest(end - start, F.lit(0))
        texts.append(_join(F.slice(S, start + 1, length)).alias(f"_t{i}"))
        if i < m - 1:
            last_sents = F.slice(S, F.greatest(end - F.lit(o - 1), start + 1), F.least(length, F.lit(o)))
            tail_words = F.flatten(F.transform(last_sents, lambda s: F.split(s, r"\s+")))
            tails.append(_last(tail_words, o).alias(f"_tw{i}"))
    z = y.select(*keep, "_short", F.when(F.col("_short"), F.array(*word_parts)).alias("_wp"),
                 *texts, *tails)
    sent_parts = [F.col("_t0")]
    for i in range(1, m):
        prev = F.flatten(F.array(*[F.col(f"_tw{j}") for j in range(i)]))
        sent_parts.append(F.concat(_join(_last(prev, o)), F.lit(" "), F.col(f"_t{i}")))
    return z.select(*keep, F.when(F.col("_short"), F.col("_wp")).otherwise(F.array(*sent_parts))
                    .alias(out_col))


def chunk_columns(chunks: Column, m: int, prefix: str = "chunk_") -> list[Column]:
    """Numbered columns, '' where the list is shorter."""
    return [F.coalesce(F.try_element_at(chunks, F.lit(i + 1)), F.lit("")).alias(f"{prefix}{i + 1}")
            for i in range(m)]
