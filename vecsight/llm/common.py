"""Shared helpers of the text operators: scratch tables, text batches, fingerprints, vector sums.

Fingerprints are 64-bit polynomial sums modulo 2**64 over a fixed random table of byte
values, finished with an avalanche mix.  They are used for equality of shingles and byte
strings; two different strings of a corpus of n strings agree with probability about
n * n / 2**65.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsight.sources.files import scratch_dir

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, added: str) -> T.StructType:
    """The columns of ``df`` followed by those of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def set_apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``own`` renamed, so that no name of theirs meets one that an
    operator adds, and the names in their order; ``set_back`` undoes it."""
    names = [c if c in own else f"__other_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def set_back(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the session's shared folder and read it back: later stages start from
    files that every executor sees, so a lost executor costs only its running tasks."""
    path = scratch_dir(df.sparkSession, f"llm-{tag}")
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written: it does so when the driver
    collects its garbage, which else may be half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_tables: list[str] = []


def tables_made() -> int:
    """How many tables ``cut`` has written so far."""
    return len(_tables)


def forget_tables(spark: SparkSession, since: int) -> None:
    """Remove the tables that ``cut`` has written after the first ``since``.  Only for callers whose
    results that read them are all written elsewhere, as those of pipeline stages are."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_tables) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Rows go to Python tasks in batches of at most ``most`` bytes (a longer row stands alone) from now
    on in this session; a smaller limit that is set stays."""
    have = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES))
    if have > most:
        spark.conf.set(_BATCH_BYTES, str(most))


#: A table of up to so many rows of one long is sent to every task (16 MB); larger ones are joined by a shuffle.
FEW_ROWS = 2_000_000


def few(df: DataFrame) -> DataFrame:
    """``df``, a narrow table, marked to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def keyed(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with a unique long ``row_id``, written once so that every later stage sees the same ids."""
    return cut(df.withColumn("row_id", F.monotonically_increasing_id()), tag)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finish of 64-bit values (in place on a copy)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), _BASE if kind == "up" else _BASE_INVERSE, U64)
        step[0] = 1
        _powers[kind] = have = np.cumprod(step, dtype=U64)
    return have[:n]


class Fingerprints:
    """Fingerprints of substrings of one byte array: ``of(starts, ends)``, vectorised."""

    def __init__(self, data: np.ndarray, lowered: bool = False):
        terms = (_LOWERED if lowered else _VALUES)[data]
        terms *= _power("up", len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = _power("down", len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.inverse[starts]
        return mix(out)

    def every(self, length: int) -> np.ndarray:
        """The fingerprints of all substrings of one length, by start."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.inverse[:len(out)]
        return mix(out)


def set_bits(keys: DataFrame) -> np.ndarray:
    """2**26 bits, set for the values of the long column ``key``: a filter of fixed size that lets all
    of them pass (``has_bit``) and most other values not, as long as there are few of them."""
    words = keys.groupBy(F.expr("key & 1048575").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 20) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << 20, U64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(U64)
    return (bits[(k & U64((1 << 20) - 1)).astype(int)] >> ((k >> U64(20)) & U64(63))) & U64(1) == 1


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return memory that is free inside this Python worker to the machine: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_pieces(column: pa.Array, most: int = 700_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``most`` bytes (a longer row stands
    alone): (first row, end row, bytes, offsets of the rows in them).  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for lo in range(0, len(column), 512):  # converted a part at a time
        some = column.slice(lo, 512).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
        raw = some.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield lo + i, lo + j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 0x20, 0x09-0x0D, never across rows)
    and, per row, the index of its first word (one more entry closes the last row)."""
    n = len(data)
    ink = ~_SPACE[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[:1], before[1:] = False, ink[:-1]
    after[-1:], after[:-1] = False, ink[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def add_up(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sum float64 vectors given as rows (key int, vec binary), one vector per key.

    Each task adds the vectors it meets one by one, so memory is one vector per key; only the
    sums of a fixed number of keys of fixed length reach the driver.
    """
    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                vec = np.frombuffer(raw, np.float64)
                sums[key] = sums[key] + vec if key in sums else vec.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.int32()),
                                              "vec": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = rows.mapInArrow(total, "key int, vec binary").repartition(8, "key").mapInArrow(total, "key int, vec binary")
    return {r.key: np.frombuffer(r.vec, np.float64) for r in out.collect()}


def kth_largest(df: DataFrame, column: str, k: int, ways: int = 64) -> float | None:
    """The k-th largest value of a double column without sorting or collecting it: the bracket
    that holds it is cut into ``ways`` parts per pass, each pass one aggregate over the table.
    None if there are fewer than k values; NULL and NaN are left out."""
    df = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("x"))
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while lo < hi:
        at = F.array(*[F.lit(float(c)) for c in np.unique(np.linspace(lo, hi, ways + 1))])
        slot = F.size(F.filter(at, lambda c: c <= F.col("x")))
        parts = (df.where(F.col("x").between(float(lo), float(hi))).groupBy(slot.alias("s"))
                 .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        for part in sorted(parts, key=lambda r: -r.s):
            if above + part.n >= k:
                lo, hi = part.lo, part.hi
                break
            above += part.n
    return lo
