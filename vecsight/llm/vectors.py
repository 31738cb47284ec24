"""Vector columns as bytes, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, dim, raw): the vector as bytes (see ``unpack``), floats where the column holds floats;
    ``raw`` is null for vectors that take no part
    (null, empty, zero, or with null or non-finite components)."""
    single = vectors.schema[column].dataType.elementType.typeName() == "float"

    def run(batches):
        for batch in batches:
            raw, dim = [], []
            for x in batch.column(1):
                v = None if not x.is_valid or x.values.null_count else np.asarray(x.values)
                good = v is not None and len(v) and np.isfinite(v).all() and v.any()
                raw.append(v.tobytes() + bytes([v.itemsize]) if good else None)
                dim.append(len(v) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())],
                                             [key, "dim", "raw"])

    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<float>" if single else "array<double>"))
    return rows.mapInArrow(run, f"{key} long, dim int, raw binary")


def unpack(raw: bytes) -> np.ndarray:
    """The doubles of a packed vector: its last byte is the size of its components."""
    return np.frombuffer(raw, f"<f{raw[-1]}", count=len(raw) // raw[-1]).astype(np.float64)


def matrix(column, unit: bool = False) -> np.ndarray:
    """The vectors of a column of equal dimension as rows, if asked at length 1."""
    rows = np.stack([unpack(x) for x in (column.to_pylist() if hasattr(column, "to_pylist") else column)])
    if unit:
        rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
        rows = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first ``keys`` columns agree, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        heads = [np.asarray(batch.column(k)) for k in range(keys)]
        for h in heads:
            change[1:] |= h[1:] != h[:-1]
        first = tuple(h[0] for h in heads)
        change[0] = last is not None and first != last
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:]):
            if change[lo] and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
        last = tuple(h[-1] for h in heads)
    if held:
        yield pa.Table.from_batches(held)
