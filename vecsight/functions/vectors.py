"""Vector column expressions (JVM side, no Python in the hot path).

Vectors are ``array<float>`` columns; arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecsight.constants import NORM_EPS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_vector_text(col) -> Column:
    """``'[0.1 0.2\\n 0.3]'`` -> ``array<float>``; any whitespace separates values."""
    inner = F.regexp_replace(_c(col), r"^\s*\[?\s*|\s*\]?\s*$", "")
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(
        F.split(inner, r"\s+").cast("array<float>"))


def vector_to_text(col, digits: int | None = None) -> Column:
    """``array<float>`` -> ``'[a b c]'`` (optionally rounded)."""
    v = _c(col)
    elems = F.transform(v, lambda x: F.round(x.cast("double"), digits)) if digits is not None \
        else F.transform(v, lambda x: x.cast("double"))
    return F.concat(F.lit("["), F.array_join(elems.cast("array<string>"), " "), F.lit("]"))


def sq_norm(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(col) -> Column:
    return F.sqrt(sq_norm(col))


def l2_normalize(col, eps: float = NORM_EPS) -> Column:
    """x / max(||x||, eps) element-wise, as ``array<double>``."""
    v = _c(col)
    n = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a, b) -> Column:
    """Dot product in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)

