"""Pixel arrays (I22, I23): rescale to 8 bit and shape checks, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_uint8(px) -> Column:
    """Clip below 0, divide by the *unclipped* maximum, x255, truncate.

    NULL when the maximum is not positive (undefined in the original)."""
    p = (F.col(px) if isinstance(px, str) else px).cast("array<double>")
    mx = F.array_max(p)
    scaled = F.transform(p, lambda x: F.least(F.floor(F.greatest(x, F.lit(0.0)) / mx * 255), F.lit(255))
                         .cast("int"))
    return F.when(mx > 0, scaled)


def shape_ok(shape) -> Column:
    """A 2-D image, or a 3-D image whose last axis has 3 channels."""
    s = F.col(shape) if isinstance(shape, str) else shape
    return (F.size(s) == 2) | ((F.size(s) == 3) & (F.try_element_at(s, F.lit(3)) == 3))


def shape_reason(shape, px) -> Column:
    s = F.col(shape) if isinstance(shape, str) else shape
    p = F.col(px) if isinstance(px, str) else px
    n = F.aggregate(s, F.lit(1).cast("long"), lambda a, x: a * x)
    return (F.when(~shape_ok(s), "bad shape")
            .when(n != F.size(p), "size mismatch"))
