"""Null-preserving numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip(col, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp into [lo, hi]; NULL stays NULL (``greatest(NULL, 0)`` is 0 in Spark)."""
    c = _c(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def nonneg(col) -> Column:
    """``max(x, 0)`` keeping NULL."""
    return clip(col, lo=0.0)


def log1p_nonneg(col) -> Column:
    """E3 guard: ``log1p(max(x, 0))`` keeping NULL."""
    return F.log1p(nonneg(col))


def round_half_even(col, scale: int = 4) -> Column:
    """Numpy rounding: ``rint(x * 10^s) / 10^s`` (half to even on the scaled double).

    ``bround`` rounds the shortest decimal text of the double instead, which
    disagrees with numpy when the scaled value is not exactly representable.
    """
    factor = F.lit(float(10 ** scale))
    return F.rint(_c(col) * factor) / factor
