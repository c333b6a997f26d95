"""Calendar keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month keys of the agricultural feed, and its yearly key.
MONTH_KEYS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
YEAR_KEY = "YEAR"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_day(col) -> Column:
    """Timestamp -> DATE (``date_trunc`` would turn NTZ into a zoned type)."""
    return F.to_date(_c(col))


def day_key(col) -> Column:
    """``yyyy-MM-dd`` text, for output only; joins use the DATE itself."""
    return F.date_format(_c(col), "yyyy-MM-dd")


def year_key(col) -> Column:
    """Calendar year as INT."""
    return F.year(_c(col))


def month_abbr(col) -> Column:
    """Upper-case English month abbreviation (``SEP``)."""
    return F.upper(F.date_format(_c(col), "MMM"))


def day_of_year(col) -> Column:
    """1..366."""
    return F.dayofyear(_c(col))


def mask_unless_in(col, allowed: Sequence[str] = MONTH_KEYS) -> Column:
    """Keep the value only when it is one of ``allowed``; else NULL."""
    c = _c(col)
    return F.when(c.isin(list(allowed)), c)
