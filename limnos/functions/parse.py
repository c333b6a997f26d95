"""Lenient parsing of text columns (S1-S6, IO1 null tokens)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens that pandas' CSV reader treats as missing.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Agricultural suppression codes that mean "no value".
SUPPRESSION_CODES = ("(D)", "(H)", "(Z)", "(NA)")

# Plain decimal or scientific notation, optional sign, surrounding blanks.
_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

DEFAULT_TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss",
                      "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd",
                      "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens_to_null(col, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Missing-value tokens become NULL; as in pandas, a token with blanks around it is text."""
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def to_number(col) -> Column:
    """Lenient text -> DOUBLE; anything that is not a plain number is NULL.

    ``try_cast`` alone would accept ``1.0d``, ``inf`` and ``NaN``; the regex
    guard keeps the engine's rule that a missing number is NULL, never NaN.
    A number too large for a DOUBLE (``1e999``) is an infinity, which is a value
    like others: quantiles rank it, spatial joins leave its row unmatched.
    """
    c = _c(col).cast("string")
    return F.when(c.rlike(_NUMERIC), F.trim(c).try_cast("double"))


def to_ts(col, formats: Sequence[str] = DEFAULT_TS_FORMATS) -> Column:
    """Lenient text -> TIMESTAMP_NTZ, trying each format; bad input -> NULL."""
    c = _c(col).cast("string")
    tries = [F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries).cast("timestamp_ntz")


def to_ts_strict(col, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict parse (ANSI): malformed input fails the query."""
    return F.to_timestamp_ntz(_c(col).cast("string"), F.lit(fmt))


def combine_date_time(date_col, time_col, formats: Sequence[str] = DEFAULT_TS_FORMATS) -> Column:
    """S3: ``date + ' ' + time`` parsed leniently; NULL if either part is NULL."""
    return to_ts(F.concat(_c(date_col), F.lit(" "), _c(time_col)), formats)


def suppression_to_null(col, codes: Sequence[str] = SUPPRESSION_CODES) -> Column:
    """Suppression codes (after trimming) become NULL."""
    c = _c(col)
    return F.when(F.trim(c).isin(list(codes)), F.lit(None)).otherwise(c)


def strip_thousands(col) -> Column:
    """Drop ``,`` thousands separators before a numeric parse."""
    return F.regexp_replace(_c(col), ",", "")


def strip_suffix(col, pattern: str = r", MEASURED IN .*$") -> Column:
    """Remove a trailing qualifier such as ``, MEASURED IN $``."""
    return F.regexp_replace(_c(col), pattern, "")
