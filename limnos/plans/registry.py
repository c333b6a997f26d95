"""Registry shared by the query modules, plus small output helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its DuckDB oracle SQL (if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def iso_date(col) -> Column:
    """DATE -> ``yyyy-MM-dd`` text for catalogue output (unambiguous to compare)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string")


def iso_ts(col) -> Column:
    """TIMESTAMP -> ``yyyy-MM-dd HH:mm:ss`` text for catalogue output."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(col, scale: int = 6) -> Column:
    """Round a computed double for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, scale)


def pseudo_lat(key) -> Column:
    """Pseudo latitude in degrees from an integer key (integer hundredths, exact)."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.lit(4040) + (k * 71) % 310).cast("double") / F.lit(100.0)


def pseudo_lon(key) -> Column:
    """Pseudo longitude in degrees from an integer key (integer hundredths, exact)."""
    k = F.col(key) if isinstance(key, str) else key
    return (F.lit(-9660) + (k * 53) % 640).cast("double") / F.lit(100.0)


def sql_lat(key: str) -> str:
    return f"(CAST(4040 + ({key} * 71) % 310 AS DOUBLE) / CAST(100 AS DOUBLE))"


def sql_lon(key: str) -> str:
    return f"(CAST(-9660 + ({key} * 53) % 640 AS DOUBLE) / CAST(100 AS DOUBLE))"
