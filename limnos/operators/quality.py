"""Schema hygiene, profiling and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.session import qcol


# ---------------------------------------------------------------- projection
def normalize_columns(df: DataFrame, lower: bool = False) -> DataFrame:
    """Strip names, inner spaces -> ``_``, optionally lower-case."""
    names = []
    for name in df.columns:
        new = name.strip().replace(" ", "_")
        names.append(new.lower() if lower else new)
    if len(set(names)) != len(names):
        dupes = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"normalised column names collide: {dupes}")
    return df.toDF(*names)


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty or whitespace-only strings -> NULL in every (or the given) string column."""
    targets = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    out = [F.when(qcol(n).rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(qcol(n)).alias(n)
           if n in targets else qcol(n) for n in df.columns]
    return df.select(*out)


def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """One aggregate pass: total rows and per-column non-null counts."""
    cols = list(cols if cols is not None else df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(qcol(c)).alias(f"__nn{i}") for i, c in enumerate(cols)]).first()
    return row["__rows"], {c: row[f"__nn{i}"] for i, c in enumerate(cols)}


def drop_sparse_columns(df: DataFrame, min_fraction: float = 0.10, keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns with ``non_null >= rows * min_fraction`` (inclusive).

    Eager by nature (the output schema depends on the data): one aggregate
    job, then a lazy ``select``.
    """
    rows, counts = non_null_counts(df)
    threshold = rows * min_fraction
    survivors = [c for c in df.columns if c in keep or counts[c] >= threshold]
    return df.select(*[qcol(c) for c in survivors])


def missing_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """``(column_name, position, null_count, percent_missing)`` in one pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(qcol(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                               F.col(f"__m{i}").alias("null_count")) for i, c in enumerate(cols)])
    out = (agg.select(F.col("__rows"), F.explode(pairs).alias("m"))
           .select("m.column_name", "m.position", "m.null_count",
                   F.when(F.col("__rows") > 0, F.col("m.null_count") * 100.0 / F.col("__rows"))
                   .otherwise(F.lit(0.0)).alias("percent_missing")))
    return out.filter(F.col("null_count") > 0) if only_missing else out


def select_required(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: projection in the given order; a missing column is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"required columns absent: {missing}")
    return df.select(*[qcol(c) for c in cols])


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Projection to the listed columns that exist, list order kept."""
    return df.select(*[qcol(c) for c in cols if c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, except_: Sequence[str] = ()) -> DataFrame:
    """``prefix + name`` for every column not in ``except_``."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in except_})


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop helper columns; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """A constant column (e.g. ``state='IOWA'``)."""
    return df.withColumn(name, F.lit(value))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL -> constant per column."""
    return df.select(*[F.coalesce(qcol(c), F.lit(values[c])).alias(c) if c in values else qcol(c)
                       for c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """``(column_name, position, data_type, non_null, null_count, rows)``, one pass."""
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(qcol(c)).alias(f"__n{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                                 F.lit(types[c]).alias("data_type"), F.col(f"__n{i}").alias("non_null"))
                        for i, c in enumerate(cols)])
    return (agg.select(F.col("__rows").alias("rows"), F.explode(entries).alias("e"))
            .select("e.column_name", "e.position", "e.data_type", "e.non_null",
                    (F.col("rows") - F.col("e.non_null")).alias("null_count"), "rows"))


# ------------------------------------------------------------------- filters
def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """rows where every listed column is non-null."""
    cond = None
    for c in subset:
        cond = qcol(c).isNotNull() if cond is None else cond & qcol(c).isNotNull()
    return df if cond is None else df.filter(cond)


def keep_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """constant-set membership."""
    return df.filter(qcol(col).isin(list(values)))


def keep_equal(df: DataFrame, col: str, value) -> DataFrame:
    """equality filter."""
    return df.filter(qcol(col) == F.lit(value))


def in_range(col: str | Column, lo: float | None, hi: float | None) -> Column:
    """Inclusive physical-range predicate; NULL is out of range."""
    c = qcol(col) if isinstance(col, str) else col
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & (c <= F.lit(hi))
    return cond


def filter_range(df: DataFrame, col: str, lo: float | None, hi: float | None) -> DataFrame:
    """inclusive range filter."""
    return df.filter(in_range(col, lo, hi))


def range_counts(df: DataFrame, col: str | Column, lo_col: Column, hi_col: Column,
                 by: Sequence[str] = ()) -> DataFrame:
    """F4 report: rows before and after a per-group range filter, one aggregate."""
    c = qcol(col) if isinstance(col, str) else col
    kept = c.isNotNull() & (c >= lo_col) & (c <= hi_col)
    grouped = df.groupBy(*[qcol(b) for b in by]) if by else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("rows_before_filter"), F.count_if(kept).alias("rows_used"))


def min_rows_gate(df: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """keep groups with at least ``min_rows`` rows (aggregate + semi join)."""
    keys = [qcol(b) for b in by]
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows).drop("__n")
    return df.join(ok, on=list(by), how="left_semi")


def keep_finite(df: DataFrame, col: str) -> DataFrame:
    """drop NULL (and NaN, should any slip through) cells."""
    c = qcol(col)
    return df.filter(c.isNotNull() & ~F.isnan(c))
