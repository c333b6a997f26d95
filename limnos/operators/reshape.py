"""Counting, first/last selection, pivots, distinct and ordered selections
(A1-A10, A12-A14, W1-W3, W6, W7).

Order-dependent pandas semantics ("first", "last", keep-first) need an
explicit order column here: Spark rows have no inherent order.  All
selections are expressed as aggregates with ``min_by``/``max_by`` so they keep
map-side partial aggregation (one shuffle, skew-tolerant) instead of windows
that sort each whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from limnos.session import qcol


def _cols(names: Sequence[str]) -> list[Column]:
    return [qcol(n) for n in names]


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*_cols(order)) if len(order) > 1 else qcol(order[0])


# ------------------------------------------------------------------ counting
def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A1: frequency of each non-null value, most frequent first (ties by value)."""
    return (df.filter(qcol(col).isNotNull()).groupBy(qcol(col)).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.col(name).desc(), qcol(col).asc()))


def top_categories(df: DataFrame, col: str, n: int = 30) -> DataFrame:
    """A2: the ``n`` most frequent values (at most ``n`` rows; ties broken by value)."""
    return value_counts(df, col).limit(n)


def keep_top_categories(df: DataFrame, col: str, n: int = 30) -> DataFrame:
    """Rows whose category is among the ``n`` most frequent.

    The top list has at most ``n`` rows, so broadcasting it is size-safe.
    """
    top = top_categories(df, col, n).select(qcol(col))
    return df.join(F.broadcast(top), on=[col], how="left_semi")


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Unique rows over ``cols`` (all columns by default)."""
    return df.select(*_cols(cols)).distinct() if cols else df.distinct()


def distinct_count(col: str, approx: bool = False, rsd: float = 0.01) -> Column:
    """Exact or HyperLogLog distinct count aggregate."""
    return F.approx_count_distinct(qcol(col), rsd) if approx else F.count_distinct(qcol(col))


# ----------------------------------------------------------------- selection
def first_per_group(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str],
                    drop_null_keys: bool = True) -> DataFrame:
    """A3: the values of the earliest row (by ``order``) per key.

    Rows with a NULL key are dropped, as pandas ``groupby`` does.
    """
    src = df
    if drop_null_keys:
        for k in keys:
            src = src.filter(qcol(k).isNotNull())
    picked = F.min_by(F.struct(*_cols(values)), _order_key(order)).alias("__first")
    return src.groupBy(*_cols(keys)).agg(picked).select(*_cols(keys), *[F.col(f"__first.`{v}`").alias(v)
                                                                         for v in values])


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first whole row per key (``dropDuplicates`` keeps an arbitrary one)."""
    rest = [c for c in df.columns if c not in keys]
    return first_per_group(df, keys, rest, order, drop_null_keys=False).select(*_cols(df.columns))


def latest_per_entity(df: DataFrame, key: str, ts: str, tie: str | None = None,
                      cols: Sequence[str] | None = None, per_column: bool = True) -> DataFrame:
    """Per entity, the most recent value of each column.

    ``per_column=True`` (parity): each column's last *non-null* value in time
    order, so one output row can mix several input rows.  ``False``: the
    whole latest row.  Rows with NULL ``ts`` never win.  Ties on ``ts`` are
    broken by ``tie`` (largest wins).
    """
    cols = [c for c in (cols or df.columns) if c not in (key,)]
    order = F.struct(qcol(ts), qcol(tie)) if tie else qcol(ts)
    src = df.filter(qcol(ts).isNotNull())
    if per_column:
        aggs = [F.max_by(F.when(qcol(c).isNotNull(), qcol(c)), F.when(qcol(c).isNotNull(), order)).alias(c)
                for c in cols]
        return src.groupBy(qcol(key)).agg(*aggs)
    row = F.max_by(F.struct(*_cols(cols)), order).alias("__last")
    return src.groupBy(qcol(key)).agg(row).select(qcol(key), *[F.col(f"__last.`{c}`").alias(c) for c in cols])


# -------------------------------------------------------------------- pivots
def pivot_value_unit(df: DataFrame, index: Sequence[str], category: str, value: str, unit: str,
                     categories: Sequence[str], order: Sequence[str],
                     on_duplicate: str = "first") -> DataFrame:
    """A4: long -> wide with ``<cat>_value`` / ``<cat>_unit`` per declared category.

    One conditional aggregate per output column (``min_by ... FILTER``) so
    the whole pivot is a single partial+final aggregation on ``index``.
    ``on_duplicate='error'`` first checks that no index x category cell
    holds more than one row (one extra aggregate job).
    """
    if on_duplicate == "error":
        dup = (df.groupBy(*_cols(index), qcol(category)).count().filter(F.col("count") > 1).limit(1).count())
        if dup:
            raise ValueError("duplicate index x category cells; use on_duplicate='first'")
    okey = _order_key(order)
    aggs = []
    for cat in categories:
        hit = qcol(category) == F.lit(cat)
        aggs.append(F.min_by(qcol(value), F.when(hit, okey)).alias(f"{cat}_value"))
        aggs.append(F.min_by(qcol(unit), F.when(hit, okey)).alias(f"{cat}_unit"))
    return df.groupBy(*_cols(index)).agg(*aggs)


def pivot_first(df: DataFrame, index: Sequence[str], column: str, value: str, categories: Sequence[str],
                order: Sequence[str]) -> DataFrame:
    """A5: first non-null value per cell (pandas ``pivot_table(aggfunc='first')``).

    NULL values are filtered first, which gives pandas' drop behaviour: an
    index whose cells are all NULL produces no row.
    """
    src = df.filter(qcol(value).isNotNull() & qcol(column).isin(list(categories)))
    okey = _order_key(order)
    aggs = [F.min_by(qcol(value), F.when(qcol(column) == F.lit(cat), okey)).alias(cat) for cat in categories]
    return src.groupBy(*_cols(index)).agg(*aggs)


def to_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], var_name: str = "variable",
            value_name: str = "value") -> DataFrame:
    """Wide -> long (``unpivot``), e.g. to feed per-target fits from a wide table."""
    return df.unpivot(_cols(ids), _cols(value_cols), var_name, value_name)


# --------------------------------------------------------------- statistics
def match_rate(col: str) -> Column:
    """Percent of rows where ``col`` is non-null."""
    return F.avg(F.when(qcol(col).isNotNull(), F.lit(100.0)).otherwise(F.lit(0.0)))


def dataset_summary(df: DataFrame, id_col: str, date_col: str, matched_col: str | None = None) -> DataFrame:
    """Rows, distinct ids, date range and match rate in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(qcol(id_col)).alias("distinct_ids"),
            F.min(qcol(date_col)).alias("first_date"), F.max(qcol(date_col)).alias("last_date")]
    if matched_col:
        aggs += [F.count(qcol(matched_col)).alias("matched_rows"), match_rate(matched_col).alias("match_pct")]
    return df.agg(*aggs)


def group_mean(df: DataFrame, by: Sequence[str], col: str, name: str = "mean") -> DataFrame:
    """Mean per group."""
    return df.groupBy(*_cols(by)).agg(F.avg(qcol(col)).alias(name))


def describe_numeric(df: DataFrame, cols: Sequence[str], extra_percentiles: Sequence[float] = ()) -> DataFrame:
    """P10: count/mean/std/min/quartiles/max per column as long rows.

    Quartiles are exact with numpy's linear interpolation, found in proven
    sketch brackets (no single-task merge of all values); the moments come
    from the search's first aggregate, so the profile costs no extra scan.  The result is a small literal frame (one row per column).
    """
    from limnos.operators.stats import exact_profile

    ps = [0.25, 0.5, 0.75, *extra_percentiles]
    prof = exact_profile(df, cols, ps)
    extra_names = [f"p{int(round(p * 100)):02d}" for p in extra_percentiles]
    rows = []
    for c in cols:
        n, mean, std, lo, hi, q = prof[c]
        rows.append((c, int(n), mean, std, lo, q[0], q[1], q[2], hi, *q[3:]))
    schema = ("column_name string, count long, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double" + "".join(f", {e} double" for e in extra_names))
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------- ordered / top-k
def best_per_group(df: DataFrame, by: Sequence[str], score: str, rank_cols: Sequence[str],
                   flag: str = "best") -> DataFrame:
    """Flag the best row per group by ``score`` desc; earliest ``rank_cols`` wins ties.

    Meant for result tables (a few rows per group: one per model family),
    where a window sorting each group is cheap.
    """
    w = Window.partitionBy(*_cols(by)).orderBy(qcol(score).desc_nulls_last(), *[qcol(r).asc() for r in rank_cols])
    return df.withColumn(flag, F.row_number().over(w) == 1)


def bounded_sample(df: DataFrame, key_cols: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those with the smallest ``md5(key || seed)``.

    Deterministic under any partitioning (``sample`` is not).  Every task keeps
    its own first ``n`` before they meet, so nothing is sorted whole.
    """
    parts = [F.coalesce(qcol(k).cast("string"), F.lit("\u0000")) for k in key_cols]  # NULL-safe key text
    hashed = df.withColumn("__h", F.md5(F.concat_ws("\u0001", *parts, F.lit(str(seed)))))
    return hashed.orderBy("__h", *_cols(key_cols)).limit(n).drop("__h")


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by an explicit key."""
    return df.orderBy(*_cols(order)).limit(n)
