"""Feature engineering (E1-E11): seasonal harmonics, climate ranges,
interactions, median imputation, standardisation, scoring matrices."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.stats import exact_medians
from limnos.session import qcol

# The twelve model inputs, in contract order.
FEATURE_COLS = ("doy", "gdd_40_86", "high", "highc", "low", "lowc", "precip", "snow", "snowd",
                "distance_to_climate_station_km", "LatitudeMeasure", "LongitudeMeasure")

# Names of the fourteen derived features, in the order they are appended.
DERIVED_COLS = ("season_sin", "season_cos", "season2_sin", "season2_cos", "range_f", "range_c", "mean_c",
                "moisture", "log_moisture", "gdd_x_precip", "frozen", "lat_x_season_sin", "lon_x_season_cos",
                "dist_x_season_cos")

DAYS_IN_YEAR = 366.0  # fixed value: the seasonal divisor is always 366


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def derived_feature_sql(mapping: Mapping[str, str | None] | None = None) -> dict[str, str]:
    """The fourteen derived features as Spark SQL expressions.

    ``mapping`` renames canonical inputs to the frame's columns; a latitude or
    longitude mapped to ``None`` counts as 0 (the reference's rule for an
    11-column matrix).  Comparisons follow numpy: a NULL ``highc`` gives
    ``frozen = 0``.  The same text feeds DataFrame code (``F.expr``) and
    persisted ML pipelines (``SQLTransformer``), so both compute identically.
    """
    m = dict(mapping or {})

    def c(name: str) -> str:
        target = m.get(name, name)
        return "0.0D" if target is None else _sql_name(target)

    angle = f"(CAST({2.0 * math.pi!r} AS DOUBLE) * {c('doy')} / {DAYS_IN_YEAR!r}D)"
    angle2 = f"(2.0D * {angle})"
    moisture = f"({c('precip')} + {c('snow')} + {c('snowd')})"
    return {
        "season_sin": f"sin({angle})",
        "season_cos": f"cos({angle})",
        "season2_sin": f"sin({angle2})",
        "season2_cos": f"cos({angle2})",
        "range_f": f"{c('high')} - {c('low')}",
        "range_c": f"{c('highc')} - {c('lowc')}",
        "mean_c": f"({c('highc')} + {c('lowc')}) / 2.0D",
        "moisture": moisture,
        "log_moisture": f"log1p(CASE WHEN {moisture} IS NULL THEN NULL ELSE greatest({moisture}, 0.0D) END)",
        "gdd_x_precip": f"{c('gdd_40_86')} * CASE WHEN {c('precip')} IS NULL THEN NULL "
                        f"ELSE greatest({c('precip')}, 0.0D) END",
        "frozen": f"CASE WHEN {c('highc')} <= 0.0D THEN 1.0D ELSE 0.0D END",
        "lat_x_season_sin": f"{c('LatitudeMeasure')} * sin({angle})",
        "lon_x_season_cos": f"{c('LongitudeMeasure')} * cos({angle})",
        "dist_x_season_cos": f"{c('distance_to_climate_station_km')} * cos({angle})",
    }


def derived_feature_exprs(mapping: Mapping[str, str | None] | None = None) -> dict[str, Column]:
    """E1-E6 as Columns (built-in expressions, whole-stage codegen)."""
    return {name: F.expr(text) for name, text in derived_feature_sql(mapping).items()}


def add_derived_features(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Append the fourteen derived features (one projection, codegen'd)."""
    return df.withColumns(derived_feature_exprs(mapping))


def fit_median_imputer(train: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact per-column medians learned on the training rows."""
    return exact_medians(train, cols)


def apply_imputer(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """NULL -> learned median (a column without any value stays NULL)."""
    return df.withColumns({c: F.coalesce(qcol(c), F.lit(v)) for c, v in medians.items() if v is not None})


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> exact median of the same frame (the station snapshot)."""
    return apply_imputer(df, exact_medians(df, cols))


def fit_standardiser(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per-column (mean, population std); a zero std is stored as 1 (sklearn)."""
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(qcol(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        out[c] = (row[f"m{i}"], s if s not in (None, 0.0) else 1.0)
    return out


def apply_standardiser(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (qcol(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean, unit population std (one aggregate, then a projection)."""
    return apply_standardiser(df, fit_standardiser(df, cols))


def scoring_matrix(snapshot: DataFrame, when: dt.date | str, features: Sequence[str] = FEATURE_COLS,
                   keep: Sequence[str] = (), doy_col: str = "doy") -> DataFrame:
    """Snapshot features for a scoring date — ``doy`` from the date, NULLs
    filled with the snapshot's exact medians, fixed column order."""
    day = dt.date.fromisoformat(str(when)) if not isinstance(when, dt.date) else when
    frame = snapshot.withColumn(doy_col, F.lit(day.timetuple().tm_yday).cast("double"))
    frame = impute_median(frame, list(features))
    return frame.select(*[qcol(c) for c in keep], *[qcol(c) for c in features])
