"""End-to-end flows in the modelled workflow's own column names.

Entry 1 (batch cleaning and merging), Entry 2 (training) and Entry 3
(scoring a date, map grid, calendar) composed from the library operators.
Each function is lazy except where the output schema depends on the data
(sparse-column drop, declared pivot list) or a model is fitted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import (combine_date_time, convert_units, month_abbr, standardised_unit, strip_suffix,
                              strip_thousands, suppression_to_null, to_day, to_number, to_ts, year_key)
from limnos.functions.calendar import MONTH_KEYS, YEAR_KEY
from limnos.operators.features import FEATURE_COLS
from limnos.operators.grid import SAMPLE_CAP, hull_mask, interpolate_idw, make_grid, render_table
from limnos.operators.joins import attach_map, join_on_keys, semi_join
from limnos.operators.learners import DEFAULT_TARGETS, TargetSpec, predict, train_all
from limnos.operators.quality import (blank_to_null, drop_null_rows, drop_sparse_columns,
                                      fill_constants, normalize_columns, prefix_columns, select_available,
                                      select_required, with_constant)
from limnos.operators.regression import (coefficient_table, eligible_targets, exact_split, fit_ols_qr, metric_lookup,
                                         predict_linear, regression_metrics)
from limnos.operators.reshape import latest_per_entity, pivot_first, pivot_value_unit
from limnos.operators.spatial import nearest_join
from limnos.operators.timeline import calendar_summary, calendar_window, score_calendar, score_dates, score_entities
from limnos.session import qcol, stored

ID = "MonitoringLocationIdentifier"
TS = "ActivityStartDateTime"

# The measurement columns kept from the raw water-quality feed.
WQ_COLUMNS = ("ActivityIdentifier", "ActivityStartDate", "ActivityStartTime/Time", "MonitoringLocationIdentifier",
              "MonitoringLocationName", "ActivityLocation/LatitudeMeasure", "ActivityLocation/LongitudeMeasure",
              "CharacteristicName", "ResultMeasureValue", "ResultMeasure/MeasureUnitCode", "ResultValueTypeName")
# Station columns kept when present.
STATION_COLUMNS = ("OrganizationIdentifier", "MonitoringLocationIdentifier", "MonitoringLocationName",
                   "MonitoringLocationTypeName", "HUCEightDigitCode", "LatitudeMeasure", "LongitudeMeasure",
                   "DrainageAreaMeasure/MeasureValue", "DrainageAreaMeasure/MeasureUnitCode", "StateCode",
                   "CountyCode", "ProviderName")
WEATHER_NUMERIC = ("doy", "gdd_40_86", "high", "highc", "low", "lowc", "precip", "snow", "snowd")
OLS_PREDICTORS = ("latitude", "longitude", "distance_to_climate_station_km", "doy", "gdd_40_86", "high", "low",
                  "precip", "snow", "snowd")


# ------------------------------------------------------------ Entry 1: clean
def clean_water_quality(raw: DataFrame, top_n: int = 30, order_col: str | None = None) -> DataFrame:
    """Long raw measurements -> wide samples ``(id, timestamp, <char>_value, <char>_unit)``.

    ``order_col`` is the ingest ordinal that stands for file row order (the
    "first" duplicate wins); without one, an ordinal is taken at scan time.
    Two passes over the feed: one grouped aggregate per characteristic gives
    at once the non-null count of every column (sparse-column drop), the
    ``top_n`` characteristics (counted before cleaning, ties by name) and which
    of them keep at least one clean row (the declared pivot columns); the
    second pass is the cleaning and the pivot itself.
    """
    df = blank_to_null(normalize_columns(raw))
    if order_col is None:
        df = df.withColumn("__ord", F.monotonically_increasing_id())
        order_col = "__ord"
    unit = "ResultMeasure/MeasureUnitCode"
    ts = combine_date_time("ActivityStartDate", "ActivityStartTime/Time")
    cols = df.columns
    stats = stored(_wq_stats(df, cols), "wq-stats")  # one row per characteristic
    sums = stats.agg(F.sum("__n").alias("n"), *[F.sum(f"__nn{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    total = sums["n"] or 0
    required = [ID, "CharacteristicName", "ResultMeasureValue", "MonitoringLocationName", "ActivityStartDate",
                "ActivityStartTime/Time", unit, order_col]
    survivors = [c for i, c in enumerate(cols)
                 if c in required or (sums[f"c{i}"] or 0) >= total * 0.10]
    named = (stats.filter(qcol("CharacteristicName").isNotNull()).orderBy(F.col("__n").desc(), "CharacteristicName")
             .limit(top_n).select("CharacteristicName", "__clean").collect())
    top = [r["CharacteristicName"] for r in named]
    chars = sorted(r["CharacteristicName"] for r in named if r["__clean"] > 0)
    df = select_required(df.select(*[qcol(c) for c in survivors]),
                         [c for c in WQ_COLUMNS if c in survivors] + [order_col])
    df = (df.filter(qcol("CharacteristicName").isin(top))        # bounded literal list (<= top_n)
          .withColumn(TS, ts).drop("ActivityStartDate", "ActivityStartTime/Time")
          .withColumn("ResultMeasureValue", to_number("ResultMeasureValue")))
    df = drop_null_rows(df, [ID, "CharacteristicName", "ResultMeasureValue"])
    df = df.withColumns({"ResultMeasureValue": convert_units("CharacteristicName", "ResultMeasureValue", unit),
                         unit: standardised_unit("CharacteristicName", unit)})
    # First (value, unit) per (id, name, timestamp, characteristic); null keys drop out.
    keyed = drop_null_rows(df, [ID, "MonitoringLocationName", TS, "CharacteristicName"])
    return pivot_value_unit(keyed, [ID, TS], "CharacteristicName", "ResultMeasureValue", unit, chars,
                            order=["MonitoringLocationName", order_col])


def _wq_stats(df: DataFrame, cols) -> DataFrame:
    """Per characteristic: rows, rows that survive cleaning (all keys and a number), non-null per column."""
    ts = combine_date_time("ActivityStartDate", "ActivityStartTime/Time")
    clean_row = (qcol(ID).isNotNull() & qcol("MonitoringLocationName").isNotNull() & ts.isNotNull()
                 & to_number("ResultMeasureValue").isNotNull())
    return df.groupBy("CharacteristicName").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(clean_row).alias("__clean"),
        *[F.count(qcol(c)).alias(f"__nn{i}") for i, c in enumerate(cols)])


def water_quality_report(raw: DataFrame, top_n: int = 30) -> DataFrame:
    """A3 report: per characteristic the raw rows, the rows the cleaning keeps, the
    rows it drops (unparseable value or a NULL key such as a missing time of
    day, which pandas ``groupby`` drops silently) and whether it is in the top n."""
    df = blank_to_null(normalize_columns(raw))
    s = _wq_stats(df, []).select(F.col("CharacteristicName").alias("characteristic"), F.col("__n").alias("rows"),
                                 F.col("__clean").alias("clean_rows"))
    s = stored(s, "wq-report")
    top = s.orderBy(F.col("rows").desc(), F.col("characteristic")).limit(top_n).select("characteristic", F.lit(True).alias("in_top"))
    return (s.join(top, "characteristic", "left").withColumn("dropped_rows", F.col("rows") - F.col("clean_rows"))
            .withColumn("in_top", F.coalesce("in_top", F.lit(False)))
            .select("characteristic", "rows", "clean_rows", "dropped_rows", "in_top"))


def clean_stations(raw: DataFrame) -> DataFrame:
    df = drop_sparse_columns(blank_to_null(normalize_columns(raw)), 0.10)
    df = select_available(df, STATION_COLUMNS)
    nums = [c for c in ("LatitudeMeasure", "LongitudeMeasure", "DrainageAreaMeasure/MeasureValue") if c in df.columns]
    return df.withColumns({c: to_number(qcol(c)) for c in nums})


def clean_weather(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("day", to_day(to_ts("day")))
    df = df.withColumns({c: to_number(qcol(c)) for c in WEATHER_NUMERIC if c in df.columns})
    df = fill_constants(df, {"snow": 0.0, "snowd": 0.0})
    return drop_null_rows(df, ["high", "low", "precip"])


def clean_agriculture(raw: DataFrame) -> DataFrame:
    df = drop_sparse_columns(blank_to_null(normalize_columns(raw, lower=True)), 0.10, keep=["value"])
    fixes = {"value": to_number(strip_thousands(suppression_to_null("value")))}
    if "cv_(%)" in df.columns:    # may have been dropped as sparse
        fixes["cv_(%)"] = to_number(suppression_to_null(qcol("cv_(%)")))
    return df.withColumns(fixes)


# ------------------------------------------------------------ Entry 1: merge
def merge_samples_stations(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Samples left-joined to the station dimension."""
    return join_on_keys(samples, stations, [ID], how="left")


def station_weather_map(stations: DataFrame, weather_points: DataFrame, weather: DataFrame,
                        metric: str = "planar_rad") -> DataFrame:
    """J10 + A6 + J7: each station coordinate -> nearest weather station present in the data."""
    present = weather.select(F.col("station").alias("id")).distinct()
    pts = semi_join(weather_points, present, ["id"])
    locs = drop_null_rows(stations.select(ID, "LatitudeMeasure", "LongitudeMeasure"),
                          [ID, "LatitudeMeasure", "LongitudeMeasure"]).distinct()
    pts = pts.select(F.col("id").alias("climate_station"), F.col("name").alias("climate_station_name"),
                     F.col("lat").alias("climate_lat"), F.col("lon").alias("climate_lon"))
    return nearest_join(locs, pts, left_lat="LatitudeMeasure", left_lon="LongitudeMeasure", right_lat="climate_lat",
                        right_lon="climate_lon", right_cols=["climate_station", "climate_station_name"],
                        tie="climate_station", metric=metric, distance_col="distance_to_climate_station_km")


def merge_weather(merged: DataFrame, mapping: DataFrame, weather: DataFrame) -> DataFrame:
    """J2 + J3: nearest-station map then daily weather on (station, day)."""
    m = mapping.select(ID, "climate_station", "climate_station_name", "distance_to_climate_station_km")
    df = attach_map(merged, m, [ID]).withColumn("day", to_day(TS))
    return join_on_keys(df, weather, ["climate_station", "day"], ["station", "day"], how="left")


def merge_agriculture(df: DataFrame, ag: DataFrame, items: Sequence[str], state: str = "IOWA") -> DataFrame:
    """A5 + J5 + J6: yearly and monthly agriculture pivots (first value per item), prefixed."""
    ag = ag.withColumn("data_item", strip_suffix("data_item"))
    if "__ord" not in ag.columns:
        ag = ag.withColumn("__ord", F.monotonically_increasing_id())
    # One pivot over (year, period, state) feeds both tables (one scan, one shuffle).
    cells = pivot_first(ag.filter(F.col("period").isin([*MONTH_KEYS, YEAR_KEY])), ["year", "period", "state"],
                        "data_item", "value", items, ["__ord"])
    monthly = prefix_columns(cells.filter(F.col("period") != YEAR_KEY), "AG_MONTH_", ["year", "period", "state"]) \
        .withColumnRenamed("period", "month")
    yearly = prefix_columns(cells.filter(F.col("period") == YEAR_KEY).drop("period"), "AG_YEAR_", ["year", "state"])
    base = with_constant(df, "state", state).withColumns({"year": year_key("day"), "month": month_abbr("day")})
    out = join_on_keys(base, yearly, ["year", "state"], how="left")
    return join_on_keys(out, monthly, ["year", "month", "state"], how="left")


# ----------------------------------------------------------- Entry 2: train
def train_models(table: DataFrame, specs, targets: Sequence[TargetSpec] = DEFAULT_TARGETS, folds: int = 5,
                 model_dir: str | None = None, key_cols: Sequence[str] = (ID, TS)):
    """Metrics table and fitted pipelines for every target x family."""
    return train_all(table, targets, specs, FEATURE_COLS, key_cols=key_cols, folds=folds, model_dir=model_dir)


def train_ols_long(long: DataFrame, targets: Sequence[str] | None = None, min_samples: int = 100,
                   top_n: int = 5, test_size: float = 0.2, seed: int = 42, key_cols: Sequence[str] = ()
                   ) -> tuple[DataFrame, DataFrame]:
    """The OLS path on the long table: targets chosen by complete-row count
    (M1: an explicit list keeps its order, else the ``top_n`` largest), one
    grouped fit for all of them, holdout metrics (7 columns) and the
    coefficient table (intercept first)."""
    need = [*OLS_PREDICTORS, "ResultMeasureValue"]
    chosen = eligible_targets(long, "CharacteristicName", need, min_samples, top_n=top_n, explicit=targets)
    data = drop_null_rows(long, need).join(
        F.broadcast(chosen.select(F.col("target").alias("CharacteristicName"))),  # at most top_n / len(targets) rows
        on="CharacteristicName", how="left_semi")
    split = exact_split(data, list(key_cols) or need, by=["CharacteristicName"], test_fraction=test_size, seed=seed,
                        rule="ols")
    fit = fit_ols_qr(split.filter(~F.col("is_test")), list(OLS_PREDICTORS), "ResultMeasureValue",
                  by=["CharacteristicName"])
    scored = predict_linear(split.filter(F.col("is_test")), fit, list(OLS_PREDICTORS), by=["CharacteristicName"])
    m = regression_metrics(scored, "ResultMeasureValue", "prediction", ["CharacteristicName"])
    sizes = split.groupBy("CharacteristicName").agg(F.count(F.lit(1)).alias("sample_count"),
                                                    F.count_if(~F.col("is_test")).alias("train_count"),
                                                    F.count_if(F.col("is_test")).alias("test_count"))
    metrics = sizes.join(m.drop("n"), "CharacteristicName").withColumnRenamed("CharacteristicName", "target_variable")
    coefs = coefficient_table(fit, list(OLS_PREDICTORS), by=["CharacteristicName"], target_name="target_variable")
    return metrics.orderBy(F.col("r2").desc()), coefs


# ----------------------------------------------------------- Entry 3: score
def station_snapshot(merged: DataFrame) -> DataFrame:
    """Per station, each column's latest non-null value."""
    return latest_per_entity(merged, ID, TS, per_column=True)


def run_prediction(snapshot: DataFrame, model: PipelineModel, target: str, when: dt.date | str,
                   resolution: int = 120, sample_n: int | None = SAMPLE_CAP, metrics: DataFrame | None = None,
                   model_name: str | None = None) -> dict[str, DataFrame]:
    """Stations scored for ``when``, map table, 14-week calendar and its summary, low/average/high over the
    stations, and (given the ``metrics`` table) the metrics row of the chosen target and model.

    The snapshot and the scored stations are written once; every later step reads those tables.
    """
    snapshot = stored(snapshot, "snapshot")
    scorer = lambda d: predict(model, d)
    stations = stored(score_entities(snapshot, scorer, when, FEATURE_COLS), "scored-stations")
    # Stand-ins for missing station details on the map.
    extra_fill = {"ProviderName": "Unknown provider", "climate_station_name": "Unknown climate station",
                  "distance_to_climate_station_km": 0.0}
    extra = {c: v for c, v in extra_fill.items() if c in stations.columns}
    pts = stations.select(ID, "LatitudeMeasure", "LongitudeMeasure", "predicted",
                          *[c for c in ("MonitoringLocationName", *extra) if c in stations.columns])
    grid = make_grid(pts, "LatitudeMeasure", "LongitudeMeasure", resolution)
    vals = interpolate_idw(pts, grid, station_id=ID, lat="LatitudeMeasure", lon="LongitudeMeasure",
                           value="predicted")
    vals = hull_mask(vals, pts, lat="LatitudeMeasure", lon="LongitudeMeasure")
    table = render_table(vals, pts, target=target, station_id=ID, lat="LatitudeMeasure", lon="LongitudeMeasure",
                         value="predicted", sample_n=sample_n,
                         station_name="MonitoringLocationName" if "MonitoringLocationName" in pts.columns else None,
                         station_extra=extra)
    start, stop = calendar_window(when)
    days = [start + dt.timedelta(days=i) for i in range((stop - start).days + 1)]
    daily = score_dates(snapshot, scorer, days, FEATURE_COLS)
    calendar = stored(score_calendar(daily, when), "calendar")
    levels = stations.agg(F.min("predicted").alias("low"), F.avg("predicted").alias("average"), F.max("predicted").alias("high"),
                          F.count("predicted").alias("stations"))
    out = {"stations": stations, "map": table, "calendar": calendar, "calendar_summary": calendar_summary(calendar, when), "levels": levels}
    if metrics is not None and model_name is not None:
        out["metrics"] = metric_lookup(metrics, target, model_name)
    return out

