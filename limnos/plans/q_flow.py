"""Catalogue: the cleaning and merging flow (Entry 1) on the driver tables.

The driver tables are mapped onto the feeds' column contracts: events are the
long water-quality measurements (user = monitoring location, event type =
characteristic), customers the station dimension, daily order totals per
weather station the weather feed, and suppliers the weather stations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.learners import LINEAR, fit_model
from limnos.operators.reshape import to_long
from limnos.plans import flows
from limnos.plans.registry import iso_date, iso_ts, pseudo_lat, pseudo_lon, r6, register
from limnos.session import qcol, table

# Characteristic names given to the event types (the reference's temperature
# characteristic gets Fahrenheit rows to convert).
CHARACTERISTICS = {"view": "Temperature, water", "click": "pH", "purchase": "Dissolved oxygen (DO)",
                   "signup": "Nitrate", "error": "Turbidity"}


def _raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in CHARACTERISTICS.items()])
    is_temp = F.col("event_type") == "view"
    fahrenheit = is_temp & (F.col("event_id") % 3 == 0)
    value = F.when(fahrenheit, F.col("value") * 9.0 / 5.0 + 32.0).otherwise(F.col("value"))
    return e.select(
        F.col("event_id").cast("string").alias("ActivityIdentifier"),
        F.date_format("ts", "yyyy-MM-dd").alias("ActivityStartDate"),
        F.date_format("ts", "HH:mm:ss").alias("ActivityStartTime/Time"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("MonitoringLocationIdentifier"),
        F.concat(F.lit("Station "), F.col("user_id").cast("string")).alias("MonitoringLocationName"),
        pseudo_lat("user_id").cast("string").alias("ActivityLocation/LatitudeMeasure"),
        pseudo_lon("user_id").cast("string").alias("ActivityLocation/LongitudeMeasure"),
        name.alias("CharacteristicName"),
        value.cast("string").alias("ResultMeasureValue"),
        F.when(fahrenheit, F.lit("deg F")).when(is_temp, F.lit("deg C")).otherwise(F.lit("units"))
        .alias("ResultMeasure/MeasureUnitCode"),
        F.lit("Actual").alias("ResultValueTypeName"),
        F.col("event_id").alias("__ingest_order"))


def _raw_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("MonitoringLocationIdentifier"),
                    F.col("c_name").alias("MonitoringLocationName"),
                    pseudo_lat("c_custkey").cast("string").alias("LatitudeMeasure"),
                    pseudo_lon("c_custkey").cast("string").alias("LongitudeMeasure"),
                    F.col("c_mktsegment").alias("ProviderName"), F.lit(" ").alias("HUCEightDigitCode"))


def _raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("o_orderdate"))
    daily = o.groupBy(F.concat(F.lit("W"), (F.col("o_custkey") % 97).cast("string")).alias("station"),
                      day.alias("d")).agg(
        # exact decimal sum (prices have 2 decimals), one division: identical in any engine
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("p"),
        F.count(F.lit(1)).alias("n"))
    high = F.col("p") / F.lit(3000.0)  # non-terminating quotients: no exact rounding ties
    return daily.select(
        "station", F.date_format("d", "yyyy-MM-dd").alias("day"), F.dayofyear("d").cast("string").alias("doy"),
        (F.col("n") * 3.0).cast("string").alias("gdd_40_86"), high.cast("string").alias("high"),
        ((high - 32.0) * 5.0 / 9.0).cast("string").alias("highc"), (high - 15.0).cast("string").alias("low"),
        ((high - 47.0) * 5.0 / 9.0).cast("string").alias("lowc"), (F.col("n") / 10.0).cast("string").alias("precip"),
        F.when(F.col("n") % 2 == 0, F.lit("0.5")).alias("snow"), F.lit(None).cast("string").alias("snowd"))


def _weather_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("id"),
                    F.coalesce(F.col("s_name"), F.lit("")).alias("name"),
                    pseudo_lat("s_suppkey").alias("lat"), pseudo_lon("s_suppkey").alias("lon"))


def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry 1: clean long measurements to wide samples, join stations, map
    each station to its nearest weather station and join that day's weather."""
    samples = flows.clean_water_quality(_raw_measurements(spark, sf_dir), order_col="__ingest_order")
    stations = flows.clean_stations(_raw_stations(spark, sf_dir))
    weather = flows.clean_weather(_raw_weather(spark, sf_dir))
    mapping = flows.station_weather_map(stations, _weather_points(spark, sf_dir), weather)
    merged = flows.merge_weather(flows.merge_samples_stations(samples, stations), mapping, weather)
    doubles = [f.name for f in merged.schema.fields if f.dataType.typeName() == "double"]
    return merged.withColumns({flows.TS: iso_ts(flows.TS), "day": iso_date("day"),
                               **{c: r6(qcol(c)) for c in doubles}})


def _lat(k: str) -> str:
    return f"(CAST(4040 + ({k} * 71) % 310 AS DOUBLE) / CAST(100 AS DOUBLE))"


def _lon(k: str) -> str:
    return f"(CAST(-9660 + ({k} * 53) % 640 AS DOUBLE) / CAST(100 AS DOUBLE))"


_CHARS = sorted(CHARACTERISTICS.values())
_PIVOT = ",\n       ".join(
    f"arg_min(v, struct_pack(sname, ord)) FILTER (WHERE cname = '{c}') AS \"{c}_value\", "
    f"arg_min(u, struct_pack(sname, ord)) FILTER (WHERE cname = '{c}') AS \"{c}_unit\"" for c in _CHARS)
_CNAME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHARACTERISTICS.items())
_HIGH = "(p / CAST(3000 AS DOUBLE))"


def _spark_round(c: str) -> str:
    """Spark's round(double, 6): HALF_UP on the double's shortest decimal text."""
    return f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 20)), 6) AS DOUBLE)"

register("merged_samples", sql=f"""
WITH raw AS (
  SELECT 'S' || CAST(user_id AS VARCHAR) AS sid, 'Station ' || CAST(user_id AS VARCHAR) AS sname,
         CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts,
         CASE event_type {_CNAME} END AS cname,
         CASE WHEN event_type = 'view' AND event_id % 3 = 0
              THEN value * CAST(9 AS DOUBLE) / CAST(5 AS DOUBLE) + CAST(32 AS DOUBLE) ELSE value END AS v0,
         CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'deg F'
              WHEN event_type = 'view' THEN 'deg C' ELSE 'units' END AS u0,
         event_id AS ord
  FROM events),
conv AS (
  SELECT sid, sname, ts, cname, ord,
         CASE WHEN cname = 'Temperature, water' AND u0 = 'deg F'
              THEN (v0 + CAST(-32 AS DOUBLE)) * (CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE)) ELSE v0 END AS v,
         CASE WHEN cname = 'Temperature, water' THEN 'deg C' ELSE u0 END AS u
  FROM raw WHERE sid IS NOT NULL AND cname IS NOT NULL AND v0 IS NOT NULL),
wide AS (
  SELECT sid AS MonitoringLocationIdentifier, ts AS ActivityStartDateTime,
       {_PIVOT}
  FROM conv WHERE sname IS NOT NULL AND ts IS NOT NULL GROUP BY sid, ts),
st AS (
  SELECT 'S' || CAST(c_custkey AS VARCHAR) AS MonitoringLocationIdentifier, c_name AS MonitoringLocationName,
         {_lat('c_custkey')} AS LatitudeMeasure, {_lon('c_custkey')} AS LongitudeMeasure, c_mktsegment AS ProviderName
  FROM customer),
wx AS (
  SELECT 'W' || CAST(o_custkey % 97 AS VARCHAR) AS station, make_date(2024, 1, CAST(day(o_orderdate) AS INTEGER)) AS day,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS p, count(*) AS n
  FROM orders GROUP BY 1, 2),
weather AS (
  SELECT station, day, CAST(dayofyear(day) AS DOUBLE) AS doy, CAST(n * 3 AS DOUBLE) AS gdd_40_86,
         {_HIGH} AS high, ({_HIGH} - CAST(32 AS DOUBLE)) * CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE) AS highc,
         {_HIGH} - CAST(15 AS DOUBLE) AS low,
         ({_HIGH} - CAST(47 AS DOUBLE)) * CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE) AS lowc,
         n / CAST(10 AS DOUBLE) AS precip, CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.0 END AS snow, 0.0 AS snowd
  FROM wx),
pts AS (
  SELECT 'W' || CAST(s_suppkey AS VARCHAR) AS climate_station, coalesce(s_name, '') AS climate_station_name,
         {_lat('s_suppkey')} AS clat, {_lon('s_suppkey')} AS clon
  FROM supplier WHERE 'W' || CAST(s_suppkey AS VARCHAR) IN (SELECT station FROM weather)),
locs AS (SELECT DISTINCT MonitoringLocationIdentifier AS sid, LatitudeMeasure AS lat, LongitudeMeasure AS lon FROM st),
near AS (
  SELECT sid, climate_station, climate_station_name,
         sqrt((radians(lat) - radians(clat)) * (radians(lat) - radians(clat))
              + (radians(lon) - radians(clon)) * (radians(lon) - radians(clon))) * 6371.0
           AS distance_to_climate_station_km,
         row_number() OVER (PARTITION BY sid, lat, lon
                            ORDER BY (clat - lat) * (clat - lat) + (clon - lon) * (clon - lon), climate_station) AS rn
  FROM locs CROSS JOIN pts),
m AS (
  SELECT w.*, st.MonitoringLocationName, st.LatitudeMeasure, st.LongitudeMeasure, st.ProviderName,
         near.climate_station, near.climate_station_name, near.distance_to_climate_station_km,
         CAST(w.ActivityStartDateTime AS DATE) AS day
  FROM wide w LEFT JOIN st ON w.MonitoringLocationIdentifier = st.MonitoringLocationIdentifier
              LEFT JOIN near ON w.MonitoringLocationIdentifier = near.sid AND near.rn = 1)
SELECT m.MonitoringLocationIdentifier, strftime(m.ActivityStartDateTime, '%Y-%m-%d %H:%M:%S') AS ActivityStartDateTime,
       {", ".join(f'round("{c}_value", 6) AS "{c}_value", "{c}_unit"' for c in _CHARS)},
       m.MonitoringLocationName, round(m.LatitudeMeasure, 6) AS LatitudeMeasure,
       round(m.LongitudeMeasure, 6) AS LongitudeMeasure, m.ProviderName, m.climate_station, m.climate_station_name,
       round(m.distance_to_climate_station_km, 6) AS distance_to_climate_station_km,
       CAST(m.day AS VARCHAR) AS day,
       {", ".join(f"{_spark_round(c)} AS {c}" for c in
                  ("doy", "gdd_40_86", "high", "highc", "low", "lowc", "precip", "snow", "snowd"))}
FROM m LEFT JOIN weather ON m.climate_station = weather.station AND m.day = weather.day
""")(merged_samples)


def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 report on the driver tables: rows kept and dropped per characteristic."""
    raw = _raw_measurements(spark, sf_dir).drop("__ingest_order")
    return flows.water_quality_report(raw, top_n=4)


register("cleaning_report", sql=f"""
WITH raw AS (
  SELECT CASE event_type {_CNAME} END AS characteristic, user_id, ts, value FROM events),
s AS (
  SELECT characteristic, count(*) AS rows,
         count(*) FILTER (WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL) AS clean_rows
  FROM raw GROUP BY characteristic)
SELECT characteristic, rows, clean_rows, rows - clean_rows AS dropped_rows,
       characteristic IS NOT NULL AND row_number() OVER (ORDER BY rows DESC, characteristic) <= 4 AS in_top
FROM s
""")(cleaning_report)


def ols_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry 2, OLS path: the merged wide samples unpivoted to the long layout
    the OLS trainer expects, targets chosen by complete-row count (M1), exact
    split, one grouped fit, holdout metrics per target (7 columns)."""
    # Written once to the shared checkpoint folder: the training steps below
    # run several jobs over it, which would otherwise each recompute the flow.
    merged = merged_samples(spark, sf_dir).checkpoint()
    values = [c for c in merged.columns if c.endswith("_value")]
    ids = [flows.ID, flows.TS, "LatitudeMeasure", "LongitudeMeasure", "distance_to_climate_station_km", "doy",
           "gdd_40_86", "high", "low", "precip", "snow", "snowd"]
    long = to_long(merged, ids, values, "CharacteristicName", "ResultMeasureValue").withColumns({
        "CharacteristicName": F.regexp_replace("CharacteristicName", "_value$", ""),
        "latitude": F.col("LatitudeMeasure"), "longitude": F.col("LongitudeMeasure")})
    metrics, _ = flows.train_ols_long(long, min_samples=100, top_n=5, key_cols=[flows.ID, flows.TS])
    return metrics.select("target_variable", "sample_count", "train_count", "test_count",
                          *[r6(c).alias(c) for c in ("rmse", "mae", "r2")])


register("ols_targets")(ols_targets)


def station_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry 3 on the driver tables: per-station snapshot (A9), a linear model
    of water temperature fitted on the merged samples, every station scored
    for 2024-01-20 and the map table (grid, IDW, hull mask, clip, labels)."""
    merged = merged_samples(spark, sf_dir).withColumn(flows.TS, F.to_timestamp_ntz(flows.TS)).checkpoint()
    target = "Temperature, water_value"
    feats = [c for c in flows.FEATURE_COLS]
    train = merged.filter(qcol(target).isNotNull())
    model = fit_model(train, LINEAR, feats, target, key_cols=[flows.ID, flows.TS])
    snap = flows.station_snapshot(merged.select(flows.ID, flows.TS, "MonitoringLocationName", *feats))
    out = flows.run_prediction(snap, model, "Water Temperature", "2024-01-20", resolution=60, sample_n=1000)
    return out["map"].select("kind", "id", "name", r6("lat").alias("lat"), r6("lon").alias("lon"),
                             r6("value").alias("value"), "label")


register("station_map")(station_map)
