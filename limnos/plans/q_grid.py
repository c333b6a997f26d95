"""Catalogue: scoring by date, calendar, gridding and point enrichment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.grid import enrich_points, hull_mask, interpolate_idw, make_grid, render_table
from limnos.operators.timeline import calendar_summary, calendar_window, score_calendar, score_dates, score_entities
from limnos.plans.registry import iso_date, pseudo_lat, pseudo_lon, r6, register, sql_lat, sql_lon
from limnos.session import table

SCORE_FEATURES = ["doy", "x1", "lat", "lon"]
CAL_END = "2024-01-17"


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("x1"),
        pseudo_lat("c_custkey").alias("lat"), pseudo_lon("c_custkey").alias("lon"))


def linear_scorer(df: DataFrame) -> DataFrame:
    """A fixed linear model over (doy harmonics, x1, lat): stands in for a fitted one."""
    ang = F.lit(2.0 * math.pi) * F.col("doy") / F.lit(366.0)
    pred = (F.lit(12.0) + F.lit(0.001) * F.col("x1") + F.lit(3.0) * F.sin(ang) - F.lit(1.5) * F.cos(ang)
            + F.lit(0.2) * (F.col("lat") - F.lit(40.0)))
    return df.withColumn("predicted", pred)


_SNAP_SQL = f"""
s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x1,
             {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer),
f AS (SELECT c_custkey, coalesce(x1, (SELECT median(x1) FROM s)) AS x1, lat, lon FROM s)"""


def _pred_sql(doy: str) -> str:
    ang = f"((2 * pi()) * {doy} / CAST(366 AS DOUBLE))"
    return (f"(12.0 + 0.001 * x1 + 3.0 * sin({ang}) - 1.5 * cos({ang}) + 0.2 * (lat - 40.0))")


def score_entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 + E11: every station scored for 2026-05-01."""
    s = score_entities(_snapshot(spark, sf_dir), linear_scorer, "2026-05-01", SCORE_FEATURES)
    return s.select("c_custkey", r6("predicted").alias("predicted"))


register("score_entities", sql=f"""
WITH {_SNAP_SQL}
SELECT c_custkey, round({_pred_sql('CAST(121 AS DOUBLE)')}, 6) AS predicted FROM f
""")(score_entities_query)


def _calendar_dates():
    import datetime as dt
    start, stop = calendar_window(CAL_END)
    return [start + dt.timedelta(days=i) for i in range((stop - start).days + 1)]


def score_dates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 + J13 + A13: statewide mean prediction for each day of the calendar window."""
    d = score_dates(_snapshot(spark, sf_dir), linear_scorer, _calendar_dates(), SCORE_FEATURES)
    return d.select(iso_date("date").alias("date"), "doy", r6("mean_prediction").alias("mean_prediction"))


register("score_dates", sql=f"""
WITH {_SNAP_SQL},
d AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2023-10-15', TIMESTAMP '2024-01-20',
                                                       INTERVAL 1 DAY) t(x))
SELECT CAST(date AS VARCHAR) AS date, CAST(dayofyear(date) AS DOUBLE) AS doy,
       round(avg({_pred_sql('CAST(dayofyear(date) AS DOUBLE)')}), 6) AS mean_prediction
FROM d CROSS JOIN f GROUP BY date
""")(score_dates_query)


def score_calendar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 + W5 + S14: 14-week calendar ending on the Saturday after 2024-01-17."""
    daily = score_dates(_snapshot(spark, sf_dir), linear_scorer, _calendar_dates(), SCORE_FEATURES)
    cal = score_calendar(daily, CAL_END)
    return cal.select(iso_date("date").alias("date"), "week", "weekday", r6("value").alias("value"), "is_future",
                      "level", "month_label")


register("score_calendar", sql=f"""
WITH {_SNAP_SQL},
d AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2023-10-15', TIMESTAMP '2024-01-20',
                                                       INTERVAL 1 DAY) t(x)),
m AS (SELECT date, avg({_pred_sql('CAST(dayofyear(date) AS DOUBLE)')}) AS v FROM d CROSS JOIN f GROUP BY date),
c AS (SELECT date, datediff('day', DATE '2023-10-15', date) AS off,
             CASE WHEN date > DATE '{CAL_END}' THEN NULL ELSE v END AS v FROM m),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM c)
SELECT CAST(date AS VARCHAR) AS date, CAST(off // 7 AS INTEGER) AS week,
       ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][off % 7 + 1] AS weekday,
       round(v, 6) AS value, date > DATE '{CAL_END}' AS is_future,
       CASE WHEN date > DATE '{CAL_END}' THEN 0 WHEN hi <= lo THEN 2
            WHEN (v - lo) / (hi - lo) < 0.2 THEN 0 WHEN (v - lo) / (hi - lo) < 0.4 THEN 1
            WHEN (v - lo) / (hi - lo) < 0.6 THEN 2 WHEN (v - lo) / (hi - lo) < 0.8 THEN 3 ELSE 4 END AS level,
       CASE WHEN off // 7 = 0 OR strftime(date - CAST(off % 7 AS INTEGER), '%b')
                                 <> strftime(date - CAST(off % 7 AS INTEGER) - 7, '%b')
            THEN strftime(date - CAST(off % 7 AS INTEGER), '%b') ELSE '' END AS month_label
FROM c, b
""")(score_calendar_query)


def calendar_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current value, mean, peak and range of the past days in the calendar window."""
    daily = score_dates(_snapshot(spark, sf_dir), linear_scorer, _calendar_dates(), SCORE_FEATURES)
    s = calendar_summary(score_calendar(daily, CAL_END), CAL_END)
    return s.select(*[r6(c).alias(c) for c in ("current_value", "window_mean", "peak_value", "window_low")],
                    "days", iso_date("end_date").alias("end_date"))


register("calendar_summary", sql=f"""
WITH {_SNAP_SQL},
d AS (SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2023-10-15', TIMESTAMP '{CAL_END}',
                                                       INTERVAL 1 DAY) t(x)),
m AS (SELECT date, avg({_pred_sql('CAST(dayofyear(date) AS DOUBLE)')}) AS v FROM d CROSS JOIN f GROUP BY date)
SELECT round(arg_max(v, date), 6) AS current_value, round(avg(v), 6) AS window_mean, round(max(v), 6) AS peak_value,
       round(min(v), 6) AS window_low, count(*) AS days, '{CAL_END}' AS end_date
FROM m
""")(calendar_summary_query)


# ------------------------------------------------------------------ grids
def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", pseudo_lat("s_suppkey").alias("lat"), pseudo_lon("s_suppkey").alias("lon"),
        (F.col("s_acctbal") / F.lit(200.0)).alias("score"))


def _idw_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    st = _stations(spark, sf_dir)
    grid = make_grid(st, "lat", "lon", resolution=20, margin=0.5)
    return st, interpolate_idw(st, grid, station_id="s_suppkey", lat="lat", lon="lon", value="score", k=8)


def grid_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G2: 20 x 20 grid over the stations, IDW of the 8 nearest."""
    _, g = _idw_grid(spark, sf_dir)
    return g.select("cell_id", "row", "col", r6("lat").alias("lat"), r6("lon").alias("lon"),
                    r6("value").alias("value"))


_GRID_SQL = f"""
s AS (SELECT s_suppkey, s_name, {sql_lat('s_suppkey')} AS lat, {sql_lon('s_suppkey')} AS lon,
             s_acctbal / CAST(200 AS DOUBLE) AS score FROM supplier),
b AS (SELECT min(lat) - 0.5 AS a0, max(lat) + 0.5 AS a1, min(lon) - 0.5 AS b0, max(lon) + 0.5 AS b1 FROM s),
g AS (SELECT i AS cell_id, CAST(i // 20 AS INTEGER) AS row, CAST(i % 20 AS INTEGER) AS col FROM range(0, 400) t(i)),
gg AS (SELECT cell_id, row, col,
              CASE WHEN row = 19 THEN a1 ELSE a0 + CAST(row AS DOUBLE) * ((a1 - a0) / CAST(19 AS DOUBLE)) END AS lat,
              CASE WHEN col = 19 THEN b1 ELSE b0 + CAST(col AS DOUBLE) * ((b1 - b0) / CAST(19 AS DOUBLE)) END AS lon
       FROM g, b),
p AS (SELECT gg.cell_id, gg.row, gg.col, gg.lat, gg.lon, s.s_suppkey, s.score,
             (s.lat - gg.lat) * (s.lat - gg.lat) + (s.lon - gg.lon) * (s.lon - gg.lon) AS d2
      FROM gg CROSS JOIN s),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, s_suppkey) AS rn FROM p),
idw AS (SELECT cell_id, row, col, lat, lon,
               coalesce(arg_min(score, s_suppkey) FILTER (WHERE d2 = 0),
                        sum(score / pow(d2, 1.0)) FILTER (WHERE d2 <> 0)
                        / sum(1.0 / pow(d2, 1.0)) FILTER (WHERE d2 <> 0)) AS value
        FROM r WHERE rn <= 8 GROUP BY cell_id, row, col, lat, lon)"""

register("grid_idw", sql=f"""
WITH {_GRID_SQL}
SELECT cell_id, row, col, round(lat, 6) AS lat, round(lon, 6) AS lon, round(value, 6) AS value FROM idw
""")(grid_idw)


def grid_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 + G4 + F6 + W6 + S13 + P12: hull-masked IDW grid, clipped to the
    stations' 2nd..98th percentile, labelled, 100 cells sampled by hash,
    plus the labelled station rows."""
    st, g = _idw_grid(spark, sf_dir)
    inside = hull_mask(g, st, lat="lat", lon="lon")
    out = render_table(inside, st, target="Water Temperature", station_id="s_suppkey", lat="lat", lon="lon",
                       value="score", sample_n=100, seed=0, station_name="s_name")
    return out.select("kind", "id", "name", r6("lat").alias("lat"), r6("lon").alias("lon"),
                      r6("value").alias("value"), "unit", "label", "detail")


def _label_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'Unknown' WHEN {v} < 5 THEN 'Very Cold' WHEN {v} <= 20 THEN 'Moderate' "
            f"WHEN {v} <= 28 THEN 'Warm' ELSE 'Very Warm' END")


def _detail_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'No interpretation available.' "
            f"WHEN {v} < 5 THEN 'Cold-water conditions; fine for some species but stressful for others.' "
            f"WHEN {v} <= 20 THEN 'A generally favorable temperature range for many freshwater ecosystems.' "
            f"WHEN {v} <= 28 THEN 'Warmer water can begin reducing oxygen availability and increase stress.' "
            f"ELSE 'Potentially stressful for aquatic life, especially when oxygen is limited.' END")


register("grid_masked", sql=f"""
WITH {_GRID_SQL},
pts AS (SELECT DISTINCT lat, lon FROM s),
edges AS (SELECT a.lon AS x, a.lat AS y, b.lon - a.lon AS dx, b.lat - a.lat AS dy FROM pts a JOIN pts b ON a.lon <> b.lon OR a.lat <> b.lat
          WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE (b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon) < CAST('-1e-12' AS DOUBLE))),
inside AS (SELECT * FROM idw WHERE NOT EXISTS (
             SELECT 1 FROM edges e WHERE e.dx * (idw.lat - e.y) - e.dy * (idw.lon - e.x) < CAST('-1e-09' AS DOUBLE))),
q AS (SELECT quantile_cont(score, 0.02) AS lo, quantile_cont(score, 0.98) AS hi FROM s),
cl AS (SELECT cell_id, lat, lon, least(greatest(value, lo), hi) AS v FROM inside, q WHERE value IS NOT NULL),
smp AS (SELECT * FROM cl ORDER BY md5(CAST(cell_id AS VARCHAR) || chr(1) || '0'), cell_id LIMIT 100)
SELECT 'grid' AS kind, CAST(cell_id AS VARCHAR) AS id, 'Interpolated surface' AS name, round(lat, 6) AS lat,
       round(lon, 6) AS lon, round(v, 6) AS value, '°C' AS unit, {_label_sql('v')} AS label,
       {_detail_sql('v')} AS detail
FROM smp
UNION ALL
SELECT 'station', CAST(s_suppkey AS VARCHAR), coalesce(s_name, 'Unknown station'), round(lat, 6), round(lon, 6),
       round(round_even(score, 4), 6), '°C', {_label_sql('score')}, {_detail_sql('score')}
FROM s
""")(grid_masked)


def enriched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's score, interpretation and nearest named place."""
    pts = table(spark, sf_dir, "customer").select(
        "c_custkey", pseudo_lat("c_custkey").alias("lat"), pseudo_lon("c_custkey").alias("lon"),
        (F.col("c_acctbal") / F.lit(200.0)).alias("score"))
    nat = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", pseudo_lat("n_nationkey").alias("n_lat"), pseudo_lon("n_nationkey").alias("n_lon"))
    e = enrich_points(pts, nat, target="Water Temperature", lat="lat", lon="lon", value="score", place_lat="n_lat",
                      place_lon="n_lon", place_name="n_name", place_order="n_nationkey")
    return e.select("c_custkey", r6("score").alias("score"), "nearest_place", "label", "detail")


register("enriched_points", sql=f"""
WITH c AS (SELECT c_custkey, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon,
                  c_acctbal / CAST(200 AS DOUBLE) AS score FROM customer),
n AS (SELECT n_nationkey, n_name, {sql_lat('n_nationkey')} AS nlat, {sql_lon('n_nationkey')} AS nlon FROM nation),
r AS (SELECT c.*, n_name, row_number() OVER (PARTITION BY c_custkey
          ORDER BY (nlat - lat) * (nlat - lat) + (nlon - lon) * (nlon - lon), n_nationkey) AS rn FROM c CROSS JOIN n)
SELECT c_custkey, round(score, 6) AS score, coalesce(n_name, 'Iowa') AS nearest_place,
       {_label_sql('score')} AS label, {_detail_sql('score')} AS detail
FROM r WHERE rn = 1
""")(enriched_points)
