"""Catalogue: nearest-neighbour joins on pseudo-coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.spatial import nearest_join, nearest_label, nearest_name
from limnos.plans.registry import pseudo_lat, pseudo_lon, r6, register, sql_lat, sql_lon
from limnos.session import table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", pseudo_lat("c_custkey").alias("lat"), pseudo_lon("c_custkey").alias("lon"))


def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest supplier under the reference's planar-radian
    metric and under great-circle distance."""
    sup = table(spark, sf_dir, "supplier").select(
        "s_suppkey", pseudo_lat("s_suppkey").alias("s_lat"), pseudo_lon("s_suppkey").alias("s_lon"))
    a = nearest_join(_customers(spark, sf_dir), sup.withColumnRenamed("s_suppkey", "planar_suppkey"),
                     left_lat="lat", left_lon="lon", right_lat="s_lat", right_lon="s_lon",
                     right_cols=["planar_suppkey"], tie="planar_suppkey", metric="planar_rad",
                     distance_col="planar_km")
    b = nearest_join(a, sup.withColumnRenamed("s_suppkey", "hav_suppkey"),
                     left_lat="lat", left_lon="lon", right_lat="s_lat", right_lon="s_lon",
                     right_cols=["hav_suppkey"], tie="hav_suppkey", metric="haversine", distance_col="hav_km")
    return b.select("c_custkey", "planar_suppkey", r6("planar_km", 4).alias("planar_km"),
                    "hav_suppkey", r6("hav_km", 4).alias("hav_km"))


register("nearest_supplier", sql=f"""
WITH c AS (SELECT c_custkey, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer),
s AS (SELECT s_suppkey, {sql_lat('s_suppkey')} AS slat, {sql_lon('s_suppkey')} AS slon FROM supplier),
pairs AS (
  SELECT c_custkey, s_suppkey,
         (slat - lat) * (slat - lat) + (slon - lon) * (slon - lon) AS pkey,
         sqrt((radians(lat) - radians(slat)) * (radians(lat) - radians(slat))
              + (radians(lon) - radians(slon)) * (radians(lon) - radians(slon))) * 6371.0 AS pkm,
         sin(radians(slat - lat) / 2) * sin(radians(slat - lat) / 2)
           + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) * sin(radians(slon - lon) / 2) AS hkey
  FROM c CROSS JOIN s),
p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pkey, s_suppkey) AS prn,
                row_number() OVER (PARTITION BY c_custkey ORDER BY hkey, s_suppkey) AS hrn FROM pairs)
SELECT a.c_custkey, a.s_suppkey AS planar_suppkey, round(a.pkm, 4) AS planar_km,
       b.s_suppkey AS hav_suppkey, round(2 * 6371.0 * asin(sqrt(least(b.hkey, 1.0))), 4) AS hav_km
FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND a.prn = 1 AND b.hrn = 1
""")(nearest_supplier)


def nearest_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + J9: nearest named place (nations as places, first listed wins ties)
    and the nearest station's name with missing names read as ``Unknown``."""
    nat = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", pseudo_lat("n_nationkey").alias("n_lat"), pseudo_lon("n_nationkey").alias("n_lon"))
    places = nearest_label(_customers(spark, sf_dir), nat, lat="lat", lon="lon", place_lat="n_lat",
                           place_lon="n_lon", place_name="n_name", place_order="n_nationkey")
    stations = nat.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None))
                              .otherwise(F.col("n_name")))
    named = nearest_name(places, stations, lat="lat", lon="lon", station_lat="n_lat", station_lon="n_lon",
                         station_name="n_name", station_order="n_nationkey")
    return named.select("c_custkey", "nearest_place", "nearest_station_name")


register("nearest_nation", sql=f"""
WITH c AS (SELECT c_custkey, {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer),
n AS (SELECT n_nationkey, n_name, {sql_lat('n_nationkey')} AS nlat, {sql_lon('n_nationkey')} AS nlon FROM nation),
r AS (SELECT c_custkey, n_nationkey, n_name,
             row_number() OVER (PARTITION BY c_custkey
                                ORDER BY (nlat - lat) * (nlat - lat) + (nlon - lon) * (nlon - lon), n_nationkey) AS rn
      FROM c CROSS JOIN n)
SELECT c_custkey, coalesce(n_name, 'Iowa') AS nearest_place,
       CASE WHEN n_nationkey % 5 = 0 THEN 'Unknown' ELSE coalesce(n_name, 'Unknown') END AS nearest_station_name
FROM r WHERE rn = 1
""")(nearest_nation)
