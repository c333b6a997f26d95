"""Catalogue: features, imputation, splits, grouped OLS and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.features import DERIVED_COLS, add_derived_features, scoring_matrix, standardise
from limnos.operators.quality import drop_null_rows
from limnos.operators.regression import (coefficient_table, cv_ols, eligible_targets, exact_split, fit_ols, gram_rows,
                                         hash_folds, hash_split, key_hash, metric_lookup, predict_linear, regression_metrics)
from limnos.operators.reshape import best_per_group
from limnos.plans.registry import pseudo_lat, pseudo_lon, r6, register, sql_lat, sql_lon
from limnos.session import qcol, stored, table


# ------------------------------------------------------- seasonal features
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling-table stand-in: line items joined to their order, twelve
    canonical inputs mapped from TPC-H columns."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    high = F.col("l_extendedprice") / F.lit(1000.0)
    low = high - F.col("l_discount") * F.lit(100.0)
    return j.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity",
        F.dayofyear("o_orderdate").cast("double").alias("doy"),
        F.col("l_quantity").alias("gdd_40_86"),
        high.alias("high"), ((high - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)).alias("highc"),
        low.alias("low"), ((low - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)).alias("lowc"),
        (F.col("l_discount") * F.lit(10.0) - F.lit(0.3)).alias("precip"),
        F.col("l_tax").alias("snow"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_tax") * F.lit(2.0)).alias("snowd"),
        F.col("l_linenumber").cast("double").alias("distance_to_climate_station_km"),
        pseudo_lat("l_suppkey").alias("LatitudeMeasure"), pseudo_lon("l_suppkey").alias("LongitudeMeasure"))


_FEAT_SQL = f"""
feat AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, l_quantity,
         CAST(dayofyear(o_orderdate) AS DOUBLE) AS doy, l_quantity AS gdd_40_86,
         l_extendedprice / CAST(1000 AS DOUBLE) AS high,
         (l_extendedprice / CAST(1000 AS DOUBLE) - CAST(32 AS DOUBLE)) * CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE) AS highc,
         l_extendedprice / CAST(1000 AS DOUBLE) - l_discount * CAST(100 AS DOUBLE) AS low,
         (l_extendedprice / CAST(1000 AS DOUBLE) - l_discount * CAST(100 AS DOUBLE) - CAST(32 AS DOUBLE))
           * CAST(5 AS DOUBLE) / CAST(9 AS DOUBLE) AS lowc,
         l_discount * CAST(10 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS precip,
         l_tax AS snow,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * CAST(2 AS DOUBLE) END AS snowd,
         CAST(l_linenumber AS DOUBLE) AS distance_to_climate_station_km,
         {sql_lat('l_suppkey')} AS LatitudeMeasure, {sql_lon('l_suppkey')} AS LongitudeMeasure
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def seasonal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E6 + S15 + S16: the fourteen derived features, rounded."""
    f = add_derived_features(feature_frame(spark, sf_dir))
    return f.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in DERIVED_COLS])


register("seasonal_features", sql=f"""
WITH {_FEAT_SQL},
a AS (SELECT *, (2 * pi()) * doy / CAST(366 AS DOUBLE) AS ang, precip + snow + snowd AS moist FROM feat)
SELECT l_orderkey, l_linenumber,
       0.0 + round(sin(ang), 6) AS season_sin, 0.0 + round(cos(ang), 6) AS season_cos,
       0.0 + round(sin(2 * ang), 6) AS season2_sin, 0.0 + round(cos(2 * ang), 6) AS season2_cos,
       0.0 + round(high - low, 6) AS range_f, 0.0 + round(highc - lowc, 6) AS range_c,
       0.0 + round((highc + lowc) / CAST(2 AS DOUBLE), 6) AS mean_c,
       0.0 + round(moist, 6) AS moisture,
       0.0 + round(ln(1 + CASE WHEN moist IS NULL THEN NULL ELSE greatest(moist, 0.0) END), 6) AS log_moisture,
       0.0 + round(gdd_40_86 * greatest(precip, 0.0), 6) AS gdd_x_precip,
       CAST(CASE WHEN highc <= 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS frozen,
       0.0 + round(LatitudeMeasure * sin(ang), 6) AS lat_x_season_sin,
       0.0 + round(LongitudeMeasure * cos(ang), 6) AS lon_x_season_cos,
       0.0 + round(distance_to_climate_station_km * cos(ang), 6) AS dist_x_season_cos
FROM a
""")(seasonal_features)


# --------------------------------------------------------- imputed matrix
_SNAP_FEATURES = ["doy", "x1", "x2", "lat", "lon"]


def imputed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + E8 + E9 + E11: a station snapshot with planted gaps, scored for
    2026-05-01: ``doy`` from the date, exact medians filled, standardised."""
    k = F.col("c_custkey")
    snap = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("x1"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_nationkey").cast("double")).alias("x2"),
        pseudo_lat("c_custkey").alias("lat"), pseudo_lon("c_custkey").alias("lon"))
    m = scoring_matrix(snap, "2026-05-01", _SNAP_FEATURES, keep=["c_custkey"])
    z = standardise(m, _SNAP_FEATURES)
    return z.select("c_custkey", *[r6(c).alias(f"{c}_z") for c in _SNAP_FEATURES])


register("imputed_matrix", sql=f"""
WITH s AS (
  SELECT c_custkey, CAST(121 AS DOUBLE) AS doy,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x1,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS x2,
         {sql_lat('c_custkey')} AS lat, {sql_lon('c_custkey')} AS lon FROM customer),
f AS (SELECT c_custkey, doy, coalesce(x1, (SELECT median(x1) FROM s)) AS x1,
             coalesce(x2, (SELECT median(x2) FROM s)) AS x2, lat, lon FROM s),
st AS (SELECT avg(doy) AS md, coalesce(nullif(stddev_pop(doy), 0), 1) AS sd,
              avg(x1) AS m1, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1,
              avg(x2) AS m2, coalesce(nullif(stddev_pop(x2), 0), 1) AS s2,
              avg(lat) AS ma, coalesce(nullif(stddev_pop(lat), 0), 1) AS sa,
              avg(lon) AS mo, coalesce(nullif(stddev_pop(lon), 0), 1) AS so FROM f)
SELECT c_custkey, round((doy - md) / sd, 6) AS doy_z, round((x1 - m1) / s1, 6) AS x1_z,
       round((x2 - m2) / s2, 6) AS x2_z, round((lat - ma) / sa, 6) AS lat_z, round((lon - mo) / so, 6) AS lon_z
FROM f, st
""")(imputed_matrix)


# ------------------------------------------------------------ split sizes
def hash_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: rows per side of the seeded 80/20 hash split of ``orders``."""
    s = hash_split(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.2, 42)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"))


register("hash_split_sizes", sql="""
SELECT (('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 8))::BIGINT % 10000) < 2000 AS is_test,
       count(*) AS n_rows
FROM orders GROUP BY 1
""")(hash_split_sizes)


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: rows per hash fold of ``orders``."""
    f = hash_folds(table(spark, sf_dir, "orders"), ["o_orderkey"], 5, 42)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


register("fold_sizes", sql="""
SELECT CAST((('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':43'), 1, 8))::BIGINT % 10000) % 5 AS INTEGER) AS fold,
       count(*) AS n_rows
FROM orders GROUP BY 1
""")(fold_sizes)


def exact_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 exact: per order status exactly ceil(0.2 n) test rows, chosen by (hash, key)."""
    s = exact_split(table(spark, sf_dir, "orders"), ["o_orderkey"], by=["o_orderstatus"], test_fraction=0.2, seed=42)
    return s.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_test").alias("n_test"),
        F.sum(F.when(F.col("is_test"), F.col("o_orderkey"))).alias("test_key_sum"))


register("exact_split_sizes", sql="""
WITH h AS (SELECT o_orderstatus, o_orderkey, CAST(o_orderkey AS VARCHAR) AS k,
                  ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 1, 15))::BIGINT AS hv FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY hv, k) AS rn,
                count(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
SELECT o_orderstatus, count(*) AS n_rows,
       count(*) FILTER (WHERE rn <= ceil(CAST(0.2 AS DOUBLE) * n)) AS n_test,
       CAST(sum(o_orderkey) FILTER (WHERE rn <= ceil(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) AS test_key_sum
FROM r GROUP BY o_orderstatus
""")(exact_split_sizes)


# -------------------------------------------------------------------- OLS
_OLS_X = ["l_quantity", "l_discount", "l_tax"]


def ols_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 (pass 2): Gram sums of centred, scaled inputs per target."""
    g = gram_rows(table(spark, sf_dir, "lineitem"), _OLS_X, "l_extendedprice", by=["l_returnflag"])
    p = len(_OLS_X)
    return g.select(F.col("l_returnflag").alias("target"), "n", F.posexplode("szz").alias("pos", "v")).select(
        "target", "n", (F.col("pos") / p).cast("int").alias("term_i"), (F.col("pos") % p).cast("int").alias("term_j"),
        r6("v", 4).alias("gram"))


def _z(c: str) -> str:
    return (f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w "
            f"ELSE 0.0 END")


register("ols_moments", sql=f"""
WITH z AS (
  SELECT l_returnflag AS target, {_z('l_quantity')} AS z0, {_z('l_discount')} AS z1, {_z('l_tax')} AS z2
  FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL
  WINDOW w AS (PARTITION BY l_returnflag)),
g AS (SELECT target, count(*) AS n,
             [sum(z0*z0), sum(z0*z1), sum(z0*z2), sum(z1*z0), sum(z1*z1), sum(z1*z2),
              sum(z2*z0), sum(z2*z1), sum(z2*z2)] AS szz FROM z GROUP BY target)
SELECT target, n, CAST((i - 1) // 3 AS INTEGER) AS term_i, CAST((i - 1) % 3 AS INTEGER) AS term_j,
       round(szz[i], 4) AS gram
FROM g, range(1, 10) t(i)
""")(ols_moments)


def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: one-feature fit per target (slope, intercept, training R^2)."""
    fit = fit_ols(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", by=["l_returnflag"])
    return fit.select(F.col("l_returnflag").alias("target"), r6(F.col("coefficients")[0]).alias("slope"),
                      r6("intercept").alias("intercept"), r6("r2_train").alias("r2"))


register("ols_simple", sql="""
SELECT l_returnflag AS target, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
FROM lineitem GROUP BY l_returnflag
""")(ols_simple)


def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M3 + M4 + M5 + M10: per target an exact split of the complete rows, a multi-feature
    fit of the training side, and the long coefficient table with the sizes and the held-out
    metrics of its target (checked against numpy lstsq in pytest)."""
    by, keys, y = ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice"
    feats = ["doy", "gdd_40_86", "high", "low", "precip", "snow", "distance_to_climate_station_km",
             "LatitudeMeasure", "LongitudeMeasure"]
    rows = feature_frame(spark, sf_dir).select(*dict.fromkeys([*by, *keys, *feats]))
    for c in [*feats, y]:  # NaN is missing, as for the fit
        rows = rows.filter(~F.isnan(qcol(c)))
    # Stored once, with the hash of their keys: the split, the fit and the scores each read them.
    rows = stored(drop_null_rows(rows, [*by, *feats, y]).withColumn("__hash", key_hash(keys, 42)), "ols-multi")
    f = hash_split(rows, keys, 0.2, 42, by=by, rule="ols", hash_col="__hash")
    fit = stored(fit_ols(f.filter(~F.col("is_test")), feats, y, by=by), "ols-multi-fit")
    scored = predict_linear(f.filter(F.col("is_test")), fit, feats, by=by)
    metrics = regression_metrics(scored, y, "prediction", by).withColumnRenamed("n", "test_count")
    metrics = metrics.join(fit.select(*by, F.col("n_train").alias("train_count")), by)
    metrics = metrics.select(F.col("l_returnflag").alias("target_variable"), (F.col("train_count") + F.col("test_count")).alias("sample_count"),
                             "train_count", "test_count", "rmse", "mae", "r2")
    return coefficient_table(fit, feats, by=by, target_name="target_variable").join(metrics, "target_variable", "left")


register("ols_multi")(ols_multi)


def ols_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: 5-fold cross-validated R^2 (mean, population std) per target."""
    return cv_ols(table(spark, sf_dir, "lineitem"), _OLS_X, "l_extendedprice", by=["l_returnflag"],
                  key_cols=["l_orderkey", "l_linenumber", "l_extendedprice"])


register("ols_cv")(ols_cv)


# -------------------------------------------------------- eligible targets
register("eligible_targets", sql="""
SELECT event_type AS target, count(*) AS sample_count FROM events
WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL
GROUP BY event_type HAVING count(*) >= 1990 ORDER BY count(*) DESC, event_type LIMIT 3
""")(lambda spark, sf_dir: eligible_targets(table(spark, sf_dir, "events"), "event_type", ["user_id", "value"],
                                            min_samples=1990, top_n=3))


# -------------------------------------------------------- metrics by group
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + W3 + J14: metrics of two fixed linear guesses per target, best flagged."""
    li = table(spark, sf_dir, "lineitem")
    long = li.select(F.col("l_returnflag").alias("target"), "l_extendedprice",
                     F.explode(F.array(
                         F.struct(F.lit("g900").alias("model"), F.lit(0).alias("spec"),
                                  (F.col("l_quantity") * F.lit(900.0)).alias("pred")),
                         F.struct(F.lit("g1000").alias("model"), F.lit(1).alias("spec"),
                                  (F.col("l_quantity") * F.lit(1000.0)).alias("pred")))).alias("m")
                     ).select("target", "l_extendedprice", "m.*")
    m = regression_metrics(long, "l_extendedprice", "pred", by=["target", "model", "spec"], zero_variance="sklearn")
    m = best_per_group(m, ["target"], "r2", ["spec"], flag="best_model_for_target")
    return m.select("target", "model", "n", *[r6(c).alias(c) for c in ("r2", "rmse", "mae", "error_rate_pct")],
                    "best_model_for_target")


register("metrics_by_group", sql="""
WITH long AS (
  SELECT l_returnflag AS target, l_extendedprice AS y, 'g900' AS model, 0 AS spec, l_quantity * 900.0 AS p FROM lineitem
  UNION ALL
  SELECT l_returnflag, l_extendedprice, 'g1000', 1, l_quantity * 1000.0 FROM lineitem),
m AS (
  SELECT target, model, spec, count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst,
         avg(abs(y - p)) AS mae,
         avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0.0 ELSE 2.0 * abs(y - p) / (abs(y) + abs(p)) END) * 100.0 AS smape
  FROM long GROUP BY target, model, spec),
r AS (SELECT *, CASE WHEN sst > 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM m)
SELECT target, model, n, round(r2, 6) AS r2, round(sqrt(sse / n), 6) AS rmse, round(mae, 6) AS mae,
       round(smape, 6) AS error_rate_pct,
       row_number() OVER (PARTITION BY target ORDER BY r2 DESC, spec) = 1 AS best_model_for_target
FROM r
""")(metrics_by_group)


def metric_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of one (target, model) pair."""
    return metric_lookup(metrics_by_group(spark, sf_dir), "A", "g1000")


register("metric_lookup", sql="""
WITH long AS (
  SELECT l_returnflag AS target, l_extendedprice AS y, 'g900' AS model, 0 AS spec, l_quantity * 900.0 AS p FROM lineitem
  UNION ALL
  SELECT l_returnflag, l_extendedprice, 'g1000', 1, l_quantity * 1000.0 FROM lineitem),
m AS (
  SELECT target, model, spec, count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst,
         avg(abs(y - p)) AS mae,
         avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0.0 ELSE 2.0 * abs(y - p) / (abs(y) + abs(p)) END) * 100.0 AS smape
  FROM long GROUP BY target, model, spec),
r AS (SELECT *, CASE WHEN sst > 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM m),
b AS (SELECT target, model, n, round(r2, 6) AS r2, round(sqrt(sse / n), 6) AS rmse, round(mae, 6) AS mae,
             round(smape, 6) AS error_rate_pct,
             row_number() OVER (PARTITION BY target ORDER BY r2 DESC, spec) = 1 AS best_model_for_target FROM r)
SELECT * FROM b WHERE target = 'A' AND model = 'g1000'
""")(metric_row)
