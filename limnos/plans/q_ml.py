"""Catalogue: model families, boosting, training loop and ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.boosting import BoostingSettings, BoostingUnit, fit_boosting, predict_boosted
from limnos.operators.features import FEATURE_COLS
from limnos.operators.learners import (BOOSTING, FOREST, LINEAR, Ledger, ModelSpec, TargetSpec, fit_model, load_models, predict,
                                       save_model, train_all)
from limnos.operators.regression import hash_folds, hash_split, regression_metrics
from limnos.plans.q_model import feature_frame
from limnos.plans.registry import register
from limnos.session import scratch_path, stored, table

KEYS = ["l_orderkey", "l_linenumber", "l_extendedprice"]
PRICE = TargetSpec("Price", "price_k", (0.0, 200.0), False, "price")
QUANTITY = TargetSpec("Quantity", "l_quantity", (1.0, 50.0), True, "quantity")


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_frame(spark, sf_dir).withColumn("price_k", F.col("l_extendedprice") / F.lit(1000.0))


def _split_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with its split, stored once for medians, fit and scoring."""
    return stored(hash_split(_frame(spark, sf_dir), KEYS, 0.2, 42), "ml-data")


def _fit_save_score(spark: SparkSession, sf_dir: str, spec: ModelSpec) -> DataFrame:
    """M6/M7/M8 + IO6: fit on the training split, save, reload, score the test split."""
    data, folder = _split_frame(spark, sf_dir), scratch_path(spark, "models")
    save_model(fit_model(data.filter(~F.col("is_test")), spec, FEATURE_COLS, PRICE.column, key_cols=KEYS), folder, spec, PRICE)
    reloaded = load_models(folder, [PRICE], [spec])[PRICE.label, spec.name]
    scored = predict(reloaded, data.filter(F.col("is_test")))
    return scored.select("l_orderkey", "l_linenumber", "price_k", "predicted")


register("ml_lr")(lambda spark, sf_dir: _fit_save_score(spark, sf_dir, LINEAR))
register("ml_rf")(lambda spark, sf_dir: _fit_save_score(spark, sf_dir, FOREST))
register("ml_gb")(lambda spark, sf_dir: _fit_save_score(spark, sf_dir, BOOSTING))


def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12 + E10: the metrics table over two targets x three families
    (the count target is fitted on log1p and predicted through expm1)."""
    metrics, _ = train_all(_frame(spark, sf_dir), [PRICE, QUANTITY], [LINEAR, FOREST, BOOSTING],
                           key_cols=KEYS, folds=5)
    return metrics


register("train_metrics")(train_metrics)

_KEY_MD5 = "md5(concat_ws(':', l_orderkey, l_linenumber, '{seed}'))"


def train_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12 + E8 + E10: the linear family for two targets through the ledger, and a second call that
    finds every unit done.  A plain and a log target: sizes, finished units, and whether the scores hold up."""
    ledger, frame = scratch_path(spark, "ledger"), _frame(spark, sf_dir)
    metrics, _ = train_all(frame, [PRICE, QUANTITY], [LINEAR], key_cols=KEYS, ledger_dir=ledger)
    _, again = train_all(frame, [PRICE, QUANTITY], [LINEAR], key_cols=KEYS, ledger_dir=ledger)
    units = len(Ledger(spark, ledger).rows())
    exact = F.when(F.col("target") == PRICE.label, (F.col("r2") > 1 - 1e-9) & (F.col("cv_r2_mean") > 1 - 1e-9) & (F.col("cv_r2_std") < 1e-9))
    return metrics.select("target", "model", "rows_before_filter", "rows_used", "train_rows", "test_rows",
                          exact.otherwise((F.col("r2") > 0.5) & (F.col("cv_r2_mean") > 0.5)).alias("scores_hold"),
                          F.col("best_model_for_target").cast("boolean").alias("best"), F.lit(units).cast("long").alias("units"), F.lit(len(again)).cast("long").alias("refitted"))


register("train_ledger", sql=f"""
WITH d AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT target, '{LINEAR.name}' AS model, n AS rows_before_filter, n AS rows_used, CAST(n - ceil(0.2 * n) AS BIGINT) AS train_rows, CAST(ceil(0.2 * n) AS BIGINT) AS test_rows,
       TRUE AS scores_hold, TRUE AS best, CAST(12 AS BIGINT) AS units, CAST(0 AS BIGINT) AS refitted
FROM d, (SELECT unnest(['{PRICE.label}', '{QUANTITY.label}']) AS target)
""")(train_ledger)


# --------------------------------------------------------- boosting, exactly
_STUMPS = BoostingSettings(learning_rate=0.5, rounds=2, least_rows=5, l2=0.1, leaves=2, stop_above=1 << 60)


def _stump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("z"),
                                                   (F.col("l_extendedprice") / F.lit(1000.0)).cast("double").alias("y"))


def boosting_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: two boosted trees of one split each, with L2 and a learning rate, over two inputs; predictions by input values."""
    rows = _stump_rows(spark, sf_dir)
    models, _ = fit_boosting([BoostingUnit("all", rows, ["x", "z"], "y", KEYS, _STUMPS)])
    scored = predict_boosted(rows.select("x", "z"), {"all": models[0]}, ["x", "z"])
    return scored.groupBy("x", "z").agg(F.count("*").alias("n"), F.round(F.max("prediction"), 4).alias("predicted"))


_CUTS = """
{name}_cuts AS (
  SELECT f, c, sum(CASE WHEN v <= c THEN 1 ELSE 0 END) AS cl, sum(CASE WHEN v <= c THEN g ELSE 0 END) AS gl, count(*) AS n, sum(g) AS gs
  FROM (SELECT 0 AS f, x AS v, g FROM {name} UNION ALL SELECT 1, z, g FROM {name}) JOIN (
    SELECT DISTINCT 0 AS f, x AS c FROM {name} UNION SELECT DISTINCT 1, z FROM {name}) USING (f) GROUP BY f, c),
{name}_best AS (
  SELECT f, c, -0.5 * gl / (cl + 0.1) AS low, -0.5 * (gs - gl) / (n - cl + 0.1) AS high FROM {name}_cuts WHERE cl >= 5 AND n - cl >= 5
  ORDER BY gl * gl / (cl + 0.1) + (gs - gl) * (gs - gl) / (n - cl + 0.1) DESC, f, c LIMIT 1)"""
register("boosting_two_rounds", sql=f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS z, CAST(l_extendedprice / 1000.0 AS DOUBLE) AS y FROM lineitem),
b AS (SELECT avg(y) AS base FROM d),
r1 AS (SELECT x, z, y, base - y AS g FROM d, b),{_CUTS.format(name="r1")},
r2 AS (SELECT x, z, y, g + CASE WHEN (CASE f WHEN 0 THEN x ELSE z END) <= c THEN low ELSE high END AS g FROM r1, r1_best),{_CUTS.format(name="r2")}
SELECT x, z, count(*) AS n, round(max(y + g + CASE WHEN (CASE f WHEN 0 THEN x ELSE z END) <= c THEN low ELSE high END), 4) AS predicted FROM r2, r2_best GROUP BY x, z
""")(boosting_two_rounds)


def boosting_cv_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 for trees: five folds trained in lockstep, one split each; fold scores."""
    rows = stored(hash_folds(_stump_rows(spark, sf_dir), KEYS[:2], 5, 42, "fold"), "stump-rows")
    settings = BoostingSettings(learning_rate=1.0, rounds=1, least_rows=5, leaves=2, stop_above=1 << 60)
    units = [BoostingUnit(str(f), rows.filter(F.col("fold") != f), ["x"], "y", KEYS, settings) for f in range(5)]
    models, _ = fit_boosting(units)
    scored = predict_boosted(rows.select("x", "y", F.col("fold").cast("string").alias("fold")), {str(f): m for f, m in enumerate(models)}, ["x"], by="fold")
    found = regression_metrics(scored, "y", "prediction", ["fold"], zero_variance="sklearn")
    return found.select("fold", F.col("n").cast("long").alias("n"), F.round("r2", 5).alias("r2"), F.round("rmse", 4).alias("rmse"))


register("boosting_cv_stump", sql=f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice / 1000.0 AS DOUBLE) AS y,
                  (CAST('0x' || substr({_KEY_MD5.format(seed=43)}, 1, 8) AS BIGINT) % 10000) % 5 AS fold FROM lineitem),
t AS (SELECT k.f, x, y FROM d JOIN (SELECT unnest(range(5)) AS f) k ON fold <> k.f),
cuts AS (SELECT t.f, c, sum(CASE WHEN x <= c THEN 1 ELSE 0 END) AS cl, sum(CASE WHEN x <= c THEN y ELSE 0 END) AS sl, count(*) AS n, sum(y) AS s
         FROM t, (SELECT DISTINCT x AS c FROM d) GROUP BY t.f, c),
best AS (SELECT f, c, sl / cl AS low, (s - sl) / (n - cl) AS high,
                row_number() OVER (PARTITION BY f ORDER BY sl * sl / cl + (s - sl) * (s - sl) / (n - cl) - s * s / n DESC, c) AS k FROM cuts WHERE cl >= 5 AND n - cl >= 5),
p AS (SELECT fold, y, CASE WHEN x <= c THEN low ELSE high END AS p FROM d JOIN best ON fold = f AND k = 1)
SELECT CAST(fold AS VARCHAR) AS fold, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM p GROUP BY fold
""")(boosting_cv_stump)
