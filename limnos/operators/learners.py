"""Model families, training loop with a ledger, persistence (M6-M9, M11, M12, IO6, E10).

The linear family is a plain ``PipelineModel``: SQLTransformer (median fill, values
baked in as text) -> SQLTransformer (derived features) -> SQLTransformer (the line) ->
SQLTransformer (``predicted``, with ``expm1`` for log-target models); it saves and loads
with Spark's own ML persistence.  Gradient boosting (``operators.boosting``) is a
``BoostedPipeline`` and a forest (``operators.forest``) a ``ForestPipeline``: the same
preparation, then trees that are saved as Parquet tables.  No pickles.  Spark's own
linear solver and forest stay available as families ``spark_lr`` and ``spark_rf``.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from limnos.operators.boosting import BoostedModel, BoostingSettings, BoostingUnit, fit_boosting, predict_boosted
from limnos.operators.forest import ForestModel, ForestSettings, fit_forest, predict_forest
from limnos.operators.features import DERIVED_COLS, FEATURE_COLS, derived_feature_sql, fit_median_imputer
from limnos.operators.quality import filter_range
from limnos.operators.stats import medians_outside
from limnos.operators.regression import exact_split, fit_ols, fit_ols_parts, hash_bucket, hash_folds, key_hash, regression_metrics
from limnos.session import qcol, scratch_path, stored


@dataclass(frozen=True)
class ModelSpec:
    """One model family with its estimator parameters."""

    name: str
    family: str  # "lr" (one-pass OLS) | "rf" | "gb" | "spark_lr", "spark_rf" (Spark ML's)
    params: Mapping[str, object] = field(default_factory=dict)
    file_prefix: str = ""
    #: Partitions a forest bootstraps in; part of the model, as another number gives another forest.
    layout: int = 16


# Model file prefixes (lr, rf, gb) and the reference's model settings; the forest tries
# the square root of the number of inputs at each split and has no depth limit.
LINEAR = ModelSpec("Linear Regression", "lr", {}, "lr")
FOREST = ModelSpec("Random Forest", "rf", {"trees": 500, "least_split": 4, "least_leaf": 2}, "rf")
BOOSTING = ModelSpec("Gradient Boosting", "gb", {"learning_rate": 0.03, "max_depth": 10, "rounds": 700,
                                                 "least_rows": 5, "l2": 0.1}, "gb")
BOOSTING_NITRATE = ModelSpec("Gradient Boosting", "gb", {"learning_rate": 0.05, "max_depth": 8, "rounds": 500,
                                                         "least_rows": 10, "l2": 0.1}, "gb")
# Per-target families as the reference trains them.
DEFAULT_SPECS = {"*": [LINEAR, FOREST, BOOSTING], "Nitrate": [LINEAR, FOREST, BOOSTING_NITRATE]}


@dataclass(frozen=True)
class TargetSpec:
    """A modelling target: label column, valid range, optional log1p transform."""

    label: str
    column: str
    valid_range: tuple[float, float]
    log_target: bool = False
    file_stem: str = ""


# Targets, their columns and valid physical ranges.
DEFAULT_TARGETS = (
    TargetSpec("Water Temperature", "Temperature, water_value", (-5.0, 45.0), False, "water_temperature"),
    TargetSpec("pH", "pH_value", (0.0, 14.0), False, "ph"),
    TargetSpec("Dissolved Oxygen", "Dissolved oxygen (DO)_value", (0.0, 30.0), False, "dissolved_oxygen"),
    TargetSpec("Nitrate", "Nitrate_value", (0.0, 50.0), True, "nitrate"),
)

MIN_SAMPLES = 50  # fixed value: fewer rows train no model


def _estimator(spec: ModelSpec, features_col: str, label_col: str, seed: int):
    p = dict(spec.params)
    if spec.family in ("lr", "spark_lr"):
        return LinearRegression(featuresCol=features_col, labelCol=label_col, **p)
    if spec.family == "spark_rf":
        return RandomForestRegressor(featuresCol=features_col, labelCol=label_col, seed=seed, **p)
    raise ValueError(f"unknown family {spec.family!r}")


def _preprocess_stages(features: Sequence[str], medians: Mapping[str, float | None], derived: bool = True
                       ) -> tuple[list, list[str]]:
    """SQLTransformer stages: median fill, then the derived features; returns (stages, model inputs)."""
    filled = {f: f"__in_{i}" for i, f in enumerate(features)}
    fill_sql = ", ".join(
        f"coalesce(`{f}`, CAST({medians.get(f)!r} AS DOUBLE)) AS `{filled[f]}`" if medians.get(f) is not None
        else f"CAST(`{f}` AS DOUBLE) AS `{filled[f]}`" for f in features)
    stages = [SQLTransformer(statement=f"SELECT *, {fill_sql} FROM __THIS__")]
    inputs = [filled[f] for f in features]
    if derived:
        mapping = {canon: filled.get(canon) for canon in FEATURE_COLS}
        exprs = derived_feature_sql(mapping)
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(
            f"{text} AS `__d_{name}`" for name, text in exprs.items()) + " FROM __THIS__"))
        inputs += [f"__d_{n}" for n in DERIVED_COLS]
    return stages, inputs


def _output_stage(log_target: bool) -> SQLTransformer:
    out = "expm1(prediction)" if log_target else "prediction"
    return SQLTransformer(statement=f"SELECT *, {out} AS predicted FROM __THIS__")


def build_pipeline(spec: ModelSpec, features: Sequence[str], medians: Mapping[str, float | None],
                   log_target: bool = False, label_col: str = "__label", seed: int = 42,
                   derived: bool = True) -> Pipeline:
    """M7/M8 (and Spark's own linear solver, family ``spark_lr``): imputer ->
    derived features -> assembler -> [scaler] -> estimator -> output."""
    stages, inputs = _preprocess_stages(features, medians, derived)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__raw", handleInvalid="keep"))
    vec = "__raw"
    if spec.family in ("lr", "spark_lr"):
        stages.append(StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True))
        vec = "__scaled"
    stages.append(_estimator(spec, vec, label_col, seed))
    stages.append(_output_stage(log_target))
    return Pipeline(stages=stages)


def _fit_linear(data: DataFrame, features: Sequence[str], medians: Mapping[str, float | None],
                log_target: bool) -> PipelineModel:
    """M6: least squares on standardised inputs (minimum-norm for collinear
    columns, as a scaler + OLS pipeline does), solved from one Gram pass; the
    fitted line is baked into a SQLTransformer, so the model is a plain,
    persistable PipelineModel."""
    stages, inputs = _preprocess_stages(features, medians)
    prepared = data
    for stage in stages:
        prepared = stage.transform(prepared)
    fit = fit_ols(prepared.select(*[qcol(c) for c in inputs], F.col("__label")), inputs, "__label").first()
    return _line_pipeline(stages, inputs, fit, log_target)


def _line_pipeline(stages: Sequence, inputs: Sequence[str], fit, log_target: bool) -> PipelineModel:
    if fit is None:
        raise ValueError("no complete training rows")
    terms = " + ".join(f"CAST({b!r} AS DOUBLE) * `{c}`" for b, c in zip(fit["coefficients"], inputs, strict=True))
    line = SQLTransformer(statement=f"SELECT *, CAST({fit['intercept']!r} AS DOUBLE) + {terms} AS prediction "
                                    "FROM __THIS__")
    return PipelineModel(stages=[*stages, line, _output_stage(log_target)])


def fit_linear_folds(data: DataFrame, features: Sequence[str], medians: Mapping[int, Mapping[str, float | None]], log_target: bool) -> dict[int, PipelineModel]:
    """M6 for the training sets of several folds in one pass over ``data`` (features, ``__label``, ``__cv_fold``).

    ``medians`` by fold: of the rows outside it, or of all rows for ``WHOLE``.  A row whose missing values are filled
    alike in every set is summed once, for its own fold; another is summed once for each distinct filling.
    """
    fills: list[dict] = []
    version_of = {}
    for fold, found in medians.items():
        fill = {f: found.get(f) for f in features}
        if fill not in fills:
            fills.append(fill)
        version_of[fold] = fills.index(fill)
    varying = [f for f in features if any(x[f] != fills[0][f] for x in fills)]
    version = F.lit(-1)
    if varying:
        lacking = reduce(lambda a, b: a | b, [qcol(f).isNull() for f in varying])
        version = F.explode(F.when(lacking, F.array(*[F.lit(v) for v in range(len(fills))])).otherwise(F.array(F.lit(-1))))
    rows = data.withColumn("__version", version)
    for f in varying:
        filled = F.element_at(F.array(*[F.lit(x[f]).cast("double") for x in fills]), F.greatest(F.col("__version"), F.lit(0)) + 1)
        rows = rows.withColumn(f, F.coalesce(qcol(f).cast("double"), filled))
    stages, inputs = _preprocess_stages(features, {f: None if f in varying else fills[0][f] for f in features})
    for stage in stages:
        rows = stage.transform(rows)
    mine = lambda fold: (F.col("__version") == -1) | (F.col("__version") == version_of[fold])
    uses = [mine(fold) if fold == WHOLE else mine(fold) & (F.col("__cv_fold") != fold) for fold in medians]
    fits = {r["fit"]: r for r in fit_ols_parts(rows, inputs, "__label", ["__version", "__cv_fold"], uses).collect()}
    return {fold: _line_pipeline(*_preprocess_stages(features, medians[fold]), fits.get(k), log_target) for k, fold in enumerate(medians)}


@dataclass
class BoostedPipeline:
    """Median fill -> derived features -> boosted trees -> ``predicted``; ``transform`` as a PipelineModel."""

    features: list[str]
    medians: dict[str, float | None]
    log_target: bool
    model: BoostedModel

    def transform(self, df: DataFrame) -> DataFrame:
        stages, inputs = _preprocess_stages(self.features, self.medians)
        for stage in stages:
            df = stage.transform(df)
        df = predict_boosted(df, {"": self.model}, inputs)
        return _output_stage(self.log_target).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        nodes, cuts = self.model.tables()
        meta = json.dumps({"features": self.features, "medians": self.medians, "log_target": self.log_target, "inputs": self.model.inputs,
                           "base": self.model.base, "scale": self.model.scale})
        spark.createDataFrame(nodes, "tree int, node int, feature int, cut int, left int, right int, step long").write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(cuts, "input int, position int, threshold double").write.mode("overwrite").parquet(f"{path}/thresholds")
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedPipeline:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()]
        cuts = [tuple(r) for r in spark.read.parquet(f"{path}/thresholds").collect()]
        model = BoostedModel.from_tables(meta["inputs"], meta["base"], meta["scale"], nodes, cuts)
        return cls(meta["features"], meta["medians"], meta["log_target"], model)


@dataclass
class ForestPipeline:
    """Median fill -> derived features -> forest -> ``predicted``; ``transform`` as a PipelineModel."""

    features: list[str]
    medians: dict[str, float | None]
    log_target: bool
    model: ForestModel

    def transform(self, df: DataFrame) -> DataFrame:
        stages, _ = _preprocess_stages(self.features, self.medians)
        for stage in stages:
            df = stage.transform(df)
        return _output_stage(self.log_target).transform(predict_forest(df, self.model))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.save(path, spark)
        meta = json.dumps({"features": self.features, "medians": self.medians, "log_target": self.log_target})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/preparation")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestPipeline:
        meta = json.loads(spark.read.parquet(f"{path}/preparation").first()["meta"])
        return cls(meta["features"], meta["medians"], meta["log_target"], ForestModel.load(path, spark))


@dataclass
class BoostingJob:
    """One boosted model to fit: rows with the features, keys and ``__label``."""

    data: DataFrame
    spec: ModelSpec
    features: Sequence[str]
    medians: Mapping[str, float | None]
    log_target: bool
    key_cols: Sequence[str]


def fit_boosted(jobs: Sequence[BoostingJob], seed: int = 42) -> list[BoostedPipeline]:
    """M8: all models in lockstep, one Spark job a tree level for all of them."""
    units = []
    for number, job in enumerate(jobs):
        stages, inputs = _preprocess_stages(job.features, job.medians)
        data = job.data
        for stage in stages:
            data = stage.transform(data)
        units.append(BoostingUnit(str(number), data, inputs, "__label", list(job.key_cols) or list(job.features), BoostingSettings(**job.spec.params)))
    models, _ = fit_boosting(units, seed)
    return [BoostedPipeline(list(j.features), dict(j.medians), j.log_target, m) for j, m in zip(jobs, models, strict=True)]


def _drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__") or c == "prediction"])


def fit_model(train: DataFrame, spec: ModelSpec, features: Sequence[str], label: str, log_target: bool = False,
              key_cols: Sequence[str] = (), seed: int = 42, medians: Mapping[str, float | None] | None = None
              ) -> PipelineModel:
    """Fit one pipeline; medians are learned on ``train``.

    Spark ML's forests bootstrap per partition, so their input is first laid out by a
    hash of ``key_cols`` and sorted: the same rows give the same forest
    whatever the upstream partitioning was.
    """
    lab = F.log1p(qcol(label)) if log_target else qcol(label)
    cols = list(dict.fromkeys([*features, *key_cols]))
    data = train.select(*[qcol(c) for c in cols], lab.cast("double").alias("__label"))
    if spec.family == "spark_rf" and key_cols:
        data = data.repartition(spec.layout, *[qcol(k) for k in key_cols]).sortWithinPartitions(*[qcol(k) for k in key_cols])
    # The fit makes several passes (medians, scaler, solver / tree levels): keep only the
    # needed columns in memory for its duration.  A line with known medians takes one pass.
    if medians is None or spec.family != "lr":
        data = data.cache()
    try:
        if medians is None:
            medians = fit_median_imputer(data, features)
        if spec.family == "lr":
            return _fit_linear(data, features, medians, log_target)
        if spec.family == "gb":
            return fit_boosted([BoostingJob(data, spec, features, medians, log_target, key_cols)], seed)[0]
        if spec.family == "rf":
            stages, inputs = _preprocess_stages(features, medians)
            prepared = data
            for stage in stages:
                prepared = stage.transform(prepared)
            forest = fit_forest(prepared, inputs, "__label", list(key_cols) or list(features), ForestSettings(seed=seed, **spec.params))
            return ForestPipeline(list(features), dict(medians), log_target, forest)
        return build_pipeline(spec, features, medians, log_target, seed=seed).fit(data)
    finally:
        data.unpersist()


def predict(model, df: DataFrame) -> DataFrame:
    """Input rows plus ``predicted``."""
    return _drop_internal(model.transform(df))


def _fold_medians(data: DataFrame, features: Sequence[str], folds: int) -> dict[int, dict[str, float | None]]:
    """Every training fold's medians, and those of all rows (``WHOLE``), in one search."""
    return {WHOLE if f is None else f: found for f, found in medians_outside(data, "__cv_fold", range(folds), features).items()}


def _score(model, rows: DataFrame, label: str) -> dict:
    found = regression_metrics(predict(model, rows), label, "predicted", zero_variance="sklearn").first()
    return found.asDict() if found is not None else {"n": 0}


def _mean_std(scores: Sequence[float]) -> tuple[float, float]:
    if not scores:
        return float("nan"), float("nan")
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def cross_validate(df: DataFrame, spec: ModelSpec, features: Sequence[str], label: str, key_cols: Sequence[str],
                   folds: int = 5, seed: int = 42, log_target: bool = False) -> tuple[float, float]:
    """M9: k-fold R^2 (mean, population std); medians are re-learned per training fold.

    Boosted folds are trained in lockstep, lines in one pass, forests one after another.
    """
    data = hash_folds(df, key_cols, folds, seed, "__cv_fold").cache()
    try:
        medians = _fold_medians(data, features, folds)
        train = lambda f: data.filter(F.col("__cv_fold") != f)
        if spec.family == "lr":
            fitted = fit_linear_folds(_with_label(data, label, log_target), features, {f: medians[f] for f in range(folds)}, log_target)
            models = [fitted[f] for f in range(folds)]
        elif spec.family == "gb":
            models = fit_boosted([BoostingJob(_with_label(train(f), label, log_target), spec, features, medians[f], log_target, key_cols) for f in range(folds)], seed)
        else:
            models = [fit_model(train(f), spec, features, label, log_target, key_cols, seed, medians[f]) for f in range(folds)]
        found = [_score(m, data.filter(F.col("__cv_fold") == f), label) for f, m in enumerate(models)]
    finally:
        data.unpersist()
    return _mean_std([m["r2"] for m in found if m["n"]])


def _with_label(df: DataFrame, label: str, log_target: bool) -> DataFrame:
    return df.withColumn("__label", (F.log1p(qcol(label)) if log_target else qcol(label)).cast("double"))


# ------------------------------------------------------------- training ledger
#: Rows of the ledger and the model index are appended one at a time.
_APPENDING = threading.Lock()
LEDGER_SCHEMA = "target string, model string, fold int, n long, r2 double, rmse double, mae double, error_rate_pct double"
#: The fold number of the model that is fitted on all training rows and scored on the test rows.
WHOLE = -1


class Ledger:
    """Finished training units, one stored row each: (target, model, fold) and the metrics."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> dict[tuple[str, str, int], dict]:
        try:
            found = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path).collect()
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            found = []
        return {(r.target, r.model, r.fold): r.asDict() for r in found}

    def add(self, target: str, model: str, fold: int, metrics: Mapping[str, object]) -> None:
        row = (target, model, fold, metrics.get("n", 0), *[metrics.get(k) for k in ("r2", "rmse", "mae", "error_rate_pct")])
        with _APPENDING:
            self.spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def _at_once(spark: SparkSession, tasks: Sequence[Callable[[], None]], most: int) -> None:
    """Run independent units as concurrent Spark jobs, each in a scheduler pool of its own."""
    def in_pool(number: int, task: Callable[[], None]) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"unit-{number % most}")
        try:
            task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(most) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(in_pool), k, t) for k, t in enumerate(tasks)]
        errors = [f.exception() for f in running]
    for error in errors:
        if error is not None:
            raise error


def train_all(df: DataFrame, targets: Sequence[TargetSpec], specs: Sequence[ModelSpec] | Mapping[str, Sequence[ModelSpec]],
              features: Sequence[str] = FEATURE_COLS, key_cols: Sequence[str] = (), folds: int = 5,
              test_fraction: float = 0.2, seed: int = 42, min_samples: int = MIN_SAMPLES,
              model_dir: str | None = None, exact_sizes: bool = True, ledger_dir: str | None = None, at_once: int = 2
              ) -> tuple[DataFrame, dict[tuple[str, str], object]]:
    """M11 + M12: per target and family — range filter, gate, split, CV, fit,
    holdout metrics, best flag; optionally persist the models.

    A unit is one (target, family, fold) fit.  Each finished unit is a row of the
    ledger in ``ledger_dir``; a restart with the same folder fits only what lacks a
    row.  ``at_once`` units run as concurrent jobs; boosted units of a target run in
    lockstep, and its lines are fitted in one pass.  Models are returned for the units fitted in this call, and saved in
    ``model_dir`` before their row is written.  Returns the metrics table (one row
    per target x family) and the models.
    """
    spark = df.sparkSession
    ledger = Ledger(spark, ledger_dir or scratch_path(spark, "ledger"))
    family_of = lambda t: list(specs.get(t.label, specs.get("*", [])) if isinstance(specs, Mapping) else specs)
    done = ledger.rows()
    if all((t.label, s.name, f) in done for t in targets for s in family_of(t) for f in (*range(folds), WHOLE)):
        # Nothing is left to fit: only the sides' sizes are asked for.
        df = df.select(*[qcol(c) for c in dict.fromkeys([*key_cols, *[t.column for t in targets]])])
    else:
        df = hash_folds(df, key_cols, folds, seed, "__cv_fold")
    # Every target counts, splits and fits these rows: they are made once, with what the split and the folds need of their keys.
    if exact_sizes:
        df = df.withColumn("__hash", key_hash(key_cols, seed))
    df = stored(df, "training-rows")
    # Filters on the stored rows see these counts first: one pass for all targets.
    columns = {t.label: qcol(t.column) for t in targets}
    sizes = df.agg(F.lit(0), *[x for k, t in enumerate(targets) for x in (F.count(columns[t.label]).alias(f"before{k}"), F.count_if(columns[t.label].between(*t.valid_range)).alias(f"used{k}"))]).first()
    plan, models = [], {}
    for k, t in enumerate(targets):
        kept = filter_range(df.filter(columns[t.label].isNotNull()), t.column, *t.valid_range)
        counts = {"before": sizes[f"before{k}"], "used": sizes[f"used{k}"]}
        if counts["used"] < min_samples:
            continue
        if exact_sizes:    # test = ceil(fraction * n) exactly, as the reference's splitter
            split = exact_split(kept, key_cols, test_fraction=test_fraction, seed=seed, rule="sklearn", col="__test", hash_col="__hash", aside=["__cv_fold"]).drop("__hash")
        else:
            split = kept.withColumn("__test", hash_bucket(key_cols, seed) < F.lit(int(round(test_fraction * 10_000))))
        train, test = split.filter(~F.col("__test")).drop("__test"), split.filter(F.col("__test")).drop("__test")
        family = family_of(t)
        wanted = [(s, f) for s in family for f in (*range(folds), WHOLE) if (t.label, s.name, f) not in done]
        if wanted:
            _train_target(spark, t, train, test, wanted, features, key_cols, folds, seed, ledger, model_dir, models, at_once)
        sides = split.agg(F.count_if(~F.col("__test")).alias("train"), F.count_if("__test").alias("test")).first()
        plan.append((t, family, counts, sides["train"], sides["test"]))
    done, rows = ledger.rows(), []
    for t, family, counts, n_train, n_test in plan:
        for rank, spec in enumerate(family):
            cv = _mean_std([done[t.label, spec.name, f]["r2"] for f in range(folds) if done[t.label, spec.name, f]["n"]])
            m = done[t.label, spec.name, WHOLE]
            rows.append((t.label, t.column, spec.name, rank, counts["before"], counts["used"], n_train, n_test, *cv, m["r2"], m["rmse"], m["mae"], m["error_rate_pct"]))
    schema = ("target string, target_column string, model string, spec_rank int, rows_before_filter long, "
              "rows_used long, train_rows long, test_rows long, cv_r2_mean double, cv_r2_std double, r2 double, "
              "rmse double, mae double, error_rate_pct double")
    metrics = spark.createDataFrame(rows, schema)
    from limnos.operators.reshape import best_per_group
    metrics = best_per_group(metrics, ["target"], "r2", ["spec_rank"], flag="best_model_for_target")
    return metrics.drop("spec_rank"), models


def _train_target(spark, t: TargetSpec, train: DataFrame, test: DataFrame, wanted: Sequence[tuple[ModelSpec, int]], features, key_cols, folds: int, seed: int,
                  ledger: Ledger, model_dir: str | None, models: dict, at_once: int) -> None:
    """Fit the wanted units of one target and write their rows."""
    medians = _fold_medians(train, features, folds)
    rows_of = lambda f: train if f == WHOLE else train.filter(F.col("__cv_fold") != f)
    held_of = lambda f: test if f == WHOLE else train.filter(F.col("__cv_fold") == f)

    def finish(spec: ModelSpec, fold: int, model) -> None:
        if fold == WHOLE:
            models[(t.label, spec.name)] = model
            if model_dir:
                save_model(model, model_dir, spec, t, spark)
        ledger.add(t.label, spec.name, fold, _score(model, held_of(fold), t.column))

    def one(spec: ModelSpec, fold: int) -> Callable[[], None]:
        return lambda: finish(spec, fold, fit_model(rows_of(fold), spec, features, t.column, t.log_target, key_cols, seed, medians[fold]))

    lines = [(s, f) for s, f in wanted if s.family == "lr"]
    if lines:
        fitted = fit_linear_folds(_with_label(train, t.column, t.log_target), features, {f: medians[f] for _, f in lines}, t.log_target)
        _at_once(spark, [lambda s=s, f=f: finish(s, f, fitted[f]) for s, f in lines], at_once)
    _at_once(spark, [one(s, f) for s, f in wanted if s.family not in ("lr", "gb")], at_once)
    boosted = [(s, f) for s, f in wanted if s.family == "gb"]
    if boosted:
        fitted = fit_boosted([BoostingJob(_with_label(rows_of(f), t.column, t.log_target), s, features, medians[f], t.log_target, key_cols) for s, f in boosted], seed)
        for (s, f), model in zip(boosted, fitted, strict=True):
            finish(s, f, model)


# ------------------------------------------------------------- persistence
def model_path(model_dir: str, spec: ModelSpec, target: TargetSpec) -> str:
    return os.path.join(model_dir, f"{spec.file_prefix or spec.family}_{target.file_stem or target.label}")


MODEL_INDEX = "prefix string, stem string, kind string"


def save_model(model, model_dir: str, spec: ModelSpec, target: TargetSpec, spark: SparkSession | None = None) -> str:
    """IO6: persist one fitted model as ``{prefix}_{stem}`` (overwrite) and list it in the folder's index."""
    path, spark = model_path(model_dir, spec, target), spark or SparkSession.getActiveSession()
    kind = {BoostedPipeline: "boosted", ForestPipeline: "forest"}.get(type(model), "pipeline")
    if kind != "pipeline":
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    row = (spec.file_prefix or spec.family, target.file_stem or target.label, kind)
    with _APPENDING:
        spark.createDataFrame([row], MODEL_INDEX).coalesce(1).write.mode("append").parquet(os.path.join(model_dir, "index"))
    return path


def load_model(path: str, kind: str):
    own = {"boosted": BoostedPipeline, "forest": ForestPipeline}.get(kind)
    return own.load(SparkSession.getActiveSession(), path) if own else PipelineModel.load(path)


def load_models(model_dir: str, targets: Sequence[TargetSpec], specs: Sequence[ModelSpec]) -> dict[tuple[str, str], object]:
    """IO6: load every (target, family) model that the folder lists; missing ones are skipped."""
    try:
        listed = {(r.prefix, r.stem): r.kind for r in SparkSession.getActiveSession().read.schema(MODEL_INDEX).parquet(os.path.join(model_dir, "index")).collect()}
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out = {}
    for t in targets:
        for s in specs:
            kind = listed.get((s.file_prefix or s.family, t.file_stem or t.label))
            if kind is not None:
                out[(t.label, s.name)] = load_model(model_path(model_dir, s, t), kind)
    return out
