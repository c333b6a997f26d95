import os

import duckdb
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from limnos.operators.learners import BOOSTING, FOREST, LINEAR, ModelSpec, fit_model, predict
from limnos.plans import q_ml, q_more
from limnos.plans.q_model import feature_frame
from limnos.operators.features import FEATURE_COLS
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def frame(spark):
    return feature_frame(spark, SF_SMALL).withColumn("y", F.col("l_extendedprice") / 1000.0).cache()


def test_pipeline_save_load_roundtrip(spark, frame, tmp_path):
    model = fit_model(frame, LINEAR, FEATURE_COLS, "y")
    a = predict(model, frame).agg(F.sum("predicted")).first()[0]
    model.write().overwrite().save(str(tmp_path / "lr"))
    b = predict(PipelineModel.load(str(tmp_path / "lr")), frame).agg(F.sum("predicted")).first()[0]
    assert a == pytest.approx(b, rel=1e-12)


def test_log_target_and_forest_layout(spark, frame):
    gb = ModelSpec("gb", "gb", {"rounds": 3, "max_depth": 3})
    m = fit_model(frame, gb, FEATURE_COLS, "l_quantity", log_target=True)
    assert predict(m, frame).filter(F.col("predicted") <= -1).count() == 0
    rf = ModelSpec("rf", "rf", {"trees": 4})
    keys = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    s1 = predict(fit_model(frame, rf, FEATURE_COLS, "y", key_cols=keys), frame).agg(F.sum("predicted")).first()[0]
    s2 = predict(fit_model(frame.repartition(5), rf, FEATURE_COLS, "y", key_cols=keys), frame) \
        .agg(F.sum("predicted")).first()[0]
    assert s1 == pytest.approx(s2, rel=1e-12)


def test_registered_models_have_the_reference_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_ml, "_fit_save_score", lambda spark, sf_dir, spec: seen.append(spec))
    for name in ("ml_lr", "ml_rf", "ml_gb"):
        entry.queries()[name](spark, SF_SMALL)
    assert seen == [LINEAR, FOREST, BOOSTING]
    monkeypatch.setattr(q_ml, "train_all", lambda df, targets, specs, **kw: (seen.append((specs, kw["folds"])), None))
    entry.queries()["train_metrics"](spark, SF_SMALL)
    assert seen[3:] == [([LINEAR, FOREST, BOOSTING], 5)]
    monkeypatch.setattr(q_more, "fit_model", lambda df, spec, *a, **kw: seen.append(spec))
    monkeypatch.setattr(q_more, "save_model", lambda *a: (_ for _ in ()).throw(InterruptedError()))
    for name in ("lr_invariants", "rf_invariants"):
        with pytest.raises(InterruptedError):
            entry.queries()[name](spark, SF_SMALL)
    assert seen[4:] == [LINEAR, FOREST]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "click_value" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


FAST = ["flagship_wide_join", "match_rate", "clean_strings", "lenient_casts", "unit_standardise", "classify_values",
        "latest_per_user", "year_month_joins", "nearest_supplier", "seasonal_features", "ols_simple", "score_calendar",
        "grid_masked"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    mine = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(want.columns)

    def norm(df):
        out = []
        for row in df[cols].astype(object).itertuples(index=False):
            out.append(tuple(None if (isinstance(v, float) and v != v) or v is None
                             else (round(v, 6) if isinstance(v, float) else v) for v in row))
        return sorted(out, key=lambda t: tuple((v is not None, str(v)) for v in t))
    assert norm(mine) == norm(want)


def test_train_all_makes_its_rows_once(spark):
    from limnos.operators.learners import LINEAR, TargetSpec, train_all
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(200).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id * 37 % 11 AS DOUBLE) AS y", "CAST(id % 5 AS DOUBLE) AS z")
    source = rows.mapInPandas(counted, rows.schema)
    from limnos.operators import learners
    features = list(learners.FEATURE_COLS)
    source = source.withColumns({f: source["x"] + source["k"] * (i % 3) for i, f in enumerate(features)})
    metrics, _ = train_all(source, [TargetSpec("y", "y", (0.0, 20.0)), TargetSpec("z", "z", (0.0, 20.0))], [LINEAR], key_cols=["k"], folds=2)
    assert {(r["target"], r["train_rows"], r["test_rows"]) for r in metrics.collect()} == {("y", 160, 40), ("z", 160, 40)}
    assert made.value == 200


def test_lines_of_all_folds_in_one_pass(spark, monkeypatch):
    from limnos.operators import learners, regression
    from limnos.operators.features import fit_median_imputer
    passes, whole_pass = [], regression._task_moments
    monkeypatch.setattr(regression, "_task_moments", lambda *a, **k: passes.append(1) or whole_pass(*a, **k))
    features = list(learners.FEATURE_COLS)
    # Each input lacks some values, so that the folds' medians differ.
    rows = spark.range(400).withColumn("y", F.sin("id") * 9.0)
    rows = rows.withColumns({f: F.when(F.col("id") % (7 + i) != 0, F.sin(F.col("id") * (i + 2)) * 5.0 + F.cos(F.col("id") * 0.1 * i)) for i, f in enumerate(features)})
    rows = learners.hash_folds(rows, ["id"], 4, 42, "__cv_fold").withColumn("__label", F.col("y")).cache()
    medians = learners._fold_medians(rows, features, 4)
    assert len({tuple(m.values()) for m in medians.values()}) == 5
    models = learners.fit_linear_folds(rows, features, medians, False)
    assert len(passes) == 1
    for fold, model in models.items():
        train = rows if fold == learners.WHOLE else rows.filter(F.col("__cv_fold") != fold)
        assert medians[fold] == fit_median_imputer(train, features)
        alone = fit_model(train, LINEAR, features, "y")
        both = [[r.predicted for r in predict(m, rows).orderBy("id").collect()] for m in (model, alone)]
        assert both[0] == pytest.approx(both[1], abs=1e-8)


def test_train_all_fits_lines_and_medians_of_a_target_in_shared_passes(spark, monkeypatch):
    from limnos.operators import learners
    from limnos.operators.learners import TargetSpec, train_all
    monkeypatch.setattr(learners, "fit_model", lambda *a, **k: pytest.fail("a line fitted alone"))
    features = list(learners.FEATURE_COLS)
    rows = spark.range(300).withColumns({"y": F.col("id") % 11 * 1.0, "z": F.col("id") % 5 * 1.0})
    rows = rows.withColumns({f: F.sin(F.col("id") * (i + 1)) for i, f in enumerate(features)})
    metrics, models = train_all(rows, [TargetSpec("y", "y", (0.0, 8.0)), TargetSpec("z", "z", (0.0, 20.0))], [LINEAR], key_cols=["id"], folds=3)
    kept = sum(k % 11 <= 8 for k in range(300))
    assert {(r["target"], r["rows_before_filter"], r["rows_used"], r["train_rows"] + r["test_rows"], r["test_rows"]) for r in metrics.collect()} == \
        {("y", 300, kept, kept, -(-kept // 5)), ("z", 300, 300, 300, 60)}
    assert set(models) == {("y", LINEAR.name), ("z", LINEAR.name)}
