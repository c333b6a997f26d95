"""Forests over shared histograms against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import forest
from limnos.operators.forest import ForestModel, ForestSettings, fit_forest, predict_forest

INPUTS = ["x0", "x1", "x2", "x3", "x4"]


def make(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)) * 6) / 2
    x[:, 3] = 1.0  # never parts the rows
    y = np.where(x[:, 0] > 0.4, 5.0, 0.0) + x[:, 1] + rng.normal(size=n) * 0.1
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in INPUTS) + ", `y.1` double")


def plain_tree(bins, label, weight, name, s):
    """Prediction of each row by recursion over its own node's rows."""
    out, p = np.zeros(len(label), np.int64), bins.shape[1]

    def go(rows, everyone, name):
        w, y = weight[rows].sum(), (weight[rows] * label[rows]).sum()
        best = (0.0, None, None)
        if len(rows) >= s.least_split and len(set(label[rows])) > 1:
            valid = False
            for tried, f in enumerate(forest.input_order(np.array([name], np.uint64), p)[0]):
                if tried >= max(1, int(np.sqrt(p))) and valid:
                    break
                for cut in sorted(set(bins[rows, f]))[:-1]:
                    a = rows[bins[rows, f] <= cut]
                    if min(len(a), len(rows) - len(a)) >= s.least_leaf:
                        valid = True
                        gain = float(forest._gain(np.array([(weight[a] * label[a]).sum()]), np.array([weight[a].sum()]), np.array([y]), np.array([w]))[0])
                        if gain > best[0]:
                            best = (gain, f, cut)
        if best[1] is None:
            out[everyone] = int(np.rint(y / w))
            return
        a, b = forest.child_names(np.array([name], np.uint64))
        for side, child in ((True, a[0]), (False, b[0])):
            go(rows[(bins[rows, best[1]] <= best[2]) == side], everyone[(bins[everyone, best[1]] <= best[2]) == side], child)

    go(np.flatnonzero(weight > 0), np.arange(len(label)), name)
    return out


def predictions(df):
    return df.orderBy("id").toPandas()["prediction"].to_numpy()


@pytest.mark.parametrize("small", [16_384, 150, 40])
def test_matches_plain_trees_whatever_grows_in_one_group(spark, small):
    df, s = make(spark, 500, 3), ForestSettings(trees=6, small_rows=small)
    model = fit_forest(df, INPUTS, "y.1", ["id"], s)
    rows = df.orderBy("id").toPandas()
    bins = forest.bin_values(rows[INPUTS].to_numpy(float), model.thresholds)
    label = np.rint((rows["y.1"].to_numpy() - model.base) * model.scale).astype(np.int64)
    keys = df.select("id", F.xxhash64("id").alias("k")).orderBy("id").toPandas()["k"].to_numpy()
    total = np.zeros(len(label), np.int64)
    for t in range(s.trees):
        seed = forest.tree_seed(s.seed, t)
        total += plain_tree(bins, label, forest.weights(keys, seed), seed, s)
    got = predict_forest(df, model)
    assert got.columns == [*df.columns, "prediction"]
    assert np.allclose(predictions(got), model.base + total / (s.trees * model.scale), atol=1e-9)
    assert small > 500 or any(len(u[0]) > 1 for u in model.uppers)


def test_partitions_chunks_and_saved_model_change_nothing(spark, tmp_path, monkeypatch):
    df, s = make(spark, 600, 5), ForestSettings(trees=8, small_rows=100)
    model = fit_forest(df, INPUTS, "y.1", ["id"], s)
    want = predictions(predict_forest(df, model))
    assert (predictions(predict_forest(df, fit_forest(df.repartition(7), INPUTS, "y.1", ["id"], s))) == want).all()
    model.save(str(tmp_path / "m"), spark)
    monkeypatch.setattr(forest, "CHUNK_BYTES", 10_000)
    assert (predictions(predict_forest(df.repartition(3), ForestModel.load(str(tmp_path / "m"), spark))) == want).all()
    label = df.orderBy("id").toPandas()["y.1"].to_numpy()
    assert 1 - ((label - want) ** 2).mean() / label.var() > 0.9


def test_odd_tables(spark):
    df, s = make(spark, 60, 1), ForestSettings(trees=3)
    assert predictions(predict_forest(df, fit_forest(df.limit(0), INPUTS, "y.1", ["id"], s))).tolist() == [0.0] * 60
    constant = df.withColumn("y.1", F.lit(4.5)).withColumn("x0", F.lit(None).cast("double"))
    assert predictions(predict_forest(constant, fit_forest(constant, INPUTS, "y.1", ["id"], s))) == pytest.approx([4.5] * 60)
    repeated = df.unionByName(df).unionByName(df)
    assert predict_forest(repeated, fit_forest(repeated, INPUTS, "y.1", ["id"], s)).count() == 180


def test_weights_are_poisson_numbers():
    w = forest.weights(np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 200_000), forest.tree_seed(1, 3))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
