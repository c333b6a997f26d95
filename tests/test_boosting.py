"""Histogram boosting against a plain version, and the training ledger."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import boosting, learners
from limnos.operators.boosting import BoostingSettings, BoostingUnit, fit_boosting, predict_boosted
from limnos.operators.learners import LINEAR, Ledger, ModelSpec, TargetSpec, fit_model, load_models, predict, save_model, train_all


def make(n, p, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)) * 4) / 2
    y = 3 * (x[:, 0] > 0.4) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.3
    return x, y


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", y double")


def plain(x, y, s):
    """Predictions of best-first trees over all midpoints, by trying every split of every leaf."""
    f, base = np.zeros(len(y)), y.mean()
    for _ in range(s.rounds):
        g = base + f - y
        leaves = [(np.arange(len(y)), 0)]

        def best(rows, depth, g=g):
            found = (0.0, None)
            if s.max_depth is not None and depth >= s.max_depth:
                return found
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    left = x[rows, j] <= cut
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) >= s.least_rows:
                        gain = g[a].sum() ** 2 / (len(a) + s.l2) + g[b].sum() ** 2 / (len(b) + s.l2) - g[rows].sum() ** 2 / (len(rows) + s.l2)
                        if gain > found[0] + 1e-9:
                            found = (gain, (a, b))
            return found

        gains = [best(*leaf) for leaf in leaves]
        while len(leaves) < s.leaves and max(gain for gain, _ in gains) > 0:
            k = max(range(len(leaves)), key=lambda i: gains[i][0])
            parts = [(part, leaves[k][1] + 1) for part in gains[k][1]]
            leaves[k:k + 1] = parts
            gains[k:k + 1] = [best(*part) for part in parts]
        for rows, _ in leaves:
            f[rows] -= s.learning_rate * g[rows].sum() / (len(rows) + s.l2)
    return base + f


@pytest.mark.parametrize("settings", [
    BoostingSettings(0.3, 6, 4, 5, 0.1, 6), BoostingSettings(0.5, 4, None, 2, 1.0, 31), BoostingSettings(1.0, 3, 1, 1, 0.0, 4), BoostingSettings(0.1, 12, 3, 10, 0.5, 5)])
def test_matches_plain_boosting(spark, settings):
    x, y = make(400, 4, 7)
    df = frame(spark, x, y)
    models, jobs = fit_boosting([BoostingUnit("a", df, [f"x{j}" for j in range(4)], "y", ["id"], settings)])
    got = predict_boosted(df, {"": models[0]}, [f"x{j}" for j in range(4)]).orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.allclose(got, plain(x, y, settings), atol=1e-6)
    assert max(len(t.cut) for t in models[0].trees) <= 2 * settings.leaves - 1
    assert jobs < settings.rounds * settings.leaves


def test_lockstep_partitions_and_restarted_workers_change_nothing(spark):
    x, y = make(700, 3, 3)
    df, s = frame(spark, x, y), BoostingSettings(0.2, 8, 5, 3, 0.1, 8)
    other = BoostingSettings(0.4, 5, 2, 3, 0.1, 4)
    unit = lambda d, settings: BoostingUnit("u", d, ["x0", "x1", "x2"], "y", ["id"], settings)
    alone, apart = fit_boosting([unit(df, s)])[0][0], fit_boosting([unit(df, other)])[0][0]
    both = fit_boosting([unit(df.repartition(7), s), unit(df.repartition(3), other)])[0]
    for a, b in ((alone, both[0]), (apart, both[1])):
        assert a.tables() == b.tables()
    # A worker without a memo computes the predictions again from the trees.
    bins = alone.binned(x)
    memo = boosting._current("run", 1, bins, 8, lambda k: alone.trees[k])
    assert (memo == boosting._current("other run", 1, bins, 8, lambda k: alone.trees[k])).all()


def test_early_stopping_and_odd_tables(spark):
    x = make(600, 3, 5)[0][:, :2]
    noise = frame(spark, x, np.random.default_rng(1).normal(size=600))
    s = BoostingSettings(0.3, 200, 4, 5, 0.1, 8, stop_above=100, patience=5)
    model = fit_boosting([BoostingUnit("a", noise, ["x0", "x1"], "y", ["id"], s)])[0][0]
    loss = model.held_loss
    assert 5 < len(loss) < 200 and not any(v < loss[-6] - 1e-7 for v in loss[-5:])
    empty = noise.limit(0)
    constant = noise.withColumn("y", F.lit(2.5)).withColumn("x0", F.when(F.col("id") % 2 == 0, F.col("x0")))
    unlabelled = noise.withColumn("y", F.lit(None).cast("double"))
    models = fit_boosting([BoostingUnit("a", d, ["x0", "x1"], "y", ["id"], s) for d in (empty, constant, unlabelled)])[0]
    assert [m.predict(np.array([[1.0, np.nan]]))[0] for m in models] == [0.0, 2.5, 0.0]


def test_missing_values_have_a_bin_of_their_own(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 4 != 0, (F.col("id") % 7).cast("double")).alias("x0"), F.when(F.col("id") % 4 == 0, 9.0).otherwise(1.0).alias("y"))
    model = fit_boosting([BoostingUnit("a", df, ["x0"], "y", ["id"], BoostingSettings(1.0, 1, 1, 1))])[0][0]
    assert model.predict(np.array([[np.nan], [3.0]])) == pytest.approx([9.0, 1.0], abs=1e-6)


FEATURES = ["x0", "x1"]
BOOSTED = ModelSpec("gb", "gb", {"learning_rate": 0.3, "rounds": 5, "max_depth": 3, "least_rows": 2, "l2": 0.1}, "gb")
TARGET = TargetSpec("T", "a, b.value", (-100.0, 100.0), False, "t")
LOGGED = TargetSpec("L", "logged", (0.0, 1e6), True, "l")


def training_frame(spark):
    x, y = make(260, 3, 9)
    x = x[:, :2]
    return frame(spark, x, y).withColumn("a, b.value", F.col("y")).withColumn("logged", F.exp(F.col("y"))).drop("y")


def test_save_and_load(spark, tmp_path):
    df = training_frame(spark)
    folder = str(tmp_path / "models")
    assert load_models(folder, [TARGET], [BOOSTED]) == {}
    for target in (TARGET, LOGGED):
        model = fit_model(df, BOOSTED, FEATURES, target.column, target.log_target, ["id"])
        save_model(model, folder, BOOSTED, target)
        save_model(model, folder, BOOSTED, target)  # overwrites
    loaded = load_models(folder, [TARGET, LOGGED], [BOOSTED, LINEAR])
    assert set(loaded) == {("T", "gb"), ("L", "gb")}
    scored = predict(loaded["L", "gb"], df)
    again = predict(fit_model(df, BOOSTED, FEATURES, "logged", True, ["id"]), df)
    assert scored.columns == [*df.columns, "predicted"]
    assert {r.id: r.predicted for r in scored.collect()} == {r.id: r.predicted for r in again.collect()}


def test_a_restart_fits_only_what_lacks_a_row(spark, tmp_path, monkeypatch):
    df, folder = training_frame(spark), str(tmp_path / "ledger")
    specs, fits = [LINEAR, BOOSTED], []
    fit, boosted = learners.fit_model, learners.fit_boosted
    monkeypatch.setattr(learners, "fit_model", lambda *a, **k: fits.append(1) or fit(*a, **k))
    monkeypatch.setattr(learners, "fit_boosted", lambda jobs, seed: fits.extend(jobs) or boosted(jobs, seed))
    add, kept = Ledger.add, []

    def add_some(self, target, model, fold, metrics):
        if len(kept) == 5:
            raise InterruptedError
        kept.append((target, model, fold))
        add(self, target, model, fold, metrics)

    monkeypatch.setattr(Ledger, "add", add_some)
    with pytest.raises(InterruptedError):
        train_all(df, [TARGET], specs, FEATURES, ["id"], folds=3, ledger_dir=folder, at_once=1)
    assert set(Ledger(spark, folder).rows()) == set(kept) and len(kept) == 5
    monkeypatch.setattr(Ledger, "add", add)
    fits.clear()
    metrics, _ = train_all(df, [TARGET], specs, FEATURES, ["id"], folds=3, ledger_dir=folder)
    assert len(fits) == 8 - 5
    whole, models = train_all(df, [TARGET], specs, FEATURES, ["id"], folds=3)
    assert sorted(map(tuple, metrics.collect())) == sorted(map(tuple, whole.collect()))
    assert set(models) == {("T", "Linear Regression"), ("T", "gb")} and metrics.count() == 2


def test_rows_move_on_from_their_last_place(spark, monkeypatch, tmp_path):
    from pyspark import SparkFiles
    monkeypatch.setattr(SparkFiles, "getRootDirectory", classmethod(lambda cls: str(tmp_path)))
    rng = np.random.default_rng(4)
    bins, label, held = rng.integers(0, 9, (500, 3)).astype(np.uint8), rng.integers(-90, 90, 500), rng.random(500) < 0.2
    small = boosting._tree([1, 0, 0], [3, 255, 255], [1, 1, 2], [2, 1, 2], [0, 0, 0])
    large = boosting._tree([1, 0, 2, 0, 0], [3, 255, 5, 255, 255], [1, 1, 3, 3, 4], [2, 1, 4, 3, 4], [0] * 5)
    final = boosting._tree([1, 0, 0], [3, 255, 255], [1, 1, 2], [2, 1, 2], [0, 7, -5])
    moved, whole = [], boosting.leaf_of
    monkeypatch.setattr(boosting, "leaf_of", lambda b, t, node=None: moved.append(node is not None) or whole(b, t, node))
    offset = np.array([0, 9, 18, 27])

    def asked(done, tree, grows, slots):
        recent = [(final, np.array([0, 1, 2, 2, 2]))] * done
        (out,) = boosting._histograms("r", {0: (done, tree, grows, np.array(slots), 2)}, {0: offset}, None, {0: recent}, 0)(iter([(0, 5, bins, label, held)]))
        leaf, gradient = whole(bins, tree), (final.step[whole(bins, final)] * done) - label
        for slot in range(2):
            for k, side in ((0, ~held), (2, held)):
                mine = side & (np.array(slots)[leaf] == slot)
                for j in range(3):
                    assert (out[0][slot, k, 9 * j:9 * j + 9] == np.bincount(bins[mine, j], minlength=9)).all()
                    assert (out[0][slot, k + 1, 9 * j:9 * j + 9] == np.bincount(bins[mine, j], gradient[mine], 9)).all()

    asked(0, small, True, [-1, 0, 1])
    asked(0, large, True, [-1, -1, -1, 1, 0])
    asked(1, final, False, [-1, 1, 0])  # rows reach the first tree's leaves from their places
    asked(1, small, True, [-1, 0, 1])
    assert moved == [False, True, True, False, False]
