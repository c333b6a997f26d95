import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators.regression import (coefficient_table, cv_ols, fit_ols, gram_rows, hash_folds, hash_split,
                                         predict_linear, regression_metrics)
from limnos.operators.stats import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=3000)
    b = np.concatenate([np.full(2000, 7.25), rng.uniform(0, 10, 1000)])  # one value holds 2/3 of rows
    pdf = [(float(x), float(y) if i % 5 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(pdf, "a double, b double")
    ps = [0.02, 0.25, 0.5, 0.75, 0.98]
    got = exact_quantiles(df, ["a", "b"], ps)
    bb = np.array([y for _, y in pdf if y is not None])
    assert np.allclose(got["a"], np.percentile(a, [p * 100 for p in ps]), rtol=0, atol=1e-12)
    assert np.allclose(got["b"], np.percentile(bb, [p * 100 for p in ps]), rtol=0, atol=1e-12)
    empty = exact_quantiles(df.filter(F.lit(False)), ["a"], [0.5])
    assert empty == {"a": [None]}


def _groups(spark):
    rng = np.random.default_rng(5)
    data = []
    for g, n in (("A", 200), ("B", 150), ("C", 40)):
        x = rng.normal(size=(n, 3))
        y = 3 + x @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.1, size=n) + (ord(g) - 65)
        for i in range(n):
            data.append((g, i, float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(2 * x[i, 0]), 1.0, float(y[i])))
    return spark.createDataFrame(data, "g string, id int, x0 double, x1 double, x2 double, x0b double, "
                                       "c double, y double"), data


def test_fit_ols_matches_lstsq_with_collinear_and_constant(spark):
    df, data = _groups(spark)
    feats = ["x0", "x1", "x2", "x0b", "c"]                             # x0b = 2*x0, c constant
    fit = {r.g: r for r in fit_ols(df, feats, "y", by=["g"]).collect()}
    pred = predict_linear(df, fit_ols(df, feats, "y", by=["g"]), feats, by=["g"]).collect()
    for g in ("A", "B", "C"):
        rows = [r for r in data if r[0] == g]
        X = np.array([[1.0, *r[2:7]] for r in rows])
        y = np.array([r[7] for r in rows])
        beta = np.linalg.lstsq(X, y, rcond=None)[0]
        mine = {r.id: r.prediction for r in pred if r.g == g}
        assert np.allclose([mine[r[1]] for r in rows], X @ beta, atol=1e-8)
        assert fit[g].r2_train > 0.99
    coefs = coefficient_table(fit_ols(df, ["x0", "x1"], "y", by=["g"]), ["x0", "x1"], by=["g"])
    first = coefs.filter("g = 'A'").orderBy("position").collect()
    assert [r.feature for r in first] == ["intercept", "x0", "x1"]


def test_one_feature_equals_closed_form(spark):
    df, data = _groups(spark)
    fit = fit_ols(df, ["x0"], "y").first()
    x = np.array([r[2] for r in data])
    y = np.array([r[7] for r in data])
    slope = np.cov(x, y, bias=True)[0, 1] / np.var(x)
    assert np.isclose(fit.coefficients[0], slope, rtol=1e-10)
    assert np.isclose(fit.intercept, y.mean() - slope * x.mean(), rtol=1e-10)


def test_cv_by_fold_subtraction_equals_direct_refit(spark):
    df, _ = _groups(spark)
    cv = {r.g: r for r in cv_ols(df, ["x0", "x1", "x2"], "y", by=["g"], key_cols=["g", "id"], folds=4).collect()}
    folded = hash_folds(df, ["g", "id"], 4, 42, "f")
    for g in ("A", "B"):
        scores = []
        for f in range(4):
            train = folded.filter((F.col("g") == g) & (F.col("f") != f))
            test = folded.filter((F.col("g") == g) & (F.col("f") == f))
            fit = fit_ols(train, ["x0", "x1", "x2"], "y")
            m = regression_metrics(predict_linear(test, fit, ["x0", "x1", "x2"]), "y", "prediction",
                                   zero_variance="sklearn").first()
            scores.append(m.r2)
        assert np.isclose(cv[g].cv_r2_mean, np.mean(scores), atol=1e-9)
        assert np.isclose(cv[g].cv_r2_std, np.std(scores), atol=1e-9)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("const", 2.0, 2.0), ("const", 2.0, 2.0), ("zero", 0.0, 0.0), ("zero", 0.0, 0.0),
                                ("miss", 5.0, 4.0), ("miss", 5.0, 6.0)], "g string, y double, p double")
    z = {r.g: r for r in regression_metrics(df, "y", "p", ["g"]).collect()}
    s = {r.g: r for r in regression_metrics(df, "y", "p", ["g"], zero_variance="sklearn").collect()}
    assert z["const"].r2 == 0.0 and s["const"].r2 == 1.0 and s["miss"].r2 == 0.0
    assert z["zero"].error_rate_pct == 0.0 and z["const"].rmse == 0.0
    assert np.isclose(z["miss"].error_rate_pct, 100 * np.mean([2 * 1 / 9, 2 * 1 / 11]))


@pytest.mark.parametrize("n", [1, 5, 10, 1000])
def test_hash_split_stable_under_partitioning(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    a = {r.k for r in hash_split(df, ["k"]).filter("is_test").collect()}
    b = {r.k for r in hash_split(df.repartition(7), ["k"]).filter("is_test").collect()}
    assert a == b
    if n == 1000:
        assert 150 < len(a) < 250


def test_gram_rows_shape(spark):
    df, _ = _groups(spark)
    g = gram_rows(df, ["x0", "x1"], "y", by=["g"]).collect()
    assert len(g) == 3 and all(len(r.szz) == 4 for r in g)


def test_fewer_rows_than_features_stays_finite(spark):
    rows = [(float(i), float(i * i), float(i % 2), float(3 - i), 1.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    fit = fit_ols(df, ["a", "b", "c", "d"], "y").first()
    assert all(np.isfinite(fit.coefficients)) and np.isfinite(fit.intercept)
    pred = [r.prediction for r in predict_linear(df, fit_ols(df, ["a", "b", "c", "d"], "y"),
                                                 ["a", "b", "c", "d"]).orderBy("a").collect()]
    assert np.allclose(pred, [1.0, 2.0, 3.0], atol=1e-8)          # interpolates the training rows


@pytest.mark.parametrize("rule", ["sklearn", "ols"])
def test_exact_split_sizes(spark, rule):
    from limnos.operators.regression import exact_split

    sizes = {"a": 1, "b": 5, "c": 10, "d": 1003}
    data = [(g, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "g string, i int")
    out = exact_split(df, ["i"], by=["g"], rule=rule)
    got = {r.g: r.n for r in out.filter("is_test").groupBy("g").count().withColumnRenamed("count", "n").collect()}
    import math
    for g, n in sizes.items():
        want = math.ceil(0.2 * n) if rule == "sklearn" else (n - max(1, int(0.8 * n))) or 1
        assert got.get(g, 0) == want, (g, n)
    again = exact_split(df.repartition(7), ["i"], by=["g"], rule=rule)
    assert sorted((r.g, r.i) for r in out.filter("is_test").collect()) == \
        sorted((r.g, r.i) for r in again.filter("is_test").collect())


def test_grouped_quantiles_equal_per_group(spark):
    from limnos.operators.stats import exact_medians, exact_quantiles_by

    rng = np.random.default_rng(3)
    rows = [(int(i % 3), float(rng.normal()), float(rng.integers(0, 5)) if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "fold int, a double, b double")
    trains = F.array_remove(F.sequence(F.lit(0), F.lit(2)), F.col("fold"))
    got = exact_quantiles_by(df.withColumn("t", trains), "t", range(3), ["a", "b"], [0.5])
    for f in range(3):
        want = exact_medians(df.filter(F.col("fold") != f), ["a", "b"])
        assert got[f]["a"][0] == pytest.approx(want["a"]) and got[f]["b"][0] == pytest.approx(want["b"])


def test_exact_quantiles_of_ties_infinities_and_many_rounds(spark, monkeypatch):
    import numpy as np

    from limnos.operators import stats

    monkeypatch.setattr(stats, "SMALL", 3)        # force several bracketing rounds
    monkeypatch.setattr(stats, "ACCURACY", 50)
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(size=5000), np.full(4000, 0.25), np.full(3000, 0.75), [np.inf, -np.inf, 1e300]])
    df = spark.createDataFrame([(float(v), float(i % 2)) for i, v in enumerate(data)], "a double, b double")
    ps = [0.0, 0.001, 0.3, 0.5, 0.6, 0.99, 1.0]
    got = stats.exact_quantiles(df, ["a", "b"], ps)
    srt = np.sort(data)
    for p, v in zip(ps, got["a"]):
        at = p * (len(srt) - 1)
        lo, hi = srt[int(np.floor(at))], srt[int(np.ceil(at))]
        assert v == lo or np.isclose(v, lo + (hi - lo) * (at - np.floor(at)))
    assert got["b"] == [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def test_exact_split_sizes_with_repeated_keys(spark):
    rows = [("g", "same", 1)] * 1000 + [("h", f"k{i % 7}", i) for i in range(101)] + [("i", None, None)]
    df = spark.createDataFrame(rows, "g string, k string, v int")
    from limnos.operators.regression import exact_split
    for rule in ("sklearn", "ols"):
        out = exact_split(df, ["k"], by=["g"], rule=rule)
        got = {r.g: (r.t, r.n) for r in out.groupBy("g").agg(F.count(F.when(F.col("is_test"), 1)).alias("t"), F.count("*").alias("n")).collect()}
        assert {g: t for g, (t, _) in got.items()} == {"g": 200, "h": 21 if rule == "sklearn" else 101 - int(0.8 * 101), "i": 1}
        assert {g: n for g, (_, n) in got.items()} == {"g": 1000, "h": 101, "i": 1}
    assert sorted(map(tuple, exact_split(df, ["k"], by=["g"]).collect()), key=str) == sorted(map(tuple, exact_split(df.repartition(5), ["k"], by=["g"]).collect()), key=str)


def test_qr_keeps_the_digits_of_nearly_collinear_inputs(spark, monkeypatch):
    from limnos.operators import regression
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    rows = [(int(i % 3), float(v), float(v + 1e-6 * w), float(2 * v + w + 5)) for i, (v, w) in enumerate(zip(x, rng.normal(size=600), strict=True))]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 2.0), (1, 1.0, float("nan"), 2.0)], "g int, a double, `b.c` double, y double").repartition(9)
    monkeypatch.setattr(regression, "_MERGE", 2)
    got = {r.g: r for r in regression.fit_ols_qr(df, ["a", "b.c"], "y", by=["g"]).collect()}
    rough = {r.g: r for r in regression.fit_ols(df, ["a", "b.c"], "y", by=["g"]).collect()}
    for g in range(3):
        part = np.array([r[1:] for r in rows if r[0] == g])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[:, :2]]), part[:, 2], rcond=None)[0]
        assert got[g].n_train == len(part) and got[g].r2_train == pytest.approx(1.0, abs=1e-9)
        assert np.allclose([got[g].intercept, *got[g].coefficients], want, rtol=1e-8)
        assert not np.allclose(rough[g].coefficients, want[1:], rtol=1e-8)
    alone = regression.fit_ols_qr(df.where("g = 0"), ["a"], "y").first()
    assert alone.n_train == 201 or alone.n_train == 200
    same = df.withColumn("twice", F.col("a") * 2)
    one = regression.fit_ols_qr(same, ["a", "twice"], "y").first()
    assert one.coefficients[1] == pytest.approx(2 * one.coefficients[0])


def test_gram_rows_of_a_few_large_groups_are_not_dealt_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2] if i % 50 else None, float(i % 3), 0.1, float(a), float(5 + 2 * a + b)) for i, (a, b) in enumerate(rng.normal(1e6, 1.0, (600, 2)))]
    df = spark.createDataFrame(rows, "g string, f double, c double, x double, y double").repartition(7)
    found = gram_rows(df, ["c", "x"], "y", by=["g"], fold_col="f")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # one pass: rows meet no table of centres, so none is dealt by its group
    got = {(r["g"], r["__fold"]): r for r in found.collect()}
    assert set(got) == {(g, f) for g in "ab" for f in range(3)}  # rows without a group are left out
    for g in "ab":
        mine = np.array([r[2:] for r in rows if r[0] == g])
        for f in range(3):
            part = np.array([r[2:] for r in rows if r[0] == g and r[1] == f])
            z = (part[:, 1] - mine[:, 1].mean()) / mine[:, 1].std()
            r = got[g, f]
            assert (r["n"], r["sx"][0]) == (len(part), 0.0)
            assert np.allclose(r["szz"], [0, 0, 0, z @ z], rtol=1e-6, atol=1e-6)
            assert np.allclose([r["syy"], r["szy"][1]], [((part[:, 2] - mine[:, 2].mean()) ** 2).sum(), z @ (part[:, 2] - mine[:, 2].mean())], rtol=1e-6)


def test_quantile_sketches_see_a_bounded_number_of_rows(spark, monkeypatch):
    from limnos.operators import stats
    monkeypatch.setattr(stats, "SKETCH_ROWS", 500)
    monkeypatch.setattr(stats, "SMALL", 50)
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=20_000), rng.normal(50, 1e-3, 10_000), np.full(5_000, 2.5)])
    rare = [float(x) if i % 900 == 0 else None for i, x in enumerate(values)]
    df = spark.createDataFrame(list(zip(map(float, values), rare, [i % 3 for i in range(len(values))])), "a double, r double, g int").repartition(6)
    seen = []
    kept = stats._sketch
    monkeypatch.setattr(stats, "_sketch", lambda frame, sizes, width, shares: seen.append(sizes) or kept(frame, sizes, width, shares))
    ps = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(df, ["a", "r"], ps)
    assert np.allclose(got["a"], np.percentile(values, [p * 100 for p in ps]), rtol=0, atol=1e-12)
    assert np.allclose(got["r"], np.percentile([x for x in rare if x is not None], [p * 100 for p in ps]), rtol=0, atol=1e-12)
    by = stats.exact_quantiles_by(df, "g", range(3), ["a"], [0.5])
    assert [by[g]["a"][0] for g in range(3)] == [np.median(values[g::3]) for g in range(3)]
    assert seen[0] == {0: len(values)}
    monkeypatch.setattr(stats, "_sketch", lambda frame, sizes, width, shares: {0: {f"q{i}": [1e9] * len(shares) for i in range(width)}})
    assert np.isclose(stats.exact_quantiles(df, ["a"], [0.3])["a"][0], np.percentile(values, 30))  # a wrong sketch is found out


def test_exact_split_deals_out_the_repeats_of_one_row(spark, monkeypatch):
    import hashlib
    from limnos.operators import regression
    kept, parts = regression.stored, {}

    def watched(df, name):
        out = kept(df, name)
        if name == "split-ties":
            parts[name] = out.select(F.input_file_name()).distinct().count()
        return out

    monkeypatch.setattr(regression, "stored", watched)
    monkeypatch.setattr(regression, "_RUN", 100)
    keys = [1] * 3000 + list(range(2, 700)) + [None] * 50
    df = spark.createDataFrame([(k, "ab"[i % 2]) for i, k in enumerate(keys)], "k int, g string").repartition(5)
    split = regression.exact_split(df, ["k"], by=["g"], test_fraction=0.8).collect()
    assert len(split) == len(keys)
    number = lambda k: int(hashlib.md5(f"{chr(0) if k is None else k}:42".encode()).hexdigest()[:15], 16)
    for g in "ab":
        mine = [r for r in split if r["g"] == g]
        test = [number(r["k"]) for r in mine if r["is_test"]]
        assert len(test) == np.ceil(0.8 * len(mine))
        assert sorted(test) == sorted(number(r["k"]) for r in mine)[:len(test)]
    assert parts["split-ties"] > 1


def test_ols_multi_splits_exactly_and_scores_the_held_out_rows(spark, tmp_path):
    from limnos.plans.q_model import ols_multi
    rng = np.random.default_rng(3)
    sizes = {"A": 203, "N": 121, "R": 57}
    lines, orders = [], []
    for k, flag in enumerate(flag for flag, n in sizes.items() for _ in range(n)):
        price = float(rng.integers(1_000, 90_000))
        lines.append((k, k % 7 + 1, flag, price, float(rng.integers(1, 50)), float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, k % 31))
        orders.append((k, f"2024-{k % 12 + 1:02d}-{k % 28 + 1:02d}"))
    lines.append((5, 9, "A", None, 3.0, 0.01, 0.02, 4))  # an incomplete row counts on neither side
    lines.append((6, 9, "A", float("nan"), 3.0, 0.01, 0.02, 4))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double, l_quantity double, l_discount double, l_tax double, "
                                 "l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate string").selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = ols_multi(spark, str(tmp_path)).collect()
    assert len(got) == 30
    for flag, n in sizes.items():
        mine = sorted((r for r in got if r.target_variable == flag), key=lambda r: r.position)
        train = max(1, int(n * 0.8))
        assert {(r.sample_count, r.train_count, r.test_count) for r in mine} == {(n, train, n - train)}
        # The price is a thousand times an input: held-out rows are met exactly, whatever the split.
        assert all(r.r2 > 1 - 1e-12 and r.rmse < 1e-6 and r.mae < 1e-6 for r in mine)
        beta = {r.feature: r.coefficient for r in mine}
        for _, number, _, price, quantity, discount, tax, _ in (x for x in lines[:381] if x[2] == flag):
            x = {"high": price / 1000, "low": price / 1000 - discount * 100, "precip": discount * 10 - 0.3, "gdd_40_86": quantity, "snow": tax, "distance_to_climate_station_km": number}
            rest = sum(abs(beta[c]) for c in ("doy", "LatitudeMeasure", "LongitudeMeasure"))
            assert rest < 1e-6 and abs(beta["intercept"] + sum(beta[c] * v for c, v in x.items()) - price) < 1e-3


@pytest.mark.parametrize("rule, sizes", [("ols", {"a": 21, "b": 1, "c": 2}), ("sklearn", {"a": 21, "b": 1, "c": 2})])
def test_hash_split_by_a_rule_takes_the_least_hashes_of_each_group(spark, rule, sizes):
    import hashlib
    import math
    rows = [(g, k) for g, n in sizes.items() for k in range(n + 100, 2 * n + 100)]
    split = hash_split(spark.createDataFrame(rows, "g string, k long"), ["k"], 0.2, 42, by=["g"], rule=rule).collect()
    assert len(split) == len(rows)
    for g, n in sizes.items():
        want = max(n - max(1, int(n * 0.8)), 1) if rule == "ols" else math.ceil(0.2 * n)
        keys = sorted((k for h, k in rows if h == g), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
        assert {r.k for r in split if r.g == g and r.is_test} == set(keys[:want])


@pytest.mark.parametrize("sorted_at_once, sketch_rows", [(50_000, 200_000), (20, 100)])
def test_medians_outside_folds_match_numpy(spark, monkeypatch, sorted_at_once, sketch_rows):
    from limnos.operators import stats
    monkeypatch.setattr(stats, "_SORTED", sorted_at_once)
    monkeypatch.setattr(stats, "SKETCH_ROWS", sketch_rows)
    rng = np.random.default_rng(7)
    n = 3000
    cols = {"a": rng.normal(size=n), "b": np.concatenate([np.full(2000, 7.25), rng.uniform(0, 10, n - 2000)]), "c": np.round(rng.normal(size=n), 1),
            "d": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n) ** 5), "e": np.where(rng.random(n) < 0.2, np.inf, rng.normal(size=n)), "f": np.full(n, np.nan)}
    fold = rng.integers(0, 4, n)
    cols["g"] = np.where(fold == 2, np.nan, fold * 100.0 + rng.random(n))  # far apart by fold, none in one
    data = [(int(k), *[None if j % 2 and v != v else float(v) for j, v in enumerate(x)]) for k, *x in zip(fold, *cols.values())]
    df = spark.createDataFrame(data, "fold int, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = stats.medians_outside(df, "fold", range(4), list(cols))
    for s in (None, 0, 1, 2, 3):
        for c, v in cols.items():
            mine = v[(fold != s) & ~np.isnan(v)] if s is not None else v[~np.isnan(v)]
            assert got[s][c] == (pytest.approx(np.median(mine), abs=1e-12) if len(mine) else None), (s, c)
    assert stats.medians_outside(df.filter(F.lit(False)), "fold", range(2), ["a"]) == {None: {"a": None}, 0: {"a": None}, 1: {"a": None}}


def test_exact_split_by_a_stored_hash_is_the_same(spark):
    from limnos.operators.regression import exact_split, key_hash
    df = spark.range(500).selectExpr("id", "IF(id % 3 = 0, NULL, id % 40) AS k", "id % 9 AS v")
    plain = {r.id for r in exact_split(df, ["k"]).filter("is_test").collect()}
    hashed = df.withColumns({"h": key_hash(["k"]), "fold": F.col("k") % 2})
    again = exact_split(hashed, ["k"], hash_col="h", aside=["fold"])
    assert again.columns == ["id", "k", "v", "h", "fold", "is_test"] and again.count() == 500
    assert len(plain) == 100 and {r.id for r in again.filter("is_test").collect()} == plain
    one = exact_split(df.withColumn("one", F.lit("x")), ["id"], by=["one"]).filter("is_test").collect()
    assert {r.id for r in one} == {r.id for r in exact_split(df, ["id"]).filter("is_test").collect()}


def test_gram_rows_leave_incomplete_rows_out_without_a_filter_on_inputs(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", None, 2.0, 3.0), ("a", 2.0, float("nan"), 3.0), ("a", 3.0, 4.0, None), ("a", 4.0, 4.0, 5.0), ("b", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, z double, y double")
    g = gram_rows(df, ["x", "z"], "y", by=["g"])
    assert {(r.g, r.n) for r in g.collect()} == {("a", 2)}
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "isnan" not in plan


def test_key_codes_of_a_batch():
    import pyarrow as pa

    from limnos.operators.regression import _codes
    a, b = pa.array(["x", None, "y", "x", None, "x"]), pa.array([1, 2, 2, 1, 2, None], pa.int32())
    code = _codes([a, b])
    assert [len({c for c, k in zip(code, zip(a.to_pylist(), b.to_pylist())) if k == key}) for key in {("x", 1), (None, 2), ("y", 2), ("x", None)}] == [1] * 4
    assert len(set(code.tolist())) == 4
    wide = [pa.array(np.arange(2000) // 2 + k) for k in range(4)]  # more combinations than numbers of 31 bits
    assert len(set(_codes(wide).tolist())) == 1000 and (np.diff(_codes(wide).reshape(-1, 2), axis=1) == 0).all()
