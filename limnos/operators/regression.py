"""Grouped least squares, splits, cross-validation and metrics
(M1-M5, M9, M10, M15).

All groups (targets) are fitted in one distributed pass: tasks sum means and
centred products per group (per fold when cross-validating), which merge into
the Gram sums of the centred, scaled features.  The (p+1)^2 solve runs per
group in ``applyInPandas`` over the Gram rows, so nothing but the small
coefficient tables ever exists per group, and no row data leaves the
executors.  Exactly collinear inputs get the minimum-norm solution
(pseudo-inverse with a relative cutoff); predictions are unaffected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.session import qcol, stored

try:  # ship the per-group solver by value: executors need numpy/pandas, not this package
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass

HASH_BUCKETS = 10_000


# ------------------------------------------------------------------ splits
def _key_part(col: str) -> Column:
    """Key text for hashing; NULL gets a marker so (a, NULL) and (NULL, a) differ."""
    return F.coalesce(qcol(col).cast("string"), F.lit("\u0000"))


def hash_bucket(key_cols: Sequence[str], seed: int = 42, buckets: int = HASH_BUCKETS) -> Column:
    """Stable bucket in [0, buckets) from ``md5(key || ':' || seed)`` (first 32 bits).

    Reproducible across runs, partitionings and engines (DuckDB:
    ``('0x' || substr(md5(k), 1, 8))::BIGINT % buckets``).
    """
    key = F.concat_ws(":", *[_key_part(c) for c in key_cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.2, seed: int = 42,
               col: str = "is_test", by: Sequence[str] = (), rule: str | None = None, hash_col: str | None = None) -> DataFrame:
    """M2: deterministic train/test flag (``test_fraction`` of the hash space).

    With a ``rule`` the test side has exactly the reference's size, per group of ``by`` (see ``exact_split``, also for ``hash_col``).
    """
    if rule is not None:
        return exact_split(df, key_cols, by, test_fraction, seed, rule, col, hash_col)
    return df.withColumn(col, hash_bucket(key_cols, seed) < F.lit(int(round(test_fraction * HASH_BUCKETS))))


def hash_folds(df: DataFrame, key_cols: Sequence[str], folds: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """M9: deterministic fold id in [0, folds)."""
    return df.withColumn(col, hash_bucket(key_cols, seed + 1) % F.lit(folds))


# ------------------------------------------------------------- eligibility
def eligible_targets(long: DataFrame, target_col: str, required: Sequence[str], min_samples: int,
                     top_n: int | None = None, explicit: Sequence[str] | None = None) -> DataFrame:
    """M1: targets by complete-row count (``target``, ``sample_count``).

    ``explicit`` keeps its own order (``position``) and drops short targets;
    otherwise the ``top_n`` largest counts (ties by name).
    """
    complete = long
    for c in required:
        complete = complete.filter(qcol(c).isNotNull())
    counts = (complete.groupBy(qcol(target_col).alias("target")).agg(F.count(F.lit(1)).alias("sample_count"))
              .filter(F.col("sample_count") >= min_samples))
    if explicit:
        order = long.sparkSession.createDataFrame([(t, i) for i, t in enumerate(explicit)],
                                                  "target string, position int")
        return counts.join(F.broadcast(order), on="target").orderBy("position")
    ranked = counts.orderBy(F.col("sample_count").desc(), F.col("target"))
    return ranked.limit(top_n) if top_n else ranked


# --------------------------------------------------------------- Gram sums
def _group_cols(by: Sequence[str]) -> list[Column]:
    return [qcol(b) for b in by]


#: Numbers a task holds before it hands its partial sums on.
_HELD_NUMBERS = 4_000_000


def _moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred products; the first row is taken off before, so a constant column has exactly none."""
    gap = rows - rows[0]
    mean = gap.mean(axis=0)
    gap -= mean
    return len(rows), rows[0] + mean, gap.T @ gap


def _joined(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of two sets of rows together (Chan, Golub and LeVeque)."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """A small number per row, the same for rows with the same keys (NULL is a key like others)."""
    code, many = 0, 1
    for c in columns:
        kinds = c.dictionary_encode(null_encoding="encode")
        many *= max(1, len(kinds.dictionary))
        code = code * max(1, len(kinds.dictionary)) + kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if many > 1 << 31:
            values, code = np.unique(code, return_inverse=True)
            many = len(values)
    return code.astype(np.int16) if many < 1 << 15 else code


def _partial_moments(keys: int, width: int):
    """Per task: moments of the columns after the first ``keys`` per key (numpy BLAS on Arrow batches), of rows that lack none; bounded memory."""
    most = max(1, _HELD_NUMBERS // (width * width + width + 1))

    def flushed(acc: dict, schema: pa.Schema) -> pa.RecordBatch:
        cols = [pa.array([key[i] for key in acc], schema.field(i).type) for i in range(keys)]
        cols += [pa.array([x[0] for x in acc.values()], pa.int64()), *[pa.array([x[i].ravel().tolist() for x in acc.values()], pa.list_(pa.float64())) for i in (1, 2)]]
        return pa.RecordBatch.from_arrays(cols, [*schema.names[:keys], "__n", "__mean", "__m"])

    def run(batches):
        acc: dict[tuple, tuple] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns[keys:]])
            whole = ~np.isnan(rows).any(axis=1)  # NULL arrives as NaN
            if not whole.all():
                batch, rows = batch.filter(pa.array(whole)), rows[whole]
                if not batch.num_rows:
                    continue
            code = _codes(batch.columns[:keys])
            order = np.argsort(code, kind="stable") if code.any() else np.arange(len(code))
            heads = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            for at in np.split(order, heads[1:]):
                key = tuple(batch.column(i)[int(at[0])].as_py() for i in range(keys))
                part = _moments(rows[at] if len(heads) > 1 else rows)
                acc[key] = _joined(acc[key], part) if key in acc else part
                if len(acc) >= most:
                    yield flushed(acc, schema)
                    acc = {}
        if acc:
            yield flushed(acc, schema)
    return run


def _merge_moments(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    parts = [(int(n), np.asarray(mean, float), np.asarray(m, float).reshape(len(mean), -1)) for n, mean, m in zip(pdf["__n"], pdf["__mean"], pdf["__m"], strict=True)]
    return reduce(_joined, parts)


def _merge_tasks(pdf: pd.DataFrame) -> pd.DataFrame:
    n, mean, m = _merge_moments(pdf)
    return pdf.iloc[:1].assign(__n=n, __mean=[mean.tolist()], __m=[m.ravel().tolist()])


def _gram_of(p: int):
    """Moments of a group's folds -> their Gram sums, centred and scaled by the whole group's moments."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        folds = {f: _merge_moments(part) for f, part in pdf.groupby("__fold", sort=True)}
        n, mean, m = reduce(_joined, folds.values())
        spread = np.sqrt(np.maximum(np.diag(m)[:p], 0.0) / n)
        scale = np.append(np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 0.0), 1.0)
        out = []
        for fold, (nf, mean_f, m_f) in folds.items():
            z = (mean_f - mean) * scale
            sums = m_f * np.outer(scale, scale) + nf * np.outer(z, z)
            out.append({"__fold": fold, "n": nf, "mx": mean[:p].tolist(), "sx": spread.tolist(), "my": mean[p], "sz": (nf * z[:p]).tolist(),
                        "szz": sums[:p, :p].ravel().tolist(), "sy": nf * z[p], "szy": sums[:p, p].tolist(), "syy": sums[p, p]})
        kept = [c for c in pdf.columns if c not in ("__fold", "__p", "__n", "__mean", "__m")]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in kept}, **row} for row in out])
    return run


#: Tasks whose moments are merged before those of a whole group are.
_MERGE_TASKS = 64


_NUMBERS = T.ArrayType(T.DoubleType())


def _task_moments(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[Column]) -> DataFrame:
    """Moments of the complete rows per key, merged by up to ``_MERGE_TASKS`` tasks: the keys, __n, __mean, __m, __p.

    Incomplete rows are left out by numpy: a filter on every (derived) column would compute each of them twice.
    """
    rows = df.select(*keys, *[qcol(c).cast("double").alias(f"__c{i}") for i, c in enumerate([*features, label])])
    kinds = rows.schema.fields[:len(keys)]
    moments = [T.StructField("__n", T.LongType()), T.StructField("__mean", _NUMBERS), T.StructField("__m", _NUMBERS)]
    parts = rows.mapInArrow(_partial_moments(len(keys), len(features) + 1), T.StructType([*kinds, *moments]))
    parts = parts.withColumn("__p", (F.spark_partition_id() / _MERGE_TASKS).cast("int"))
    return parts.groupBy(*[qcol(k.name) for k in kinds], "__p").applyInPandas(_merge_tasks, T.StructType([*kinds, *moments, T.StructField("__p", T.IntegerType())]))


def _gram_schema(keys: Sequence[T.StructField]) -> T.StructType:
    fields = {"n": T.LongType(), "mx": _NUMBERS, "sx": _NUMBERS, "my": T.DoubleType(), "sz": _NUMBERS, "szz": _NUMBERS, "sy": T.DoubleType(), "szy": _NUMBERS, "syy": T.DoubleType()}
    return T.StructType([*keys, *[T.StructField(k, kind) for k, kind in fields.items()]])


def gram_rows(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (),
              fold_col: str | None = None) -> DataFrame:
    """Per group (and fold): centres/scales and Gram sums of centred, scaled inputs.

    One pass: every task keeps the count, means and centred products of its rows per
    group and fold (handing them on whenever they pass ``_HELD_NUMBERS``), these are
    merged by tasks, then by group, and centred and scaled by the whole group's
    moments.  Rows are not joined or dealt by group, so a few large groups do not
    land in a few tasks.  Rows with a NULL group, or a NULL or NaN number, are ignored.
    Output columns: ``by``, ``__fold``, ``n``, ``mx``/``sx`` (arrays), ``my``,
    ``sz``, ``szz`` (flattened p x p), ``sy``, ``szy``, ``syy``.
    """
    for c in by:
        df = df.filter(qcol(c).isNotNull())
    fold = (qcol(fold_col) if fold_col else F.lit(-1)).cast("int").alias("__fold")
    merged = _task_moments(df, features, label, [*_group_cols(by), fold])
    schema = _gram_schema([merged.schema[k] for k in [*by, "__fold"]])
    return merged.groupBy(*(_group_cols(by) or [F.lit(0).alias("__one")])).applyInPandas(_gram_of(len(features)), schema)


def _solve(n, sz, szz, sy, szy, syy, mx, sx, my, rcond=1e-10):
    """Least squares on summed moments of one row subset -> (intercept, beta, r2_train)."""
    p = len(sz)
    if n <= 0:
        return None
    mz, muy = sz / n, sy / n
    c = szz - n * np.outer(mz, mz)
    b = szy - n * mz * muy
    if p:
        scale = np.max(np.abs(np.diag(c))) if c.size else 0.0
        beta_z = np.linalg.pinv(c, rcond=rcond, hermitian=True) @ b if scale > 0 else np.zeros(p)
    else:
        beta_z = np.zeros(0)
    safe = np.where(sx > 0, sx, 1.0)
    beta = np.where(sx > 0, beta_z / safe, 0.0)
    intercept = my + muy - mz @ beta_z - np.sum(beta * mx)
    syy_c = syy - n * muy * muy
    sse = syy_c - 2 * beta_z @ b + beta_z @ c @ beta_z
    r2 = 1.0 - sse / syy_c if syy_c > 0 else 0.0
    return float(intercept), beta, float(r2)


def _coef_schema(df_schema: T.StructType, by: Sequence[str], with_fold: bool) -> T.StructType:
    fields = [df_schema[b] for b in by]
    if with_fold:
        fields.append(T.StructField("fold", T.IntegerType()))
    fields += [T.StructField("n_train", T.LongType()), T.StructField("intercept", T.DoubleType()),
               T.StructField("coefficients", T.ArrayType(T.DoubleType())),
               T.StructField("r2_train", T.DoubleType())]
    return T.StructType(fields)


def _gram_solver(by: Sequence[str], mode: str):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = {b: pdf[b].iloc[0] for b in by}
        mx = np.asarray(pdf["mx"].iloc[0], dtype=float)
        sx = np.asarray(pdf["sx"].iloc[0], dtype=float)
        my = float(pdf["my"].iloc[0])
        p = len(mx)
        parts = []
        for _, r in pdf.iterrows():
            parts.append((int(r["__fold"]), float(r["n"]), np.asarray(r["sz"], float),
                          np.asarray(r["szz"], float).reshape(p, p), float(r["sy"]),
                          np.asarray(r["szy"], float), float(r["syy"])))
        tot = [sum(x[i] for x in parts) for i in range(1, 7)]
        out = []
        if mode == "fit":
            res = _solve(*tot, mx, sx, my)
            if res:
                out.append({**keys, "n_train": int(tot[0]), "intercept": res[0],
                            "coefficients": res[1].tolist(), "r2_train": res[2]})
        else:
            for f in parts:
                train = [t - x for t, x in zip(tot, f[1:], strict=True)]
                res = _solve(*train, mx, sx, my)
                if res:
                    out.append({**keys, "fold": f[0], "n_train": int(train[0]), "intercept": res[0],
                                "coefficients": res[1].tolist(), "r2_train": res[2]})
        cols = [*by, *(["fold"] if mode == "cv" else []), "n_train", "intercept", "coefficients", "r2_train"]
        return pd.DataFrame(out, columns=cols)
    return solve


def _partial_r(keys: Sequence[str], width: int):
    """Per task: the R factor of [1, inputs, label] per key, folded in block by block."""
    most = max(1, _HELD_NUMBERS // (width * width))

    def run(batches):
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False, dropna=False):
                block = part[[f"__c{i}" for i in range(width)]].to_numpy(float)
                n, r = held.get(key, (0, np.empty((0, width))))
                held[key] = (n + len(block), np.linalg.qr(np.vstack([r, block]), mode="r"))
                if len(held) > most:
                    yield _r_frame(keys, held)
                    held = {}
        yield _r_frame(keys, held)
    return run


def _r_frame(keys: Sequence[str], held: dict) -> pd.DataFrame:
    rows = [{**dict(zip(keys, key, strict=True)), "__n": n, "__r": r.ravel().tolist()} for key, (n, r) in held.items()]
    return pd.DataFrame(rows, columns=[*keys, "__n", "__r"])


def _merge_r(keys: Sequence[str], width: int, carried: Sequence[str]):
    """R factor of stacked R factors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.asarray(r, float).reshape(-1, width) for r in pdf["__r"]])
        first = pdf.iloc[:1]
        return pd.DataFrame({**{c: first[c] for c in (*keys, *carried)}, "__n": [int(pdf["__n"].sum())], "__r": [np.linalg.qr(stacked, mode="r").ravel().tolist()]})
    return run


def _solve_r(by: Sequence[str], width: int):
    """Least squares from one R factor: the minimum-norm solution by its singular values, as from the rows themselves."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.vstack([np.asarray(x, float).reshape(-1, width) for x in pdf["__r"]])
        n, a, b = int(pdf["__n"].sum()), r[:, :-1], r[:, -1]
        beta = np.linalg.lstsq(a, b, rcond=np.finfo(float).eps * max(n, width - 1))[0]
        sse = float(((b - a @ beta) ** 2).sum())
        # Row 0 of R holds sqrt(n) and the label's mean times it: the rest of the label's column is its spread.
        q, _ = np.linalg.qr(a[:, :1])
        sst = float(((b - q[:, 0] * (q[:, 0] @ b)) ** 2).sum())
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "n_train": n, "intercept": float(beta[0]), "coefficients": beta[1:].tolist(),
                              "r2_train": 1.0 - sse / sst if sst > 0 else 0.0}])
    return run


#: R factors that one merge stacks.
_MERGE = 32


def fit_ols_qr(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """M3 by tall-skinny QR: every task folds its rows into one R factor per group, R factors merge in a tree.

    The inputs' condition number is not squared, as it is by sums of products, so nearly
    collinear inputs keep their digits.  Same columns as ``fit_ols``; inputs are used as they
    are, so exactly collinear ones share the minimum-norm solution of the raw columns.
    """
    width, keys = len(features) + 2, [*by] or ["__all"]
    complete = df if by else df.withColumn("__all", F.lit(0))
    for c in [*features, label]:
        complete = complete.filter(qcol(c).isNotNull() & ~F.isnan(qcol(c)))
    cols = [F.lit(1.0), *[qcol(f).cast("double") for f in features], qcol(label).cast("double")]
    rows = complete.select(*_group_cols(keys), *[c.alias(f"__c{i}") for i, c in enumerate(cols)])
    kinds = [rows.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("__n", T.LongType()), T.StructField("__r", T.ArrayType(T.DoubleType()))])
    parts = stored(rows.mapInPandas(_partial_r(keys, width), schema).withColumn("__p", F.spark_partition_id()), "ols-r")
    left = (parts.agg(F.max("__p")).first()[0] or 0) + 1
    while left > _MERGE:
        left = -(-left // _MERGE)
        step = T.StructType([*kinds, T.StructField("__p", T.IntegerType()), *schema.fields[len(keys):]])
        parts = parts.withColumn("__p", (F.col("__p") / _MERGE).cast("int"))
        parts = stored(parts.groupBy(*_group_cols(keys), "__p").applyInPandas(_merge_r(keys, width, ["__p"]), step), "ols-r")
    return parts.groupBy(*_group_cols(keys)).applyInPandas(_solve_r(by, width), _coef_schema(df.schema, by, with_fold=False))


def fit_ols(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """M3: least squares with intercept for every group in one pass (sums of products; see ``fit_ols_qr``).

    Returns one row per group: ``by``, ``n_train``, ``intercept``,
    ``coefficients`` (array in ``features`` order), ``r2_train``.
    """
    g = gram_rows(df, features, label, by)
    key = list(by) if by else None
    schema = _coef_schema(df.schema, by, with_fold=False)
    if key:
        return g.groupBy(*_group_cols(by)).applyInPandas(_gram_solver(by, "fit"), schema)
    return g.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(
        lambda pdf: _gram_solver((), "fit")(pdf.drop(columns="__all")), schema)


def fit_ols_parts(df: DataFrame, features: Sequence[str], label: str, parts: Sequence[str], uses: Sequence[Column]) -> DataFrame:
    """M3 for several overlapping row sets in one pass: fit number k takes the rows whose ``parts`` columns meet ``uses[k]``.

    The moments of each combination of ``parts`` (few) are summed once and merged for every fit that uses it.
    Columns: ``fit`` (k), and those of ``fit_ols``; a fit without complete rows has no row.
    """
    merged = _task_moments(df, features, label, [qcol(c) for c in parts])
    taken = F.filter(F.array(*[F.when(use, F.lit(k)) for k, use in enumerate(uses)]), lambda k: k.isNotNull())
    merged = merged.withColumn("fit", F.explode(taken)).withColumn("__fold", F.lit(-1)).drop(*parts)
    schema = _gram_schema([merged.schema["fit"], merged.schema["__fold"]])
    grams = merged.groupBy("fit").applyInPandas(_gram_of(len(features)), schema)
    return grams.groupBy("fit").applyInPandas(_gram_solver(["fit"], "fit"), _coef_schema(grams.schema, ["fit"], with_fold=False))


def coefficient_table(fit: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                      target_name: str | None = None) -> DataFrame:
    """M5: long ``(by..., feature, position, coefficient)``, intercept first."""
    names = F.array(F.lit("intercept"), *[F.lit(f) for f in features])
    vals = F.concat(F.array(F.col("intercept")), F.col("coefficients"))
    z = F.arrays_zip(names.alias("feature"), vals.alias("coefficient"))
    out = fit.select(*_group_cols(by), F.posexplode(z).alias("position", "e")).select(
        *_group_cols(by), F.col("e.feature").alias("feature"), "position", F.col("e.coefficient").alias("coefficient"))
    return out.withColumnRenamed(by[0], target_name) if (target_name and by) else out


def predict_linear(df: DataFrame, fit: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                   extra_keys: Sequence[str] = (), out_col: str = "prediction") -> DataFrame:
    """M4: ``intercept + sum(beta_j * x_j)`` with each row's group coefficients.

    Grouped fits are attached by an equi-join on the group key (one small row
    per group); an ungrouped fit is inlined as literals.
    """
    keys = [*by, *extra_keys]
    if not keys:
        row = fit.first()
        expr = F.lit(row["intercept"])
        for f, b in zip(features, row["coefficients"], strict=True):
            expr = expr + F.lit(b) * qcol(f)
        return df.withColumn(out_col, expr)
    coef = fit.select(*[qcol(k) for k in keys], F.col("intercept").alias("__b0"), F.col("coefficients").alias("__b"))
    j = df.join(coef, on=keys, how="left")
    expr = F.col("__b0")
    for i, f in enumerate(features):
        expr = expr + F.col("__b")[i] * qcol(f)
    return j.withColumn(out_col, expr).drop("__b0", "__b")


def cv_ols(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), key_cols: Sequence[str] = (),
           folds: int = 5, seed: int = 42, zero_variance: str = "sklearn") -> DataFrame:
    """M9: k-fold R^2 of OLS per group — mean and population std over folds.

    One Gram pass per (group, fold); each fold's training fit is the total
    minus that fold's sums, so all k fits come from the same pass.  Then the
    fold's rows are scored with its fit and R^2 aggregated per (group, fold).
    """
    df = hash_folds(df, key_cols, folds, seed, "__fold_id")
    g = gram_rows(df, features, label, by, fold_col="__fold_id")
    schema = _coef_schema(df.schema, by, with_fold=True)
    if by:
        fits = g.groupBy(*_group_cols(by)).applyInPandas(_gram_solver(by, "cv"), schema)
    else:
        fits = g.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(
            lambda pdf: _gram_solver((), "cv")(pdf.drop(columns="__all")), schema)
    scored = predict_linear(df.withColumnRenamed("__fold_id", "fold"), fits, features, by, ["fold"], "__pred")
    m = regression_metrics(scored.filter(F.col("__pred").isNotNull()), label, "__pred", [*by, "fold"],
                           zero_variance=zero_variance)
    return m.groupBy(*_group_cols(by)).agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                                           F.count(F.lit(1)).alias("cv_folds"))


# ----------------------------------------------------------------- metrics
def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (),
                       zero_variance: str = "zero") -> DataFrame:
    """``n, r2, rmse, mae, error_rate_pct`` (symmetric MAPE, 0/0 -> 0) per group.

    ``zero_variance='zero'``: R^2 = 0 when the label is constant (OLS path);
    ``'sklearn'``: 1 for a perfect constant fit, else 0.
    """
    yc, pc = qcol(y), qcol(yhat)
    err = yc - pc
    denom = F.abs(yc) + F.abs(pc)
    grouped = df.groupBy(*_group_cols(by)) if by else df.groupBy()
    agg = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("__sse"),
                      (F.var_pop(yc) * F.count(F.lit(1))).alias("__sst"), F.avg(F.abs(err)).alias("mae"),
                      F.avg(F.when(denom == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.abs(err) / denom)).alias("__sm"))
    if zero_variance == "sklearn":
        zero = F.when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        zero = F.lit(0.0)
    r2 = F.when(F.col("__sst") > 0, F.lit(1.0) - F.col("__sse") / F.col("__sst")).otherwise(zero)
    return agg.select(*_group_cols(by), "n", r2.alias("r2"), F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"),
                      "mae", (F.col("__sm") * F.lit(100.0)).alias("error_rate_pct"))


def metric_lookup(metrics: DataFrame, target: str, model: str, target_col: str = "target",
                  model_col: str = "model") -> DataFrame:
    """The metrics row of one (target, model)."""
    return metrics.filter((qcol(target_col) == F.lit(target)) & (qcol(model_col) == F.lit(model)))


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack per-target result frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ----------------------------------------------------------- exact splits
_HASH_BITS = 60
_STEP_BITS = 15
#: Repeats of one row that are unfolded together.
_RUN = 10_000


def _test_size(n: Column, test_fraction: float, rule: str) -> Column:
    if rule == "sklearn":                      # test = ceil(fraction * n)
        return F.least(n, F.ceil(F.lit(test_fraction) * n))
    train = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(1.0 - test_fraction) * n))   # OLS script: train = max(1, floor(0.8 n)) ...
    return F.greatest(n - train, F.lit(1).cast("long"))                                  # ... and the test side is never empty


def _reached(hist: DataFrame, need: DataFrame) -> DataFrame:
    """Per group the first prefix ``__p`` at which ``__need`` rows are reached, the rows still wanted of it and its rows."""
    cum = hist.join(need.select("__g", "__need"), "__g").withColumn("__cum", F.sum("__n").over(Window.partitionBy("__g").orderBy("__b")))
    found = cum.filter(F.col("__cum") >= F.col("__need")).groupBy("__g").agg(F.min(F.struct("__b", "__need", "__cum", "__n")).alias("x"))
    return stored(found.select("__g", (F.col("x.__need") - F.col("x.__cum") + F.col("x.__n")).alias("__need"),
                               F.col("x.__b").alias("__p"), F.col("x.__n").alias("__n")), "split-state")


def _cut_hashes(keys: DataFrame, need: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per group the hash at which the needed rows (those of least hash) are reached.

    ``keys``: __g, __h (60 bits); ``need``: from counts (__g, __n) to __g, __need
    (at least 1).  Returns __g, __cut, __left (rows still wanted among those with the
    cut hash) and __at (rows that have it).  The rows are read twice: for the counts
    of at most 2^15 prefixes a group, and for the hashes of the prefix that is cut,
    each kept once with its count: some 2^-15 of a group's hashes, which are cut in turn.
    The state stays a table with one row a group.
    """
    low = _HASH_BITS - _STEP_BITS
    prefix = F.shiftright("__h", low)
    hist = stored(keys.groupBy("__g", prefix.alias("__b")).agg(F.count(F.lit(1)).alias("__n")), "split-counts")
    state = _reached(hist, need(hist))
    near = keys.join(state.select("__g", "__p"), "__g").filter(prefix == F.col("__p"))
    state = _reached(near.groupBy("__g", F.col("__h").alias("__b")).agg(F.count(F.lit(1)).alias("__n")), state)
    return state.select("__g", F.col("__p").alias("__cut"), F.col("__need").alias("__left"), F.col("__n").alias("__at"))


def key_hash(key_cols: Sequence[str], seed: int = 42) -> Column:
    """The 60-bit number by which ``exact_split`` orders rows."""
    key_txt = F.concat_ws("\u0001", *[_key_part(c) for c in key_cols])
    return _hash_number(F.concat_ws(":", key_txt, F.lit(str(seed))))


def _hash_number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def exact_split(df: DataFrame, key_cols: Sequence[str], by: Sequence[str] = (), test_fraction: float = 0.2,
                seed: int = 42, rule: str = "sklearn", col: str = "is_test", hash_col: str | None = None,
                aside: Sequence[str] = ()) -> DataFrame:
    """M2 ``exact=True``: per group exactly the reference's test size, chosen as
    the rows with the smallest ``hash(key, seed)``.

    The cut is found on 15 bits of the hash, then on the hashes left, by counts alone, in two readings of the keys.  Rows
    that share the cut hash (repeated keys) are told apart by a hash of the
    whole row and, for rows equal in every column, of an occurrence number, so
    the size is exact whatever repeats.  No group is sorted in one task and
    nothing that grows with groups or repeats reaches the driver.  ``hash_col`` is a column of
    ``df`` that already holds ``key_hash(key_cols, seed)``; it and the columns ``aside`` do not tell rows apart.
    """
    columns = [c for c in df.columns if c != hash_col and c not in aside]
    gid = F.to_json(F.struct(*[qcol(b) for b in by])) if by else F.lit("")
    data = df.withColumns({"__x": qcol(hash_col) if hash_col else key_hash(key_cols, seed), "__g": gid})
    keys = data.select("__g", F.col("__x").alias("__h"))
    keys = keys if hash_col else stored(keys, "split-keys")
    sizes = lambda hist: hist.groupBy("__g").agg(F.sum("__n").alias("__n"))
    cuts = _cut_hashes(keys, lambda hist: sizes(hist).select("__g", _test_size(F.col("__n"), test_fraction, rule).alias("__need")).filter("__need > 0"))
    if by:
        marked = data.join(cuts, "__g", "left")
    else:  # one cut: the rows are filtered by a number, not joined
        cut = cuts.first()
        marked = data.withColumns({c: F.lit(cut[c] if cut else None).cast("long") for c in ("__cut", "__left", "__at")})
    low = F.coalesce(F.col("__x") <= F.col("__cut"), F.lit(False))
    chosen = lambda rows: rows.withColumn(col, low).select(*[qcol(c) for c in df.columns], col)
    if cuts.filter("__left < __at").isEmpty():
        return chosen(marked)
    tied = F.coalesce((F.col("__x") == F.col("__cut")) & (F.col("__left") < F.col("__at")), F.lit(False))
    plain = chosen(marked.filter(~tied))
    same = marked.filter(tied).groupBy(*[qcol(c) for c in df.columns], "__g", "__left").agg(F.count(F.lit(1)).alias("__n"))
    # A row that repeats often is unfolded in runs, which are dealt out: not all of it in one task.
    runs = same.withColumn("__o", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(_RUN).cast("long"))))
    runs = runs.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))
    rows = runs.withColumn("__o", F.explode(F.sequence(F.col("__o"), F.least(F.col("__n"), F.col("__o") + F.lit(_RUN - 1)))))
    text = F.to_json(F.struct(*[qcol(c) for c in columns], "__o"))
    rows = stored(rows.withColumn("__h", _hash_number(F.concat_ws(":", text, F.lit(str(seed))))), "split-ties")
    inner = _cut_hashes(rows.select("__g", "__h"), lambda _: cuts.select("__g", F.col("__left").alias("__need")).filter("__left < __at"))
    ties = rows.join(inner.select("__g", "__cut"), "__g").withColumn(col, F.col("__h") <= F.col("__cut"))
    return plain.unionByName(ties.select(*[qcol(c) for c in df.columns], col))
