"""Linear models over many groups at once, from centred moments.

A fit needs only counts, means and co-moments, which Spark accumulates map-side and merges pairwise for any number of groups;
products of raw values, which would cancel where means are large, are never summed. The per-group solve (at most a few dozen
unknowns) is a vectorized helper on them. Expanding folds reuse them: fold k merges the moments of steps 0..k.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitcast.operators import splits
from pitcast.session import staged


@dataclass(frozen=True)
class LinearSpec:
    """``ols``; ``ridge`` and ``elastic_net`` act on features scaled by their population deviation."""

    kind: str = "ols"
    alpha: float = 0.0
    l1_ratio: float = 0.0


OLS = LinearSpec()
RIDGE = LinearSpec("ridge", 10.0)
ELASTIC_NET = LinearSpec("elastic_net", 0.1, 0.5)


WIDE = 12


def moment_count(n_features: int) -> int:
    width = n_features + 2
    return width * (width + 1) // 2


def _place(i: int, j: int, width: int) -> str:
    """Column of entry ``i <= j`` of the packed upper triangle."""
    return f"m{i * width - i * (i - 1) // 2 + j - i}"


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Packed upper triangle per key over (1, features, target), as columns m0, m1, ...

    The first is the count, the rest of the first row holds means, and the other rows hold co-moments, the sums of products of
    deviations from the means.
    """
    rows = df.dropna(subset=[*features, target])
    values = [F.col(f).cast("double") for f in [*features, target]]
    if len(features) > WIDE:
        return _wide_moments(rows, keys, values)
    width = len(values) + 1
    n = F.count(F.lit(1))
    parts = {"m0": n.cast("double")} | {_place(0, j, width): F.avg(v) for j, v in enumerate(values, 1)}
    for i in range(1, width):
        for j in range(i, width):
            parts[_place(i, j, width)] = F.covar_pop(values[i - 1], values[j - 1]) * n
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in parts.items()])


def _wide_moments(rows: DataFrame, keys: Sequence[str], values: list[Column]) -> DataFrame:
    """The same moments for many features: pairs become rows whose co-moments combine map-side per position.

    Hundreds of separate aggregates would outgrow generated code; this plan has three. A constant 1 ahead of the values gives the means.
    """
    width = len(values) + 1
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.transform(F.slice("_v", i, F.lit(width + 1) - i), lambda x: F.struct(F.element_at("_v", i).alias("a"), x.alias("b"))),
    ))
    long = rows.select(*keys, F.array(F.lit(1.0), *values).alias("_v")).select(*keys, F.posexplode(pairs).alias("_p", "_x"))
    a, b, n = F.col("_x.a"), F.col("_x.b"), F.count(F.lit(1)).cast("double")
    per = long.groupBy(*keys, "_p").agg(
        F.when(F.col("_p") == 0, n).when(F.col("_p") < width, F.avg(b)).otherwise(F.covar_pop(a, b) * n).alias("_s")
    )
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_a"))
    return packed.select(*keys, *[F.col("_a")[i]["_s"].alias(f"m{i}") for i in range(width * (width + 1) // 2)])


def _summable(parts: DataFrame, keys: Sequence[str], order: str, n_features: int) -> DataFrame:
    """``parts`` with moments about a point of their key, ``_ref``, which add up; the point is the mean of the key's first part.

    It lies within the values, so that sums about it do not cancel, and no later part can move it.
    """
    width = n_features + 2
    first = F.min_by(F.array(*[F.col(_place(0, j, width)) for j in range(1, width)]), F.when(F.col("m0").isNotNull(), F.col(order))).over(W.partitionBy(*keys))
    held = parts.withColumn("_ref", first)
    gap = {j: F.col(_place(0, j, width)) - F.col("_ref")[j - 1] for j in range(1, width)}
    about = {_place(0, j, width): F.col("m0") * g for j, g in gap.items()}
    for i in range(1, width):
        about |= {_place(i, j, width): F.col(_place(i, j, width)) + F.col("m0") * gap[i] * gap[j] for j in range(i, width)}
    return held.withColumns(about)


def _centred(sums: DataFrame, n_features: int) -> DataFrame:
    """Moments about the mean again, of sums of :func:`_summable` parts."""
    width = n_features + 2
    n = F.col("m0")
    back = {_place(0, j, width): F.col("_ref")[j - 1] + F.col(_place(0, j, width)) / n for j in range(1, width)}
    for i in range(1, width):
        back |= {_place(i, j, width): F.col(_place(i, j, width)) - F.col(_place(0, i, width)) * F.col(_place(0, j, width)) / n for j in range(i, width)}
    return sums.where(n > 0).withColumns(back).drop("_ref")


def running_moments(parts: DataFrame, keys: Sequence[str], step: str, n_features: int, extra: Sequence[str] = ()) -> DataFrame:
    """Moments merged along ``step``; one small row per (key, step) enters the window, and rows without moments only ask."""
    w = W.partitionBy(*keys).orderBy(step).rangeBetween(W.unboundedPreceding, W.currentRow)
    names = [f"m{i}" for i in range(moment_count(n_features))]
    held = _summable(parts, keys, step, n_features)
    return _centred(held.select(*keys, step, *extra, "_ref", *[F.sum(m).over(w).alias(m) for m in names]), n_features)


def merged_moments(parts: DataFrame, keys: Sequence[str], group: Sequence[str], n_features: int) -> DataFrame:
    """Moments of each group of :func:`_summable` ``parts`` of the same key."""
    names = [f"m{i}" for i in range(moment_count(n_features))]
    return _centred(parts.groupBy(*keys, *group).agg(F.any_value("_ref").alias("_ref"), *[F.sum(m).alias(m) for m in names]), n_features)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = packed
    return full + np.triu(full, 1).T


def solve_one(packed: np.ndarray, n_features: int, spec: LinearSpec) -> np.ndarray:
    """Intercept and coefficients from packed moments."""
    g = _unpack(packed, n_features + 2)
    n = g[0, 0]
    mean = g[0, 1:]
    cov = g[1:, 1:] / n
    sxx, sxy = cov[:-1, :-1], cov[:-1, -1]
    if spec.kind == "ols":
        beta = np.linalg.pinv(sxx, rcond=1e-12, hermitian=True) @ sxy
    else:
        var = np.diag(sxx)
        tiny = 1e-24 * mean[:-1] ** 2
        scale = np.where(var > tiny, np.sqrt(np.maximum(var, 0.0)), 1.0)
        zxx = sxx / np.outer(scale, scale)
        zxy = np.where(var > tiny, sxy, 0.0) / scale
        if spec.kind == "ridge":
            z = np.linalg.solve(zxx + np.eye(n_features) * spec.alpha / n, zxy)
        else:
            z = _coordinate_descent(zxx, zxy, spec)
        beta = z / scale
    return np.concatenate([[mean[-1] - mean[:-1] @ beta], beta])


def _coordinate_descent(zxx: np.ndarray, zxy: np.ndarray, spec: LinearSpec) -> np.ndarray:
    l1, l2 = spec.alpha * spec.l1_ratio, spec.alpha * (1 - spec.l1_ratio)
    z = np.zeros(len(zxy))
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(z)):
            rho = zxy[j] - zxx[j] @ z + zxx[j, j] * z[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (zxx[j, j] + l2)
            largest = max(largest, abs(new - z[j]))
            z[j] = new
        if largest < 1e-12:
            break
    return z


def solve(moment_rows: DataFrame, keys: Sequence[str], n_features: int, spec: LinearSpec = OLS) -> DataFrame:
    """One row of parameters per key: ``coef`` = [intercept, b1, ...] and ``n_train``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fit(packed: pd.Series) -> pd.Series:
        return pd.Series([solve_one(np.asarray(p, dtype=float), n_features, spec) for p in packed])

    names = [f"m{i}" for i in range(moment_count(n_features))]
    rows = moment_rows.where(F.col("m0") > 0)
    return rows.select(*keys, F.col("m0").cast("bigint").alias("n_train"), fit(F.array(*names)).alias("coef"))


def fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, spec: LinearSpec = OLS) -> DataFrame:
    return solve(moments(df, keys, features, target), keys, len(features), spec)


def dot(coef: Column | str, features: Sequence[Column | str]) -> Column:
    """Intercept plus weighted features, NULL when any input is."""
    c = F.col(coef) if isinstance(coef, str) else coef
    total = c[0]
    for i, f in enumerate(features, start=1):
        total = total + c[i] * (F.col(f) if isinstance(f, str) else f).cast("double")
    return total


def score(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str],
          prediction: str = "prediction") -> DataFrame:
    """Attach predictions; parameters have one row per key, so Spark broadcasts them while small."""
    joined = df.join(params, list(keys)) if keys else df.withColumn("coef", params.select("coef").scalar())
    return joined.withColumn(prediction, dot("coef", features)).drop("coef", "n_train")


def fit_folds(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, date: str,
              spec: splits.FoldSpec, folds: DataFrame, model: LinearSpec = OLS) -> DataFrame:
    """Parameters per (key, fold).

    Expanding windows read every row once and take running sums over the fold steps. Windows of
    fixed length sum the per-date moments of their span instead.
    """
    k = len(features)
    if spec.lookback is None:
        rows = df
        if spec.train_start is not None:
            rows = df.where(F.col(date).cast("timestamp") >= F.lit(spec.train_start))
        stepped = rows.withColumn("_k", splits.first_training_step(date, spec))
        per_step = moments(stepped, [*keys, "_k"], features, target)
        # A step without new rows still needs its fold, so the sums are read at every fold step.
        steps = folds.agg(F.collect_set("_k")).scalar()
        spine = per_step.select(*keys).distinct().withColumn("_k", F.explode(steps)).withColumn("_asked", F.lit(True))
        both = per_step.unionByName(spine, allowMissingColumns=True)
        running = running_moments(both, keys, "_k", k, ["_asked"])
        per_fold = running.where(F.col("_asked")).join(folds.select("_k", "fold"), "_k").drop("_k", "_asked")
    else:
        per_date = _summable(moments(df, [*keys, date], features, target), keys, date, k)
        per_fold = merged_moments(splits.training_rows(per_date, date, spec, folds), keys, ["fold"], k)
    return solve(per_fold, [*keys, "fold"], k, model)


def backtest(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, date: str,
             spec: splits.FoldSpec, model: LinearSpec = OLS, prediction: str = "predicted_weekly_change") -> DataFrame:
    """One-step rolling-origin backtest of all series and folds in one job."""
    clean = staged(df.dropna(subset=[*features, target]).select(*dict.fromkeys([*keys, date, target, *features])), "backtest")
    folds = splits.fold_table(clean, date, spec)
    params = fit_folds(clean, keys, features, target, date, spec, folds, model)
    rows = splits.validation_rows(clean, date, spec, folds)
    scored = rows.join(params, [*keys, "fold"]).withColumn(prediction, dot("coef", features))
    return scored.select(
        *keys, date, target, "fold", "n_train", prediction, (F.col(target) - F.col(prediction)).alias("forecast_deviation")
    )


def seasonal_band(df: DataFrame, params: DataFrame, train: DataFrame, keys: Sequence[str], features: Sequence[str],
                  target: str = "weekly_change_bcf") -> DataFrame:
    """Predictions with a band of one residual sample deviation of the training rows."""
    resid = score(train, params, keys, features, "_p").groupBy(*keys).agg(
        F.stddev_samp(F.col(target) - F.col("_p")).alias("_std")
    )
    scored = score(df, params, keys, features, "predicted_weekly_change").join(resid, list(keys))
    return scored.withColumns(
        {
            "lower_band": F.col("predicted_weekly_change") - F.col("_std"),
            "upper_band": F.col("predicted_weekly_change") + F.col("_std"),
        }
    ).drop("_std")


def autoregressive_error_fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, date: str) -> DataFrame:
    """Regression with first-order autocorrelated errors, by one Cochrane-Orcutt round.

    Pass one fits least squares and measures the residual autocorrelation per series; pass two
    fits the quasi-differenced rows. ``coef`` is expressed for the original scale.
    """
    w = W.partitionBy(*keys).orderBy(date)
    first = score(df, fit(df, keys, features, target), keys, features, "_p")
    resid = first.withColumn("_e", F.col(target) - F.col("_p"))
    pairs = resid.withColumn("_e1", F.lag("_e").over(w)).where(F.col("_e1").isNotNull())
    rho = pairs.groupBy(*keys).agg(F.regr_slope("_e", "_e1").alias("rho"))
    shifted = df.join(rho, list(keys))
    cols = [*features, target]
    quasi = shifted.withColumns({c: F.col(c) - F.col("rho") * F.lag(c).over(w) for c in cols}).dropna(subset=cols)
    second = fit(quasi, keys, features, target).join(rho, list(keys))
    rest = F.slice("coef", 2, len(features))
    return second.select(*keys, "n_train", "rho", F.concat(F.array(F.col("coef")[0] / (1 - F.col("rho"))), rest).alias("coef"))


def autoregressive_one_step(df: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str],
                            target: str, date: str) -> DataFrame:
    """One-step prediction: regression value plus rho times the previous residual."""
    w = W.partitionBy(*keys).orderBy(date)
    base = df.join(params, list(keys)).withColumn("_x", dot("coef", features))
    previous = F.lag(F.col(target) - F.col("_x")).over(w)
    return base.withColumn("prediction", F.col("_x") + F.col("rho") * previous).drop("_x", "coef", "n_train")


def harmonic_search(train: DataFrame, evaluation: DataFrame, keys: Sequence[str], target: str, max_harmonics: int = 10) -> DataFrame:
    """Error of every harmonic count 1..K, fitted from one set of moments per series."""
    from pitcast.functions.calendar import add_fourier, fourier_names

    names = fourier_names(max_harmonics)
    wide = moments(add_fourier(train, max_harmonics), keys, names, target)
    full = 2 * max_harmonics

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def fit_all(packed: pd.Series) -> pd.Series:
        out = []
        for p in packed:
            g = _unpack(np.asarray(p, dtype=float), full + 2)
            sub = []
            for k in range(1, max_harmonics + 1):
                pick = [*range(2 * k + 1), full + 1]
                part = g[np.ix_(pick, pick)][np.triu_indices(2 * k + 2)]
                sub.append(np.concatenate([solve_one(part, 2 * k, OLS), np.zeros(full - 2 * k)]))
            out.append(sub)
        return pd.Series(out)

    packed = F.array(*[f"m{i}" for i in range(moment_count(full))])
    params = wide.select(*keys, F.posexplode(fit_all(packed)).alias("_i", "coef")).withColumn(
        "harmonics", (F.col("_i") + 1).cast("int")
    )
    scored = add_fourier(evaluation, max_harmonics).join(params.drop("_i"), list(keys))
    error = F.abs(F.col(target) - dot("coef", names))
    return scored.groupBy(*keys, "harmonics").agg(F.avg(error).alias("mae"))
