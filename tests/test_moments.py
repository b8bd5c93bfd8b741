"""Moments of values with large means against NumPy."""

import datetime as dt

import numpy as np
import pytest

from pitcast.operators import linear, reconcile, splits


def large(n, k, seed=3):
    rng = np.random.default_rng(seed)
    x = 1e7 + rng.normal(size=(n, k))
    return x, x @ np.linspace(1, -1, k) + 0.1 * rng.normal(size=n) + 3e6


def exact(x, y, alpha=0.0):
    """Least squares (or ridge on scaled features) of centred values."""
    cx, cy = x - x.mean(axis=0), y - y.mean()
    s = cx.std(axis=0) if alpha else np.ones(x.shape[1])
    beta = np.linalg.solve((cx / s).T @ (cx / s) + alpha * np.eye(x.shape[1]), (cx / s).T @ cy) / s
    return np.concatenate([[y.mean() - x.mean(axis=0) @ beta], beta])


def frame(spark, x, y):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [("a", dt.date(2016, 1, 1) + dt.timedelta(weeks=i), *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    rows += [("none", dt.date(2016, 1, 1), *[None] * len(names), 1.0), ("one", dt.date(2016, 1, 1), *[1e7] * len(names), 2.0)]
    return spark.createDataFrame(rows, f"g string, date date, {', '.join(n + ' double' for n in names)}, y double").repartition(7), names


@pytest.mark.parametrize("k", [2, 14])
@pytest.mark.parametrize("spec", [linear.OLS, linear.RIDGE])
def test_fits_with_large_means(spark, k, spec):
    x, y = large(400, k)
    df, names = frame(spark, x, y)
    got = {r["g"]: r for r in linear.fit(df, ["g"], names, "y", spec).collect()}
    want = exact(x, y, spec.alpha)
    assert np.abs(np.array(got["a"]["coef"][1:]) - want[1:]).max() < 1e-8
    at = x[:5] @ np.array(got["a"]["coef"][1:]) + got["a"]["coef"][0]
    assert np.abs(at - (x[:5] @ want[1:] + want[0])).max() < 1e-6
    assert set(got) == {"a", "one"} and got["one"]["n_train"] == 1 and got["one"]["coef"][1:] == [0.0] * k


@pytest.mark.parametrize("rolling", [False, True])
def test_folds_with_large_means(spark, rolling):
    x, y = large(200, 2)
    df, names = frame(spark, x, y)
    make = splits.rolling_weeks if rolling else splits.expanding_weeks
    spec = make("2016-06-03", "2017-12-29", 8, 8)
    folds = splits.fold_table(df, "date", spec)
    bounds = {r["fold"]: (r["train_start"].date(), r["train_end"].date()) for r in folds.collect()}
    days = [dt.date(2016, 1, 1) + dt.timedelta(weeks=i) for i in range(200)]
    got = {r["fold"]: r for r in linear.fit_folds(df, ["g"], names, "y", "date", spec, folds).where("g = 'a'").collect()}
    assert len(got) == len(bounds) > 5
    for fold, (low, high) in bounds.items():
        rows = [i for i, d in enumerate(days) if low <= d < high]
        assert got[fold]["n_train"] == len(rows)
        assert np.abs(np.array(got[fold]["coef"][1:]) - exact(x[rows], y[rows])[1:]).max() < 1e-8


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_shrinkage_with_large_means(spark, keys):
    from test_models import ledoit_wolf

    rng = np.random.default_rng(8)
    v = 1e7 + rng.normal(size=(60, 6)) * np.arange(1, 7)
    start = dt.date(2020, 1, 3)
    rows = [("k", start + dt.timedelta(weeks=i), 1, r, float(v[i, j])) for i in range(60) for j, r in enumerate(reconcile.ALL_REGIONS)]
    residuals = spark.createDataFrame(rows, "g string, date date, horizon int, region string, residual double")
    origins = spark.createDataFrame([("k", start + dt.timedelta(weeks=i)) for i in (10, 30, 60)], "g string, forecast_origin date")
    out = reconcile.mint_adjustments(reconcile.residual_vectors(residuals, keys=keys), origins, keys).collect()
    u = np.array([1.0] + [-1.0] * 5)
    assert len(out) == 3
    for r in out:
        known = v[: r["n_vectors"]]
        cu = ledoit_wolf(known - known.mean(axis=0)) @ u
        assert np.abs(np.array(r["adjustment"]) - cu / (u @ cu)).max() < 1e-8
