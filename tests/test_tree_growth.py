"""Tree growth against a plain grower, quantiles against brute force, and the backtest of any model."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest

from pitcast.operators import backtests, linear, splits
from pitcast.operators import tree_growth as tg


def plain_tree(x, g, h, spec):
    """One tree, split by split: the leaf and split with the largest rise first. Returns a function of rows."""
    score = lambda i: g[i].sum() ** 2 / (h[i].sum() + spec.l2)

    def best(i):
        top = (1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[i, f])
            for a, b in zip(values[:-1], values[1:]):
                low, high = i[x[i, f] <= a], i[x[i, f] > a]
                if min(len(low), len(high)) >= spec.min_leaf:
                    rise = score(low) + score(high) - score(i)
                    if rise > top[0] + 1e-9 * score(i):
                        top = (rise, (f, a + (b - a) / 2, low, high))
        return top

    root = {"rows": np.arange(len(g))}
    leaves = [root]
    while spec.max_leaves is None or len(leaves) < spec.max_leaves:
        for leaf in leaves:
            if "best" not in leaf:
                leaf["best"] = best(leaf["rows"])
        rise, split = max((leaf["best"] for leaf in leaves), key=lambda b: b[0] if b[1] else -1)
        if split is None:
            break
        leaf = next(x for x in leaves if x["best"][1] is split)
        f, at, low, high = split
        leaf |= {"split": (f, at), "low": {"rows": low}, "high": {"rows": high}}
        leaves = [x for x in leaves if x is not leaf] + [leaf["low"], leaf["high"]]

    def leaf_of(v):
        node = root
        while "split" in node:
            f, at = node["split"]
            node = node["low"] if v[f] <= at else node["high"]
        return node

    return leaf_of


def value(leaf, g, h, spec):
    return g[leaf["rows"]].sum() / (h[leaf["rows"]].sum() + spec.l2)


def data(n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 4, n)
    y = np.round(5 * x[:, 0] + 3 * np.sin(3 * x[:, 1]) + 2 * x[:, 2] + rng.normal(size=n), 2)
    return x, y


@pytest.mark.parametrize("leaves", [None, 4, 9])
def test_many_trees_at_once_equal_single_ones(leaves):
    x, y = data()
    spec = replace(tg.BOOSTING, min_leaf=4, max_leaves=leaves)
    sizes = [30, 77, 120]
    row, tree = np.concatenate([np.arange(s) for s in sizes]), np.repeat(np.arange(3), sizes)
    grown = tg.grow(x, row, tree, 3, y[row], np.ones(len(row)), spec)
    for t, s in enumerate(sizes):
        leaf_of = plain_tree(x[:s], y[:s], np.ones(s), spec)
        got = grown.value[grown.leaves(x, np.arange(120), np.full(120, t))]
        assert got == pytest.approx([value(leaf_of(v), y[:s], np.ones(s), spec) for v in x])


def test_boosting_equals_a_plain_loop_fold_by_fold():
    x, y = data()
    spec = replace(tg.BOOSTING, size=12, min_leaf=6, max_leaves=5, rate=0.3)
    train, asked = [np.arange(60), np.arange(20, 100)], [np.arange(60, 80), np.arange(100, 120)]
    for got, rows, wanted in zip(tg.fit_predict(x, y, train, asked, spec), train, asked):
        raw, out = np.full(len(rows), y[rows].mean()), np.full(len(wanted), y[rows].mean())
        for _ in range(spec.size):
            g, h = y[rows] - raw, np.ones(len(rows))
            leaf_of = plain_tree(x[rows], g, h, spec)
            raw = raw + spec.rate * np.array([value(leaf_of(v), g, h, spec) for v in x[rows]])
            out = out + spec.rate * np.array([value(leaf_of(v), g, h, spec) for v in x[wanted]])
        assert got[:, 0] == pytest.approx(out)


def test_quantile_boosting_moves_leaves_by_quantiles():
    x, y = data()
    spec = replace(tg.QUANTILE_BOOSTING, size=6, min_leaf=10, max_leaves=4, rate=0.5, quantiles=(0.1, 0.9))
    rows, wanted = np.arange(90), np.arange(90, 120)
    got = tg.fit_predict(x, y, [rows], [wanted], spec)[0]
    for j, q in enumerate(spec.quantiles):
        raw, out = np.full(90, np.percentile(y[rows], 100 * q)), np.full(30, np.percentile(y[rows], 100 * q))
        for _ in range(spec.size):
            left = y[rows] - raw
            g, h = np.where(left >= 0, q, q - 1), np.ones(90)
            leaf_of = plain_tree(x[rows], g, h, spec)
            step = lambda v: np.percentile(left[leaf_of(v)["rows"]], 100 * q)  # noqa: B023, E731
            raw, out = raw + spec.rate * np.array([step(v) for v in x[rows]]), out + spec.rate * np.array([step(v) for v in x[wanted]])
        assert got[:, j] == pytest.approx(out)


def test_forest_is_the_mean_of_trees_on_bootstrap_rows():
    x, y = data()
    spec = replace(tg.FOREST, size=5)
    rows, wanted = np.arange(100), np.arange(100, 120)
    got = tg.fit_predict(x, y, [rows], [wanted], spec)[0][:, 0]
    draws = np.random.default_rng([spec.seed, 0]).integers(0, 100, (5, 100))
    want = np.zeros(20)
    for d in draws:
        times = np.bincount(d, minlength=100)
        bag = np.flatnonzero(times)
        g, h = times[bag] * y[bag], times[bag].astype(float)
        leaf_of = plain_tree(x[bag], g, h, spec)
        want += [value(leaf_of(v), g, h, spec) / 5 for v in x[wanted]]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("outlier", [0.0, 1e12])
def test_forest_quantiles_are_order_statistics(outlier):
    x, y = data()
    y = y.copy()
    y[7] += outlier
    spec = replace(tg.QUANTILE_FOREST, size=7, quantiles=(0.1, 0.5, 0.9))
    rows, wanted = np.arange(100), np.arange(100, 120)
    got = tg.fit_predict(x, y, [rows], [wanted], spec)[0]
    grown = tg.bag(x[rows], y[rows], spec, 0)
    leaf = lambda v, t: grown.leaves(v[None, :], np.array([0]), np.array([t]))[0]
    for i, v in enumerate(x[wanted]):
        weight = np.zeros(100)
        for t in range(7):
            mates = [r for r in rows if leaf(x[r], t) == leaf(v, t)]
            weight[mates] += 1 / len(mates)
        order = np.argsort(y[rows], kind="stable")
        total = np.cumsum(weight[order])
        assert list(got[i]) == [y[rows][order][np.flatnonzero(total >= q * total[-1] - 1e-9)[0]] for q in spec.quantiles]


SPEC = splits.expanding_weeks("2016-01-01", "2017-12-29", 8, 8)
FEATURES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def frame(spark):
    out = []
    for g, seed in (("a", 1), ("b", 2)):
        x, y = data(150, seed)
        out += [(g, dt.date(2016, 1, 8) + dt.timedelta(weeks=i), *map(float, v), float(t), 1) for i, (v, t) in enumerate(zip(x, y))]
    out += [("short", dt.date(2018, 2, 2), 0.0, 0.0, 0.0, 1.0, 1), ("a", dt.date(2016, 1, 7), None, 0.0, 0.0, 1.0, 1), ("b", dt.date(2018, 3, 1), 0.0, 0.0, 0.0, None, 1)]
    return spark.createDataFrame(out, "g string, date date, x0 double, x1 double, x2 double, y double, fold int").repartition(5)


def test_backtest_fits_each_series_and_fold(frame):
    spec = replace(tg.BOOSTING, size=8, min_leaf=5)
    rows = [r for r in frame.collect() if r.g == "a" and r.x0 is not None]
    rows.sort(key=lambda r: r.date)
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r.y for r in rows])
    got = {(r.date, r.fold): r for r in backtests.one_step(frame, ["g"], FEATURES, "y", "date", SPEC, spec).collect() if r.g == "a"}
    one = {(r.date, r.fold): r.n_train for r in backtests.one_step(frame, ["g"], FEATURES, "y", "date", SPEC).collect() if r.g == "a"}
    assert {k: r.n_train for k, r in got.items()} == one and len({f for _, f in got}) > 3
    for (day, fold), r in got.items():
        n = r.n_train
        assert all(v.date < day for v in rows[:n])
        want = tg.fit_predict(x, y, [np.arange(n)], [np.array([i for i, v in enumerate(rows) if v.date == day])], spec)[0][0, 0]
        assert r.predicted_weekly_change == pytest.approx(want)


def test_later_rows_change_nothing(frame):
    from pyspark.sql import functions as F

    spec = replace(tg.FOREST, size=4)
    folds = lambda df: {(r.g, r.date, r.fold): r.predicted_weekly_change for r in backtests.one_step(df, ["g"], FEATURES, "y", "date", SPEC, spec).collect()}
    end = dt.date(2018, 6, 1)
    whole, changed = folds(frame), folds(frame.withColumn("y", F.when(F.col("date") >= F.lit(end), F.col("y") + 1000).otherwise(F.col("y"))))
    early = [k for k in whole if k[1] < end]
    assert early and all(whole[k] == changed[k] for k in early)


def test_blend_is_the_average_and_needs_one_prediction(frame):
    spec = replace(tg.BOOSTING, size=5)
    run = lambda m: {(r.g, r.date, r.fold): r.predicted_weekly_change for r in backtests.one_step(frame, ["g"], FEATURES, "y", "date", SPEC, m).collect()}
    a, b, both = run(linear.RIDGE), run(spec), run(backtests.Blend((linear.RIDGE, spec)))
    assert set(a) == set(b) == set(both) and all(both[k] == pytest.approx((a[k] + b[k]) / 2) for k in a)
    with pytest.raises(ValueError):
        run(backtests.Blend((linear.OLS, tg.QUANTILE_FOREST)))


def test_quantile_backtest_and_empty_table(frame):
    out = backtests.one_step(frame, ["g"], FEATURES, "y", "date", SPEC, replace(tg.QUANTILE_FOREST, size=6))
    assert out.where("p10 > p90").isEmpty() and out.count() > 20
    assert backtests.one_step(frame.limit(0), ["g"], FEATURES, "y", "date", SPEC, replace(tg.FOREST, size=2)).isEmpty()
