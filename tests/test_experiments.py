"""Permutations, replayed bootstrap draws, and the contracts of paired comparisons."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitcast.functions.hashing import permuted
from pitcast.operators import experiments

DAY = dt.date(2020, 1, 3)


def hashed(tag, n):
    return int(hashlib.md5(tag.encode()).hexdigest()[:15], 16) % n


@pytest.mark.parametrize("n", [1, 2, 3, 64, 501])
def test_permutations_are_one_to_one_for_every_size(spark, n):
    rows = spark.range(n).select(*[permuted(F.col("id"), F.lit(f"t{k}"), F.lit(n).cast("long")).alias(f"p{k}") for k in range(3)]).collect()
    for k in range(3):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(n))
    if n > 100:
        moved = [r["p0"] - i for i, r in enumerate(rows)]
        assert len({r["p0"] - r["p1"] for r in rows}) > n / 3 and abs(np.corrcoef(range(n), [r["p0"] for r in rows])[0, 1]) < 0.2 and len(set(moved)) > n / 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_bootstrap_equals_its_replay(spark, n):
    rng = np.random.default_rng(n)
    gains = rng.normal(1, 2, n)
    rows = [("a", DAY + dt.timedelta(weeks=i), float(g)) for i, g in enumerate(gains)] + [("a", DAY - dt.timedelta(weeks=1), None), ("b", DAY, 3.0)]
    df = spark.createDataFrame(rows, "region string, date date, error_gain double").repartition(3)
    got = {r["region"]: r for r in experiments.block_bootstrap(df, ["date"], keys=["region"], draws=50, seed=9).collect()}
    means = []
    for draw in range(1, 51):
        picks = np.concatenate([gains[(hashed(f"9:{draw}:{b}", n) + np.arange(4)) % n] for b in range(1, -(-n // 4) + 1)])[:n]
        means.append(picks.mean())
    assert got["a"]["mae_improvement"] == pytest.approx(gains.mean())
    assert [got["a"]["ci_lower"], got["a"]["ci_upper"]] == pytest.approx(list(np.quantile(means, [0.025, 0.975])))
    assert got["b"]["ci_lower"] == got["b"]["ci_upper"] == 3.0


def side(spark, rows):
    return spark.createDataFrame(rows, "date date, region string, horizon int, actual_weekly_change double, predicted_weekly_change double, p10 double, p90 double")


def good(n=5):
    return [(DAY + dt.timedelta(weeks=i), "R48", 1, 10.0 + i, 8.0 + i, 0.0, 20.0) for i in range(n)]


def test_pairs_are_one_to_one_with_equal_actuals(spark):
    base = side(spark, good())
    assert experiments.pair(base, base).count() == 5
    with pytest.raises(Exception, match="key twice"):
        experiments.pair(side(spark, good() + good(1)), base).collect()
    with pytest.raises(Exception, match="key twice"):
        experiments.pair(base, side(spark, good() + good(1))).count()
    moved = [(*good()[0][:3], 11.0, *good()[0][4:])] + good()[1:]
    with pytest.raises(Exception, match="actuals do not match"):
        experiments.pair(base, side(spark, moved)).collect()


def test_promotion_needs_two_pairs(spark):
    with pytest.raises(ValueError, match="at least two"):
        experiments.promotion_gate(side(spark, good(1)), side(spark, good(1)))
    with pytest.raises(ValueError, match="at least two"):
        experiments.promotion_gate(side(spark, good(3)), side(spark, [(*r[:2], 2, *r[3:]) for r in good(3)]))


def test_importance_equals_swapping_rows(spark):
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(37, 2)), 37
    y = 3 * x[:, 0] + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "i int, x0 double, x1 double, y double").repartition(4)
    got = {r["feature"]: r for r in experiments.permutation_importance(df, ["x0", "x1"], "y", lambda c: 3 * c["x0"] + 0.5 * c["x1"], 4, 7, ["i"]).collect()}

    def donor(i, repeat):
        for r in range(1, 21):
            other = (hashed(f"7:{repeat}:{r}", n) - i) % n
            if hashlib.md5(f"7:{repeat}:{r}:{max(i, other)}".encode()).hexdigest() < "8":
                i = other
        return i

    model = lambda v: 3 * v[:, 0] + 0.5 * v[:, 1]
    base = np.abs(y - model(x)).mean()
    for j, name in enumerate(("x0", "x1")):
        gains = []
        for repeat in range(1, 5):
            moved = x.copy()
            moved[:, j] = x[[donor(i, repeat) for i in range(n)], j]
            gains.append(np.abs(y - model(moved)).mean() - base)
        assert got[name]["importance_mean"] == pytest.approx(np.mean(gains)) and got[name]["importance_std"] == pytest.approx(np.std(gains))
