"""Frames over blocks with halos, newest rows by limits, and fold extents without copies of rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.operators import ordered, power, rollups, splits

START = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("before,block", [(0, 1), (3, 3), (5, 2), (4, 50), (7, 10_000)])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_frames_cross_blocks(spark, before, block, keys):
    rng = random.Random(before)
    rows = [("ab"[i % 5 == 0], i, rng.choice([None, float(rng.randint(0, 9))])) for i in range(211)]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(6)
    part = [F.col(k) for k in keys]
    plain = W.partitionBy(*part).orderBy("t")
    want = df.select("g", "t", F.sum("v").over(plain.rowsBetween(-before, 0)).alias("s"), F.lag("v", before).over(plain).alias("l"))
    w = W.partitionBy(*part, "_block").orderBy("_pos")
    blocks = ordered.framed(df, keys, ["t"], before, block)
    got = blocks.withColumns({"s": F.sum("v").over(w.rowsBetween(-before, 0)), "l": F.lag("v", before).over(w)}).where(~F.col("_halo")).select("g", "t", "s", "l")
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert blocks.groupBy(*keys, "_block").count().agg(F.max("count")).first()[0] <= max(block, before, 1) + before


def fuel(spark, n):
    rng = random.Random(4)
    rows = [(START + dt.timedelta(hours=h), rng.choice([None, 0.0, rng.uniform(1, 9)]), rng.choice([0.0, rng.uniform(1, 9)])) for h in range(n) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "valid_at timestamp, gas_mw double, coal_mw double").repartition(5), sorted(rows)


def test_share_residuals_of_a_long_series_equal_a_loop(spark, monkeypatch):
    df, rows = fuel(spark, 2600)
    monkeypatch.setattr(power, "framed", lambda *a: ordered.framed(*a, block=900))
    known = [(t, g, g + c, g / (g + c) if g + c > 0 else None) for t, g, c in rows if g is not None]
    trailing = []
    for i in range(len(known)):
        shares = [s for *_, s in known[max(0, i - 719) : i + 1] if s is not None]
        trailing.append(sum(shares) / len(shares) if len(shares) >= 24 else None)
    want = {(b, known[i][0]): abs(known[i][1] - known[i][2] * trailing[i - k]) for b, k in power.SHARE_LAGS.items() for i in range(k, len(known)) if trailing[i - k] is not None}
    got = {(r.horizon_bucket, r.valid_at): r.abs_error for r in power.share_residuals(df).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_recent_share_and_level_read_the_newest_rows(spark):
    df, rows = fuel(spark, 2600)
    end = START + dt.timedelta(hours=2500)
    shares = [g / (g + c) for t, g, c in rows if t < end and g is not None and g + c > 0]
    r = power.recent_gas_share(df, F.lit(end)).first()
    assert len(shares) > 900 and r.gas_share == pytest.approx(sum(shares[-720:]) / 720) and r.n_hours == len(shares)
    keyed = power.recent_gas_share(df.withColumn("g", F.lit("x")), F.lit(end), ["g"]).first()
    assert keyed.gas_share == pytest.approx(r.gas_share)
    assert power.recent_gas_share(df, F.lit(START)).isEmpty() or power.recent_gas_share(df, F.lit(START)).first().n_hours == 0
    unkeyed = power.recent_gas_share(df, F.lit(end))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in unkeyed or "TakeOrdered" in unkeyed
    values = df.withColumn("g", F.when(F.year("valid_at") > 2000, "x").otherwise("y"))
    profile = rollups.hour_profile(values, "gas_mw", ["g"])
    by_hour = {p.hour_of_week: p.profile_mw for p in profile.collect()}
    hours = {h.valid_at: h.h for h in values.select("valid_at", rollups.hour_of_week("valid_at").alias("h")).collect()}
    known = [(t, g) for t, g, _ in rows if g is not None]
    level = rollups.hour_level(values, profile, "gas_mw", ["g"])
    assert level.first().adjust_mw == pytest.approx(sum(g - by_hour[hours[t]] for t, g in known[-24:]) / 24)
    assert level.first().mean_mw == pytest.approx(sum(g for _, g in known) / len(known))
    assert "WindowGroupLimit" in level._jdf.queryExecution().executedPlan().toString()


DAY = 86_400
SPECS = [
    splits.expanding_weeks("2025-01-10", "2025-03-01", 2, 1),
    splits.rolling_weeks("2025-02-01", "2025-03-01", 1, 2),
    splits.FoldSpec(dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc), 5 * DAY, 3 * DAY, None, 9 * DAY, 2 * DAY),
    splits.FoldSpec(dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc), 2 * DAY, 9 * DAY, None, 4 * DAY),
    splits.FoldSpec(dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc), 30 * DAY, 1 * DAY),
]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_fold_extents_equal_copies_of_rows(spark, spec, keys):
    rng = random.Random(6)
    rows = [("abc"[rng.randrange(3)], START + dt.timedelta(hours=rng.randrange(24 * 160))) for _ in range(160)]
    rows += [("late", START + dt.timedelta(days=150)), ("early", START + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, "g string, t timestamp").repartition(3)
    folds = splits.fold_table(df, "t", spec)
    train = splits.training_rows(df, "t", spec, folds).groupBy(*keys, "fold").agg(F.count("*").alias("n_train"), F.max("t").alias("last_train"))
    val = splits.validation_rows(df, "t", spec, folds).groupBy(*keys, "fold").agg(F.count("*").alias("n_val"), F.min("t").alias("first_val"))
    names = [*keys, "fold", "n_train", "last_train", "n_val", "first_val"]
    want = val.join(train, [*keys, "fold"], "left").fillna(0, ["n_train"]).select(*names)
    got = splits.fold_extents(df, "t", spec, folds, keys).where("n_val > 0").select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 3
