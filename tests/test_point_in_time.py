"""As-of selection, features, leakage, intervals and splits on small frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pitcast.operators import asof, checks, intervals, splits
from pitcast.operators import features as ft

D = dt.date
TS = "cast(%s as timestamp)"


def stamp(text):
    return F.lit(text).cast("timestamp")


def versions(spark):
    df = spark.createDataFrame(
        [("load", "2026-07-13 02:00:00", "2026-07-12 00:00:00", "2026-07-12 01:00:00", 10.0),
         ("load", "2026-07-13 02:00:00", "2026-07-12 23:00:00", "2026-07-13 03:00:00", 99.0)],
        "component string, valid_at string, issued_at string, retrieved_at string, value double",
    )
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_at", "issued_at", "retrieved_at")})


def test_late_retrieval_is_invisible(spark):
    early = asof.select_as_of(versions(spark), stamp("2026-07-13 01:00:00"), ["component"])
    late = asof.select_as_of(versions(spark), stamp("2026-07-13 04:00:00"), ["component"])
    assert [r["value"] for r in early.collect()] == [10.0]
    assert [r["value"] for r in late.collect()] == [99.0]


def test_missing_targets(spark):
    known = asof.select_as_of(versions(spark), stamp("2026-07-01 00:00:00"), ["component"])
    want = versions(spark).select("component", "valid_at").distinct()
    assert asof.missing_targets(known, want, ["component", "valid_at"]).count() == 1


def test_many_origins_equal_brute_force(spark):
    rng = random.Random(7)
    base = dt.datetime(2026, 1, 1)
    facts, asked = [], []
    for i in range(400):
        issued = base + dt.timedelta(minutes=rng.randrange(0, 20_000))
        facts.append((rng.choice("ab"), rng.randrange(3), issued, issued + dt.timedelta(minutes=rng.randrange(0, 3000)), float(i)))
    for e in "ab":
        for v in range(3):
            for _ in range(12):
                asked.append((e, v, base + dt.timedelta(minutes=rng.randrange(0, 21_000))))
    asked = sorted(set(asked))
    f = spark.createDataFrame(facts, "e string, v int, issued timestamp, retrieved timestamp, x double")
    t = spark.createDataFrame(asked, "e string, v int, origin timestamp")
    got = {(r["e"], r["v"], r["origin"]): r["x"] for r in asof.latest_at_origins(t, f, ["e", "v"], "origin", "issued", "retrieved").collect()}
    for e, v, o in asked:
        ok = [(i, k, x) for fe, fv, i, k, x in facts if (fe, fv) == (e, v) and i <= o and k <= o]
        assert got[(e, v, o)] == (max(ok)[2] if ok else None)


def balance(spark, extra=()):
    base = [(D(2026, 6, 5) + dt.timedelta(weeks=i), "R31", "2026-06-27 00:00:00", 10.0 - i, float(i + 1)) for i in range(4)]
    df = spark.createDataFrame(base + list(extra), "date date, duoarea string, available_at string, local_balance double, net_inflow_balancing double")
    return df.withColumn("available_at", F.col("available_at").cast("timestamp"))


def test_balance_features_use_only_known_revisions(spark):
    late = [(D(2026, 6, 26), "R31", "2026-07-04 00:00:00", 500.0, 500.0)]
    origins = spark.createDataFrame([(D(2026, 7, 3), "R31")], "date date, duoarea string")
    a = asof.balance_features_at_origins(origins, balance(spark)).first()
    b = asof.balance_features_at_origins(origins, balance(spark, late)).first()
    assert a == b
    assert (a["local_balance_lag1"], a["net_inflow_balancing_lag1"], a["net_inflow_balancing_rolling_4wk"], a["balance_history_weeks"]) == (7.0, 4.0, 2.5, 4)


def test_scenario_as_of_and_ambiguity(spark):
    df = spark.createDataFrame(
        [(D(2026, 7, 10), "R31", "2026-07-01 00:00:00", "m1", 70.0), (D(2026, 7, 10), "R31", "2026-07-05 00:00:00", "m1", 35.0)],
        "date date, duoarea string, issued_at string, model string, hdd double",
    ).withColumn("issued_at", F.col("issued_at").cast("timestamp"))
    pick = lambda at: asof.scenario_as_of(df, stamp(at), "R31").first()["hdd"]
    assert pick("2026-07-02 00:00:00") == 70.0 and pick("2026-07-06 00:00:00") == 35.0
    twice = asof.scenario_as_of(df.union(df.withColumn("model", F.lit("m2"))), stamp("2026-07-06 00:00:00"), "R31")
    with pytest.raises(Exception, match="Multiple"):
        asof.require_single_model(twice).collect()


def test_weights_ignore_later_revisions(spark):
    df = spark.createDataFrame(
        [("A", "R31", "2026-01-01 00:00:00", 75.0), ("B", "R31", "2026-01-01 00:00:00", 25.0), ("A", "R31", "2026-03-01 00:00:00", 1.0)],
        "state string, duoarea string, available_at string, gas_load double",
    ).withColumn("available_at", F.col("available_at").cast("timestamp"))
    out = {r["state"]: r["weather_weight"] for r in asof.state_weights_as_of(df, stamp("2026-02-01 00:00:00"), "gas_load").collect()}
    assert out == {"A": 0.75, "B": 0.25}


def weekly(spark, change_last=None):
    storage, weather = [], []
    for r, level in (("R31", 100.0), ("R48", 300.0)):
        for i in range(60):
            day = D(2023, 1, 6) + dt.timedelta(weeks=i)
            change = float(i) if change_last is None or i < 59 else change_last
            storage.append((day, r, level + i, change))
            weather.append((day, r, 50.0, float(i), 1.0, 7))
    s = spark.createDataFrame(storage, "date date, duoarea string, storage_bcf double, weekly_change_bcf double").withColumns(
        {"year": F.year("date"), "month": F.month("date"), "week_of_year": F.weekofyear("date")}
    )
    return s, spark.createDataFrame(weather, "date date, duoarea string, temperature_f double, hdd double, cdd double, weather_days int")


def test_feature_values_and_no_target_leak(spark):
    out = ft.weekly_model_features(*weekly(spark)).where("duoarea = 'R31'").orderBy("date").collect()
    assert out[4]["weekly_change_rolling_4wk"] == 1.5 and out[3]["weekly_change_rolling_4wk"] is None
    assert out[53]["storage_vs_last_year"] == 52.0 and out[53]["storage_vs_5yr_avg"] == 52.0
    assert out[55]["weekly_change_yoy"] == 52.0
    moved = ft.weekly_model_features(*weekly(spark, 9999.0)).where("duoarea = 'R31'").orderBy("date").collect()
    for name in ft.ENGINEERED:
        assert moved[59][name] == out[59][name]


def test_interpolation_holds_edges(spark):
    knots = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0)], "k string, x double, v double")
    targets = spark.createDataFrame([("a", x) for x in (5.0, 10.0, 15.0, 20.0, 25.0)], "k string, x double")
    out = ft.interpolate_at(targets, knots, ["k"], "x", ["v"]).orderBy("x").collect()
    assert [r["v"] for r in out] == [1.0, 1.0, 2.0, 3.0, 3.0]


def rank_radius(residuals, coverage):
    n = len(residuals)
    return sorted(residuals)[min(n, math.ceil((n + 1) * coverage)) - 1]


def test_rolling_interval_excludes_same_date(spark):
    df = spark.createDataFrame(
        [(D(2024, 1, 5), 1.0, 0.0), (D(2024, 1, 12), 2.0, 0.0), (D(2024, 1, 19), 50.0, 0.0), (D(2024, 1, 26), 4.0, 0.0)],
        "date date, actual double, predicted_weekly_change double",
    )
    out = intervals.rolling_intervals(df, "actual", coverage=0.5, minimum=2).orderBy("date").collect()
    assert [r["calibration_samples"] for r in out] == [0, 1, 2, 3]
    assert [r["interval_radius"] for r in out] == [None, None, 2.0, 2.0]


def test_rolling_selection_equals_brute_force(spark):
    rng = random.Random(3)
    data = []
    for g in ("a", "b"):
        for i in range(500 if g == "a" else 40):
            y = None if rng.random() < 0.05 else round(rng.gauss(0, 10 ** rng.randrange(3)), 1)
            data.append((g, D(2024, 1, 1) + dt.timedelta(days=rng.randrange(60)), y, 0.0))
    df = spark.createDataFrame(data, "g string, date date, y double, p double")
    out = intervals.rolling_intervals(df, "y", "p", coverage=0.8, minimum=5, group=["g"])
    for r in out.select("g", "date", "calibration_samples", "interval_radius").distinct().collect():
        known = [abs(y) for g, d, y, _ in data if g == r["g"] and d < r["date"] and y is not None]
        assert r["calibration_samples"] == len(known)
        assert r["interval_radius"] == (rank_radius(known, 0.8) if len(known) >= 5 else None)


def test_equal_residuals_spread_over_tasks(spark):
    from pitcast.operators import ordered

    values = [0.0] * 2700 + [float(i % 97) for i in range(300)]
    df = spark.createDataFrame([("x", v, i) for i, v in enumerate(values)], "g string, e double, i long")
    assert intervals.conformal_radius(df, "e", 0.8, ["g"]).first()["radius"] == rank_radius(values, 0.8)
    assert intervals.conformal_radius(df, "e", 0.99, ["g"]).first()["radius"] == rank_radius(values, 0.99)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test's tables are too small to need tasks
    tasks = ordered.placed(df.where("e = 0"), ["g"], ["e", "i"]).groupBy("_pid").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 2000
    assert "collect_list" not in open(intervals.__file__).read()


def test_delayed_release(spark):
    # The first residual is realized after the second origin, so only the third origin may use it.
    df = spark.createDataFrame(
        [("2026-01-01 00:00:00", "2026-01-03 00:00:00", 5.0, 0.0), ("2026-01-02 00:00:00", "2026-01-04 00:00:00", 6.0, 0.0),
         ("2026-01-03 00:00:00", "2026-01-05 00:00:00", 7.0, 0.0)],
        "forecast_origin string, target string, actual double, prediction double",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("forecast_origin", "target")}).withColumn("horizon_bucket", F.lit("h1"))
    out = intervals.horizon_intervals(df, "actual", "prediction", target="target", minimum=1).orderBy("forecast_origin").collect()
    assert [r["calibration_count"] for r in out] == [0, 0, 1]
    assert out[2]["upper_bound"] == 5.0
    plain = intervals.horizon_intervals(df, "actual", "prediction", minimum=1).orderBy("forecast_origin").collect()
    assert [r["calibration_count"] for r in plain] == [0, 1, 2]


def test_folds_and_rejections(spark):
    df = spark.createDataFrame([(D(2024, 1, 5) + dt.timedelta(weeks=i),) for i in range(8)], "date date")
    sizes = splits.fold_sizes(df, "date", splits.expanding_weeks("2024-01-01", "2024-01-19", 2, 2)).orderBy("fold").collect()
    assert [(r["fold"], r["n_train"], r["n_val"]) for r in sizes] == [(1, 3, 2), (2, 5, 2), (3, 7, 1)]
    rolling = splits.fold_sizes(df, "date", splits.rolling_weeks("2024-01-01", "2024-01-19", 2, 2)).orderBy("fold").collect()
    assert [r["n_train"] for r in rolling] == [3, 3, 3]
    with pytest.raises(ValueError, match="training rows"):
        splits.require_training_rows(splits.fold_sizes(df, "date", splits.expanding_weeks("2023-01-01", "2023-12-29", 4, 4)))
    with pytest.raises(ValueError):
        splits.expanding_weeks("2024-01-01", "2024-01-19", 0, 1)
    with pytest.raises(ValueError):
        splits.holdout(df, "date", train_end="2024-02-01", val_start="2024-01-01")


def test_embargo_and_lookback(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, h),) for h in range(10)], "t timestamp")
    spec = splits.FoldSpec(dt.datetime(2026, 1, 1, 4, tzinfo=dt.timezone.utc), 2 * 3600, 2 * 3600, lookback=3 * 3600, embargo=3600)
    out = splits.fold_sizes(df, "t", spec).orderBy("fold").collect()
    assert [(r["n_train"], r["n_val"], r["first_val"].hour) for r in out] == [(3, 2, 5), (3, 2, 7), (3, 1, 9)]


@pytest.mark.parametrize("dates,ok", [([0, 7, 14], True), ([0, 14], False), ([0, 0, 7], False)])
def test_consecutive_week_check(spark, dates, ok):
    df = spark.createDataFrame([("R31", D(2024, 1, 5) + dt.timedelta(days=d), 1.0) for d in dates], "duoarea string, period date, value double")
    report = checks.consecutive_weeks(df).drop("duoarea")
    if ok:
        checks.enforce(report)
    else:
        with pytest.raises(checks.ContractError):
            checks.enforce(report)


def test_grid_check(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "A"), (D(2024, 1, 1), "B"), (D(2024, 1, 2), "A")], "date date, state string")
    assert checks.state_grid(df, F.lit(2)).first().asDict() == {"duplicate_rows": 0, "incomplete_dates": 1}


def test_exact_quantiles_interpolate(spark):
    rng = random.Random(3)
    data = [("a" if i % 3 else "b", rng.gauss(0, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v double")
    out = {r["g"]: (r["q1"], r["q2"]) for r in intervals.exact_quantiles(df, "v", (0.1, 0.5), ("q1", "q2"), ["g"]).collect()}
    for g in "ab":
        v = sorted(x for k, x in data if k == g)
        at = lambda q: v[math.floor((len(v) - 1) * q)] + (v[math.ceil((len(v) - 1) * q)] - v[math.floor((len(v) - 1) * q)]) * ((len(v) - 1) * q % 1)
        assert out[g] == pytest.approx((at(0.1), at(0.5)))


def test_missing_temperature_has_no_degree_days(spark):
    from pitcast.functions.calendar import degree_days

    out = degree_days(spark.createDataFrame([(None,), (60.0,)], "temperature_f double")).collect()
    assert [(r["hdd"], r["cdd"]) for r in out] == [(None, None), (5.0, 0.0)]


def test_contract_errors_stop_the_job(spark):
    from pitcast.operators import checks, metrics, rollups
    from pitcast.sources import vendors

    archive = spark.createDataFrame(
        [("p", "m", "r", "1", "2026-01-01 00:00:00", "2026-01-02 00:00:00", "2026-01-03 00:00:00", s, "R31", 30.0, 35.0, 0.0, 1.0) for s in ("A", "B")],
        ", ".join(f"{c} {'double' if c in ('temperature_f', 'hdd', 'cdd', 'coverage') else 'string'}" for c in rollups.ARCHIVE_COLUMNS),
    )
    weights = lambda *w: spark.createDataFrame([(s, "R31", x) for s, x in w], "state string, duoarea string, weather_weight double")
    assert rollups.region_members(archive, weights(("A", 0.5), ("B", 0.5))).first()["hdd"] == 35.0
    with pytest.raises(Exception, match="No weight for state B"):
        rollups.region_members(archive, weights(("A", 1.0))).collect()
    with pytest.raises(Exception, match="sum to one"):
        rollups.region_members(archive, weights(("A", 0.5), ("B", 0.4))).collect()
    history = spark.createDataFrame([("A", "R31", "2026-01-01 00:00:00", -1.0)], "state string, duoarea string, available_at string, gas_load double")
    with pytest.raises(Exception, match="must not be negative"):
        asof.state_weights_as_of(history.withColumn("available_at", F.col("available_at").cast("timestamp")), stamp("2026-02-01 00:00:00"), "gas_load").collect()
    report = spark.createDataFrame([("2026-01-01T01:00:00Z", "x")], "timestamp string, systemTotal string")
    with pytest.raises(Exception, match="unreadable load baseline"):
        vendors.component_product(report, "load", stamp("2026-01-02 00:00:00"), issued=stamp("2026-01-01 00:00:00")).collect()
    bounds = spark.createDataFrame([(1.0, 2.0, 1.0)], "y double, low double, high double")
    with pytest.raises(Exception, match="lower bound exceeds"):
        bounds.agg(*metrics.interval_columns("y", "low", "high", 0.8)).collect()
    weeks = spark.createDataFrame([(D(2026, 1, 2), checks.RAW_COMPONENTS[0], float("inf"))], "period date, component string, value double")
    assert checks.crude_long(weeks).first()["not_finite"] == 1
