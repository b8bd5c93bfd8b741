"""Models against NumPy or a plain loop, physical identities, reconciliation and queries."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitcast.operators import crude, disaggregate, experiments, linear, power, reconcile, recursive, trees

D = dt.date
FRIDAY = D(2016, 1, 8)


def table(spark, n=80, k=3, groups=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    data, arrays = [], {}
    for g in groups:
        x = rng.normal(size=(n, k)) * [1, 10, 100][:k] + [0, 5, 50][:k]
        y = x @ [2.0, -0.3, 0.05][:k] + 7 + rng.normal(size=n)
        arrays[g] = (x, y)
        data += [(g, i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "g string, i int, " + ", ".join(f"x{j} double" for j in range(k)) + ", y double"), arrays


def test_ols_ridge_and_elastic_net(spark):
    df, arrays = table(spark)
    names = ["x0", "x1", "x2"]
    fits = {kind.kind: {r["g"]: r["coef"] for r in linear.fit(df, ["g"], names, "y", kind).collect()} for kind in (linear.OLS, linear.RIDGE, linear.ELASTIC_NET)}
    for g, (x, y) in arrays.items():
        ols = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
        assert np.allclose(fits["ols"][g], ols)
        z = (x - x.mean(0)) / x.std(0)
        b = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose(fits["ridge"][g][1:], b / x.std(0))
        e = np.array(fits["elastic_net"][g][1:]) * x.std(0)
        grad = z.T @ (y - y.mean() - z @ e) / len(y) - 0.05 * e
        assert np.all(np.abs(grad[np.abs(e) > 1e-9] - 0.05 * np.sign(e[np.abs(e) > 1e-9])) < 1e-6)
        assert np.all(np.abs(grad[np.abs(e) <= 1e-9]) <= 0.05 + 1e-9)


def test_wide_moments_equal_direct_sums(spark, monkeypatch):
    df, _ = table(spark)
    names = ["x0", "x1", "x2"]
    direct = linear.moments(df, ["g"], names, "y").orderBy("g").collect()
    monkeypatch.setattr(linear, "WIDE", 0)
    wide = linear.moments(df, ["g"], names, "y").orderBy("g").collect()
    assert np.allclose([list(r)[1:] for r in direct], [list(r)[1:] for r in wide])


def test_constant_column_gives_minimum_norm(spark):
    df, arrays = table(spark, k=2)
    out = {r["g"]: r["coef"] for r in linear.fit(df.withColumn("c", F.lit(3.0)), ["g"], ["x0", "x1", "c"], "y").collect()}
    for g, (x, y) in arrays.items():
        ols = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
        assert np.allclose(out[g][:3], ols, atol=1e-6) and abs(out[g][3]) < 1e-6


def test_fold_count_and_first_error(spark):
    from pitcast.operators import metrics, splits

    days = [(FRIDAY + dt.timedelta(weeks=i), "a", None if i == 2 else 1.0, float(i)) for i in range(8)]
    df = spark.createDataFrame(days, "date date, duoarea string, feature double, weekly_change_bcf double")
    spec = splits.expanding_weeks("2016-01-01", "2016-01-29", 1, 1)
    out = linear.backtest(df, ["duoarea"], ["feature"], "weekly_change_bcf", "date", spec).orderBy("fold").collect()
    assert [r["n_train"] for r in out] == [3, 4, 5, 6]
    assert out[0]["predicted_weekly_change"] == pytest.approx((0 + 1 + 3) / 3)
    m = {r["fold"] for r in metrics.fold_metrics(spark.createDataFrame(out), "weekly_change_bcf", "predicted_weekly_change", "fold", ["duoarea"]).collect()}
    assert m == {"1", "2", "3", "4", "overall"}


def feature_frame(n=330, seed=3):
    rng = random.Random(seed)
    rows, level = [], 2000.0
    for i in range(n):
        day = FRIDAY + dt.timedelta(weeks=i)
        change = 50 * math.sin(i / 8) + rng.gauss(0, 5)
        level += change
        t = 55 + 25 * math.sin(i / 8.3) + rng.gauss(0, 3)
        rows.append([day, "R48", level, change if i else None, day.isocalendar()[1], t, max(0.0, 65 - t) * 7, max(0.0, t - 65) * 7, 7.0])
    return rows


def brute_recursion(rows, start, horizon, coef, names):
    hist = [r for r in rows if r[0] < start]
    profile = {}
    for r in hist:
        profile.setdefault(r[4], []).append(r)
    mean = lambda v: sum(v) / len(v)
    per_week = {w: [mean([r[c] for r in rs]) for c in (5, 6, 7, 8)] for w, rs in profile.items()}
    overall = [mean([v[c] for v in per_week.values()]) for c in range(4)]
    hdd, cdd = [r[6] for r in hist], [r[7] for r in hist]
    chg = [r[3] for r in hist if r[3] is not None]
    storage, by_date = hist[-1][2], {r[0]: r[2] for r in hist}

    def same_week(week, before, fallback):
        v = [r[2] for r in hist if r[4] == week and r[0] < before]
        return mean(v[-5:]) if v else fallback

    out = []
    for h in range(horizon):
        t = start + dt.timedelta(weeks=h)
        week, prev = t.isocalendar()[1], t - dt.timedelta(weeks=1)
        w = per_week.get(week, overall)
        avg5 = same_week(prev.isocalendar()[1], prev, storage)
        py, pw = prev.isocalendar()[0], prev.isocalendar()[1]
        match = [d for d in by_date if d.isocalendar()[0] == py - 1 and d.isocalendar()[1] == pw]
        far = match[0] if match else t - dt.timedelta(weeks=53)
        last_year = by_date[far] if far in by_date else same_week(far.isocalendar()[1], prev, storage)
        f = {
            "week_sin": math.sin(2 * math.pi * week / 52), "hdd": w[1], "hdd_lag1": hdd[-1], "cdd_rolling_4wk": mean(cdd[-4:]),
            "weekly_change_lag1": chg[-1], "weekly_change_rolling_4wk": mean(chg[-4:]), "storage_vs_5yr_avg": storage - avg5,
            "storage_vs_last_year": storage - last_year, "is_injection_season": float(4 <= t.month <= 10),
        }
        p = coef[0] + sum(c * f[n] for c, n in zip(coef[1:], names))
        storage += p
        hdd.append(w[1]); cdd.append(w[2]); chg.append(p); by_date[t] = storage  # noqa: E702
        out.append((p, storage))
    return out


NAMES = ["week_sin", "hdd", "hdd_lag1", "cdd_rolling_4wk", "weekly_change_lag1", "weekly_change_rolling_4wk", "storage_vs_5yr_avg", "storage_vs_last_year", "is_injection_season"]
COEF = [3.0, 20.0, -0.2, 0.1, 0.05, 0.4, 0.2, -0.02, -0.03, 5.0]


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "date date, duoarea string, storage_bcf double, weekly_change_bcf double, week_of_year int, temperature_f double, hdd double, cdd double, weather_days double")


@pytest.mark.parametrize("start_index,horizon", [(30, 8), (60, 30), (320, 10)])
def test_recursion_equals_a_plain_loop(spark, start_index, horizon):
    rows = feature_frame()
    start = FRIDAY + dt.timedelta(weeks=start_index)
    origins = spark.createDataFrame([("R48", 1, start, horizon)], "duoarea string, fold int, start_date date, n_steps int")
    params = spark.createDataFrame([("R48", 1, COEF)], "duoarea string, fold int, coef array<double>")
    inputs = recursive.step_inputs(_frame(spark, rows), origins, ["duoarea"], horizon)
    got = recursive.project_linear(inputs, params, ["duoarea"], NAMES).orderBy("horizon").collect()
    want = brute_recursion(rows, start, horizon, COEF, NAMES)
    assert np.allclose([(r["predicted_weekly_change"], r["projected_storage"]) for r in got], want)
    assert got[0]["forecast_origin"] == start - dt.timedelta(weeks=1)


def test_recursion_ignores_the_future(spark):
    rows = feature_frame()
    start = FRIDAY + dt.timedelta(weeks=200)
    changed = [r if r[0] < start else [r[0], r[1], 1e6, -1e5, r[4], -99.0, 1e4, 0.0, 7.0] for r in rows]
    origins = spark.createDataFrame([("R48", 1, start, 6)], "duoarea string, fold int, start_date date, n_steps int")
    params = spark.createDataFrame([("R48", 1, COEF)], "duoarea string, fold int, coef array<double>")
    run = lambda data: [r["predicted_weekly_change"] for r in recursive.project_linear(recursive.step_inputs(_frame(spark, data), origins, ["duoarea"], 6), params, ["duoarea"], NAMES).orderBy("horizon").collect()]
    assert np.allclose(run(rows), run(changed))


def test_recursion_rejects_unknown_features():
    with pytest.raises(ValueError):
        recursive.check_request(["storage_bcf_lag52"], 4, "seasonal")
    with pytest.raises(ValueError):
        recursive.check_request(["hdd"], 0, "seasonal")


def test_scenario_mode_uses_known_issue_and_rejects_gaps(spark):
    rows = feature_frame(120)
    start = FRIDAY + dt.timedelta(weeks=100)
    origins = spark.createDataFrame([("R48", 1, start, 2)], "duoarea string, fold int, start_date date, n_steps int")
    params = spark.createDataFrame([("R48", 1, [0.0, 1.0])], "duoarea string, fold int, coef array<double>")
    sc = [(start + dt.timedelta(weeks=w), "R48", start - dt.timedelta(days=d), 40.0, h, 0.0, 7.0) for w in (0, 1) for d, h in ((9, 70.0), (2, 35.0))]
    scen = lambda n: spark.createDataFrame(sc[:n], "date date, duoarea string, issued_at date, temperature_f double, hdd double, cdd double, weather_days double")
    run = lambda n: [r["predicted_weekly_change"] for r in recursive.project_linear(recursive.step_inputs(_frame(spark, rows), origins, ["duoarea"], 2, "scenario", scen(n)), params, ["duoarea"], ["hdd"]).orderBy("horizon").collect()]
    assert run(4) == [70.0, 70.0]
    with pytest.raises(Exception, match="no usable"):
        run(2)


def test_tree_recursion_runs_all_origins(spark):
    df = _frame(spark, feature_frame(150))
    rows = df.withColumn("weekly_change_lag1", F.lag("weekly_change_bcf").over(__import__("pyspark.sql").sql.Window.orderBy("date")))
    model = trees.fit_boosting(rows, ["hdd", "weekly_change_lag1"], "weekly_change_bcf", rounds=3, depth=2)
    origins = spark.createDataFrame([("R48", f, FRIDAY + dt.timedelta(weeks=w), 3) for f, w in ((1, 100), (2, 120))], "duoarea string, fold int, start_date date, n_steps int")
    inputs = recursive.step_inputs(df, origins, ["duoarea"], 3)
    out = recursive.project_with_model(inputs, model, ["duoarea"], ["hdd", "weekly_change_lag1"], 3, "gbt").collect()
    assert len(out) == 6
    for f in (1, 2):
        mine = sorted((r for r in out if r["fold"] == f), key=lambda r: r["horizon"])
        assert mine[1]["projected_storage"] - mine[0]["projected_storage"] == pytest.approx(mine[1]["predicted_weekly_change"])


def base_rows(n_origins=12, seed=5):
    rng = random.Random(seed)
    out = []
    for o in range(n_origins):
        origin = FRIDAY + dt.timedelta(weeks=o)
        for r in reconcile.ALL_REGIONS:
            p = 52.0 + rng.gauss(0, 3) if r == "R48" else 10.0 + rng.gauss(0, 1)
            out.append((origin, origin + dt.timedelta(weeks=1), 1, r, p, p + rng.gauss(0, 2)))
    return out


def ledoit_wolf(x):
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - p * mu**2) / p
    beta = min(((x**2).sum(1) ** 2).sum() / n - (s**2).sum(), delta * p * n) / (p * n)
    shrink = 0.0 if beta <= 0 else beta / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def test_mint_equals_matrix_form_and_is_coherent(spark):
    data = base_rows()
    df = spark.createDataFrame(data, "forecast_origin date, date date, horizon int, region string, predicted_weekly_change double, actual_weekly_change double")
    resid = df.withColumn("residual", F.col("actual_weekly_change") - F.col("predicted_weekly_change"))
    out = reconcile.mint(df, resid).collect()
    got = {(r["forecast_origin"], r["region"]): r["predicted_weekly_change"] for r in out}
    s = np.vstack([np.ones(5), np.eye(5)])
    for origin in sorted({r[0] for r in data}):
        prior = [[next(x[5] - x[4] for x in data if x[1] == d and x[3] == g) for g in reconcile.ALL_REGIONS] for d in sorted({r[1] for r in data}) if d < origin]
        if len(prior) < 2:
            assert (origin, "R48") not in got
            continue
        w = np.linalg.pinv(ledoit_wolf(np.array(prior)))
        y = np.array([next(x[4] for x in data if x[0] == origin and x[3] == g) for g in reconcile.ALL_REGIONS])
        want = s @ np.linalg.pinv(s.T @ w @ s) @ s.T @ w @ y
        assert np.allclose([got[(origin, g)] for g in reconcile.ALL_REGIONS], want, atol=1e-6)
        assert abs(got[(origin, "R48")] - sum(got[(origin, g)] for g in reconcile.CHILDREN)) < 1e-9


def test_future_residuals_are_inert(spark):
    data = base_rows()
    last = max(r[0] for r in data)
    schema = "forecast_origin date, date date, horizon int, region string, predicted_weekly_change double, actual_weekly_change double"
    moved = [r if r[1] < last else (*r[:5], 1e6) for r in data]

    def run(rows):
        df = spark.createDataFrame(rows, schema)
        resid = df.withColumn("residual", F.col("actual_weekly_change") - F.col("predicted_weekly_change"))
        return {(r["forecast_origin"], r["region"]): r["predicted_weekly_change"] for r in reconcile.mint(df.drop("actual_weekly_change"), resid).collect()}

    a, b = run(data), run(moved)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_crude_identity_and_forecast_loop(spark):
    comp = {"production_kbpd": 10_000.0, "imports_kbpd": 6_000.0, "refinery_inputs_kbpd": 15_000.0, "exports_kbpd": 571.428571428571, "commercial_stocks_kb": 400_000.0, "spr_stocks_kb": 300_000.0}
    rows = [(FRIDAY, c, v) for c, v in comp.items()]
    rows += [(FRIDAY + dt.timedelta(weeks=1), c, v + (6000 if c == "commercial_stocks_kb" else 2000 if c == "spr_stocks_kb" else 0)) for c, v in comp.items()]
    out = crude.weekly_balance(spark.createDataFrame(rows, "period date, component string, value double")).orderBy("date").collect()[1]
    assert out["production_mmbbl"] == pytest.approx(70.0) and out["commercial_stock_change_mmbbl"] == pytest.approx(6.0)
    assert out["fundamental_balance_mmbbl"] + out["balance_adjustment_mmbbl"] == pytest.approx(out["commercial_stock_change_mmbbl"])


def test_crude_backtest_ignores_the_future(spark):
    rng = random.Random(2)
    rows = [(FRIDAY + dt.timedelta(weeks=i), *[50 + math.sin(i / 8) * k + rng.random() for k in range(1, 5)], rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 2)) for i in range(180)]
    schema = "date date, production_mmbbl double, imports_mmbbl double, refinery_inputs_mmbbl double, exports_mmbbl double, spr_stock_change_mmbbl double, balance_adjustment_mmbbl double, commercial_stock_change_mmbbl double"
    cut = FRIDAY + dt.timedelta(weeks=170)
    moved = [r if r[0] < cut else (r[0], *[9e5] * 7) for r in rows]
    run = lambda data: {r["date"]: r["prediction_mmbbl"] for r in crude.backtest(spark.createDataFrame(data, schema)).collect()}
    a, b = run(rows), run(moved)
    assert len(a) == 24 and all(abs(a[d] - b[d]) < 1e-9 for d in a if d <= cut)


def test_power_stack_balances_and_curtails(spark):
    cols = "load_forecast_mw double, wind_forecast_mw double, solar_forecast_mw double, nuclear_mw double, hydro_mw double, other_nonthermal_mw double, net_imports_mw double, battery_net_discharge_mw double, available_capacity_mw double"
    df = spark.createDataFrame([(50_000.0, 10_000.0, 5_000.0, 5_000.0, 100.0, 50.0, -200.0, 10.0, 45_000.0), (20_000.0, 20_000.0, 6_000.0, 5_000.0, 0.0, 0.0, 0.0, 0.0, 90_000.0)], cols)
    a, b = power.physical_stack(df).orderBy(F.desc("load_forecast_mw")).collect()
    assert abs(a["balance_error_mw"]) < 1e-8 and abs(b["balance_error_mw"]) < 1e-8
    assert b["curtailment_mw"] == 11_000.0 and b["gas_generation_mw"] == 0.0
    assert a["capacity_shortfall_mw"] == 5_000.0 and b["capacity_shortfall_mw"] == 0.0
    assert a["gas_burn_bcf_base"] == pytest.approx(a["gas_generation_mw"] * 7.5 / 1_037_000)


def correction_rows(late=False):
    rng = random.Random(4)
    rows = []
    for o in range(6):
        origin = dt.datetime(2026, 1, 1) + dt.timedelta(days=o)
        for h in range(1, 49):
            t = origin + dt.timedelta(hours=h)
            seen = origin + dt.timedelta(minutes=5) if not late or o != 0 else dt.datetime(2026, 6, 1)
            rows.append(("load", origin, t, seen, 100.0 + h, 100.0 + h + 10 + rng.random(), h))
    return rows


def test_correction_trains_on_known_labels_only(spark):
    schema = "component string, forecast_origin timestamp, delivery_hour timestamp, retrieved_at timestamp, baseline_mw double, actual_mw double, horizon_hour int"
    feats = ["baseline_mw", "horizon_hour"]

    def sizes(rows):
        df = spark.createDataFrame(rows, schema).withColumn("horizon_bucket", F.lit("h001_024"))
        return {r["forecast_origin"]: r["n_train"] for r in power.rolling_corrections(df, feats, min_train=1).select("forecast_origin", "n_train").distinct().collect()}

    for late in (False, True):
        rows = correction_rows(late)
        for origin, n in sizes(rows).items():
            assert n == sum(1 for r in rows if r[1] < origin and r[2] < origin and r[3] <= origin)


def test_recent_error_equals_brute_force_with_gaps(spark):
    rng = random.Random(9)
    rows = [r for r in correction_rows() if rng.random() < 0.6]
    rows += [("load", dt.datetime(2025, 11, 1), dt.datetime(2025, 11, 1) + dt.timedelta(hours=h), dt.datetime(2025, 11, 2), 1.0, 3.0, h) for h in range(1, 20)]
    df = spark.createDataFrame(rows, "component string, forecast_origin timestamp, delivery_hour timestamp, retrieved_at timestamp, baseline_mw double, actual_mw double, horizon_hour int")
    got = {r["forecast_origin"]: r["recent_error_mw"] for r in power.recent_error(df, df.select("component", "forecast_origin").distinct()).collect()}
    for origin in {r[1] for r in rows}:
        latest = {}
        for r in sorted(rows, key=lambda r: r[1]):
            if r[1] < origin and r[2] < origin and r[3] <= origin:
                latest[r[2]] = r[5] - r[4]
        tail = [latest[k] for k in sorted(latest)[-24:]]
        if tail:
            assert got[origin] == pytest.approx(sum(tail) / len(tail))
        else:
            assert origin not in got


def test_promotion_needs_every_bucket(spark):
    schema = "component string, horizon_bucket string, baseline_mw double, actual_mw double, corrected_mw double"
    good = [("load", "h001_024", 10.0, 20.0, 18.0), ("load", "h025_072", 10.0, 20.0, 19.0)]
    assert power.promotion(spark.createDataFrame(good, schema)).first()["promoted"]
    assert not power.promotion(spark.createDataFrame([good[0], ("load", "h025_072", 19.0, 20.0, 18.5)], schema)).first()["promoted"]


def test_block_bootstrap_bounds(spark):
    rng = np.random.default_rng(0)
    gains = rng.normal(2.0, 1.0, 61)
    df = spark.createDataFrame([(FRIDAY + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(gains)], "date date, error_gain double")
    out = experiments.block_bootstrap(df, ["date"]).first()
    assert out["mae_improvement"] == pytest.approx(gains.mean())
    draws = []
    for _ in range(2000):
        starts = rng.integers(0, 61, 16)
        draws.append(np.concatenate([gains[(s + np.arange(4)) % 61] for s in starts])[:61].mean())
    assert abs(out["ci_lower"] - np.quantile(draws, 0.025)) < 0.08 and abs(out["ci_upper"] - np.quantile(draws, 0.975)) < 0.08


def test_promotion_gate_on_constant_gain(spark):
    rows = [(FRIDAY + dt.timedelta(weeks=i), r, 1, 10.0) for i in range(10) for r in reconcile.ALL_REGIONS]
    df = spark.createDataFrame(rows, "date date, region string, horizon int, actual_weekly_change double")
    day = F.datediff("date", F.lit(FRIDAY.isoformat()).cast("date")) / 7
    band = F.when(day < 8, 1.0).otherwise(-1.0)
    side = lambda p: df.withColumn("predicted_weekly_change", F.lit(p)).withColumns({"p10": F.lit(10.0) - band, "p90": F.lit(10.0) + band})
    out = experiments.promotion_gate(side(7.0), side(9.0)).first()
    assert out["mae_improvement"] == pytest.approx(2.0) and out["interval_coverage"] == pytest.approx(0.8) and out["promote"]
    assert not experiments.promotion_gate(side(9.0), side(7.0)).first()["promote"]


def test_permutation_importance_ranks_the_used_feature(spark):
    df, _ = table(spark, n=200, groups=("a",))
    out = experiments.permutation_importance(df.select("x0", "x1", "y"), ["x0", "x1"], "y", lambda c: c["x0"] * 2.0, repeats=3).collect()
    gain = {r["feature"]: r["importance_mean"] for r in out}
    assert gain["x1"] == pytest.approx(0.0) and gain["x0"] > 0.1


def test_series_codes(spark):
    df = spark.createDataFrame([("N3010TX2",), ("NA1160_STX_2",), ("N9050PA2",)], "series string")
    s = F.col("series")
    out = [tuple(r) for r in df.select(disaggregate.component_of(s), disaggregate.state_of(s)).collect()]
    assert out == [("res", "TX"), ("dry_production", "TX"), ("marketed_production", "PA")]


def test_registered_queries_have_sql_and_run(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    for name in ("w07_weekly_model_features", "j06_balance_features_at_origins", "r03_mint_shrink", "b12_rolling_correction_folds"):
        assert names[name](spark, "/root/testdata/sf0.001").columns
    assert entry.entry(spark).count() > 0


def test_power_correction_sees_nothing_after_the_origin(spark):
    hours = spark.range(12 * 24).select((F.col("id") * 3600 + F.lit(1_700_000_000 - 1_700_000_000 % 86400)).alias("s"))
    origins = spark.range(10).select((F.col("id") * 86400 + F.lit(1_700_000_000 - 1_700_000_000 % 86400 + 86400)).alias("o"))
    pairs = origins.join(hours, (F.col("s") > F.col("o")) & (F.col("s") <= F.col("o") + 48 * 3600))
    base = pairs.select(
        F.lit("load").alias("component"), F.timestamp_seconds("o").alias("forecast_origin"), F.timestamp_seconds("s").alias("delivery_hour"),
        ((F.col("s") - F.col("o")) / 3600).cast("int").alias("horizon_hour"), F.lit("h001_024").alias("horizon_bucket"), F.timestamp_seconds("s").alias("retrieved_at"),
        (F.lit(100.0) + F.col("s") / 3600 % 24).alias("baseline_mw"),
    ).withColumn("actual_mw", F.col("baseline_mw") * 1.1 + F.hour("delivery_hour") % 3)
    origin = F.timestamp_seconds(F.lit(1_700_000_000 - 1_700_000_000 % 86400 + 8 * 86400))
    later = base.withColumn("actual_mw", F.when(F.col("delivery_hour") >= origin, -5000.0).otherwise(F.col("actual_mw")))
    feats = ["baseline_mw", "horizon_hour"]
    out = []
    for history in (base, later):
        forecast, rows = power.correct(history, base.where(F.col("forecast_origin") == origin), origin, feats, min_train=10)
        assert rows.count() > 0 and rows.where(F.col("delivery_hour") >= origin).isEmpty()
        out.append((sorted(r["forecast_mw"] for r in forecast.collect()), sorted((r["delivery_hour"], r["corrected_mw"], r["promoted"]) for r in rows.collect())))
    assert out[0] == out[1]
    assert out[0][1][0][2]  # the correction is promoted here, so its errors calibrate
    flat = base.withColumn("actual_mw", F.col("baseline_mw"))
    _, rows = power.correct(flat, flat.where(F.col("forecast_origin") == origin), origin, feats, min_train=10)
    assert all(r["corrected_mw"] == r["baseline_mw"] and not r["promoted"] for r in rows.collect())
