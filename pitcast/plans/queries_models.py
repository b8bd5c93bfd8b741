"""Models, splits, backtests, intervals, reconciliation and experiments (M, B, I, W16-W17, R, F03)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pitcast.functions.calendar import add_calendar_features, add_fourier, fourier_names
from pitcast.operators import backtests, crude, disaggregate, experiments, intervals, linear, metrics, reconcile, recursive, splits, tree_growth
from pitcast.operators import features as ft
from pitcast.plans import jobs
from pitcast.plans.queries_features import FEATURE_CTE, lag, strict
from pitcast.plans.registry import d, query, r, sql_linear, sql_pred
from pitcast.session import scratch_path, staged

FEATURES = ["weekly_change_lag1", "weekly_change_rolling_4wk", "hdd"]
RECURSIVE = ["week_sin", "week_cos", "hdd", "hdd_lag1", "cdd_rolling_4wk", "weekly_change_lag1", "weekly_change_rolling_4wk", "storage_vs_5yr_avg", "storage_vs_last_year"]
SPEC = splits.expanding_weeks("1995-01-01", "1997-12-26", 8, 8)


def feature_rows(t):
    return ft.weekly_model_features(t.wk_storage, t.wk_weather)


def feature_rows_all(t):
    return ft.weekly_model_features(t.wk_all, t.wk_weather_all)


FEAT = f"""{FEATURE_CTE}, feat AS (SELECT *, {lag('weekly_change_bcf', 1)} AS weekly_change_lag1, {strict('weekly_change_bcf', 4)} AS weekly_change_rolling_4wk FROM avg5)"""
_FOLD = """folds AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS fold, te FROM (SELECT DISTINCT k, te FROM (SELECT k, DATE '1997-12-27' + CAST(k * 56 AS INTEGER) AS te FROM range(0, 80) x(k)) JOIN wk_storage ON date >= te AND date < te + 56))"""


def _folds_sql(step_days: int, val_days: int, start: str, rolling: bool) -> str:
    ts = f"DATE '{start}' + CAST(k * {step_days} AS INTEGER)" if rolling else f"DATE '{start}'"
    return f"""SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS fold, CAST(ts AS TIMESTAMP) AS train_start, CAST(te AS TIMESTAMP) AS train_end, CAST(te AS TIMESTAMP) AS val_start, CAST(te + {val_days} AS TIMESTAMP) AS val_end
  FROM (SELECT k, {ts} AS ts, DATE '1997-12-27' + CAST(k * {step_days} AS INTEGER) AS te FROM range(0, 400) x(k)) f WHERE EXISTS (SELECT 1 FROM wk_storage WHERE date >= te AND date < te + {val_days})"""


@query("b01_rolling_origin_folds", """WITH f AS (SELECT k, TIMESTAMP '2024-01-10 00:00:00' + to_hours(CAST(24 * k AS INTEGER)) AS te FROM range(0, 40) x(k)), v AS (SELECT k, te, count(*) AS n_val, min(valid_at) AS first_val FROM f JOIN hours ON valid_at >= te + INTERVAL 6 HOUR AND valid_at < te + INTERVAL 54 HOUR GROUP BY 1, 2)
  SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS fold, (SELECT count(*) FROM hours WHERE valid_at < te AND valid_at >= te - INTERVAL 7 DAY) AS n_train, n_val, (SELECT max(valid_at) FROM hours WHERE valid_at < te) AS last_train, first_val FROM v""")
def b01(t):
    spec = splits.FoldSpec(dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc), horizon=48 * 3600, step=24 * 3600, lookback=7 * splits.DAY, embargo=6 * 3600)
    return splits.fold_sizes(t.hours, "valid_at", spec)


@query("b02_holdout_split", f"SELECT duoarea, {d('date')}, CASE WHEN date <= DATE '1999-12-31' THEN 'train' ELSE 'validation' END AS role FROM wk_storage WHERE date <= DATE '2000-06-30'")
def b02(t):
    return splits.holdout(t.wk_storage.select("duoarea", "date"), "date", train_end="1999-12-31", val_end="2000-06-30")


@query("b03_expanding_folds", _folds_sql(28, 28, "1995-01-01", False))
def b03(t):
    return splits.fold_table(t.wk_storage, "date", splits.expanding_weeks("1995-01-01", "1997-12-26", 4, 4)).drop("_k")


@query("b04_rolling_folds", _folds_sql(28, 56, "1995-01-01", True))
def b04(t):
    return splits.fold_table(t.wk_storage, "date", splits.rolling_weeks("1995-01-01", "1997-12-26", 8, 4)).drop("_k")


_B06 = f"""WITH {FEAT}, {_FOLD}, clean AS (SELECT * FROM feat WHERE weekly_change_rolling_4wk IS NOT NULL), tr AS (SELECT fold, c.* FROM folds JOIN clean c ON c.date < te AND c.date >= DATE '1995-01-01'),
  {sql_linear('o', 'tr', ['duoarea', 'fold'], FEATURES, 'weekly_change_bcf')},
  pred AS (SELECT c.duoarea, c.date, f.fold, b.n AS n_train, c.weekly_change_bcf AS y, {sql_pred('b', ['c.' + x for x in FEATURES])} AS p FROM folds f JOIN clean c ON c.date >= te AND c.date < te + 56 JOIN o_b b ON b.duoarea = c.duoarea AND b.fold = f.fold)"""


@query("b06_one_step_backtest", f"{_B06} SELECT duoarea, {d('date')}, {r('y AS weekly_change_bcf', 'p AS predicted_weekly_change', 'y - p AS forecast_deviation')}, fold, n_train FROM pred")
def b06(t):
    return linear.backtest(feature_rows(t), ["duoarea"], FEATURES, "weekly_change_bcf", "date", SPEC)


@query("b06_backtest_metrics", f"{_B06} SELECT duoarea, CASE WHEN grouping(fold) = 1 THEN 'overall' ELSE CAST(fold AS VARCHAR) END AS fold, {r('avg(abs(y-p)) AS mae', 'sqrt(avg((y-p)*(y-p))) AS rmse', 'avg(y-p) AS bias')}, count(*) AS n_samples FROM pred GROUP BY GROUPING SETS ((duoarea, fold), (duoarea))")
def b06_metrics(t):
    return metrics.fold_metrics(b06(t), "weekly_change_bcf", "predicted_weekly_change", "fold", ["duoarea"])


@query("b06_rolling_window_backtest", f"""WITH {FEAT}, {_FOLD}, clean AS (SELECT * FROM feat WHERE weekly_change_rolling_4wk IS NOT NULL), tr AS (SELECT fold, c.* FROM folds JOIN clean c ON c.date < te AND c.date >= te - 1091),
  {sql_linear('o', 'tr', ['duoarea', 'fold'], FEATURES, 'weekly_change_bcf', 10.0)}
  SELECT c.duoarea, {d('c.date')}, f.fold, b.n AS n_train, {r(sql_pred('b', ['c.' + x for x in FEATURES]) + ' AS predicted_weekly_change')} FROM folds f JOIN clean c ON c.date >= te AND c.date < te + 56 JOIN o_b b ON b.duoarea = c.duoarea AND b.fold = f.fold""")
def b06_rolling(t):
    spec = splits.rolling_weeks("1995-01-01", "1997-12-26", 8, 8)
    return linear.backtest(feature_rows(t), ["duoarea"], FEATURES, "weekly_change_bcf", "date", spec, linear.RIDGE).select("duoarea", "date", "fold", "n_train", "predicted_weekly_change")


def _coef_sql(alpha: float) -> str:
    cols = ["my - b[1]*m[1]/s[1] - b[2]*m[2]/s[2] - b[3]*m[3]/s[3] AS intercept", *[f"b[{i}]/s[{i}] AS b{i}" for i in (1, 2, 3)]]
    return f"WITH {FEAT}, {sql_linear('o', 'feat', ['duoarea'], FEATURES, 'weekly_change_bcf', alpha)} SELECT duoarea, n AS n_train, {r(*cols)} FROM o_b"


def _coefs(params):
    return params.select("duoarea", "n_train", F.col("coef")[0].alias("intercept"), *[F.col("coef")[i].alias(f"b{i}") for i in (1, 2, 3)])


@query("m01_ols", _coef_sql(0.0))
def m01(t):
    return _coefs(linear.fit(feature_rows(t), ["duoarea"], FEATURES, "weekly_change_bcf"))


@query("m02_ridge", _coef_sql(10.0))
def m02(t):
    return _coefs(linear.fit(feature_rows(t), ["duoarea"], FEATURES, "weekly_change_bcf", linear.RIDGE))


@query("m03_elastic_net")
def m03(t):
    return _coefs(linear.fit(feature_rows(t), ["duoarea"], FEATURES, "weekly_change_bcf", linear.ELASTIC_NET))


TREE_FEATURES = ["week_sin", "week_cos", "hdd", "cdd", "weekly_change_lag1", "weekly_change_rolling_4wk"]


def _tree_rows(t):
    return feature_rows(t).select("duoarea", "date", "weekly_change_bcf", *TREE_FEATURES)


def _tree_backtest(t, model):
    """Metrics per fold and series of a model fit in every fold, at its defaults."""
    scored = backtests.one_step(_tree_rows(t), ["duoarea"], TREE_FEATURES, "weekly_change_bcf", "date", SPEC, model)
    return metrics.fold_metrics(scored, "weekly_change_bcf", "predicted_weekly_change", "fold", ["duoarea"])


def _tree_band(t, model):
    bands = backtests.one_step(_tree_rows(t), ["duoarea"], TREE_FEATURES, "weekly_change_bcf", "date", SPEC, model)
    # separate quantile models may cross; the band is between the lower and the higher one
    ordered = bands.withColumns({"p10": F.least("p10", "p90"), "p90": F.greatest("p10", "p90")})
    return metrics.interval_metrics(ordered, "weekly_change_bcf", "p10", "p90", 0.8, ["duoarea"])


@query("m04_random_forest")
def m04(t):
    return _tree_backtest(t, tree_growth.FOREST)


@query("m05_boosting")
def m05(t):
    return _tree_backtest(t, tree_growth.BOOSTING)


@query("m06_quantile_forest")
def m06(t):
    return _tree_band(t, tree_growth.QUANTILE_FOREST)


@query("m06_quantile_boosting")
def m06_boosting(t):
    return _tree_band(t, tree_growth.QUANTILE_BOOSTING)


@query("m07_linear_plus_boosting")
def m07(t):
    return _tree_backtest(t, backtests.LINEAR_BOOSTING)


_SEAS = ["sin(2*pi()*week_of_year/52.0)", "cos(2*pi()*week_of_year/52.0)", "sin(2*pi()*month/12.0)", "cos(2*pi()*month/12.0)"]


def _band_sql(xs: list[str], actuals: bool) -> str:
    tail = ", weekly_change_bcf - p AS forecast_deviation" if actuals else ""
    flag = ", (weekly_change_bcf > p + sd OR weekly_change_bcf < p - sd) AS outside_band" if actuals else ""
    cols = ["p AS predicted_weekly_change", "p - sd AS lower_band", "p + sd AS upper_band"] + ([tail[2:]] if tail else [])
    return f"""WITH {sql_linear('o', '(SELECT * FROM wk_storage WHERE year < 2001)', ['duoarea'], xs, 'weekly_change_bcf')},
  res AS (SELECT w.duoarea, stddev_samp(weekly_change_bcf - ({sql_pred('b', xs)})) AS sd FROM wk_storage w JOIN o_b b USING (duoarea) WHERE year < 2001 GROUP BY 1),
  q AS (SELECT w.duoarea, w.date, weekly_change_bcf, sd, {sql_pred('b', xs)} AS p FROM wk_storage w JOIN o_b b USING (duoarea) JOIN res USING (duoarea) WHERE year = 2001)
  SELECT duoarea, {d('date')}, {r(*cols)}{flag} FROM q"""


def _band(t, prepare, names):
    rows = prepare(t.wk_storage)
    train, val = rows.where(F.col("year") < 2001), rows.where(F.col("year") == 2001)
    params = linear.fit(train, ["duoarea"], names, "weekly_change_bcf")
    return linear.seasonal_band(val, params, train, ["duoarea"], names)


@query("m09_seasonal_linear", _band_sql(_SEAS, False))
def m09(t):
    return _band(t, add_calendar_features, list(ft.CALENDAR_FEATURES)).select("duoarea", "date", "predicted_weekly_change", "lower_band", "upper_band")


_F3 = [f"{fn}(2*pi()*{k}*week_of_year/52.0)" for k in (1, 2, 3) for fn in ("sin", "cos")]


@query("m09_fourier", _band_sql(_F3, False))
def m09_fourier(t):
    return _band(t, lambda x: add_fourier(x, 3), fourier_names(3)).select("duoarea", "date", "predicted_weekly_change", "lower_band", "upper_band")


@query("b08_year_holdout", _band_sql(_SEAS, True))
def b08(t):
    rows = jobs.deviation_columns(_band(t, add_calendar_features, list(ft.CALENDAR_FEATURES)))
    return rows.select("duoarea", "date", "predicted_weekly_change", "lower_band", "upper_band", "forecast_deviation", "outside_band")


_HARM = " UNION ALL ".join(
    f"SELECT w.duoarea, {k} AS harmonics, abs(weekly_change_bcf - ({sql_pred('b', [f'{fn}(2*pi()*{j}*week_of_year/52.0)' for j in range(1, k + 1) for fn in ('sin', 'cos')])})) AS e FROM wk_storage w JOIN h{k}_b b USING (duoarea) WHERE year = 2001"
    for k in range(1, 11))
_HARM_CTE = ", ".join(sql_linear(f"h{k}", "(SELECT * FROM wk_storage WHERE year < 2001)", ["duoarea"], [f"{fn}(2*pi()*{j}*week_of_year/52.0)" for j in range(1, k + 1) for fn in ("sin", "cos")], "weekly_change_bcf") for k in range(1, 11))


@query("m10_harmonic_search", f"WITH {_HARM_CTE} SELECT duoarea, CAST(harmonics AS INTEGER) AS harmonics, {r('avg(e) AS mae')} FROM ({_HARM}) GROUP BY 1, 2")
def m10(t):
    rows = t.wk_storage
    return linear.harmonic_search(rows.where(F.col("year") < 2001), rows.where(F.col("year") == 2001), ["duoarea"], "weekly_change_bcf")


@query("t03_best_by_metric", f"WITH {_HARM_CTE} SELECT duoarea, harmonics, {r('mae')} FROM (SELECT duoarea, CAST(harmonics AS INTEGER) AS harmonics, avg(e) AS mae FROM ({_HARM}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY duoarea ORDER BY mae, harmonics) = 1")
def t03(t):
    return metrics.best_by(m10(t), "mae", ["duoarea"], ["harmonics"])


@query("m22_autoregressive_error", f"""WITH {FEAT}, {sql_linear('o', 'feat', ['duoarea'], ['hdd'], 'weekly_change_bcf')},
  e AS (SELECT f.*, weekly_change_bcf - ({sql_pred('b', ['hdd'])}) AS e FROM feat f JOIN o_b b USING (duoarea)),
  rho AS (SELECT duoarea, regr_slope(e, e1) AS rho FROM (SELECT *, lag(e) OVER (PARTITION BY duoarea ORDER BY date) AS e1 FROM e) WHERE e1 IS NOT NULL GROUP BY 1),
  q AS (SELECT f.duoarea, hdd - rho * lag(hdd) OVER (PARTITION BY f.duoarea ORDER BY date) AS x, weekly_change_bcf - rho * lag(weekly_change_bcf) OVER (PARTITION BY f.duoarea ORDER BY date) AS y FROM feat f JOIN rho USING (duoarea))
  SELECT q.duoarea, {r('max(rho) AS rho', 'regr_intercept(y, x) / (1 - max(rho)) AS intercept', 'regr_slope(y, x) AS slope')} FROM q JOIN rho USING (duoarea) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def m22(t):
    p = linear.autoregressive_error_fit(feature_rows(t).select("duoarea", "date", "hdd", "weekly_change_bcf"), ["duoarea"], ["hdd"], "weekly_change_bcf", "date")
    return p.select("duoarea", "rho", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope"))


def _hashed(tag: str, size: str) -> str:
    return f"(CAST('0x' || substr(md5({tag}), 1, 15) AS BIGINT) % {size})"


_MIRROR = f"((({_hashed("'42:' || rep || ':' || r", 'n')} - x) % n + n) % n)"
_SWAPPED = [f"CASE WHEN feature = '{f}' THEN d.{f} ELSE a.{f} END" for f in FEATURES]
_M18 = f"""WITH {FEAT}, clean AS (SELECT *, row_number() OVER (ORDER BY duoarea, date) - 1 AS i, count(*) OVER () AS n FROM feat WHERE {' AND '.join(f'{f} IS NOT NULL' for f in [*FEATURES, 'weekly_change_bcf'])}),
  {sql_linear('o', 'clean', [], FEATURES, 'weekly_change_bcf')},
  base AS (SELECT avg(abs(weekly_change_bcf - ({sql_pred('b', FEATURES)}))) AS e FROM clean, o_b b),
  moved AS (SELECT i, rep, list_reduce(range(1, 21), lambda x, r: CASE WHEN md5('42:' || rep || ':' || r || ':' || greatest(x, {_MIRROR})) < '8' THEN {_MIRROR} ELSE x END, i) AS j FROM clean, range(1, 6) t(rep)),
  gain AS (SELECT feature, rep, avg(abs(a.weekly_change_bcf - ({sql_pred('b', _SWAPPED)}))) - any_value(base.e) AS g FROM moved m JOIN clean a ON a.i = m.i JOIN clean d ON d.i = m.j, o_b b, base, (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) v(feature) GROUP BY feature, rep)
  SELECT feature, {r('avg(g) AS importance_mean', 'stddev_pop(g) AS importance_std')} FROM gain GROUP BY feature"""


@query("m18_permutation_importance", _M18)
def m18(t):
    rows = staged(feature_rows(t).select("duoarea", "date", "weekly_change_bcf", *FEATURES).dropna(), "importance")
    params = linear.fit(rows.withColumn("k", F.lit(1)), ["k"], FEATURES, "weekly_change_bcf")
    coef = params.select("coef").scalar()
    return experiments.permutation_importance(
        rows, FEATURES, "weekly_change_bcf", lambda c: linear.dot(coef, [c[f] for f in FEATURES]), repeats=5, order=["duoarea", "date"]
    )


@query("t04_importance_ranking", f"{_M18} ORDER BY importance_mean DESC")
def t04(t):
    return m18(t).orderBy(F.col("importance_mean").desc())


def _pair(t):
    base = staged(t.base_predictions, "base").select("date", "region", "horizon", "actual_weekly_change", "predicted_weekly_change", "p10", "p90")
    better = base.withColumn("predicted_weekly_change", 0.5 * F.col("predicted_weekly_change") + 0.25 * F.col("actual_weekly_change"))
    return base, better


_GAIN = "abs(actual_weekly_change - predicted_weekly_change) - abs(actual_weekly_change - 0.5*predicted_weekly_change - 0.25*actual_weekly_change)"
_BOOT = f"""gains AS (SELECT region, list(g ORDER BY date) AS g, count(*) AS n, avg(g) AS mae_improvement FROM (SELECT region, date, {_GAIN} AS g FROM base_predictions WHERE horizon = 1) WHERE g IS NOT NULL GROUP BY region),
  blocks AS (SELECT region, draw, g, n, {_hashed("'42:' || draw || ':' || b", 'n')} AS s, CASE WHEN b = ceil(n / 4.0) THEN (n - 1) % 4 + 1 ELSE 4 END AS size FROM gains, range(1, 2001) d(draw), range(1, CAST(ceil(n / 4.0) AS BIGINT) + 1) t(b)),
  means AS (SELECT region, draw, sum(list_sum(list_transform(range(CAST(size AS BIGINT)), lambda o: g[1 + (s + o) % n]))) / any_value(n) AS m FROM blocks GROUP BY region, draw),
  boot AS (SELECT region, any_value(mae_improvement) AS mae_improvement, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM means JOIN gains USING (region) GROUP BY region)"""


@query("m19_block_bootstrap", f"WITH {_BOOT} SELECT region, {r('mae_improvement', 'ci_lower', 'ci_upper')} FROM boot")
def m19(t):
    paired = experiments.paired_errors(experiments.pair(*_pair(t))).where(F.col("horizon") == 1)
    return experiments.block_bootstrap(paired, ["date"], keys=["region"])


@query("m19_mean_improvement", f"SELECT region, {r('avg(abs(actual_weekly_change - predicted_weekly_change) - abs(actual_weekly_change - 0.5*predicted_weekly_change - 0.25*actual_weekly_change)) AS mae_improvement')} FROM base_predictions WHERE horizon = 1 GROUP BY 1")
def m19_mean(t):
    return m19(t).select("region", "mae_improvement")


@query("m20_region_degradation", f"""SELECT region, {r('b AS baseline_mae', 'c AS challenger_mae', 'CASE WHEN b > 0 THEN (c - b) / b ELSE CAST(c > 0 AS DOUBLE) END AS degradation')} FROM (SELECT region, avg(abs(actual_weekly_change - predicted_weekly_change)) AS b,
  avg(abs(actual_weekly_change - 0.5*predicted_weekly_change - 0.25*actual_weekly_change)) AS c FROM base_predictions WHERE horizon = 1 GROUP BY 1)""")
def m20_regions(t):
    return experiments.region_degradation(experiments.pair(*_pair(t)))


_GATE = f"""WITH {_BOOT}, worst AS (SELECT max(CASE WHEN b > 0 THEN (c - b) / b ELSE CAST(c > 0 AS DOUBLE) END) AS d FROM (SELECT region, avg(abs(actual_weekly_change - predicted_weekly_change)) AS b,
    avg(abs(actual_weekly_change - 0.5*predicted_weekly_change - 0.25*actual_weekly_change)) AS c FROM base_predictions WHERE horizon = 1 GROUP BY 1)),
  cover AS (SELECT avg(CASE WHEN p10 IS NOT NULL AND p90 IS NOT NULL THEN CAST(actual_weekly_change BETWEEN p10 AND p90 AS DOUBLE) END) AS c FROM base_predictions WHERE horizon = 1 AND region = 'R48'),
  flags AS (SELECT mae_improvement, ci_lower, ci_upper, coalesce(d, 0) AS max_region_degradation, c AS interval_coverage, mae_improvement >= 1.0 AS accuracy_pass, ci_lower > 0 AS significance_pass,
    coalesce(d, 0) <= 0.1 AS region_pass, coalesce(abs(c - 0.8) <= 0.05, false) AS coverage_pass FROM boot, worst, cover WHERE region = 'R48')
  SELECT {r('mae_improvement', 'ci_lower', 'ci_upper', 'max_region_degradation', 'interval_coverage')}, accuracy_pass, significance_pass, region_pass, coverage_pass,
    accuracy_pass AND significance_pass AND region_pass AND coverage_pass AS promote FROM flags"""


@query("m20_promotion_gate", _GATE)
def m20(t):
    return experiments.promotion_gate(*_pair(t))


@query("i01_conformal_radius", f"SELECT region, horizon, n, {r('list_sort(e)[CAST(least(n, ceil((n + 1) * 0.8)) AS INTEGER)] AS radius')} FROM (SELECT region, horizon, count(*) AS n, list(abs(actual_weekly_change - predicted_weekly_change)) AS e FROM base_predictions GROUP BY 1, 2)")
def i01(t):
    rows = t.base_predictions.withColumn("e", F.abs(F.col("actual_weekly_change") - F.col("predicted_weekly_change")))
    return intervals.conformal_radius(rows, "e", 0.8, ["region", "horizon"])


_W16 = """WITH q AS (SELECT b.region, b.horizon, b.date, any_value(b.predicted_weekly_change) AS p, any_value(b.actual_weekly_change) AS y, count(c.date) AS n, list_sort(list(abs(c.actual_weekly_change - c.predicted_weekly_change)) FILTER (c.date IS NOT NULL)) AS e
  FROM base_predictions b LEFT JOIN base_predictions c ON c.region = b.region AND c.horizon = b.horizon AND c.date < b.date GROUP BY 1, 2, 3),
  k AS (SELECT *, CASE WHEN n >= 20 THEN e[CAST(least(n, ceil((n + 1) * 0.8)) AS INTEGER)] END AS radius FROM q)"""


@query("w16_rolling_conformal", f"{_W16} SELECT region, horizon, {d('date')}, CAST(n AS INTEGER) AS calibration_samples, {r('radius AS interval_radius', 'p - radius AS interval_lower', 'p + radius AS interval_upper')} FROM k")
def w16(t):
    out = intervals.rolling_intervals(t.base_predictions, "actual_weekly_change", group=["region", "horizon"])
    return out.select("region", "horizon", "date", "calibration_samples", "interval_radius", "interval_lower", "interval_upper")


@query("w16_rolling_conformal_binned", f"{_W16} SELECT region, horizon, {d('date')}, CAST(n AS INTEGER) AS calibration_samples, {r('radius AS interval_radius')} FROM k")
def w16_binned(t):
    out = intervals.rolling_intervals(t.base_predictions, "actual_weekly_change", group=["region", "horizon"])
    return out.select("region", "horizon", "date", "calibration_samples", "interval_radius")


@query("w17_delayed_release_conformal", f"""WITH q AS (SELECT b.region, b.horizon, b.forecast_origin, b.date, any_value(b.predicted_weekly_change) AS p, count(c.date) AS n, list_sort(list(abs(c.actual_weekly_change - c.predicted_weekly_change)) FILTER (c.date IS NOT NULL)) AS e
  FROM base_predictions b LEFT JOIN base_predictions c ON c.region = b.region AND c.horizon = b.horizon AND c.date <= b.forecast_origin AND c.forecast_origin < b.forecast_origin GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, CASE WHEN n >= 30 THEN e[CAST(least(n, ceil((n + 1) * 0.8)) AS INTEGER)] END AS radius FROM q)
  SELECT region, horizon, {d('date')}, CAST(n AS INTEGER) AS calibration_count, {r('p - radius AS lower_bound', 'p + radius AS upper_bound')} FROM k""")
def w17(t):
    out = intervals.horizon_intervals(t.base_predictions, "actual_weekly_change", "predicted_weekly_change", bucket="horizon", target="date", keys=["region"])
    return out.select("region", "horizon", "date", "calibration_count", "lower_bound", "upper_bound")


_G = "forecast_origin, date, horizon"
_C = "region IN ('R31','R32','R33','R34','R35')"


@query("r01_direct", f"SELECT {d('forecast_origin', 'date')}, horizon, region, {r('predicted_weekly_change')}, 'direct' AS reconciliation_method FROM base_predictions WHERE region = 'R48'")
def r01(t):
    return reconcile.direct(t.base_predictions).select("forecast_origin", "date", "horizon", "region", "predicted_weekly_change", "reconciliation_method")


_BU = f"""SELECT {_G}, region, predicted_weekly_change FROM base_predictions WHERE {_C} UNION ALL SELECT {_G}, 'R48', sum(predicted_weekly_change) FROM base_predictions WHERE {_C} GROUP BY ALL"""


@query("r02_bottom_up", f"SELECT {d('forecast_origin', 'date')}, horizon, region, {r('predicted_weekly_change')} FROM ({_BU})")
def r02(t):
    out = reconcile.bottom_up(t.base_predictions.select("forecast_origin", "date", "horizon", "region", "predicted_weekly_change"), ["forecast_origin", "date", "horizon"])
    return out.drop("reconciliation_method")


def _mint_sql() -> str:
    regions = ["R48", "R31", "R32", "R33", "R34", "R35"]
    x = [f"max(CASE WHEN region='{g}' THEN actual_weekly_change - predicted_weekly_change END)" for g in regions]
    names = [f"x{i}" for i in range(6)]
    # second = covariance about the prior mean of each origin; moments by direct two-pass sums.
    mean = ", ".join(f"avg({n}) AS m{i}" for i, n in enumerate(names))
    cov = ", ".join(f"avg((x{i}-m{i})*(x{j}-m{j})) AS c{i}{j}" for i in range(6) for j in range(6))
    norm = "+".join(f"(x{i}-m{i})*(x{i}-m{i})" for i in range(6))
    sq = "+".join(f"c{i}{j}*c{i}{j}" for i in range(6) for j in range(6))
    tr = "+".join(f"c{i}{i}" for i in range(6))
    u = ["1", "-1", "-1", "-1", "-1", "-1"]
    cu = [f"((1-w)*({'+'.join(f'c{i}{j}*({u[j]})' for j in range(6))})+w*mu*({u[i]}))" for i in range(6)]
    ucu = "+".join(f"({u[i]})*{cu[i]}" for i in range(6))
    adj = ", ".join(f"{cu[i]}/({ucu}) AS a{i}" for i in range(6))
    y = [f"max(CASE WHEN region='{g}' THEN predicted_weekly_change END) OVER w" for g in regions]
    den = "+".join(f"(c00+2*c0{k}+c{k}{k})" for k in range(1, 6))
    kid = [f"({'+'.join(f'(c0{i}+c{j}{i})*{y[i]}' for i in range(6))})/({den})" for j in range(1, 6)]
    two = "CASE region WHEN 'R48' THEN " + "+".join(kid) + " " + " ".join(f"WHEN '{g}' THEN {kid[i]}" for i, g in enumerate(regions[1:])) + " END"
    cs = ", ".join(f"c{i}{j}" for i in range(6) for j in range(6))
    pick = "CASE region " + " ".join(f"WHEN '{g}' THEN a{i}" for i, g in enumerate(regions)) + " END"
    return f"""v AS (SELECT date, horizon, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))} FROM base_predictions GROUP BY 1, 2),
  o AS (SELECT DISTINCT forecast_origin FROM base_predictions), mm AS (SELECT forecast_origin, count(*) AS n, {mean} FROM o JOIN v ON v.date < forecast_origin GROUP BY 1 HAVING count(*) >= 2),
  cc AS (SELECT forecast_origin, any_value(n) AS n, {cov}, avg(({norm})*({norm})) AS q4 FROM mm JOIN v ON v.date < forecast_origin GROUP BY 1),
  sh AS (SELECT *, ({tr})/6 AS mu, ({sq})/6 - (({tr})/6)*(({tr})/6) AS dist, (q4 - ({sq}))/(6*n) AS spread FROM cc), ww AS (SELECT *, CASE WHEN spread <= 0 OR dist <= 0 THEN 0.0 ELSE least(spread, dist)/dist END AS w FROM sh),
  aa AS (SELECT forecast_origin, n, {cs}, {adj} FROM ww),
  mint AS (SELECT b.forecast_origin, b.date, b.horizon, b.region, n, CASE WHEN n = 2 THEN {two} ELSE predicted_weekly_change - ({pick}) * sum(CASE WHEN region='R48' THEN predicted_weekly_change ELSE -predicted_weekly_change END) OVER w END AS p FROM base_predictions b JOIN aa USING (forecast_origin) WINDOW w AS (PARTITION BY b.forecast_origin, b.date, b.horizon))"""


@query("r03_mint_shrink", f"WITH {_mint_sql()} SELECT {d('forecast_origin', 'date')}, horizon, region, {r('p AS predicted_weekly_change', digits=3)} FROM mint")
def r03(t):
    rows = t.base_predictions.select("forecast_origin", "date", "horizon", "region", "predicted_weekly_change", "actual_weekly_change")
    rows = staged(rows, "base")
    resid = rows.withColumn("residual", F.col("actual_weekly_change") - F.col("predicted_weekly_change"))
    out = reconcile.mint(rows.drop("actual_weekly_change"), resid).drop("reconciliation_method")
    return out.withColumn("predicted_weekly_change", F.round("predicted_weekly_change", 3))


_CORE = ["forecast_origin", "date", "horizon", "region", "model_key", "predicted_weekly_change", "actual_weekly_change", "p10", "p50", "p90"]


@query("r04_reconciled_paths", f"""WITH {_mint_sql()}, u AS (SELECT 'direct' AS reconciliation_method, {_G}, region, predicted_weekly_change AS p FROM base_predictions WHERE region = 'R48' UNION ALL SELECT 'bottom_up', * FROM ({_BU}) UNION ALL SELECT 'mint_shrink', {_G}, region, p FROM mint)
  SELECT reconciliation_method, {d('u.forecast_origin', 'u.date')}, u.horizon, u.region, {r('p AS predicted_weekly_change', 'b.actual_weekly_change', digits=3)} FROM u JOIN base_predictions b ON b.forecast_origin = u.forecast_origin AND b.date = u.date AND b.horizon = u.horizon AND b.region = u.region""")
def r04(t):
    out = reconcile.all_paths(staged(t.base_predictions.select(*_CORE), "base"))
    return out.select(
        "reconciliation_method", "forecast_origin", "date", "horizon", "region", F.round("predicted_weekly_change", 3).alias("predicted_weekly_change"),
        F.round("actual_weekly_change", 3).alias("actual_weekly_change"),
    )


@query("r05_finalize", f"""WITH s AS (SELECT {_G}, region, CASE WHEN {_C} AND p10 IS NOT NULL THEN list_sort([p90, p50, p10]) ELSE [p90, p50, p10] END AS q, predicted_weekly_change AS p FROM base_predictions)
  SELECT {d('forecast_origin', 'date')}, horizon, region, {r(*[f"CASE WHEN region = 'R48' THEN sum(CASE WHEN region <> 'R48' THEN q[{i}] END) OVER w ELSE q[{i}] END AS {n}" for i, n in ((1, 'p10'), (2, 'p50'), (3, 'p90'))],
  "CASE WHEN region = 'R48' THEN sum(CASE WHEN region <> 'R48' THEN p END) OVER w ELSE p END AS predicted_weekly_change")} FROM s WINDOW w AS (PARTITION BY {_G})""")
def r05(t):
    crossed = t.base_predictions.select("forecast_origin", "date", "horizon", "region", "predicted_weekly_change", F.col("p90").alias("p10"), "p50", F.col("p10").alias("p90"))
    return reconcile.finalize(crossed, ["forecast_origin", "date", "horizon"], ["predicted_weekly_change", "p10", "p50", "p90"])


@query("r06_coherence_error", f"SELECT {d('forecast_origin', 'date')}, horizon, {r("sum(CASE WHEN region='R48' THEN predicted_weekly_change ELSE -predicted_weekly_change END) AS reconciliation_error")} FROM base_predictions GROUP BY forecast_origin, base_predictions.date, horizon")
def r06(t):
    return reconcile.coherence_error(t.base_predictions, group=["forecast_origin", "date", "horizon"])


_CB = "production_mmbbl, imports_mmbbl, refinery_inputs_mmbbl, exports_mmbbl, spr_stock_change_mmbbl, balance_adjustment_mmbbl"


@query("f03_crude_balance", f"SELECT {d('date')}, {r(*_CB.split(', '), 'commercial_stocks_mmbbl', 'spr_stocks_mmbbl', 'commercial_stock_change_mmbbl', 'fundamental_balance_mmbbl')} FROM crude_balance")
def f03(t):
    return crude.weekly_balance(t.crude_long)


def _crude_forecast(targets: str, history: str = "crude_balance") -> str:
    f = lambda c: f"max(f) FILTER (component = '{c}')"
    fund = f"{f('production_mmbbl')} + {f('imports_mmbbl')} - {f('refinery_inputs_mmbbl')} - {f('exports_mmbbl')} - {f('spr_stock_change_mmbbl')}"
    return f"""ch AS (UNPIVOT (SELECT date, {_CB} FROM {history}) ON {_CB} INTO NAME component VALUE value), tg AS ({targets}),
  hr AS (SELECT t.target, ch.*, weekofyear(ch.date) AS wk, row_number() OVER (PARTITION BY t.target, component ORDER BY ch.date DESC) AS rn FROM tg t JOIN ch ON ch.date < t.target),
  hl AS (SELECT *, avg(value) OVER (PARTITION BY target, component, wk) AS wm FROM hr WHERE rn <= 265),
  cf AS (SELECT target, component, coalesce(avg(value) FILTER (wk = weekofyear(target)), avg(value)) + avg(value - wm) FILTER (rn <= 4) AS raw FROM hl GROUP BY 1, 2),
  cn AS (SELECT target, component, CASE WHEN component IN ('production_mmbbl','imports_mmbbl','refinery_inputs_mmbbl','exports_mmbbl') THEN greatest(raw, 0.0) ELSE raw END AS f FROM cf),
  cp AS (SELECT target AS date, {fund} AS fund, {fund} + {f('balance_adjustment_mmbbl')} AS pred, {f('production_mmbbl')} AS prod, {f('spr_stock_change_mmbbl')} AS spr FROM cn GROUP BY 1),
  cl AS (SELECT t.target AS date, max(h.date) AS origin, last(commercial_stock_change_mmbbl ORDER BY h.date) AS base FROM tg t JOIN {history} h ON h.date < t.target AND commercial_stock_change_mmbbl IS NOT NULL GROUP BY 1)"""


@query("m17_component_forecast", f"WITH {_crude_forecast('SELECT date AS target FROM crude_balance')} SELECT CAST(origin AS TIMESTAMP) AS forecast_origin, CAST(cp.date AS TIMESTAMP) AS date, {r('fund AS fundamental_balance_forecast_mmbbl', 'pred AS prediction_mmbbl', 'base AS last_change_baseline_mmbbl', 'prod AS production_forecast_mmbbl', 'spr AS spr_stock_change_forecast_mmbbl')} FROM cp JOIN cl ON cl.date = cp.date")
def m17(t):
    balance = crude.weekly_balance(t.crude_long)
    out = crude.forecast(balance, balance.select("date")).where(F.col("last_change_baseline_mmbbl").isNotNull())
    return out.select("forecast_origin", "date", "fundamental_balance_forecast_mmbbl", "prediction_mmbbl", "last_change_baseline_mmbbl", "production_forecast_mmbbl", "spr_stock_change_forecast_mmbbl")


@query("e13_crude_next_week", f"WITH {_crude_forecast('SELECT max(date) + 7 AS target FROM crude_balance')} SELECT CAST(origin AS TIMESTAMP) AS forecast_origin, CAST(cp.date AS TIMESTAMP) AS date, {r('pred AS prediction_mmbbl')} FROM cp JOIN cl ON cl.date = cp.date")
def e13(t):
    return jobs.crude_job(t.crude_long, scratch_path(t.spark, "e13"))[1].select("forecast_origin", "date", "prediction_mmbbl")


_OIL = f"""WITH clean AS (SELECT * FROM crude_balance WHERE commercial_stock_change_mmbbl IS NOT NULL), {_crude_forecast('SELECT date AS target FROM clean QUALIFY row_number() OVER (ORDER BY date) > 156', 'clean')},
  bt AS (SELECT cp.date, origin, pred, base, c.commercial_stock_change_mmbbl AS y FROM cp JOIN cl ON cl.date = cp.date JOIN clean c ON c.date = cp.date)"""


@query("b10_crude_backtest", f"""{_OIL}, q AS (SELECT b.date, any_value(b.origin) AS origin, any_value(b.pred) AS p, any_value(b.base) AS base, any_value(b.y) AS y, count(c.date) AS n, list_sort(list(abs(c.y - c.pred)) FILTER (c.date IS NOT NULL)) AS e FROM bt b LEFT JOIN bt c ON c.date <= b.origin AND c.origin < b.origin GROUP BY 1),
  k AS (SELECT *, CASE WHEN n >= 30 THEN e[CAST(least(n, ceil((n + 1) * 0.8)) AS INTEGER)] END AS radius FROM q) SELECT {d('date')}, {r('p AS prediction_mmbbl', 'base AS last_change_baseline_mmbbl', 'y AS actual_mmbbl', 'p - radius AS lower_bound_mmbbl', 'p + radius AS upper_bound_mmbbl')}, CAST(n AS INTEGER) AS calibration_count FROM k""")
def b10(t):
    out = crude.backtest(crude.weekly_balance(t.crude_long))
    return out.select("date", "prediction_mmbbl", "last_change_baseline_mmbbl", "actual_mmbbl", "lower_bound_mmbbl", "upper_bound_mmbbl", "calibration_count")


@query("b10_crude_metrics", f"{_OIL} SELECT model, {r('avg(abs(y-p)) AS mae', 'sqrt(avg((y-p)*(y-p))) AS rmse', 'avg(y-p) AS bias')}, count(*) AS n_samples FROM (SELECT 'seasonal_level_fundamentals' AS model, y, pred AS p FROM bt UNION ALL SELECT 'last_change_baseline', y, base FROM bt) GROUP BY 1")
def b10_metrics(t):
    return crude.backtest_metrics(crude.backtest(crude.weekly_balance(t.crude_long)))


@query("m13_recursive_forecast")
def m13(t):
    rows = staged(feature_rows(t), "features")
    params = linear.fit(rows.where(F.col("date") < "2000-01-07").withColumn("fold", F.lit(1)), ["duoarea", "fold"], RECURSIVE, "weekly_change_bcf")
    origins = rows.select("duoarea").distinct().select("duoarea", F.lit(1).alias("fold"), F.lit("2000-01-07").cast("date").alias("start_date"), F.lit(26).alias("n_steps"))
    inputs = recursive.step_inputs(rows, origins, ["duoarea"], 26)
    return recursive.project_linear(inputs, params, ["duoarea"], RECURSIVE).drop("features")


@query("b07_recursive_backtest")
def b07(t):
    return recursive.backtest(feature_rows(t), ["duoarea"], RECURSIVE, splits.expanding_weeks("1995-01-01", "1998-12-25", 4, 4), horizon=4, coverage=0.8).drop("features")


@query("b07_horizon_metrics")
def b07_metrics(t):
    rows = b07(t)
    both = rows.groupBy("duoarea", "horizon").agg(
        *metrics.error_columns("actual_weekly_change", "predicted_weekly_change"), F.count("actual_weekly_change").alias("n_samples"),
        *metrics.interval_columns("actual_weekly_change", "interval_lower", "interval_upper", 0.8),
    )
    return both


def _regional(t, target=None):
    return jobs.regional_backtest(feature_rows_all(t), RECURSIVE, splits.expanding_weeks("1995-01-01", "1998-12-25", 4, 4), linear.RIDGE, "ridge", target=target)


@query("b09_hierarchical_backtest")
def b09(t):
    return _regional(t)[1]


@query("e09_regional_backtest_job")
def e09(t):
    return _regional(t, scratch_path(t.spark, "e09"))[2]


_DIS = """s AS (SELECT c.duoarea, m.period, m.a/1000.0 AS res, m.n/3.0/1000.0 AS com, m.r/1000.0 AS ind, m.q/3.0/1000.0 AS pb, CASE WHEN m.nation%2=0 THEN m.q*3/1000.0 ELSE 0.0 END AS mp, CASE WHEN m.nation%2=1 THEN m.q*3/1000.0 ELSE 0.0 END AS dp, m.p/9973.0 AS price FROM month_state m JOIN state_codes c USING (nation)),
  rg AS (SELECT duoarea, period, sum(res+com) AS res_com, sum(ind) AS ind, sum(pb) AS power_burn, sum(mp) AS mp, sum(dp) AS dp, CASE WHEN sum(res+com+ind+pb) > 0 THEN sum(price*(res+com+ind+pb))/sum(res+com+ind+pb) ELSE 0.0 END AS regional_price FROM s GROUP BY 1, 2),
  us AS (SELECT period, sum(q)/1000.0 AS q FROM month_state GROUP BY 1),
  rb AS (SELECT duoarea, period, dp + mp*2.5/3.0 AS dry_production, res_com, power_burn, ind, q/7.9*(dp + mp*2.5/3.0)/(2.5*q) + q/15.7*(res_com+power_burn+ind)/(2.0*q) AS fuel_use, regional_price FROM rg JOIN us USING (period)),
  mw AS (SELECT duoarea, CAST(date_trunc('month', date) AS DATE) AS period, sum(hdd) AS hdd, sum(cdd) AS cdd FROM region_daily GROUP BY 1, 2), mp AS (SELECT CAST(date_trunc('month', period) AS DATE) AS period, avg(value) AS price_hh FROM daily_price GROUP BY 1),
  am AS (SELECT rb.*, hdd/dd AS hdd_d, cdd/dd AS cdd_d, res_com/dd AS rc_d, power_burn/dd AS pb_d, dry_production/dd AS dry_production_d, ind/dd AS ind_d, fuel_use/dd AS fuel_use_d, regional_price - price_hh AS basis, dd, CAST(month(period) AS INTEGER) AS mon, CAST(period - DATE '1970-01-01' AS DOUBLE) + dd/2 AS x
    FROM (SELECT *, CAST(day(last_day(period)) AS DOUBLE) AS dd FROM rb) rb JOIN mw USING (duoarea, period) JOIN mp USING (period))"""


@query("m11_disaggregation_months", f"WITH {_DIS} SELECT duoarea, {d('period')}, {r('dry_production', 'res_com', 'power_burn', 'ind', 'fuel_use', 'regional_price', 'basis AS basis_spread', 'hdd_d AS hdd_per_day', 'rc_d AS res_com_per_day')} FROM am")
def m11(t):
    return _months(t).select("duoarea", "period", "dry_production", "res_com", "power_burn", "ind", "fuel_use", "regional_price", "basis_spread", "hdd_per_day", "res_com_per_day")


def _months(t):
    table = disaggregate.state_components(t.monthly_series, t.state_codes, t.daily_price)
    regional = disaggregate.regional_balance(disaggregate.regional_months(table), t.monthly_series)
    return disaggregate.aligned_months(regional, t.region_daily, t.daily_price)


@query("w09_ratio_forward_fill", f"WITH {_DIS} SELECT duoarea, {d('period')}, {r('dry_production', 'fuel_use')} FROM rb")
def w09(t):
    table = disaggregate.state_components(t.monthly_series, t.state_codes, t.daily_price)
    return disaggregate.regional_balance(disaggregate.regional_months(table), t.monthly_series).select("duoarea", "period", "dry_production", "fuel_use")


def _interp(c: str) -> str:
    return f"CASE WHEN w.x > last_x THEN coalesce(pr.{c}, ov.{c}) * CASE WHEN sc.{c} > 0 AND la.{c}_d > 0 THEN least(greatest(la.{c}_d / sc.{c}, 0.5), 1.5) ELSE 1.0 END WHEN kb.x IS NULL THEN ka.{c}_d WHEN ka.x = kb.x THEN kb.{c}_d ELSE kb.{c}_d + (ka.{c}_d - kb.{c}_d) * (w.x - kb.x) / (ka.x - kb.x) END * 7.0"


_WKLY = f"""WITH {_DIS}, {sql_linear('rc', 'am', ['duoarea'], ['hdd_d', 'cdd_d'], 'rc_d')}, {sql_linear('pw', 'am', ['duoarea'], ['hdd_d', 'cdd_d', 'regional_price'], 'pb_d')},
  pr AS (SELECT duoarea, mon, avg(basis) AS basis, avg(dry_production_d) AS dry_production, avg(ind_d) AS ind, avg(fuel_use_d) AS fuel_use FROM am GROUP BY 1, 2), ov AS (SELECT duoarea, avg(dry_production) AS dry_production, avg(ind) AS ind, avg(fuel_use) AS fuel_use FROM pr GROUP BY 1),
  la AS (SELECT *, x AS last_x FROM am QUALIFY row_number() OVER (PARTITION BY duoarea ORDER BY period DESC) = 1), wp AS (SELECT w.date, avg(value) AS price FROM (SELECT DISTINCT date FROM wk_weather) w LEFT JOIN daily_price p ON p.period BETWEEN w.date - 6 AND w.date GROUP BY 1),
  w AS (SELECT ww.duoarea, ww.date, hdd, cdd, price, CAST(month(ww.date) AS INTEGER) AS mon, CAST(ww.date - DATE '1970-01-01' AS DOUBLE) AS x, (SELECT max(x) FROM am WHERE am.duoarea = ww.duoarea AND am.x <= CAST(ww.date - DATE '1970-01-01' AS DOUBLE)) AS bx, (SELECT min(x) FROM am WHERE am.duoarea = ww.duoarea AND am.x >= CAST(ww.date - DATE '1970-01-01' AS DOUBLE)) AS ax FROM wk_weather ww JOIN wp ON wp.date = ww.date),
  e AS (SELECT w.duoarea, w.date, w.hdd, w.cdd, w.price, w.price + coalesce(pr.basis, 0.0) AS rp, {_interp('dry_production')} AS dry_production, {_interp('ind')} AS industrial, {_interp('fuel_use')} AS fuel_use FROM w LEFT JOIN pr ON pr.duoarea = w.duoarea AND pr.mon = w.mon JOIN ov ON ov.duoarea = w.duoarea
    JOIN la ON la.duoarea = w.duoarea JOIN pr sc ON sc.duoarea = w.duoarea AND sc.mon = la.mon LEFT JOIN am kb ON kb.duoarea = w.duoarea AND kb.x = w.bx LEFT JOIN am ka ON ka.duoarea = w.duoarea AND ka.x = w.ax),
  fin AS (SELECT e.*, greatest(7.0 * ({sql_pred('rb_', ['e.hdd/7.0', 'e.cdd/7.0'])}), 0.0) AS res_com, greatest(7.0 * ({sql_pred('pb_', ['e.hdd/7.0', 'e.cdd/7.0', 'e.rp'])}), 0.0) AS power_burn FROM e JOIN rc_b rb_ ON rb_.duoarea = e.duoarea JOIN pw_b pb_ ON pb_.duoarea = e.duoarea)"""
_LB = "dry_production - (res_com + power_burn + industrial + fuel_use)"


@query("m12_weekly_estimates", f"{_WKLY} SELECT duoarea, {d('date')}, {r('price', 'rp AS regional_price', 'dry_production', 'industrial', 'fuel_use', 'res_com', 'power_burn', f'{_LB} AS local_balance')} FROM fin")
def m12(t):
    from pitcast.operators.rollups import weekly_price

    return disaggregate.weekly_estimates(_months(t), t.wk_weather, weekly_price(t.daily_price, t.wk_weather)).drop("hdd", "cdd")


@query("f01_local_balance", f"{_WKLY} SELECT fin.duoarea, CAST(fin.date AS TIMESTAMP) AS date, {r(f'{_LB} AS local_balance', f'weekly_change_bcf - ({_LB}) AS net_inflow_balancing')} FROM fin JOIN wk_storage s ON s.duoarea = fin.duoarea AND s.date = fin.date")
def f01(t):
    return _balance(t).select("duoarea", "date", "local_balance", "net_inflow_balancing")


def _balance(t):
    return jobs.balance_table(t.monthly_series, t.state_codes, t.region_daily, t.daily_price, t.wk_weather, t.wk_storage)


@query("e05_balance_job", f"{_WKLY} SELECT fin.duoarea, CAST(fin.date AS TIMESTAMP) AS date, {r('res_com', 'power_burn', 'industrial', 'fuel_use', 'dry_production', f'weekly_change_bcf - ({_LB}) AS net_inflow_balancing')} FROM fin JOIN wk_storage s ON s.duoarea = fin.duoarea AND s.date = fin.date")
def e05(t):
    built = jobs.balance_job(t.monthly_series, t.state_codes, t.region_daily, t.daily_price, t.wk_weather, t.wk_storage, scratch_path(t.spark, "e05"))
    return built.select("duoarea", "date", "res_com", "power_burn", "industrial", "fuel_use", "dry_production", "net_inflow_balancing")

