"""Aggregations, metrics and joins (A, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitcast.functions.columns import require_columns
from pitcast.operators import features as ft
from pitcast.operators import metrics, reconcile, rollups
from pitcast.plans.registry import d, query, r

_FRI = "(CAST({0} AS DATE) + CAST((12 - isodow({0})) % 7 AS INTEGER))"


@query("a01_population_weighted_day", f"SELECT duoarea, {d('date')}, {r('sum(temperature_f*population_weight) AS temperature_f', 'sum(hdd*population_weight) AS hdd', 'sum(cdd*population_weight) AS cdd')} FROM state_daily GROUP BY 1, 2")
def a01(t):
    return rollups.weighted_daily_weather(t.state_daily, ["duoarea"])


@query("a02_storage_week_rollup", f"""SELECT duoarea, CAST({_FRI.format('date')} AS TIMESTAMP) AS date, {r('avg(temperature_f) AS temperature_f', 'sum(hdd) AS hdd', 'sum(cdd) AS cdd')}, CAST(count(*) AS INTEGER) AS weather_days
  FROM region_daily GROUP BY 1, 2 HAVING count(*) = 7""")
def a02(t):
    return rollups.weekly_weather(t.region_daily, ["duoarea"])


_MEMBER_KEYS = "provider, model, model_run, ensemble_member, issued_at, valid_start, valid_end"


@query("a03_region_weighting", f"""SELECT {_MEMBER_KEYS}, 'REGIONAL' AS state, a.duoarea, {r('sum(temperature_f*weather_weight) AS temperature_f', 'sum(hdd*weather_weight) AS hdd', 'sum(cdd*weather_weight) AS cdd', 'sum(coverage*weather_weight) AS coverage')}
  FROM archive a JOIN (SELECT state, duoarea, weather_weight FROM state_weights) w ON a.state = w.state AND a.duoarea = w.duoarea GROUP BY {_MEMBER_KEYS}, a.duoarea""")
def a03(t):
    return rollups.region_members(t.archive, t.state_weights)


@query("j13_many_to_one_weights", "SELECT DISTINCT state, duoarea FROM archive WHERE (state, duoarea) NOT IN (SELECT (state, duoarea) FROM state_weights WHERE weather_weight > 0.2)")
def j13(t):
    return rollups.unweighted_states(t.archive, t.state_weights.where(F.col("weather_weight") > 0.2))


_SC = "provider, model, model_run, issued_at, duoarea, date"


@query("a04_ensemble_rollup", f"""WITH m AS (SELECT provider, model, model_run, issued_at, duoarea, {_FRI.format('valid_start')} AS date, ensemble_member, avg(temperature_f) AS temperature_f, sum(hdd) AS hdd, sum(cdd) AS cdd,
  CAST(count(DISTINCT valid_start) AS INTEGER) AS weather_days, avg(coverage) AS coverage FROM region_archive GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(DISTINCT valid_start) = 7 AND avg(coverage) >= 0.999),
  s AS (SELECT {_SC}, avg(temperature_f) AS temperature_f, avg(hdd) AS hdd, avg(cdd) AS cdd, min(weather_days) AS weather_days, avg(coverage) AS coverage, CAST(count(*) AS INTEGER) AS ensemble_members,
  quantile_cont(hdd, 0.1) AS hdd_p10, quantile_cont(hdd, 0.9) AS hdd_p90, quantile_cont(cdd, 0.1) AS cdd_p10, quantile_cont(cdd, 0.9) AS cdd_p90 FROM m GROUP BY {_SC})
  SELECT {_SC.removesuffix(', date')}, {d('date')}, weather_days, ensemble_members, {r('temperature_f', 'hdd', 'cdd', 'coverage', 'hdd_p10', 'hdd_p90', 'cdd_p10', 'cdd_p90', 'hdd_p90 - hdd_p10 AS hdd_spread', 'cdd_p90 - cdd_p10 AS cdd_spread')} FROM s""")
def a04(t):
    return rollups.weekly_scenarios(t.region_archive)


@query("a05_seasonal_profile", f"""SELECT duoarea, week_of_year, {r('hdd', 'avg(hdd) OVER (PARTITION BY duoarea) AS hdd_overall')} FROM (SELECT duoarea, CAST(weekofyear(date) AS INTEGER) AS week_of_year, avg(hdd) AS hdd FROM wk_weather GROUP BY 1, 2)""")
def a05(t):
    return rollups.seasonal_profile(t.wk_weather.withColumn("week_of_year", F.weekofyear("date")), ["hdd"])


@query("a06_week_mean_std", f"""SELECT duoarea, week_of_year, {r('m AS predicted_weekly_change', 'coalesce(s, avg(s) OVER (PARTITION BY duoarea)) AS prediction_std')} FROM (
  SELECT duoarea, week_of_year, avg(weekly_change_bcf) AS m, stddev_samp(weekly_change_bcf) AS s FROM wk_storage GROUP BY 1, 2)""")
def a06(t):
    return rollups.week_mean_std(t.wk_storage)


@query("a10_state_component_rollup", f"""WITH s AS (SELECT c.duoarea, m.period, m.a/1000.0 AS res, m.n/3.0/1000.0 AS com, m.r/1000.0 AS ind, m.q/3.0/1000.0 AS pb,
  CASE WHEN m.nation%2=0 THEN m.q*3/1000.0 ELSE 0.0 END AS mp, CASE WHEN m.nation%2=1 THEN m.q*3/1000.0 ELSE 0.0 END AS dp, m.p/9973.0 AS price FROM month_state m JOIN state_codes c USING (nation))
  SELECT duoarea, {d('period')}, {r('sum(res+com) AS res_com', 'sum(ind) AS ind', 'sum(pb) AS power_burn', 'sum(mp) AS marketed_production', 'sum(dp) AS reported_dry',
  'CASE WHEN sum(res+com+ind+pb) > 0 THEN sum(price*(res+com+ind+pb))/sum(res+com+ind+pb) ELSE 0.0 END AS regional_price')} FROM s GROUP BY 1, 2""")
def a10(t):
    from pitcast.operators import disaggregate as d

    return d.regional_months(d.state_components(t.monthly_series, t.state_codes, t.daily_price))


@query("a11_month_rollups", f"SELECT duoarea, CAST(date_trunc('month', date) AS TIMESTAMP) AS period, {r('sum(hdd) AS hdd', 'sum(cdd) AS cdd', 'avg(temperature_f) AS temperature_f')} FROM region_daily GROUP BY 1, 2")
def a11(t):
    return rollups.monthly(t.region_daily, "date", sums=["hdd", "cdd"], means=["temperature_f"], keys=["duoarea"])


_PRED = "(SELECT duoarea, date, year, weekly_change_bcf AS y, lag(weekly_change_bcf) OVER (PARTITION BY duoarea ORDER BY date) AS p FROM wk_storage)"
_ERR = ["avg(abs(y-p)) AS mae", "sqrt(avg((y-p)*(y-p))) AS rmse", "avg(y-p) AS bias"]


def _pred(t):
    return t.wk_storage.select(
        "duoarea", "date", "year", F.col("weekly_change_bcf").alias("y"), F.lag("weekly_change_bcf").over(ft.series_window()).alias("p")
    )


@query("a12_error_metrics", f"SELECT duoarea, {r(*_ERR)} FROM {_PRED} GROUP BY 1")
def a12(t):
    return metrics.error_metrics(_pred(t), "y", "p", ["duoarea"])


@query("a13_error_metrics_r2", f"SELECT duoarea, {r(*_ERR, '1 - sum((y-p)*(y-p))/(var_pop(y)*count(y)) AS r2')} FROM {_PRED} WHERE p IS NOT NULL GROUP BY 1")
def a13(t):
    return metrics.error_metrics_r2(_pred(t).where(F.col("p").isNotNull()), "y", "p", ["duoarea"])


@query("a14_fold_metrics", f"SELECT duoarea, CASE WHEN grouping(year) = 1 THEN 'overall' ELSE CAST(year AS VARCHAR) END AS year, {r(*_ERR)}, count(*) AS n_samples FROM {_PRED} WHERE p IS NOT NULL GROUP BY GROUPING SETS ((duoarea, year), (duoarea))")
def a14(t):
    return metrics.fold_metrics(_pred(t), "y", "p", "year", ["duoarea"])


_BAND = "(SELECT *, CASE WHEN year >= 1997 THEN p - 100 END AS p10, CASE WHEN year >= 1997 THEN p + 100 END AS p90 FROM " + _PRED + ")"


def _band(t):
    late = F.col("year") >= 1997
    return _pred(t).withColumns({"p10": F.when(late, F.col("p") - 100), "p90": F.when(late, F.col("p") + 100)})


@query("a15_ablation_summary", f"""SELECT CASE WHEN year % 2 = 0 THEN 'seasonal' END AS weather_input, duoarea AS region, {r(*_ERR, 'avg(CASE WHEN p10 IS NOT NULL THEN CAST(y BETWEEN p10 AND p90 AS INTEGER) END) AS interval_coverage')}, count(*) AS n_samples
  FROM {_BAND} WHERE p IS NOT NULL GROUP BY 1, 2""")
def a15(t):
    df = _band(t).withColumns({"weather_input": F.when(F.col("year") % 2 == 0, F.lit("seasonal")), "region": F.col("duoarea")})
    return metrics.ablation_summary(df, ["weather_input", "region"], "y", "p")


@query("a16_interval_metrics", f"""SELECT duoarea, 0.8::DOUBLE AS nominal_coverage, {r('1 - avg(b) - avg(a) AS empirical_coverage', '1 - avg(b) - avg(a) - 0.8 AS coverage_error', 'avg(p90 - p10) AS average_interval_width', 'avg(b) AS below_interval_rate', 'avg(a) AS above_interval_rate')},
  count(*) AS interval_samples FROM (SELECT *, CAST(y < p10 AS DOUBLE) AS b, CAST(y > p90 AS DOUBLE) AS a FROM {_BAND} WHERE p10 IS NOT NULL AND p90 IS NOT NULL AND y IS NOT NULL) GROUP BY 1""")
def a16(t):
    return metrics.interval_metrics(_band(t), "y", "p10", "p90", 0.8, ["duoarea"])


_YW = """(SELECT duoarea, week_of_year, avg(m) AS avg_value, stddev_samp(m) AS std_value, min(m) AS min_value, max(m) AS max_value FROM (SELECT duoarea, year, week_of_year, avg(weekly_change_bcf) AS m
  FROM (SELECT *, max(year) OVER (PARTITION BY duoarea) AS ny FROM wk_storage) WHERE year < ny AND year >= ny - 5 GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("a17_year_week_profile", f"SELECT duoarea, week_of_year, {r('avg_value', 'std_value', 'min_value', 'max_value')} FROM {_YW}")
def a17(t):
    return rollups.year_week_profile(t.wk_storage, "weekly_change_bcf")


@query("a18_distribution", f"""SELECT duoarea, count(*) AS n, {r('avg(x) AS mean', 'stddev_samp(x) AS std', 'min(x) AS min', 'quantile_cont(x, 0.25) AS q25', 'median(x) AS median', 'quantile_cont(x, 0.75) AS q75', 'max(x) AS max')}
  FROM (SELECT duoarea, weekly_change_bcf AS x FROM wk_storage) GROUP BY 1""")
def a18(t):
    return metrics.distribution(t.wk_storage, "weekly_change_bcf", ["duoarea"])


@query("a18_histogram", """SELECT duoarea, CASE WHEN x < -1000 THEN 0 WHEN x >= 1000 THEN 21 ELSE CAST(floor((x + 1000) / 100) AS INTEGER) + 1 END AS bin, count(*) AS n
  FROM (SELECT duoarea, weekly_change_bcf AS x FROM wk_storage) GROUP BY 1, 2""")
def a18_histogram(t):
    return metrics.histogram(t.wk_storage, "weekly_change_bcf", -1000.0, 1000.0, 20, ["duoarea"])


@query("a18_extreme_rows", f"""SELECT duoarea, CAST(first(date ORDER BY weekly_change_bcf, date) AS TIMESTAMP) AS argmin, {r('min(weekly_change_bcf) AS min_value')}, CAST(first(date ORDER BY weekly_change_bcf DESC, date) AS TIMESTAMP) AS argmax,
  {r('max(weekly_change_bcf) AS max_value')} FROM wk_storage GROUP BY 1""")
def a18_extremes(t):
    return metrics.extreme_rows(t.wk_storage, "weekly_change_bcf", "date", ["duoarea"])


@query("j01_join_weather_storage", f"SELECT duoarea, {d('date')}, {r('storage_bcf', 'weekly_change_bcf', 'temperature_f', 'hdd', 'cdd')}, year, month, week_of_year, weather_days FROM wk_storage JOIN wk_weather USING (duoarea, date)")
def j01(t):
    return ft.join_weather_storage(t.wk_storage, t.wk_weather)


@query("j11_weekly_price", f"SELECT {d('w.date')}, {r('avg(value) AS value')} FROM (SELECT DISTINCT date FROM wk_storage) w LEFT JOIN daily_price p ON p.period BETWEEN w.date - 6 AND w.date GROUP BY 1")
def j11(t):
    return rollups.weekly_price(t.daily_price, t.wk_storage)


@query("j14_complete_groups", f"SELECT region, {d('date')}, horizon, {r('v')} FROM (SELECT *, count(region) OVER (PARTITION BY date, horizon) AS n FROM (SELECT duoarea AS region, date, 1 AS horizon, hdd AS v FROM wk_weather_all)) WHERE n = 6")
def j14(t):
    df = t.wk_weather_all.select(F.col("duoarea").alias("region"), "date", F.lit(1).alias("horizon"), F.col("hdd").alias("v"))
    return reconcile.complete_groups(df, ["date", "horizon"])


@query("j15_profile_left_join", f"SELECT s.duoarea, {d('s.date')}, {r('a.predicted_weekly_change', 'a.predicted_weekly_change - a.prediction_std AS lower_band', 'a.predicted_weekly_change + a.prediction_std AS upper_band')} FROM wk_storage s LEFT JOIN (SELECT duoarea, week_of_year, m AS predicted_weekly_change, coalesce(s, avg(s) OVER (PARTITION BY duoarea)) AS prediction_std FROM (SELECT duoarea, week_of_year, avg(weekly_change_bcf) AS m, stddev_samp(weekly_change_bcf) AS s FROM wk_storage WHERE year < 2001 GROUP BY 1, 2)) a ON a.duoarea = s.duoarea AND a.week_of_year = s.week_of_year WHERE s.year >= 2001")
def j15(t):
    from pitcast.plans.jobs import same_week_average

    return same_week_average(t.wk_storage.where(F.col("year") < 2001), t.wk_storage.where(F.col("year") >= 2001)).select(
        "duoarea", "date", "predicted_weekly_change", "lower_band", "upper_band"
    )


@query("j18_actuals_attach", f"SELECT v.component, v.issued_at, v.valid_at, {r('v.baseline_mw', 'coalesce(a.actual_mw, v.actual_mw) AS actual_mw')} FROM power_vintages v LEFT JOIN power_actuals a USING (component, valid_at)")
def j18(t):
    real = t.power_actuals.withColumnRenamed("actual_mw", "_real")
    return t.power_vintages.join(real, ["component", "valid_at"], "left").select(
        "component", "issued_at", "valid_at", "baseline_mw", F.coalesce("_real", "actual_mw").alias("actual_mw")
    )


@query("j19_monthly_alignment", f"""WITH w AS (SELECT duoarea, CAST(date_trunc('month', date) AS DATE) AS period, sum(hdd) AS hdd, sum(cdd) AS cdd FROM region_daily GROUP BY 1, 2),
  p AS (SELECT CAST(date_trunc('month', period) AS DATE) AS period, avg(value) AS price_hh FROM daily_price GROUP BY 1), m AS (SELECT duoarea, period, sum(q) AS q FROM month_state GROUP BY 1, 2)
  SELECT m.duoarea, {d('m.period')}, {r('q', 'hdd', 'cdd', 'price_hh')} FROM m JOIN w USING (duoarea, period) JOIN p USING (period)""")
def j19(t):
    q = t.shipped.groupBy("duoarea", F.trunc("l_shipdate", "month").alias("period")).agg(F.sum("l_quantity").alias("q"))
    weather = rollups.monthly(t.region_daily, "date", sums=["hdd", "cdd"], keys=["duoarea"])
    price = rollups.monthly(t.daily_price, "period", means=["value"]).withColumnRenamed("value", "price_hh")
    require_columns(weather, ["period"])
    return q.join(weather, ["duoarea", "period"]).join(price, "period")
