"""Projections, calendars and window features (P, W, T, U)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions import calendar as cal
from pitcast.functions.columns import find_column, finite, project_aliases, to_double, to_timestamp
from pitcast.functions.hashing import frame_hash
from pitcast.operators import features as ft
from pitcast.operators import rollups
from pitcast.operators.asof import keep_latest
from pitcast.plans.registry import d, query, r
from pitcast.sources import dimensions

_W = "PARTITION BY duoarea ORDER BY date"


def strict(x: str, n: int, over: str = _W) -> str:
    f = f"({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN avg({x}) OVER {f} END"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({_W})"


@query("p01_alias_projection", f"SELECT o_orderkey AS order_id, {r('o_totalprice AS amount')}, o_orderdate AS ordered_at FROM orders")
def p01(t):
    df = t.raw("orders").withColumnsRenamed({"o_totalprice": "Total Price ($)", "o_orderdate": "Order-Date"})
    assert find_column(df, ["order_date"]) == "Order-Date"
    return project_aliases(df, {"order_id": ["o_orderkey"], "amount": ["total_price"], "ordered_at": ["order_date"]})


@query("p02_safe_casts", f"""SELECT count(TRY_CAST(c_name AS DOUBLE)) AS numeric_names,
  count(TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS DOUBLE)) AS numeric_codes,
  {r("avg(TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS DOUBLE)) AS mean_code")}, count(TRY_CAST(c_mktsegment AS TIMESTAMP)) AS stamps FROM customer""")
def p02(t):
    code = to_double(F.regexp_replace("c_name", "[^0-9]", ""))
    return t.raw("customer").agg(
        F.count(to_double("c_name")).alias("numeric_names"), F.count(code).alias("numeric_codes"), F.avg(finite(code)).alias("mean_code"),
        F.count(to_timestamp("c_mktsegment")).alias("stamps"),
    )


@query("p03_utc_normalization", "SELECT o_orderkey, o_orderdate AS utc_at, o_orderdate - INTERVAL 5 HOUR AS shifted_at FROM orders")
def p03(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t.raw("orders").select(
        "o_orderkey", to_timestamp(text).alias("utc_at"), to_timestamp(F.concat(text, F.lit("+05:00"))).alias("shifted_at")
    )


@query("p08_clean_weekly_storage", f"""SELECT duoarea, {d('period')}, {r('value')}, CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month,
  CAST(weekofyear(period) AS INTEGER) AS week_of_year FROM storage_raw WHERE period BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND contains(series, '_SWO_')""")
def p08(t):
    from pitcast.plans.jobs import clean_weekly_storage

    raw = t.storage_raw.unionByName(t.storage_raw.where(F.month("period") == 1).withColumn("series", F.lit("OTHER")))
    return clean_weekly_storage(raw, "1996-01-01", "2000-12-31").drop("series")


@query("p09_region_filter", f"SELECT duoarea, {d('period')}, {r('value')} FROM storage_raw WHERE duoarea IN ('R31', 'R33')")
def p09(t):
    from pitcast.plans.jobs import region_rows

    return region_rows(t.storage_raw, ["R31", "R33"]).drop("series")


@query("p10_storage_model_columns", f"""SELECT duoarea, {d('date')}, {r('storage_bcf', 'weekly_change_bcf')}, year, month, week_of_year FROM (
  SELECT duoarea, period AS date, value AS storage_bcf, value - lag(value) OVER (PARTITION BY duoarea ORDER BY period) AS weekly_change_bcf,
  CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month, CAST(weekofyear(period) AS INTEGER) AS week_of_year FROM storage_raw)
  WHERE weekly_change_bcf IS NOT NULL""")
def p10(t):
    from pitcast.plans.jobs import storage_table

    return storage_table(t.storage_raw)


@query("p11_weather_projection", f"""SELECT duoarea, {d('date')}, {r('temperature_f', 'hdd', 'cdd')}, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM region_daily""")
def p11(t):
    return t.region_daily.withColumns({"year": F.year("date"), "month": F.month("date"), "day_of_year": F.dayofyear("date")})


@query("p12_degree_days", f"SELECT state, {d('date')}, {r('temperature_f', 'hdd', 'cdd')} FROM state_daily")
def p12(t):
    return cal.degree_days(t.state_daily.select("state", "date", "temperature_f"))


@query("p13_week_ending", """SELECT CAST(CAST(l_shipdate AS DATE) + CAST((12 - isodow(l_shipdate)) % 7 AS INTEGER) AS TIMESTAMP) AS date, count(*) AS n,
  count(DISTINCT l_shipdate) AS days FROM lineitem GROUP BY 1""")
def p13(t):
    return t.raw("lineitem").groupBy(cal.week_ending_friday("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_shipdate").alias("days")
    )


@query("p14_calendar_features", f"""SELECT duoarea, {d('date')}, {r('sin(2*pi()*week_of_year/52.0) AS week_sin', 'cos(2*pi()*week_of_year/52.0) AS week_cos',
  'sin(2*pi()*month/12.0) AS month_sin', 'cos(2*pi()*month/12.0) AS month_cos')}, CAST(month BETWEEN 4 AND 10 AS INTEGER) AS is_injection_season,
  CAST(month NOT BETWEEN 4 AND 10 AS INTEGER) AS is_withdrawal_season, CAST(month IN (4, 5, 9, 10) AS INTEGER) AS is_shoulder_month FROM wk_storage""")
def p14(t):
    return cal.add_calendar_features(t.wk_storage.select("duoarea", "date", "week_of_year")).drop("week_of_year")


@query("p15_fourier_features", f"SELECT duoarea, {d('date')}, " + r(*[f"{f}(2*pi()*{k}*week_of_year/52.0) AS {f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")]) + " FROM wk_storage")
def p15(t):
    return cal.add_fourier(t.wk_storage.select("duoarea", "date", "week_of_year"), 3).drop("week_of_year")


@query("p17_horizon_bucket", """SELECT component, CASE WHEN h BETWEEN 1 AND 24 THEN 'h001_024' WHEN h <= 72 THEN 'h025_072' ELSE 'h073_168' END AS horizon_bucket, count(*) AS n
  FROM (SELECT component, CAST(date_diff('minute', issued_at, valid_at) / 60 AS INTEGER) AS h FROM power_vintages) GROUP BY 1, 2""")
def p17(t):
    h = cal.hours_between("valid_at", "issued_at")
    return t.power_vintages.groupBy("component", cal.horizon_bucket(h).alias("horizon_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("p22_training_lookback", f"SELECT duoarea, {d('date')}, {r('weekly_change_bcf')} FROM (SELECT *, max(year) OVER (PARTITION BY duoarea) AS y FROM wk_storage) WHERE year >= y - 2")
def p22(t):
    return ft.training_lookback(t.wk_storage, 3).select("duoarea", "date", "weekly_change_bcf")


@query("p24_wide_to_long", f"SELECT duoarea, metric, {r('value')} FROM (UNPIVOT (SELECT duoarea, avg(abs(weekly_change_bcf)) AS mae, sqrt(avg(weekly_change_bcf*weekly_change_bcf)) AS rmse FROM wk_storage GROUP BY 1) ON mae, rmse INTO NAME metric VALUE value)")
def p24(t):
    x = F.col("weekly_change_bcf")
    wide = t.wk_storage.groupBy("duoarea").agg(F.avg(F.abs(x)).alias("mae"), F.sqrt(F.avg(x * x)).alias("rmse"))
    return wide.unpivot(["duoarea"], ["mae", "rmse"], "metric", "value")


@query("p25_trailing_years", f"SELECT duoarea, {d('date')}, {r('storage_bcf')} FROM wk_storage WHERE date >= (SELECT max(date) FROM wk_storage) - INTERVAL 24 MONTH")
def p25(t):
    return ft.trailing_years(t.wk_storage.select("duoarea", "date", "storage_bcf"), 2)


@query("p26_input_precedence", f"""WITH prof AS (SELECT duoarea, week_of_year, avg(hdd) AS hdd FROM (SELECT *, CAST(weekofyear(date) AS INTEGER) AS week_of_year FROM wk_weather) GROUP BY 1, 2),
  al AS (SELECT duoarea, avg(hdd) AS hdd FROM prof GROUP BY 1)
  SELECT s.duoarea, {d('s.date')}, {r('coalesce(w.hdd, p.hdd, a.hdd, 0.0) AS hdd')}, CASE WHEN w.hdd IS NOT NULL THEN 'observed' ELSE 'seasonal' END AS source
  FROM wk_storage s LEFT JOIN wk_weather w USING (duoarea, date) LEFT JOIN prof p ON p.duoarea = s.duoarea AND p.week_of_year = s.week_of_year LEFT JOIN al a ON a.duoarea = s.duoarea""")
def p26(t):
    profile = rollups.seasonal_profile(t.wk_weather.withColumn("week_of_year", F.weekofyear("date")), ["hdd"])
    overall = profile.groupBy("duoarea").agg(F.max("hdd_overall").alias("hdd_overall"))
    profile = profile.drop("hdd_overall").withColumnRenamed("hdd", "hdd_profile")
    rows = t.wk_storage.select("duoarea", "date", "week_of_year").join(t.wk_weather.select("duoarea", "date", "hdd"), ["duoarea", "date"], "left")
    rows = rows.join(profile, ["duoarea", "week_of_year"], "left").join(overall, "duoarea", "left")
    return rows.select(
        "duoarea", "date", F.coalesce("hdd", "hdd_profile", "hdd_overall", F.lit(0.0)).alias("hdd"),
        F.when(F.col("hdd").isNotNull(), "observed").otherwise("seasonal").alias("source"),
    )


@query("p27_regional_locations", f"SELECT duoarea, state, {r('weather_weight AS weight')} FROM state_weights")
def p27(t):
    located = dimensions.population_locations(t.nations.select("state", "population"))
    return dimensions.regional_locations(located, t.nations).select("duoarea", "state", "weight")


@query("w01_weekly_change", f"SELECT duoarea, {d('period')}, {r('value - lag(value) OVER (PARTITION BY duoarea ORDER BY period) AS weekly_change_bcf')} FROM storage_raw")
def w01(t):
    return ft.weekly_change(t.storage_raw).select("duoarea", "period", "weekly_change_bcf")


@query("w02_lags", f"SELECT duoarea, {d('date')}, {r(*[f'{lag('storage_bcf', k)} AS lag{k}' for k in (1, 4, 52, 53)])} FROM wk_storage")
def w02(t):
    w = ft.series_window()
    return t.wk_storage.select("duoarea", "date", *[F.lag("storage_bcf", k).over(w).alias(f"lag{k}") for k in (1, 4, 52, 53)])


@query("w03_strict_prior_mean", f"SELECT duoarea, {d('date')}, {r(*[f'{strict('weekly_change_bcf', n)} AS mean{n}' for n in (4, 8)])} FROM wk_storage")
def w03(t):
    w = ft.series_window()
    return t.wk_storage.select("duoarea", "date", *[ft.prior_mean("weekly_change_bcf", w, n).alias(f"mean{n}") for n in (4, 8)])


_SAME = "avg(storage_bcf) OVER (PARTITION BY duoarea, week_of_year ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query("w04_same_week_prior_mean", f"SELECT duoarea, {d('date')}, {r(f'{_SAME} AS storage_5yr_avg')} FROM wk_storage")
def w04(t):
    return t.wk_storage.select("duoarea", "date", ft.same_week_prior_mean("storage_bcf").alias("storage_5yr_avg"))


_WEATHER = [f"{x}/weather_days AS {x}_per_day" for x in ("hdd", "cdd")] + [f"{lag(x, k)} AS {x}_lag{k}" for x in ("hdd", "cdd") for k in (1, 4)] + [
    f"{strict(x, n)} AS {x}_rolling_{n}wk" for x in ("hdd", "cdd") for n in (4, 8)] + [f"{x} - {strict(x, 4)} AS {x}_vs_4wk_avg" for x in ("hdd", "cdd")]


@query("w05_weather_features", f"SELECT duoarea, {d('date')}, {r(*_WEATHER)} FROM wk_weather")
def w05(t):
    return ft.add_weather_features(t.wk_weather).select("duoarea", "date", *ft.WEATHER_FEATURES)


_STORAGE = [f"{lag('weekly_change_bcf', k)} AS weekly_change_lag{k}" for k in (1, 4)] + [
    f"{strict('weekly_change_bcf', n)} AS weekly_change_rolling_{n}wk" for n in (4, 8)] + [
    f"{lag('storage_bcf', 52)} AS storage_bcf_lag52", f"{lag('storage_bcf', 1)} - {lag('storage_bcf', 53)} AS storage_vs_last_year",
    "storage_5yr_avg AS storage_5yr_avg", f"{lag('storage_bcf', 1)} - {lag('storage_5yr_avg', 1)} AS storage_vs_5yr_avg",
    f"{lag('weekly_change_bcf', 1)} - {lag('weekly_change_bcf', 53)} AS weekly_change_yoy"]


@query("w06_storage_features", f"SELECT duoarea, {d('date')}, {r(*_STORAGE)} FROM (SELECT *, {_SAME} AS storage_5yr_avg FROM wk_storage)")
def w06(t):
    return ft.add_storage_features(t.wk_storage).select("duoarea", "date", *ft.STORAGE_FEATURES)


FEATURE_CTE = f"""joined AS (SELECT s.*, w.temperature_f, w.hdd, w.cdd, w.weather_days FROM wk_storage s JOIN wk_weather w USING (duoarea, date)),
  avg5 AS (SELECT *, {_SAME} AS storage_5yr_avg FROM joined)"""
_ALL = _WEATHER + _STORAGE
_CALENDAR = ["sin(2*pi()*week_of_year/52.0) AS week_sin", "cos(2*pi()*week_of_year/52.0) AS week_cos", "sin(2*pi()*month/12.0) AS month_sin", "cos(2*pi()*month/12.0) AS month_cos"]


@query("w07_weekly_model_features", f"""WITH {FEATURE_CTE} SELECT duoarea, {d('date')}, year, month, week_of_year, weather_days,
  {r('storage_bcf', 'weekly_change_bcf', 'temperature_f', 'hdd', 'cdd', f'{lag("storage_bcf", 1)} AS storage_bcf_lag1', *_CALENDAR, *_ALL)},
  CAST(month BETWEEN 4 AND 10 AS INTEGER) AS is_injection_season, CAST(month NOT BETWEEN 4 AND 10 AS INTEGER) AS is_withdrawal_season,
  CAST(month IN (4, 5, 9, 10) AS INTEGER) AS is_shoulder_month FROM avg5""")
def w07(t):
    return ft.weekly_model_features(t.wk_storage, t.wk_weather)


_SPARSE = "CASE WHEN weather_days >= 3 THEN temperature_f END"


@query("w08_forward_fill", f"SELECT duoarea, {d('date')}, {r(f'last_value({_SPARSE} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled')} FROM wk_weather")
def w08(t):
    sparse = t.wk_weather.withColumn("x", F.when(F.col("weather_days") >= 3, F.col("temperature_f")))
    return sparse.select("duoarea", "date", ft.forward_fill("x", ["duoarea"], "date").alias("filled"))


@query("w10_centered_norm", f"""WITH b AS (SELECT s.*, coalesce(w.hdd, 0.0) - coalesce(w.cdd, 0.0) + s.weekly_change_bcf AS local_balance FROM wk_storage s LEFT JOIN wk_weather w USING (duoarea, date)),
  n AS (SELECT *, avg(local_balance) OVER (PARTITION BY duoarea, week_of_year ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS norm FROM b)
  SELECT duoarea, {d('date')}, {r('norm AS seasonal_balance_norm', 'local_balance - norm AS market_tightness')} FROM n""")
def w10(t):
    return ft.tightness(_balance(t)).select("duoarea", "date", "seasonal_balance_norm", "market_tightness")


def _balance(t):
    joined = t.wk_storage.join(t.wk_weather.select("duoarea", "date", "hdd", "cdd"), ["duoarea", "date"], "left")
    return joined.withColumn("local_balance", F.coalesce("hdd", F.lit(0.0)) - F.coalesce("cdd", F.lit(0.0)) + F.col("weekly_change_bcf"))


@query("w11_trailing_trend", f"""WITH b AS (SELECT s.*, coalesce(w.hdd, 0.0) - coalesce(w.cdd, 0.0) + s.weekly_change_bcf AS local_balance FROM wk_storage s LEFT JOIN wk_weather w USING (duoarea, date)),
  n AS (SELECT *, local_balance - avg(local_balance) OVER (PARTITION BY duoarea, week_of_year ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mt FROM b)
  SELECT duoarea, {d('date')}, {r(f'avg(mt) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS market_tightness_rolling',
  f'avg(local_balance - weekly_change_bcf) OVER ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS net_border_flows_rolling')} FROM n""")
def w11(t):
    return ft.tightness(_balance(t)).select("duoarea", "date", "market_tightness_rolling", "net_border_flows_rolling")


@query("f04_tightness_and_border_flow", f"""WITH b AS (SELECT s.*, coalesce(w.hdd, 0.0) - coalesce(w.cdd, 0.0) + s.weekly_change_bcf AS local_balance FROM wk_storage s LEFT JOIN wk_weather w USING (duoarea, date))
  SELECT duoarea, {d('date')}, {r('local_balance - avg(local_balance) OVER (PARTITION BY duoarea, week_of_year ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS market_tightness',
  'local_balance - weekly_change_bcf AS net_border_flows')} FROM b""")
def f04(t):
    return ft.tightness(_balance(t)).select("duoarea", "date", "market_tightness", "net_border_flows")


@query("w12_cumulative_deviation", f"""WITH y AS (SELECT *, max(year) OVER (PARTITION BY duoarea) AS ny FROM wk_storage),
  p AS (SELECT duoarea, week_of_year, avg(m) AS a FROM (SELECT duoarea, year, week_of_year, avg(weekly_change_bcf) AS m FROM y WHERE year < ny AND year >= ny - 5 GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT y.duoarea, {d('date')}, {r('sum(weekly_change_bcf - a) OVER (PARTITION BY y.duoarea ORDER BY date) AS cumulative_deviation')} FROM y LEFT JOIN p ON p.duoarea = y.duoarea AND p.week_of_year = y.week_of_year WHERE year = ny""")
def w12(t):
    profile = rollups.year_week_profile(t.wk_storage, "weekly_change_bcf").select("duoarea", "week_of_year", "avg_value")
    current = ft.training_lookback(t.wk_storage, 1).join(profile, ["duoarea", "week_of_year"], "left")
    running = ft.series_window().rowsBetween(W.unboundedPreceding, 0)
    return current.select("duoarea", "date", F.sum(F.col("weekly_change_bcf") - F.col("avg_value")).over(running).alias("cumulative_deviation"))


@query("w13_plain_rolling_mean", f"""SELECT duoarea, {d('date')}, {r(f'CASE WHEN count(weekly_change_bcf) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN avg(weekly_change_bcf) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS mean4')} FROM wk_storage""")
def w13(t):
    return t.wk_storage.select("duoarea", "date", ft.strict_mean("weekly_change_bcf", ft.series_window().rowsBetween(-3, 0), 4).alias("mean4"))


@query("w19_interpolation", f"""WITH k AS (SELECT period, avg(value) AS v, CAST(period - DATE '1970-01-01' AS DOUBLE) + day(last_day(period)) / 2.0 AS x FROM (SELECT CAST(date_trunc('month', period) AS DATE) AS period, value FROM daily_price) GROUP BY 1),
  w AS (SELECT DISTINCT date, CAST(date - DATE '1970-01-01' AS DOUBLE) AS x FROM wk_storage),
  b AS (SELECT w.date, w.x, max(k.x) FILTER (k.x <= w.x) AS bx, min(k.x) FILTER (k.x >= w.x) AS ax FROM w, k GROUP BY 1, 2)
  SELECT {d('date')}, {r('CASE WHEN bx IS NULL THEN ka.v WHEN ax IS NULL OR ax = bx THEN kb.v ELSE kb.v + (ka.v - kb.v) * (b.x - bx) / (ax - bx) END AS value')}
  FROM b LEFT JOIN k kb ON kb.x = bx LEFT JOIN k ka ON ka.x = ax""")
def w19(t):
    months = rollups.monthly(t.daily_price, "period", means=["value"])
    epoch = F.lit("1970-01-01").cast("date")
    knots = months.select(F.lit("all").alias("g"), (F.datediff("period", epoch) + F.day(F.last_day("period")) / 2.0).alias("x"), "value")
    weeks = t.wk_storage.select("date").distinct().select(F.lit("all").alias("g"), "date", F.datediff("date", epoch).cast("double").alias("x"))
    return ft.interpolate_at(weeks, knots, ["g"], "x", ["value"]).select("date", "value")


@query("w20_latest_vs_previous", f"""SELECT duoarea, {d('date')}, {r('weekly_change_bcf', 'd AS change_delta')} FROM (SELECT *, weekly_change_bcf - {lag('weekly_change_bcf', 1)} AS d,
  row_number() OVER (PARTITION BY duoarea ORDER BY date DESC) AS rn FROM wk_storage) WHERE rn = 1""")
def w20(t):
    delta = t.wk_storage.withColumn("change_delta", F.col("weekly_change_bcf") - F.lag("weekly_change_bcf").over(ft.series_window()))
    latest = delta.groupBy("duoarea").agg(F.max(F.struct("date", "weekly_change_bcf", "change_delta")).alias("v"))
    return latest.select("duoarea", "v.*")


@query("w21_last_change_before", f"SELECT duoarea, {d('date')}, {r(f'last_value({_SPARSE} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known')} FROM wk_weather")
def w21(t):
    sparse = t.wk_weather.withColumn("x", F.when(F.col("weather_days") >= 3, F.col("temperature_f")))
    return sparse.select("duoarea", "date", ft.last_known_before("x", ["duoarea"], "date").alias("last_known"))


@query("t01_last_n_rows", f"SELECT duoarea, {d('date')}, {r('storage_bcf')} FROM (SELECT *, row_number() OVER (PARTITION BY duoarea ORDER BY date DESC) AS rn FROM wk_storage) WHERE rn <= 26")
def t01(t):
    return ft.last_n_rows(t.wk_storage.select("duoarea", "date", "storage_bcf"), 26, ["duoarea"])


@query("t02_keep_last", f"SELECT entity, valid_at, issued_at, {r('value')} FROM (SELECT *, row_number() OVER (PARTITION BY entity, valid_at ORDER BY issued_at DESC, value DESC) AS rn FROM vintages) WHERE rn = 1")
def t02(t):
    return keep_latest(t.vintages.select("entity", "valid_at", "issued_at", "value"), ["entity", "valid_at"], ["issued_at"])


@query("t05_canonical_order", f"SELECT duoarea, {d('date')}, {r('storage_bcf')} FROM wk_storage ORDER BY duoarea, date")
def t05(t):
    return t.wk_storage.select("duoarea", "date", "storage_bcf").orderBy("duoarea", "date")


@query("u01_union_by_name", f"SELECT duoarea, {d('date')}, {r('temperature_f')}, source FROM (SELECT duoarea, date, temperature_f, 'region' AS source FROM region_daily UNION ALL SELECT duoarea, date, temperature_f, 'state' FROM state_daily)")
def u01(t):
    a = t.region_daily.select("duoarea", "date", "temperature_f").withColumn("source", F.lit("region"))
    b = t.state_daily.select("temperature_f", "date", "duoarea").withColumn("source", F.lit("state"))
    return a.unionByName(b)


@query("u02_difference", "SELECT duoarea, CAST(date AS TIMESTAMP) AS date FROM (SELECT DISTINCT duoarea, date FROM wk_storage EXCEPT SELECT duoarea, date FROM wk_weather)")
def u02(t):
    return t.wk_storage.select("duoarea", "date").distinct().join(t.wk_weather, ["duoarea", "date"], "left_anti")


@query("u03_set_equality", """SELECT (SELECT count(*) FROM (SELECT state FROM nations EXCEPT SELECT state FROM state_daily)) AS missing,
  (SELECT count(*) FROM (SELECT state FROM state_daily EXCEPT SELECT state FROM nations)) AS unexpected""")
def u03(t):
    have, want = t.state_daily.select("state").distinct(), t.nations.select("state")
    missing = want.join(have, "state", "left_anti").select(F.lit("missing").alias("side"))
    unexpected = have.join(want, "state", "left_anti").select(F.lit("unexpected").alias("side"))
    return missing.union(unexpected).agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "unexpected").alias("unexpected"))


@query("s23_content_hash")
def s23(t):
    return frame_hash(t.wk_storage, "duoarea")


@query("x01_scalar_strings", """SELECT component, count(*) AS n FROM (SELECT CASE WHEN series LIKE 'N3010%' THEN 'res' WHEN series LIKE 'N3020%' THEN 'com' WHEN series LIKE 'N3035%' THEN 'ind'
  WHEN series LIKE 'N3045%' THEN 'power_burn' WHEN series LIKE 'N3050%' THEN 'price' WHEN series LIKE 'N9050%' THEN 'marketed_production' WHEN series LIKE 'NA1160_S%' THEN 'dry_production' END AS component
  FROM monthly_series) GROUP BY 1""")
def x01(t):
    from pitcast.operators.disaggregate import component_of

    return t.monthly_series.groupBy(component_of(F.col("series")).alias("component")).agg(F.count(F.lit(1)).alias("n"))
