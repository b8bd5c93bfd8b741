"""Hourly power queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitcast.functions.calendar import add_hourly_features, hour_of_week
from pitcast.operators import metrics, power, rollups
from pitcast.operators.intervals import bucket_bounds
from pitcast.plans import jobs
from pitcast.plans.queries_asof import WEATHER_SQL, weather_vintages
from pitcast.plans.registry import query, r, sql_linear, sql_pred
from pitcast.session import staged

ORIGIN = "2024-01-24 00:00:00"
_LOCAL = "((({0})::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago')"


def _local(c: str) -> str:
    return _LOCAL.format(c)


def _how(c: str) -> str:
    return f"((isodow({_local(c)}) - 1) * 24 + hour({_local(c)}))"


def _at(stamp: str = ORIGIN):
    return F.lit(stamp).cast("timestamp")


def _bucket(h: str) -> str:
    return f"CASE WHEN {h} BETWEEN 1 AND 24 THEN 'h001_024' WHEN {h} BETWEEN 25 AND 72 THEN 'h025_072' WHEN {h} BETWEEN 73 AND 168 THEN 'h073_168' END"


# Component history: realized values override, horizons of 1 to 168 hours, recent error per origin.
HIST = f"""h0 AS (SELECT v.component, v.issued_at AS forecast_origin, v.valid_at AS delivery_hour, v.retrieved_at, v.baseline_mw, coalesce(a.actual_mw, v.actual_mw) AS actual_mw,
  CAST(date_diff('minute', v.issued_at, v.valid_at) / 60 AS INTEGER) AS horizon_hour FROM power_vintages v LEFT JOIN power_actuals a USING (component, valid_at)),
  h1 AS (SELECT *, {_bucket('horizon_hour')} AS horizon_bucket FROM h0 WHERE horizon_hour BETWEEN 1 AND 168)"""


def recent_sql(origins: str) -> str:
    return f"""kn AS (SELECT o.component, o.forecast_origin AS asked, h.delivery_hour, h.actual_mw - h.baseline_mw AS e FROM ({origins}) o JOIN h1 h ON h.component = o.component AND h.forecast_origin < o.forecast_origin AND h.delivery_hour < o.forecast_origin
  AND h.retrieved_at <= o.forecast_origin AND h.actual_mw IS NOT NULL AND h.baseline_mw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o.component, o.forecast_origin, h.delivery_hour ORDER BY h.forecast_origin DESC) = 1),
  re AS (SELECT component, asked AS forecast_origin, avg(e) AS recent_error_mw FROM (SELECT *, row_number() OVER (PARTITION BY component, asked ORDER BY delivery_hour DESC) AS rn FROM kn) WHERE rn <= 24 GROUP BY 1, 2)"""


_ALL_ORIGINS = "SELECT DISTINCT component, forecast_origin FROM h1"


@query("p16_hourly_features", f"""SELECT component, issued_at AS forecast_origin, valid_at AS delivery_hour, CAST(date_diff('minute', issued_at, valid_at) / 60 AS INTEGER) AS horizon_hour,
  {r(f"sin(2*pi()*hour({_local('valid_at')})/24.0) AS hour_sin", f"cos(2*pi()*hour({_local('valid_at')})/24.0) AS hour_cos", f"sin(2*pi()*(isodow({_local('valid_at')})-1)/7.0) AS dow_sin", f"cos(2*pi()*(isodow({_local('valid_at')})-1)/7.0) AS dow_cos")},
  {_bucket('CAST(date_diff(\'minute\', issued_at, valid_at) / 60 AS INTEGER)')} AS horizon_bucket FROM power_vintages""")
def p16(t):
    df = t.power_vintages.select("component", F.col("issued_at").alias("forecast_origin"), F.col("valid_at").alias("delivery_hour"))
    return add_hourly_features(df).drop("recent_error_mw")


def _profile_sql(origin: str = ORIGIN) -> str:
    return f"""hk AS (SELECT component, valid_at, mw, {_how('valid_at')} AS how FROM hours WHERE valid_at < TIMESTAMP '{origin}'), pf AS (SELECT component, how, avg(mw) AS p FROM hk GROUP BY 1, 2),
  lv AS (SELECT component, avg(mw) AS m, avg(CASE WHEN rn <= 24 THEN mw - p END) AS adj FROM (SELECT hk.component, mw, p, row_number() OVER (PARTITION BY hk.component ORDER BY valid_at DESC) AS rn FROM hk JOIN pf USING (component, how)) GROUP BY 1)"""


@query("a07_hour_of_week_forecast", f"""WITH {_profile_sql()}, tg AS (SELECT component, valid_at AS delivery_hour, {_how('valid_at')} AS how FROM hours WHERE valid_at >= TIMESTAMP '{ORIGIN}')
  SELECT component, delivery_hour, {r('greatest(coalesce(p, m) + adj, 0.0) AS profile_forecast_mw')}, 'hour_of_week_adjusted' AS profile_source FROM tg LEFT JOIN pf USING (component, how) JOIN lv USING (component)""")
def a07(t):
    targets = t.hours.where(F.col("valid_at") >= _at()).select("component", F.col("valid_at").alias("delivery_hour"))
    return rollups.hour_of_week_forecast(t.hours, targets, "mw", ["component"], _at())


@query("a07_hour_of_week_profile", f"SELECT component, CAST({_how('valid_at')} AS INTEGER) AS hour_of_week, {r('avg(mw) AS profile_mw')} FROM hours GROUP BY component, {_how('valid_at')}")
def a07_profile(t):
    return t.hours.groupBy("component", hour_of_week("valid_at").alias("hour_of_week")).agg(F.avg("mw").alias("profile_mw"))


@query("m16_fill_missing_baseline", f"""WITH {_profile_sql()}, tg AS (SELECT component, valid_at AS delivery_hour, {_how('valid_at')} AS how, CASE WHEN day(valid_at) % 2 = 0 THEN mw END AS b FROM hours WHERE valid_at >= TIMESTAMP '{ORIGIN}')
  SELECT component, delivery_hour, {r('coalesce(b, greatest(coalesce(p, m) + adj, 0.0)) AS baseline_mw')}, CASE WHEN b IS NULL THEN 'fallback_hour_of_week_adjusted' ELSE 'ercot' END AS baseline_source FROM tg LEFT JOIN pf USING (component, how) JOIN lv USING (component)""")
def m16(t):
    targets = t.hours.where(F.col("valid_at") >= _at()).select(
        "component", F.col("valid_at").alias("delivery_hour"), F.when(F.day("valid_at") % 2 == 0, F.col("mw")).alias("baseline_mw")
    )
    return rollups.fill_missing_baseline(targets, t.hours, "mw", ["component"], _at())


@query("a08_hourly_pivot", f"SELECT valid_at, {r(*[f"sum(mw) FILTER (component = '{c}') AS {c}" for c in ('load', 'wind', 'solar', 'gas', 'coal')])} FROM hours GROUP BY 1")
def a08(t):
    return rollups.pivot_sum(t.hours, ["valid_at"], "component", ["load", "wind", "solar", "gas", "coal"], "mw")


@query("a08_last_non_null", f"SELECT date_trunc('day', valid_at) AS day, {r('last(gas_mw ORDER BY valid_at) FILTER (gas_mw IS NOT NULL) AS gas_mw', 'last(coal_mw ORDER BY valid_at) FILTER (coal_mw IS NOT NULL) AS coal_mw')} FROM fuel_hours GROUP BY 1")
def a08_last(t):
    return rollups.last_per_hour(t.fuel_hours.withColumn("day", F.date_trunc("day", "valid_at")), ["day"], "valid_at")


@query("a09_duplicate_vintage_sum", f"SELECT component, valid_at, {r('sum(baseline_mw) AS baseline_mw', 'sum(actual_mw) AS actual_mw')} FROM power_vintages GROUP BY 1, 2")
def a09(t):
    return t.power_vintages.groupBy("component", "valid_at").agg(F.sum("baseline_mw").alias("baseline_mw"), F.sum("actual_mw").alias("actual_mw"))


@query("a20_local_day_totals", f"SELECT component, CAST({_local('valid_at')}::DATE AS TIMESTAMP) AS date_ct, {r('sum(mw) AS mw')} FROM hours GROUP BY 1, 2")
def a20(t):
    return rollups.local_day_totals(t.hours, ["mw"], "valid_at", ["component"])


_W14 = "CASE WHEN count(s) OVER w >= 24 THEN avg(s) OVER w END"
_SHARE = f"""sh AS (SELECT valid_at, gas_mw, gas_mw + coal_mw AS dd, CASE WHEN gas_mw + coal_mw > 0 THEN gas_mw / (gas_mw + coal_mw) END AS s FROM fuel_hours WHERE gas_mw IS NOT NULL AND coal_mw IS NOT NULL AND {{}}),
  tr AS (SELECT *, {_W14} AS t FROM sh WINDOW w AS (ORDER BY valid_at ROWS BETWEEN 719 PRECEDING AND CURRENT ROW)),
  rs AS (SELECT horizon_bucket, valid_at, abs(gas_mw - dd * l) AS e FROM (SELECT valid_at, gas_mw, dd, 'h001_024' AS horizon_bucket, lag(t, 12) OVER (ORDER BY valid_at) AS l FROM tr UNION ALL SELECT valid_at, gas_mw, dd, 'h025_072', lag(t, 48) OVER (ORDER BY valid_at) FROM tr
   UNION ALL SELECT valid_at, gas_mw, dd, 'h073_168', lag(t, 120) OVER (ORDER BY valid_at) FROM tr) WHERE l IS NOT NULL)"""


@query("w14_rolling_share", f"WITH {_SHARE.format('true')} SELECT horizon_bucket, valid_at, {r('e AS abs_error')} FROM rs")
def w14(t):
    return power.share_residuals(t.fuel_hours)


@query("w15_recent_error", f"WITH {HIST}, {recent_sql(_ALL_ORIGINS)} SELECT component, forecast_origin, {r('recent_error_mw')} FROM re")
def w15(t):
    data = staged(power.realized_history(t.power_vintages, t.power_actuals), "history")
    return power.recent_error(data, data.select("component", "forecast_origin").distinct())


_E11 = f"WITH {HIST}, {recent_sql(_ALL_ORIGINS)}"


@query("e11_power_history", f"""{_E11}, {WEATHER_SQL} SELECT component, forecast_origin, delivery_hour, horizon_hour, horizon_bucket, {r('baseline_mw', 'actual_mw', 'coalesce(recent_error_mw, 0.0) AS recent_error_mw', 'temperature_f')} FROM (
  SELECT h.*, w.temperature_f, row_number() OVER (PARTITION BY h.component, h.forecast_origin, h.delivery_hour ORDER BY w.issued_at DESC NULLS LAST) AS rn FROM h1 h LEFT JOIN wv w ON w.valid_at = h.delivery_hour AND w.issued_at <= h.forecast_origin AND w.retrieved_at <= h.forecast_origin) LEFT JOIN re USING (component, forecast_origin) WHERE rn = 1""")
def e11(t):
    out = jobs.power_history(t.power_vintages, t.power_actuals, weather_vintages(t))
    return out.select("component", "forecast_origin", "delivery_hour", "horizon_hour", "horizon_bucket", "baseline_mw", "actual_mw", "recent_error_mw", "temperature_f")


CF = ["baseline_mw", "horizon_hour", "recent_error_mw"]


def _folds_sql(known: str = "true") -> str:
    return f"""{_E11}, hh AS (SELECT h1.*, coalesce(recent_error_mw, 0.0) AS recent_error_mw, actual_mw - baseline_mw AS yy FROM h1 LEFT JOIN re USING (component, forecast_origin) WHERE actual_mw IS NOT NULL AND baseline_mw IS NOT NULL AND {known}),
  os AS (SELECT component, forecast_origin AS asked FROM (SELECT component, forecast_origin, row_number() OVER (PARTITION BY component ORDER BY forecast_origin) AS i, count(*) OVER (PARTITION BY component) AS n FROM (SELECT DISTINCT component, forecast_origin FROM hh)) WHERE n >= 4 AND i > greatest(2, ceil(n * 0.6))),
  tr AS (SELECT os.asked, hh.* FROM os JOIN hh ON hh.component = os.component AND hh.forecast_origin < os.asked AND hh.delivery_hour < os.asked AND hh.retrieved_at <= os.asked), {sql_linear('cf', 'tr', ['component', 'asked'], CF, 'yy', 10.0)},
  rp AS (SELECT hh.component, hh.forecast_origin, delivery_hour, horizon_bucket, baseline_mw, actual_mw, b.n AS n_train, baseline_mw + {sql_pred('b', CF)} AS corrected_mw FROM hh JOIN cf_b b ON b.component = hh.component AND b.asked = hh.forecast_origin WHERE b.n >= 100)"""


_FOLDS = _folds_sql()


def _rolling(t):
    return power.rolling_corrections(power.component_history(t.power_vintages, t.power_actuals), CF)


@query("b12_rolling_correction_folds", f"{_FOLDS} SELECT component, forecast_origin, delivery_hour, horizon_bucket, {r('baseline_mw', 'actual_mw', 'corrected_mw')}, n_train FROM rp")
def b12(t):
    return _rolling(t)


_CMP = "SELECT component, CASE WHEN grouping(horizon_bucket) = 1 THEN 'overall' ELSE horizon_bucket END AS horizon_bucket, avg(abs(actual_mw - baseline_mw)) AS baseline_mae, avg(abs(actual_mw - corrected_mw)) AS corrected_mae, count(*) AS n_samples FROM rp GROUP BY GROUPING SETS ((component, horizon_bucket), (component))"


@query("a19_bucket_comparison", f"{_FOLDS} SELECT component, horizon_bucket, {r('baseline_mae', 'corrected_mae')}, n_samples FROM ({_CMP})")
def a19(t):
    return metrics.bucket_comparison(_rolling(t), ["component"])


@query("m14_correction_promotion", f"""{_FOLDS} SELECT component, {r("max(CASE WHEN horizon_bucket = 'overall' THEN corrected_mae END) AS corrected_mae", "max(CASE WHEN horizon_bucket = 'overall' THEN baseline_mae END) AS baseline_mae")},
  bool_and(CASE WHEN horizon_bucket = 'overall' THEN corrected_mae < baseline_mae ELSE corrected_mae <= baseline_mae * 1.05 END) AS promoted, 'ridge' AS model_name FROM ({_CMP}) GROUP BY 1""")
def m14(t):
    return power.promotion(_rolling(t))


_GATE = f"""cm AS ({_CMP}), gt AS (SELECT component, bool_and(CASE WHEN horizon_bucket = 'overall' THEN corrected_mae < baseline_mae ELSE corrected_mae <= baseline_mae * 1.05 END) AS promoted FROM cm GROUP BY 1),
  pv AS (SELECT component, forecast_origin, delivery_hour, horizon_bucket, baseline_mw, actual_mw, corrected_mw, true AS promoted FROM rp JOIN gt USING (component) WHERE gt.promoted
   UNION ALL SELECT hh.component, hh.forecast_origin, delivery_hour, horizon_bucket, baseline_mw, actual_mw, baseline_mw, false FROM hh JOIN os ON os.component = hh.component AND os.asked = hh.forecast_origin
   WHERE hh.component NOT IN (SELECT component FROM gt WHERE promoted))"""
_KNOWN_AT = "h1.forecast_origin < {0} AND delivery_hour < {0} AND retrieved_at <= {0}"
_PUBLISHED = f"{_folds_sql(_KNOWN_AT.format(f"TIMESTAMP '{ORIGIN}'"))}, {_GATE}"


@query("b11_power_backtest", f"""{_folds_sql(_KNOWN_AT.format("(SELECT max(x.forecast_origin) FROM h1 x WHERE x.component = h1.component)"))}, {_GATE},
  ka AS (SELECT o.component, o.asked, h.delivery_hour, h.actual_mw, {_how('h.delivery_hour')} AS how FROM (SELECT DISTINCT component, forecast_origin AS asked FROM pv) o JOIN h1 h ON h.component = o.component AND h.forecast_origin < o.asked AND h.delivery_hour < o.asked
    AND h.retrieved_at <= o.asked AND h.actual_mw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o.component, o.asked, h.delivery_hour ORDER BY h.forecast_origin DESC) = 1),
  kp AS (SELECT component, asked, how, avg(actual_mw) AS p FROM ka GROUP BY 1, 2, 3),
  kl AS (SELECT component, asked, avg(actual_mw) AS m, avg(CASE WHEN rn <= 24 THEN actual_mw - p END) AS adj FROM (SELECT ka.*, p, row_number() OVER (PARTITION BY component, asked ORDER BY delivery_hour DESC) AS rn FROM ka JOIN kp USING (component, asked, how)) GROUP BY 1, 2),
  fb AS (SELECT pv.*, coalesce(greatest(coalesce(p, m) + adj, 0.0), baseline_mw) AS fallback_mw FROM pv LEFT JOIN kp ON kp.component = pv.component AND kp.asked = pv.forecast_origin AND kp.how = {_how('delivery_hour')} LEFT JOIN kl ON kl.component = pv.component AND kl.asked = pv.forecast_origin),
  lg AS (SELECT component, horizon_bucket, actual_mw, 'ercot_baseline' AS model, baseline_mw AS p, false AS promoted FROM fb UNION ALL SELECT component, horizon_bucket, actual_mw, 'hour_of_week_fallback', fallback_mw, false FROM fb UNION ALL SELECT component, horizon_bucket, actual_mw, 'ridge', corrected_mw, true FROM fb WHERE promoted)
  SELECT component, horizon_bucket, model, promoted, {r('avg(abs(actual_mw - p)) AS mae', 'sqrt(avg((actual_mw - p) ** 2)) AS rmse', 'avg(actual_mw - p) AS bias')}, count(*) AS n_samples FROM lg GROUP BY 1, 2, 3, 4""")
def b11(t):
    return power.backtest(power.component_history(t.power_vintages, t.power_actuals), CF)[1]


_NET = "nl AS (SELECT forecast_origin, delivery_hour, horizon_bucket, abs(sum(CASE WHEN component = 'load' THEN actual_mw - corrected_mw ELSE corrected_mw - actual_mw END)) AS e FROM {0} GROUP BY 1, 2, 3 HAVING count(DISTINCT component) = 3)"
_RAD = "list_sort(list(e))[CAST(least(count(*), ceil((count(*) + 1) * 0.8)) AS INTEGER)]"


@query("j17_three_way_inner", f"{_FOLDS}, {_NET.format('rp')} SELECT forecast_origin, delivery_hour, horizon_bucket, {r('e AS abs_error')} FROM nl")
def j17(t):
    return power.net_load_errors(_rolling(t))


@query("w18_bucket_radius", f"""{_PUBLISHED}, {sql_linear('fin', 'hh', ['component'], CF, 'yy', 10.0)}, rd AS (SELECT component, horizon_bucket, {_RAD} AS radius FROM (SELECT *, abs(actual_mw - corrected_mw) AS e FROM pv) GROUP BY 1, 2),
  cu AS (SELECT h1.component, delivery_hour, horizon_bucket, baseline_mw, horizon_hour, coalesce(recent_error_mw, 0.0) AS recent_error_mw FROM h1 LEFT JOIN re USING (component, forecast_origin) WHERE forecast_origin = TIMESTAMP '{ORIGIN}'),
  fc AS (SELECT cu.*, CASE WHEN gt.promoted THEN greatest(baseline_mw + {sql_pred('b', CF)}, 0.0) ELSE baseline_mw END AS forecast_mw FROM cu LEFT JOIN gt USING (component) LEFT JOIN fin_b b ON b.component = cu.component)
  SELECT fc.component, fc.delivery_hour, fc.horizon_bucket, {r('baseline_mw', 'forecast_mw', 'CASE WHEN radius IS NOT NULL AND forecast_mw IS NOT NULL THEN greatest(forecast_mw - radius, 0.0) END AS load_lower_mw', 'forecast_mw + radius AS load_upper_mw')} FROM fc LEFT JOIN rd ON rd.component = fc.component AND rd.horizon_bucket = fc.horizon_bucket""")
def w18(t):
    history = power.component_history(t.power_vintages, t.power_actuals)
    current, rows = power.correct(history, history.where(F.col("forecast_origin") == _at()), _at(), CF)
    errors = rows.withColumn("abs_error", F.abs(F.col("actual_mw") - F.col("corrected_mw")))
    return bucket_bounds(current, errors, "forecast_mw", "load", keys=["component"]).select(
        "component", "delivery_hour", "horizon_bucket", "baseline_mw", "forecast_mw", "load_lower_mw", "load_upper_mw"
    )


_STACK_IN = """si AS (SELECT valid_at AS delivery_hour, sum(mw) FILTER (component='load') * 4 AS load_forecast_mw, coalesce(sum(mw) FILTER (component='wind'), 0.0) AS wind_forecast_mw, coalesce(sum(mw) FILTER (component='solar'), 0.0) AS solar_forecast_mw,
  100.0::DOUBLE AS nuclear_mw, 10.0::DOUBLE AS hydro_mw, 5.0::DOUBLE AS other_nonthermal_mw, -20.0::DOUBLE AS net_imports_mw, 7.0::DOUBLE AS battery_net_discharge_mw, coalesce(sum(mw) FILTER (component='load') * 4, 0.0) + coalesce(sum(mw) FILTER (component='gas'), 0.0) - 900.0 AS available_capacity_mw
  FROM hours GROUP BY 1 HAVING sum(mw) FILTER (component='load') IS NOT NULL),
  s1 AS (SELECT *, load_forecast_mw - wind_forecast_mw - solar_forecast_mw AS net_load_mw, load_forecast_mw - wind_forecast_mw - solar_forecast_mw - 102.0 AS raw FROM si),
  s2 AS (SELECT *, greatest(raw, 0.0) AS th, greatest(-raw, 0.0) AS curtailment_mw, available_capacity_mw - load_forecast_mw AS capacity_margin_mw FROM s1)"""


def _stack_inputs(t):
    h = t.hours.groupBy("valid_at").pivot("component", ["load", "wind", "solar", "gas"]).agg(F.sum("mw")).where(F.col("load").isNotNull())
    zero = F.lit(0.0)
    return h.select(
        F.col("valid_at").alias("delivery_hour"), (F.col("load") * 4).alias("load_forecast_mw"), F.coalesce("wind", zero).alias("wind_forecast_mw"),
        F.coalesce("solar", zero).alias("solar_forecast_mw"), F.lit(100.0).alias("nuclear_mw"), F.lit(10.0).alias("hydro_mw"),
        F.lit(5.0).alias("other_nonthermal_mw"), F.lit(-20.0).alias("net_imports_mw"), F.lit(7.0).alias("battery_net_discharge_mw"),
        (F.col("load") * 4 + F.coalesce("gas", zero) - 900.0).alias("available_capacity_mw"),
    )


@query("f02_physical_stack", f"""WITH {_STACK_IN} SELECT delivery_hour, {r('net_load_mw', 'raw AS raw_residual_mw', 'th AS dispatchable_thermal_mw', 'curtailment_mw', 'th * 0.5 AS gas_generation_mw', 'th - th * 0.5 AS coal_other_generation_mw', 'th * 0.5 * 7.0 / 1037000.0 AS gas_burn_bcf_low',
  'th * 0.5 * 7.5 / 1037000.0 AS gas_burn_bcf_base', 'th * 0.5 * 8.0 / 1037000.0 AS gas_burn_bcf_high', 'capacity_margin_mw', 'greatest(-capacity_margin_mw, 0.0) AS capacity_shortfall_mw', '0.0 AS balance_error_mw', digits=8)} FROM s2""", digits=8)
def f02(t):
    return power.physical_stack(_stack_inputs(t)).select(
        "delivery_hour", "net_load_mw", "raw_residual_mw", "dispatchable_thermal_mw", "curtailment_mw", "gas_generation_mw", "coal_other_generation_mw",
        "gas_burn_bcf_low", "gas_burn_bcf_base", "gas_burn_bcf_high", "capacity_margin_mw", "capacity_shortfall_mw", "balance_error_mw",
    )


_FUEL = ["gas_mw + coal_mw", f"sin(2*pi()*hour({_local('valid_at')})/24.0)", f"cos(2*pi()*hour({_local('valid_at')})/24.0)"]
_FUT = ["th", f"sin(2*pi()*hour({_local('delivery_hour')})/24.0)", f"cos(2*pi()*hour({_local('delivery_hour')})/24.0)"]
_KNOWN = "(SELECT * FROM fuel_hours WHERE valid_at < TIMESTAMP '{o}' AND gas_mw IS NOT NULL AND coal_mw IS NOT NULL)"
_FULL = "2024-02-10 00:00:00"


def _split_sql(origin: str) -> str:
    known = _KNOWN.format(o=origin)
    return f"""WITH {_STACK_IN}, {sql_linear('fs', known, [], _FUEL, 'gas_mw', 10.0)}, sr AS (SELECT avg(s) AS share FROM (SELECT gas_mw / (gas_mw + coal_mw) AS s FROM {known} WHERE gas_mw + coal_mw > 0 ORDER BY valid_at DESC LIMIT 720)),
  gs AS (SELECT s2.*, CASE WHEN b.n >= 720 THEN {sql_pred('b', _FUT)} ELSE th * share END AS g, CASE WHEN b.n >= 720 THEN 'ridge_fuel_split' ELSE 'recent_share_fallback' END AS src FROM s2, sr, fs_b b)"""


@query("m15_gas_split", f"{_split_sql(ORIGIN)} SELECT delivery_hour, {r('g AS gas_forecast_mw')}, src AS gas_split_source FROM gs")
def m15(t):
    stack = power.physical_stack(_stack_inputs(t))
    return power.gas_split(stack, t.fuel_hours, _at(), F.lit(3.0)).select("delivery_hour", "gas_forecast_mw", "gas_split_source")


@query("m15_gas_split_ridge", f"{_split_sql(_FULL)}, fb AS (SELECT * FROM fs_b) SELECT delivery_hour, {r(f'CASE WHEN b.n >= 600 THEN {sql_pred('b', _FUT)} ELSE th * share END AS gas_forecast_mw')} FROM s2, sr, fb b")
def m15_ridge(t):
    """The ridge branch on its own row threshold; the test hours stop short of thirty whole days."""
    stack = power.physical_stack(_stack_inputs(t))
    out = power.gas_split(stack, t.fuel_hours, _at(_FULL), F.lit(3.0), min_hours=600)
    return out.select("delivery_hour", "gas_forecast_mw")


@query("i03_gas_interval", f"""WITH {_STACK_IN}, {_SHARE.format(f"valid_at < TIMESTAMP '{ORIGIN}'")}, gr AS (SELECT horizon_bucket, {_RAD} AS radius FROM rs GROUP BY 1), b AS (SELECT s2.*, {_bucket(f"CAST(date_diff('hour', TIMESTAMP '{ORIGIN}', delivery_hour) AS INTEGER)")} AS horizon_bucket FROM s2 WHERE delivery_hour > TIMESTAMP '{ORIGIN}')
  SELECT delivery_hour, b.horizon_bucket, {r('th * 0.5 AS gas_generation_mw', 'CASE WHEN radius IS NOT NULL THEN greatest(th * 0.5 - radius, 0.0) END AS gas_generation_lower_mw', 'CASE WHEN radius IS NOT NULL THEN least(th * 0.5 + radius, th) END AS gas_generation_upper_mw', 'CASE WHEN radius IS NOT NULL THEN greatest(th * 0.5 - radius, 0.0) END * 7.5 / 1037000.0 AS gas_burn_bcf_lower', digits=8)} FROM b LEFT JOIN gr USING (horizon_bucket)""", digits=8)
def i03(t):
    rows = _stack_inputs(t).where(F.col("delivery_hour") > _at()).withColumn("forecast_origin", _at())
    stack = power.physical_stack(add_hourly_features(rows))
    return power.gas_interval(stack, t.fuel_hours, _at()).select(
        "delivery_hour", "horizon_bucket", "gas_generation_mw", "gas_generation_lower_mw", "gas_generation_upper_mw", "gas_burn_bcf_lower"
    )


@query("i02_net_load_interval", f"""{_PUBLISHED}, {_NET.format('pv')}, {_STACK_IN}, nr AS (SELECT horizon_bucket, {_RAD} AS radius FROM nl GROUP BY 1), b AS (SELECT s2.*, {_bucket(f"CAST(date_diff('hour', TIMESTAMP '{ORIGIN}', delivery_hour) AS INTEGER)")} AS horizon_bucket FROM s2 WHERE delivery_hour > TIMESTAMP '{ORIGIN}')
  SELECT delivery_hour, {r('net_load_mw', 'net_load_mw - radius AS net_load_lower_mw', 'net_load_mw + radius AS net_load_upper_mw')} FROM b LEFT JOIN nr USING (horizon_bucket)""")
def i02(t):
    rows = _stack_inputs(t).where(F.col("delivery_hour") > _at()).withColumn("forecast_origin", _at())
    stack = power.physical_stack(add_hourly_features(rows))
    _, rows = power.validated(power.known_at(power.component_history(t.power_vintages, t.power_actuals), _at()), CF)
    return bucket_bounds(stack, power.net_load_errors(rows), "net_load_mw", "net_load", clip=False).select(
        "delivery_hour", "net_load_mw", "net_load_lower_mw", "net_load_upper_mw"
    )


#: Non-thermal series made of the hours of a component and a factor.
_NONTHERMAL = {"gas": ("nuclear_mw", 0.3), "coal": ("hydro_mw", 0.2), "wind": ("other_nonthermal_mw", 0.1), "load": ("net_imports_mw", -0.05), "solar": ("battery_net_discharge_mw", 0.1)}


def _system_tables(t):
    """Histories and vintages beside load, wind and solar: non-thermal series, outages and capacity."""
    parts = [F.when(F.col("component") == c, F.struct(F.lit(n).alias("series"), (F.col("mw") * k).alias("actual_mw"))) for c, (n, k) in _NONTHERMAL.items()]
    nonthermal = t.hours.select("valid_at", F.coalesce(*parts).alias("s")).where(F.col("s").isNotNull()).select("s.series", "valid_at", "s.actual_mw")
    at = ["valid_at", "issued_at", "retrieved_at"]
    v = t.power_vintages
    outages = v.where((F.col("component") == "wind") & (F.dayofmonth("valid_at") % 3 != 0)).select(
        *at, (F.col("baseline_mw") / 7).alias("conventional_outage_mw"), (F.col("baseline_mw") / 11).alias("renewable_outage_mw")
    )
    adequacy = v.where(F.col("component") == "load").select(*at, (F.col("baseline_mw") * 1.7).alias("available_capacity_mw"))
    return {"nonthermal": nonthermal, "outages": outages, "adequacy": adequacy}


def _series_sql(c: str) -> str:
    name, k = _NONTHERMAL[c]
    value = f"coalesce(max(v) FILTER (component = '{c}'), 0.0)"
    return f"{f'greatest({value}, 0.0)' if k > 0 and c != 'solar' else value} AS {name}"


@query("e12_system_inputs", f"""WITH hk AS (SELECT component, valid_at, mw * CASE component {' '.join(f"WHEN '{c}' THEN {k}" for c, (_, k) in _NONTHERMAL.items())} END AS mw, {_how('valid_at')} AS how FROM hours WHERE valid_at < TIMESTAMP '{ORIGIN}'),
  pf AS (SELECT component, how, avg(mw) AS p FROM hk GROUP BY 1, 2),
  lv AS (SELECT component, avg(mw) AS m, avg(CASE WHEN rn <= 24 THEN mw - p END) AS adj FROM (SELECT hk.component, mw, p, row_number() OVER (PARTITION BY hk.component ORDER BY valid_at DESC) AS rn FROM hk JOIN pf USING (component, how)) GROUP BY 1),
  dh AS (SELECT TIMESTAMP '{ORIGIN}' + (k + 1) * INTERVAL 1 HOUR AS delivery_hour FROM range(168) x(k)),
  nt AS (SELECT delivery_hour, lv.component, coalesce(p, m) + adj AS v FROM dh, lv LEFT JOIN pf ON pf.component = lv.component AND pf.how = {_how('delivery_hour')}),
  kn AS (SELECT component, valid_at, max_by(baseline_mw, issued_at) AS b FROM power_vintages WHERE issued_at <= TIMESTAMP '{ORIGIN}' AND retrieved_at <= TIMESTAMP '{ORIGIN}' GROUP BY 1, 2),
  w AS (SELECT delivery_hour, {', '.join(_series_sql(c) for c in _NONTHERMAL)} FROM nt GROUP BY 1)
  SELECT w.delivery_hour, {r(*[n for n, _ in _NONTHERMAL.values()], 'coalesce(CASE WHEN day(o.valid_at) % 3 <> 0 THEN o.b / 7 END, 0.0) AS conventional_outage_mw', 'coalesce(CASE WHEN day(o.valid_at) % 3 <> 0 THEN o.b / 11 END, 0.0) AS renewable_outage_mw', '0.0 AS new_equipment_outage_mw', 'a.b * 1.7 AS available_capacity_mw')},
    '{';'.join(f'{n}:hour_of_week_adjusted' for n in power.NONTHERMAL)}' AS profile_sources
  FROM w LEFT JOIN kn o ON o.component = 'wind' AND o.valid_at = w.delivery_hour LEFT JOIN kn a ON a.component = 'load' AND a.valid_at = w.delivery_hour""")
def e12_inputs(t):
    return jobs.system_inputs(jobs.delivery_hours(t.spark, _at(), 168), _at(), **_system_tables(t))


@query("e12_power_forecast_job")
def e12(t):
    return jobs.power_forecast(t.power_vintages, t.power_actuals, t.fuel_hours, _at(), prices=t.daily_price, **_system_tables(t))


@query("e14_power_kpis")
def e14_power(t):
    f = e12(t)
    return f.agg(
        F.max("load_forecast_mw").alias("peak_load_mw"), F.max("net_load_mw").alias("peak_net_load_mw"), F.min("capacity_margin_mw").alias("min_margin_mw"),
        F.sum("gas_burn_bcf_base").alias("gas_burn_bcf"), F.max(F.abs("balance_error_mw")).alias("max_balance_error_mw"),
    )

