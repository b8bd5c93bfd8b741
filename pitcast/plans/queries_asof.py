"""Point-in-time selection (J02-J10) over all vintages and all origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitcast.functions.calendar import degree_days
from pitcast.operators import asof, rollups
from pitcast.plans import jobs
from pitcast.plans.registry import d, query, r
from pitcast.session import scratch_path

ORIGIN = "1998-06-01 00:00:00"


def _at(stamp: str = ORIGIN):
    return F.lit(stamp).cast("timestamp")


@query("j02_select_as_of", f"""SELECT entity, valid_at, issued_at, retrieved_at, {r('value')} FROM vintages WHERE issued_at <= TIMESTAMP '{ORIGIN}' AND retrieved_at <= TIMESTAMP '{ORIGIN}'
  QUALIFY row_number() OVER (PARTITION BY entity, valid_at ORDER BY issued_at DESC, retrieved_at DESC, value DESC) = 1""")
def j02(t):
    return asof.select_as_of(t.versions, _at(), ["entity"])


@query("j02_missing_valid_times", f"""SELECT duoarea AS entity, {d('date')} FROM wk_storage WHERE (duoarea, date) NOT IN (SELECT (entity, CAST(valid_at AS DATE)) FROM vintages
  WHERE retrieved_at <= TIMESTAMP '{ORIGIN}')""")
def j02_missing(t):
    known = asof.select_as_of(t.versions, _at(), ["entity"]).select("entity", F.to_date("valid_at").alias("date"))
    return asof.missing_targets(known, t.wk_storage.withColumnRenamed("duoarea", "entity"), ["entity", "date"])


@query("j03_latest_revision_as_of", f"""SELECT {d('date')}, duoarea, available_at, {r('local_balance', 'net_inflow_balancing')} FROM balance_vintages WHERE available_at <= TIMESTAMP '{ORIGIN}'
  QUALIFY row_number() OVER (PARTITION BY date, duoarea ORDER BY available_at DESC) = 1""")
def j03(t):
    known = t.balance_vintages.where(F.col("available_at") <= _at())
    return asof.keep_latest(known, ["date", "duoarea"], ["available_at"])


@query("j04_scenario_as_of", f"""SELECT {d('date')}, duoarea, issued_at, provider, model, {r('temperature_f', 'hdd', 'cdd', 'weather_days')} FROM scenarios WHERE issued_at <= TIMESTAMP '{ORIGIN}' AND duoarea = 'R32' AND provider = 'archive'
  QUALIFY row_number() OVER (PARTITION BY date, duoarea ORDER BY issued_at DESC) = 1""")
def j04(t):
    mine = (F.col("duoarea") == "R32") & (F.col("provider") == "archive") & (F.col("issued_at") <= _at())
    return asof.scenario_as_of(t.scenarios, _at(), region="R32", target_dates=t.scenarios.where(mine), provider="archive").drop("n_models")


@query("j05_state_weights_as_of", f"""SELECT state, duoarea, available_at, {r('gas_load / sum(gas_load) OVER (PARTITION BY duoarea) AS weather_weight')} FROM (SELECT * FROM weight_history WHERE available_at <= TIMESTAMP '{ORIGIN}'
  QUALIFY row_number() OVER (PARTITION BY duoarea, state ORDER BY available_at DESC) = 1)""")
def j05(t):
    return asof.state_weights_as_of(t.weight_history, _at(), "gas_load")


@query("j06_balance_features_at_origins", f"""WITH k AS (SELECT o.date AS target, o.duoarea, lag, v.available_at, v.local_balance, v.net_inflow_balancing, v.date AS src FROM wk_storage o, range(1, 5) l(lag)
  LEFT JOIN balance_vintages v ON v.duoarea = o.duoarea AND v.date = o.date - CAST(7 * lag AS INTEGER) AND v.available_at <= CAST(o.date AS TIMESTAMP)
  QUALIFY row_number() OVER (PARTITION BY o.duoarea, o.date, lag ORDER BY v.available_at DESC NULLS LAST) = 1),
  g AS (SELECT target AS date, duoarea, max(local_balance) FILTER (lag = 1) AS a, max(net_inflow_balancing) FILTER (lag = 1) AS b, avg(net_inflow_balancing) AS m, CAST(count(available_at) AS INTEGER) AS n,
  max(src) FILTER (lag = 1) AS s, max(available_at) FILTER (lag = 1) AS t, max(available_at) AS u FROM k GROUP BY 1, 2)
  SELECT {d('date')}, duoarea, CAST(date AS TIMESTAMP) AS balance_as_of, {r('a AS local_balance_lag1', 'b AS net_inflow_balancing_lag1', 'CASE WHEN n = 4 THEN m END AS net_inflow_balancing_rolling_4wk')}, n AS balance_history_weeks,
  CAST(s AS TIMESTAMP) AS balance_lag1_source_date, t AS balance_lag1_available_at, CASE WHEN n = 4 THEN u END AS balance_rolling_4wk_latest_available_at FROM g""")
def j06(t):
    return asof.balance_features_at_origins(t.wk_storage.select("date", "duoarea"), t.balance_vintages)


@query("j07_scenarios_at_origins", f"""SELECT o.duoarea, CAST(o.date AS TIMESTAMP) AS origin_date, CAST(h AS INTEGER) AS horizon, CAST(o.date + CAST(7 * (h - 1) AS INTEGER) AS TIMESTAMP) AS date, s.issued_at, s.provider, s.model,
  {r('s.temperature_f', 's.hdd', 's.cdd', 's.weather_days')} FROM wk_storage o, range(1, 5) x(h) LEFT JOIN scenarios s ON s.duoarea = o.duoarea AND s.date = o.date + CAST(7 * (h - 1) AS INTEGER) AND s.issued_at <= CAST(o.date AS TIMESTAMP)
  QUALIFY row_number() OVER (PARTITION BY o.duoarea, o.date, h ORDER BY s.issued_at DESC NULLS LAST) = 1""")
def j07(t):
    return asof.scenarios_at_origins(t.wk_storage.select("date", "duoarea"), t.scenarios)


_WH = """w AS (SELECT i.duoarea, i.state, i.issued_at, h.gas_load FROM (SELECT DISTINCT duoarea, state, issued_at FROM archive) i JOIN weight_history h ON h.duoarea = i.duoarea AND h.state = i.state AND h.available_at <= i.issued_at
  QUALIFY row_number() OVER (PARTITION BY i.duoarea, i.state, i.issued_at ORDER BY h.available_at DESC) = 1), n AS (SELECT *, gas_load / sum(gas_load) OVER (PARTITION BY duoarea, issued_at) AS weather_weight FROM w)"""


@query("j08_weights_per_run", f"WITH {_WH} SELECT duoarea, state, issued_at, {r('weather_weight')} FROM n")
def j08(t):
    return asof.weights_at_issues(t.archive, t.weight_history, "gas_load")


def weather_vintages(t):
    """Three issues of an hourly temperature per delivery hour."""
    base = t.hours.where(F.col("component") == "coal").select("valid_at", "mw", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    issued = F.timestamp_add("DAY", -F.col("k"), F.date_trunc("day", F.col("valid_at") - F.expr("INTERVAL 1 SECOND")))
    return base.select("valid_at", issued.alias("issued_at"), (issued + F.expr("INTERVAL 10 MINUTE")).alias("retrieved_at"), (F.col("mw") / 7.0 + F.col("k")).alias("temperature_f"))


WEATHER_SQL = """wv AS (SELECT valid_at, issued_at, issued_at + INTERVAL 10 MINUTE AS retrieved_at, mw / 7.0 + k AS temperature_f FROM (SELECT valid_at, mw, k, date_trunc('day', valid_at - INTERVAL 1 SECOND) - to_days(CAST(k AS INTEGER)) AS issued_at
  FROM hours, range(0, 3) x(k) WHERE component = 'coal'))"""


@query("j09_hourly_weather_as_of", f"""WITH {WEATHER_SQL} SELECT p.component, p.issued_at AS forecast_origin, p.valid_at AS delivery_hour, {r('p.baseline_mw', 'w.temperature_f')} FROM power_vintages p
  LEFT JOIN wv w ON w.valid_at = p.valid_at AND w.issued_at <= p.issued_at AND w.retrieved_at <= p.issued_at
  QUALIFY row_number() OVER (PARTITION BY p.component, p.issued_at, p.valid_at ORDER BY w.issued_at DESC NULLS LAST) = 1""")
def j09(t):
    f = t.power_vintages.select("component", F.col("issued_at").alias("forecast_origin"), F.col("valid_at").alias("delivery_hour"), "baseline_mw")
    return asof.hourly_as_of(f, weather_vintages(t))


@query("j10_spine_left_join", f"""SELECT component, s.valid_at AS delivery_hour, {r('v.baseline_mw')}, v.issued_at FROM (SELECT component, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS valid_at FROM (SELECT component, min(valid_at) AS lo, max(valid_at) AS hi FROM power_vintages GROUP BY 1)) s
  LEFT JOIN (SELECT * FROM power_vintages WHERE retrieved_at <= TIMESTAMP '2024-01-20 12:00:00' QUALIFY row_number() OVER (PARTITION BY component, valid_at ORDER BY issued_at DESC) = 1) v USING (component, valid_at)""")
def j10(t):
    span = t.power_vintages.groupBy("component").agg(F.min("valid_at").alias("lo"), F.max("valid_at").alias("hi"))
    spine = span.select("component", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("valid_at"))
    known = asof.select_as_of(t.power_vintages, _at("2024-01-20 12:00:00"), ["component"])
    return spine.join(known, ["component", "valid_at"], "left").select("component", F.col("valid_at").alias("delivery_hour"), "baseline_mw", "issued_at")


@query("e06_weather_scenario_job", f"""SELECT {d('date')}, duoarea, issued_at, provider, model, {r('temperature_f', 'hdd', 'cdd', 'weather_days')} FROM scenarios WHERE issued_at <= TIMESTAMP '{ORIGIN}'
  QUALIFY row_number() OVER (PARTITION BY date, duoarea ORDER BY issued_at DESC) = 1""")
def e06(t):
    return jobs.scenario_job(t.scenarios, _at())


@query("e07_asof_balance_job", f"""SELECT o.duoarea, {d('o.date')}, CAST(count(v.available_at) AS INTEGER) AS balance_history_weeks FROM wk_storage o, range(1, 5) l(lag)
  LEFT JOIN (SELECT date, duoarea, min(available_at) AS available_at FROM balance_vintages GROUP BY 1, 2) v ON v.duoarea = o.duoarea AND v.date = o.date - CAST(7 * lag AS INTEGER) AND v.available_at <= CAST(o.date AS TIMESTAMP) GROUP BY 1, 2""")
def e07(t):
    origins = t.wk_storage.select("date", "duoarea")
    built = jobs.asof_balance_job(origins, t.balance_vintages, target=scratch_path(t.spark, "e07"))
    return built.select("duoarea", "date", "balance_history_weeks")


_WK = "(CAST(valid_start AS DATE) + CAST((12 - isodow(valid_start)) % 7 AS INTEGER))"


@query("e08_forecast_archive_job", f"""WITH {_WH}, g AS (SELECT a.model_run, a.ensemble_member, a.issued_at, a.valid_start, a.duoarea, sum(temperature_f*weather_weight) AS temperature_f, sum(hdd*weather_weight) AS hdd, sum(coverage*weather_weight) AS coverage
  FROM archive a JOIN n ON n.state = a.state AND n.duoarea = a.duoarea AND n.issued_at = a.issued_at GROUP BY 1, 2, 3, 4, 5),
  m AS (SELECT model_run, issued_at, duoarea, {_WK} AS date, ensemble_member, avg(temperature_f) AS temperature_f, sum(hdd) AS hdd, CAST(count(DISTINCT valid_start) AS INTEGER) AS weather_days FROM g GROUP BY 1, 2, 3, 4, 5)
  SELECT model_run, issued_at, duoarea, {d('date')}, {r('avg(temperature_f) AS temperature_f', 'avg(hdd) AS hdd', 'quantile_cont(hdd, 0.9) AS hdd_p90')}, min(weather_days) AS weather_days, CAST(count(*) AS INTEGER) AS ensemble_members FROM m GROUP BY model_run, issued_at, duoarea, m.date""")
def e08(t):
    known = t.archive.join(asof.weights_at_issues(t.archive, t.weight_history, "gas_load").select("state", "duoarea", "issued_at"), ["state", "duoarea", "issued_at"], "left_semi")
    _, scenarios = jobs.archive_job(known, weight_history=t.weight_history, require_complete_weeks=False, target=scratch_path(t.spark, "e08"))
    return scenarios.select("model_run", "issued_at", "duoarea", "date", "temperature_f", "hdd", "hdd_p90", "weather_days", "ensemble_members")


@query("j16_paired_inner", f"SELECT a.region, {d('a.date')}, a.horizon, {r('a.v AS value_baseline', 'b.v AS value_challenger')} FROM (SELECT duoarea AS region, date, 1 AS horizon, storage_bcf AS v FROM wk_all) a JOIN (SELECT duoarea AS region, date, 1 AS horizon, hdd AS v FROM wk_weather_all) b USING (region, date, horizon)")
def j16(t):
    from pitcast.operators.experiments import pair

    a = t.wk_all.select(F.col("duoarea").alias("region"), "date", F.lit(1).alias("horizon"), F.col("storage_bcf").alias("value"))
    b = t.wk_weather_all.select(F.col("duoarea").alias("region"), "date", F.lit(1).alias("horizon"), F.col("hdd").alias("value"))
    return pair(a, b)


@query("j12_full_outer_coalesce", f"""SELECT coalesce(a.valid_at, b.valid_at) AS valid_at, {r('coalesce(a.mw, b.mw) AS load_actual_mw', 'b.gas AS gas_mw')} FROM (SELECT valid_at, mw FROM hours WHERE component = 'load') a
  FULL JOIN (SELECT valid_at, max(mw) FILTER (component = 'wind') AS mw, max(mw) FILTER (component = 'gas') AS gas FROM hours WHERE component IN ('wind', 'gas') GROUP BY 1) b ON a.valid_at = b.valid_at""")
def j12(t):
    from pitcast.sources.vendors import merge_actuals

    a = t.hours.where(F.col("component") == "load").select("valid_at", F.col("mw").alias("load_actual_mw"))
    b = rollups.pivot_sum(t.hours.where(F.col("component").isin("wind", "gas")), ["valid_at"], "component", ["wind", "gas"], "mw")
    return merge_actuals(a, b.select("valid_at", F.col("wind").alias("load_actual_mw"), F.col("gas").alias("gas_mw")))


@query("a04_incomplete_weeks", f"""SELECT duoarea, {d('date')}, {r('avg(hdd) AS hdd')}, CAST(count(*) AS INTEGER) AS ensemble_members FROM (SELECT duoarea, {_WK} AS date, ensemble_member, sum(hdd) AS hdd FROM region_archive GROUP BY 1, 2, 3) x GROUP BY duoarea, x.date""")
def a04_incomplete(t):
    return rollups.weekly_scenarios(degree_days(t.region_archive), require_complete_weeks=False).select("duoarea", "date", "hdd", "ensemble_members")
