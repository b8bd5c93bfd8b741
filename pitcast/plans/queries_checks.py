"""Constraint reports (C): every check over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitcast.operators import checks, crude, splits
from pitcast.operators import features as ft
from pitcast.operators.disaggregate import has_state_production, missing_series
from pitcast.plans.queries_features import FEATURE_CTE
from pitcast.plans.registry import query


@query("c01_vintage_contract", "SELECT count(*) FILTER (issued_at IS NULL OR retrieved_at IS NULL OR valid_at IS NULL) AS null_provenance, count(*) FILTER (issued_at > retrieved_at) AS issued_after_retrieved FROM vintages")
def c01(t):
    df = t.versions.withColumns({"source": F.lit("s"), "product_id": F.lit("p"), "geography": F.col("entity"), "source_hash": F.lit("h")})
    return checks.vintage_contract(df)


@query("c02_weekly_storage", "SELECT count(*) FILTER (period IS NULL OR value IS NULL) AS null_values, count(*) FILTER (value < 0) AS negative_values FROM storage_raw")
def c02(t):
    return checks.weekly_storage(t.storage_raw)


_GAP = "SELECT {k}, count(*) FILTER (s = 0) AS duplicate_periods, count(*) FILTER (s <> 7 AND s <> 0) AS gaps FROM (SELECT {k}, date_diff('day', lag({d}) OVER (PARTITION BY {k} ORDER BY {d}), {d}) AS s FROM {t}) GROUP BY 1"


@query("c03_consecutive_weeks", _GAP.format(k="duoarea", d="period", t="storage_raw"))
def c03(t):
    return checks.consecutive_weeks(t.storage_raw)


@query("c04_weekly_weather", "SELECT count(*) FILTER (isodow(date) <> 5) AS not_friday, count(*) FILTER (weather_days <> 7) AS incomplete_weeks, count(*) - count(DISTINCT (duoarea, date)) AS duplicate_keys FROM wk_weather")
def c04(t):
    return checks.weekly_weather(t.wk_weather)


@query("c05_locations", "SELECT CAST(count(*) - count(DISTINCT state) AS BIGINT) AS duplicate_names, CAST(abs(sum(population)/325.0 - 1) > 1e-6 AS BIGINT) AS weight_not_one, (SELECT count(*) FROM nations WHERE state NOT IN (SELECT state FROM state_daily)) AS missing_states, 0::BIGINT AS unexpected_states FROM nations")
def c05(t):
    located = t.nations.withColumn("weight", F.col("population") / 325.0)
    have = located.join(t.state_daily.select("state").distinct(), "state", "left_semi")
    return checks.locations(have, t.nations)


@query("c06_state_grid", "SELECT CAST(0 AS BIGINT) AS duplicate_rows, count(*) FILTER (n <> 25) AS incomplete_dates FROM (SELECT date, count(DISTINCT state) AS n FROM state_daily GROUP BY 1)")
def c06(t):
    return checks.state_grid(t.state_daily, F.lit(25))


@query("c07_weather_scenarios", "SELECT count(*) FILTER (date IS NULL OR duoarea IS NULL OR issued_at IS NULL) AS null_keys, count(*) FILTER (weather_days <= 0) AS nonpositive_days, count(*) - count(DISTINCT (date, duoarea, issued_at, provider, model)) AS duplicate_keys FROM scenarios")
def c07(t):
    return checks.weather_scenarios(t.scenarios)


@query("c08_forecast_archive", """SELECT count(*) FILTER (valid_end <= valid_start) AS empty_period, count(*) FILTER (issued_at >= valid_end) AS issued_after_end, count(*) FILTER (coverage IS NULL OR coverage NOT BETWEEN 0 AND 1) AS bad_coverage,
  count(*) FILTER (trim(provider) = '' OR trim(state) = '') AS blank_text, count(*) - count(DISTINCT (provider, model, model_run, ensemble_member, issued_at, valid_start, state, duoarea)) AS duplicate_keys FROM archive""")
def c08(t):
    return checks.forecast_archive(t.archive)


@query("c09_balance_vintages", "SELECT count(*) FILTER (local_balance IS NULL OR net_inflow_balancing IS NULL OR available_at IS NULL) AS null_values, count(*) - count(DISTINCT (date, duoarea, available_at)) AS duplicate_keys FROM balance_vintages")
def c09(t):
    return checks.balance_vintages(t.balance_vintages)


@query("c09_origins", "SELECT count(*) FILTER (duoarea = '') AS null_keys, count(*) - count(DISTINCT (date, entity)) AS duplicate_keys FROM (SELECT CAST(valid_at AS DATE) AS date, entity, entity AS duoarea FROM vintages)")
def c09_origins(t):
    return checks.origins(t.vintages.select(F.to_date("valid_at").alias("date"), F.col("entity").alias("duoarea")))


@query("c10_model_features", f"WITH {FEATURE_CTE} SELECT count(*) FILTER (date IS NULL) AS null_dates, count(*) FILTER (weather_days <= 0) AS nonpositive_days, count(*) FILTER (duoarea <> 'R31') AS other_regions, count(*) - count(DISTINCT (date, duoarea)) AS duplicate_keys FROM avg5")
def c10(t):
    return checks.model_features(ft.weekly_model_features(t.wk_storage, t.wk_weather), "R31")


@query("c11_crude_long", """SELECT count(*) - count(DISTINCT (period, component)) AS duplicate_keys, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS not_finite, count(*) FILTER (value < 0) AS negative_values,
  (SELECT count(*) FROM (SELECT period FROM crude_long GROUP BY 1 HAVING count(DISTINCT component) <> 6)) AS incomplete_weeks, (SELECT count(*) FROM (SELECT DISTINCT period FROM crude_long) WHERE isodow(period) <> 5) AS not_friday,
  (SELECT count(*) FROM (SELECT date_diff('day', lag(period) OVER (ORDER BY period), period) AS s FROM (SELECT DISTINCT period FROM crude_long)) WHERE s <> 7) AS gaps FROM crude_long""")
def c11(t):
    return checks.crude_long(t.crude_long)


@query("c12_crude_balance", """SELECT count(*) FILTER (isodow(date) <> 5) AS not_friday, count(*) FILTER (s = 0) AS duplicate_dates, count(*) FILTER (s <> 7 AND s <> 0) AS gaps, count(*) FILTER (rn > 1 AND commercial_stock_change_mmbbl IS NULL) AS missing_values,
  count(*) FILTER (production_mmbbl < 0 OR imports_mmbbl < 0 OR refinery_inputs_mmbbl < 0 OR exports_mmbbl < 0) AS negative_values, count(*) FILTER (NOT isfinite(production_mmbbl + imports_mmbbl + refinery_inputs_mmbbl + exports_mmbbl) OR NOT isfinite(coalesce(commercial_stock_change_mmbbl + spr_stock_change_mmbbl + balance_adjustment_mmbbl, 0.0))) AS not_finite FROM (SELECT *, date_diff('day', lag(date) OVER (ORDER BY date), date) AS s, row_number() OVER (ORDER BY date) AS rn FROM crude_balance)""")
def c12(t):
    return checks.crude_balance(crude.weekly_balance(t.crude_long))


@query("c13_reconcilable", """SELECT CAST(0 AS BIGINT) AS duplicate_keys, count(*) FILTER (v IS NULL) AS missing_values, (SELECT count(*) FROM (SELECT date FROM wk_weather_all GROUP BY 1 HAVING count(*) <> 6)) AS incomplete_groups FROM (SELECT hdd AS v FROM wk_weather_all)""")
def c13(t):
    df = t.wk_weather_all.select(F.col("duoarea").alias("region"), "date", F.lit(1).alias("horizon"), F.col("hdd").alias("predicted_weekly_change"))
    return checks.reconcilable(df)


@query("c14_chronological_folds", """WITH f AS (SELECT k, DATE '1997-12-27' + CAST(k * 56 AS INTEGER) AS te FROM range(0, 60) x(k)),
  v AS (SELECT k, te, count(*) AS n_val, min(date) AS first_val FROM f JOIN wk_storage ON date >= te AND date < te + 56 GROUP BY 1, 2)
  SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS fold, (SELECT count(*) FROM wk_storage WHERE date < te AND date >= DATE '1995-01-01') AS n_train, n_val, CAST((SELECT max(date) FROM wk_storage WHERE date < te) AS TIMESTAMP) AS last_train, CAST(first_val AS TIMESTAMP) AS first_val FROM v""")
def c14(t):
    return splits.fold_sizes(t.wk_storage, "date", splits.expanding_weeks("1995-01-01", "1997-12-26", 8, 8))


@query("c15_recursive_inputs", "SELECT count(*) FILTER (date IS NULL) AS null_dates, count(*) - count(DISTINCT (duoarea, date)) AS duplicate_keys FROM wk_storage")
def c15(t):
    return checks.recursive_inputs(t.wk_storage)


@query("c16_required_series", "SELECT series FROM (SELECT 'N30' || p || abbr || '2' AS series FROM state_codes, (VALUES ('10'), ('20'), ('35'), ('45')) v(p) UNION ALL SELECT unnest(['N9070US2','N9050US2','N9140US2','N9160US2','N9170US2'])) WHERE series NOT IN (SELECT series FROM monthly_series WHERE value > 900)")
def c16(t):
    return missing_series(t.monthly_series.where(F.col("value") > 900), t.state_codes)


@query("c16_state_production", "SELECT count(*) FILTER ((series LIKE 'N9050%' AND series <> 'N9050US2') OR series LIKE 'NA1160_S%') > 0 AS has_state_production FROM monthly_series")
def c16_production(t):
    return has_state_production(t.monthly_series)
