"""User-level jobs: each takes tables and returns tables; regions, folds and origins are keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitcast.operators import asof, checks, crude, disaggregate, features, linear, metrics, power, reconcile, recursive, rollups, splits
from pitcast.session import staged
from pitcast.sources import dimensions, payloads, store, vendors

STORAGE_MARK = "_SWO_"


def clean_weekly_storage(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Working-storage series inside the bounds, one row per (region, period), with calendar columns."""
    rows = raw.where(F.col("series").contains(STORAGE_MARK)).withColumns(
        {"period": F.col("period").cast("date"), "value": F.col("value").cast("double")}
    )
    if start:
        rows = rows.where(F.col("period") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("period") <= F.lit(end).cast("date"))
    one = asof.keep_latest(rows, ["duoarea", "period"], ["series"])
    return one.withColumns({"year": F.year("period"), "month": F.month("period"), "week_of_year": F.weekofyear("period")})


def _kept(tables: dict[str, DataFrame], target: str | None) -> dict[str, DataFrame]:
    """The tables themselves, or their newest versions below ``target`` once all of them are published there."""
    if target is None:
        return tables
    for name, table in tables.items():
        store.publish(table, f"{target}/{name}")
    return {name: store.read_latest(table.sparkSession, f"{target}/{name}", table.schema) for name, table in tables.items()}


def region_rows(rows: DataFrame, regions: Sequence[str], include_legacy: bool = False) -> DataFrame:
    """Rows of the wanted regions; an unknown code, or a region without any row, stops the job."""
    for code in regions:
        dimensions.require_known_region(code, include_legacy)
    kept = rows.where(F.col("duoarea").isin(*regions))
    found = {r[0] for r in kept.select("duoarea").distinct().collect()}
    missing = sorted(set(regions) - found)
    if missing:
        raise ValueError(f"No storage rows for regions {missing}.")
    return kept


def storage_table(raw: DataFrame, start: str | None = None, end: str | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """Weekly storage with its change, first weeks without a change removed."""
    rows = clean_weekly_storage(raw, start, end)
    if regions is not None:
        rows = region_rows(rows, regions)
    changed = features.weekly_change(rows)
    return changed.where(F.col("weekly_change_bcf").isNotNull()).select(
        "duoarea", F.col("period").alias("date"), F.col("value").alias("storage_bcf"), "weekly_change_bcf", "year", "month", "week_of_year"
    )


def weather_table(state_daily: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """State days to regional weeks."""
    daily = rollups.weighted_daily_weather(state_daily, ["duoarea"])
    weekly = rollups.weekly_weather(daily, ["duoarea"], drop_incomplete)
    return weekly.withColumns({"year": F.year("date"), "month": F.month("date"), "week_of_year": F.weekofyear("date")})


def weather_job(state_daily: DataFrame, target: str | None = None) -> DataFrame:
    """Complete regional weeks, checked and published when ``target`` is given."""
    table = staged(weather_table(state_daily), "weather")
    checks.enforce(checks.weekly_weather(table), "weekly weather")
    return _kept({"weather": table}, target)["weather"]


def features_job(storage: DataFrame, weather: DataFrame, target: str | None = None) -> DataFrame:
    """Model features, checked and published when ``target`` is given."""
    return _kept({"features": check_features(staged(feature_table(storage, weather), "features"))}, target)["features"]


def feature_table(storage: DataFrame, weather: DataFrame) -> DataFrame:
    return features.weekly_model_features(storage, weather)


def data_job(raw: DataFrame, state_daily: DataFrame, stages: Sequence[str] = ("storage", "weather", "features")) -> dict[str, DataFrame]:
    """The chosen stages for all regions at once, as lazy tables."""
    storage, weather = storage_table(raw), weather_table(state_daily, drop_incomplete=False)
    built = {"storage": storage, "weather": weather, "features": feature_table(storage, weather)}
    unknown = sorted(set(stages) - set(built))
    if unknown:
        raise ValueError(f"Unknown stages: {unknown}")
    return {s: built[s] for s in stages}


def same_week_average(train: DataFrame, target: DataFrame) -> DataFrame:
    """Same-week average model with a band of one sample deviation."""
    profile = rollups.week_mean_std(train)
    joined = target.join(profile, ["duoarea", "week_of_year"], "left")
    return joined.withColumns({
        "lower_band": F.col("predicted_weekly_change") - F.col("prediction_std"),
        "upper_band": F.col("predicted_weekly_change") + F.col("prediction_std"),
    })


def deviation_columns(df: DataFrame, target: str = "weekly_change_bcf") -> DataFrame:
    y, lo, hi = F.col(target), F.col("lower_band"), F.col("upper_band")
    return df.withColumns({
        "forecast_deviation": y - F.col("predicted_weekly_change"),
        "outside_band": F.coalesce((y > hi) | (y < lo), F.lit(False)),
    })


def balance_job(monthly: DataFrame, states: DataFrame, daily_weather: DataFrame, daily_price: DataFrame, weather: DataFrame, storage: DataFrame,
                target: str | None = None) -> DataFrame:
    """The weekly balance of all regions, published when ``target`` is given."""
    return _kept({"balance": balance_table(monthly, states, daily_weather, daily_price, weather, storage)}, target)["balance"]


def asof_balance_job(origins: DataFrame, vintages: DataFrame, as_of: str | None = None, target: str | None = None) -> DataFrame:
    """Balance features known at every origin of all regions; a region without any vintage stops the job. Published when ``target`` is given."""
    bare = sorted(r[0] for r in origins.select("duoarea").distinct().join(vintages.select("duoarea").distinct(), "duoarea", "left_anti").collect())
    if bare:
        raise ValueError(f"No balance vintages for regions {bare}.")
    return _kept({"asof_balance": asof.balance_features_at_origins(origins, vintages, as_of)}, target)["asof_balance"]


def balance_table(monthly: DataFrame, states: DataFrame, daily_weather: DataFrame, daily_price: DataFrame, weather: DataFrame, storage: DataFrame) -> DataFrame:
    """Weekly regional balance with the net inflow that closes it against storage; every required monthly series must be there."""
    disaggregate.require_series(monthly, states)
    table = disaggregate.state_components(monthly, states, daily_price)
    regional = disaggregate.regional_balance(disaggregate.regional_months(table), monthly)
    months = disaggregate.aligned_months(regional, daily_weather, daily_price)
    weekly = disaggregate.weekly_estimates(months, weather, rollups.weekly_price(daily_price, weather))
    return disaggregate.add_net_inflow(weekly.join(storage.select("duoarea", "date", "storage_bcf", "weekly_change_bcf"), ["duoarea", "date"]))


def scenario_job(scenarios: DataFrame, as_of, region: str | None = None, target: str | None = None) -> DataFrame:
    """Scenario table known at one origin, of one region or of all; published when ``target`` is given."""
    selected = asof.require_single_model(asof.scenario_as_of(scenarios, as_of, region=region))
    if target is not None:
        store.publish(selected, target)
    return selected


def archive_job(archive: DataFrame, weight_history: DataFrame | None = None, weights: DataFrame | None = None, weight: str = "gas_load",
                require_complete_weeks: bool = True, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Regional members and weekly scenarios of a checked state archive; all three are published when ``target`` is given."""
    archive = staged(archive, "archive")
    checks.enforce(checks.forecast_archive(archive), "forecast archive")
    if weight_history is not None:
        members = rollups.region_members(archive, asof.weights_at_issues(archive, weight_history, weight), by_issue=True)
    else:
        members = rollups.region_members(archive, weights)
    kept = _kept({"archive": archive, "members": members, "scenarios": rollups.weekly_scenarios(members, require_complete_weeks)}, target)
    return kept["members"], kept["scenarios"]


def regional_backtest(features_table: DataFrame, feature_cols: Sequence[str], spec: splits.FoldSpec, model: linear.LinearSpec,
                      model_key: str, horizon: int = 4, coverage: float | None = 0.8, minimum: int = 20,
                      target: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base forecasts of all six regions, their reconciled paths and the metric table; published when ``target`` is given."""
    base = recursive.backtest(features_table, ["duoarea"], feature_cols, spec, model, horizon, model_key=model_key, coverage=coverage, minimum=minimum)
    base = base.withColumnRenamed("duoarea", "region").drop("features")
    base = staged(base, "base")
    keep = ["forecast_origin", "date", "horizon", "region", "predicted_weekly_change", "actual_weekly_change", "p10", "p50", "p90", "model_key"]
    paths = reconcile.all_paths(base.select(*keep))
    summary = metrics.ablation_summary(paths, ["reconciliation_method", "model_key", "region", "horizon"])
    kept = _kept({"base": base, "paths": paths, "summary": summary}, target)
    return kept["base"], kept["paths"], kept["summary"]


def power_history(vintages: DataFrame, actuals: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    return power.component_history(vintages, actuals, weather)


#: Non-thermal series that a forecast may not take below zero; imports and storage have a sign.
UNSIGNED = ("nuclear_mw", "hydro_mw", "other_nonthermal_mw")
OUTAGES = ("conventional_outage_mw", "renewable_outage_mw", "new_equipment_outage_mw")


def delivery_hours(spark: SparkSession, origin, horizon_hours: int) -> DataFrame:
    """The ``horizon_hours`` (1 to 168) delivery hours that follow the origin."""
    if not 1 <= horizon_hours <= 168:
        raise ValueError("horizon_hours must be between 1 and 168.")
    first = F.date_trunc("hour", origin) + F.expr("INTERVAL 1 HOUR")
    return spark.range(1).select(F.posexplode(F.sequence(F.lit(0), F.lit(horizon_hours - 1))).alias("_p", "_k")).select(
        origin.alias("forecast_origin"), F.timestamp_add("HOUR", F.col("_k"), first).alias("delivery_hour"),
        (F.col("_k") + 1).cast("int").alias("horizon_hour"),
    )


def system_inputs(hours: DataFrame, origin, nonthermal: DataFrame | None = None, outages: DataFrame | None = None,
                  adequacy: DataFrame | None = None) -> DataFrame:
    """``delivery_hour`` with what the stack needs beside load, wind and solar, all as known at ``origin``.

    ``nonthermal``: series (as in ``power.NONTHERMAL``), valid_at, actual_mw. Each series goes on with its hour-of-week profile and
    latest level; without history it is zero, and ``profile_sources`` says so. ``outages`` and ``adequacy`` are vintages; an hour
    without a known outage has none, one without a known capacity has no capacity.
    """
    wanted = hours.select("delivery_hour", F.explode(F.array(*[F.lit(c) for c in power.NONTHERMAL])).alias("series"))
    if nonthermal is None:
        shaped = wanted.withColumns({"profile_forecast_mw": F.lit(0.0), "profile_source": F.lit("zero_missing_history")})
    else:
        shaped = rollups.hour_of_week_forecast(nonthermal, wanted, "actual_mw", ["series"], origin, nonnegative=False)
    value = F.col("profile_forecast_mw")
    value = F.when(F.col("series").isin(*UNSIGNED), F.greatest(value, F.lit(0.0))).otherwise(value)
    tags = [F.concat(F.lit(f"{c}:"), F.max(F.when(F.col("series") == c, F.col("profile_source")))) for c in power.NONTHERMAL]
    out = shaped.withColumn("_v", value).groupBy("delivery_hour").agg(
        *[F.max(F.when(F.col("series") == c, F.col("_v"))).alias(c) for c in power.NONTHERMAL], F.concat_ws(";", *tags).alias("profile_sources"),
    )
    for table, columns in ((outages, OUTAGES), (adequacy, ("available_capacity_mw",))):
        have = [] if table is None else [c for c in columns if c in table.columns]
        if have:
            known = asof.select_as_of(table.select("valid_at", "issued_at", "retrieved_at", *have), origin, [])
            out = out.join(known.select(F.col("valid_at").alias("delivery_hour"), *have), "delivery_hour", "left")
        out = out.withColumns({c: F.lit(None).cast("double") for c in columns if c not in have})
    return out.fillna(0.0, list(OUTAGES))


def power_forecast(vintages: DataFrame, actuals: DataFrame, fuel: DataFrame, origin, heat_rate: float = power.DEFAULT_RATE,
                   gas_price=None, horizon_hours: int = 168, min_train: int = 100, nonthermal: DataFrame | None = None,
                   outages: DataFrame | None = None, adequacy: DataFrame | None = None, prices: DataFrame | None = None,
                   target: str | None = None) -> DataFrame:
    """System forecast of one origin: as-of baselines, corrections, physical stack and intervals; published when ``target`` is given.

    ``origin`` is a timestamp column expression without row references. The fuel split uses ``gas_price``, else the newest of the daily
    ``prices`` before the origin, else 3.0. The other tables are those of :func:`system_inputs`.
    """
    from pitcast.functions.calendar import add_hourly_features, horizon_bucket
    from pitcast.operators.intervals import bucket_bounds

    spark = vintages.sparkSession
    hours = delivery_hours(spark, origin, horizon_hours)
    spine = hours.withColumn("component", F.explode(F.array(*[F.lit(c) for c in power.COMPONENTS])))
    known = asof.select_as_of(vintages.select("component", "valid_at", "issued_at", "retrieved_at", "baseline_mw"), origin, ["component"])
    future = spine.join(known.select("component", F.col("valid_at").alias("delivery_hour"), "baseline_mw", "issued_at"), ["component", "delivery_hour"], "left")
    real = actuals.select("component", "valid_at", "actual_mw")
    future = rollups.fill_missing_baseline(future, real, "actual_mw", ["component"], origin)
    history = power.component_history(vintages, actuals)
    at = spine.select("component", "forecast_origin").distinct()
    errors = power.recent_error(history, at)
    future = future.join(errors, ["component", "forecast_origin"], "left").withColumn("recent_error_mw", F.coalesce("recent_error_mw", F.lit(0.0)))
    future, history = staged(add_hourly_features(future), "future"), staged(add_hourly_features(history), "history")
    corrected, validation = power.correct(history, future, origin, min_train=min_train)
    validation = staged(validation, "validated")
    errors = validation.withColumn("abs_error", F.abs(F.col("actual_mw") - F.col("corrected_mw")))
    bounded = staged(bucket_bounds(corrected, errors, "forecast_mw", "forecast", keys=["component"]), "bounded")
    picks = []
    for c in power.COMPONENTS:
        for src, dst in (("forecast_mw", f"{c}_forecast_mw"), ("baseline_mw", f"{c}_baseline_mw"), ("forecast_source", f"{c}_forecast_source"),
                         ("baseline_source", f"{c}_baseline_source"), ("forecast_lower_mw", f"{c}_lower_mw"), ("forecast_upper_mw", f"{c}_upper_mw")):
            picks.append(F.max(F.when(F.col("component") == c, F.col(src))).alias(dst))
    wide = bounded.groupBy("forecast_origin", "delivery_hour", "horizon_hour").agg(*picks).withColumn("horizon_bucket", horizon_bucket("horizon_hour"))
    wide = wide.join(system_inputs(hours, origin, nonthermal, outages, adequacy), "delivery_hour")
    retrieved = vintages.where(F.col("retrieved_at") <= origin).agg(F.max("retrieved_at")).scalar()
    wide = wide.withColumns({"geography": F.lit(vendors.GEOGRAPHY), "retrieved_at": retrieved})
    price = F.lit(3.0) if gas_price is None else gas_price
    if gas_price is None and prices is not None:
        price = payloads.latest_price(prices.where(F.col("period") < F.to_date(origin))).scalar()
    stack = power.physical_stack(wide, heat_rate)
    split = power.gas_split(stack.drop("gas_generation_mw", "gas_generation_source"), fuel, origin, price)
    stack = power.physical_stack(split.drop("dispatchable_thermal_mw"), heat_rate, F.col("gas_forecast_mw"), F.col("gas_split_source"))
    stack = staged(stack.drop("gas_forecast_mw", "gas_split_source"), "stack")
    net = power.net_load_errors(validation)
    stack = bucket_bounds(stack, net, "net_load_mw", "net_load", clip=False)
    out = power.gas_interval(stack, fuel, origin)
    if target is not None:
        store.publish(staged(out, "forecast"), target)
    return out


def crude_job(long: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Crude balance and the forecast of the week after its newest row; with the input, published when ``target`` is given."""
    balance = crude.weekly_balance(long)
    kept = _kept({"observations": long, "balance": balance, "forecast": crude.forecast(balance, crude.next_week_target(balance))}, target)
    return kept["balance"], kept["forecast"]


def check_features(df: DataFrame) -> DataFrame:
    checks.enforce(checks.model_features(df), "model feature table")
    return df
