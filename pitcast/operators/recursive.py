"""Multi-step recursive forecasts of all series and origins at once.

Everything a step needs besides its own earlier predictions (seasonal weather, same-week averages,
year-ago levels) depends only on the series, the origin and the step, so it is looked up for all
steps first. A linear model is then folded over the at most 52 steps of each origin by one
higher-order expression; no step needs a shuffle, a checkpoint or Python. Tree models advance one
DataFrame transform per step over all origins together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import DEGREE_DAY_BASE_F, INJECTION_MONTHS, iso_year
from pitcast.functions.columns import at_least, require_columns
from pitcast.operators.asof import latest_at_origins
from pitcast.session import staged

WEATHER = ("temperature_f", "hdd", "cdd", "weather_days")
WEATHER_DEFAULTS = {"temperature_f": 50.0, "hdd": 0.0, "cdd": 0.0, "weather_days": 7.0, "local_balance": 0.0}
BALANCE_FEATURES = ("net_inflow_balancing_lag1", "net_inflow_balancing_rolling_4wk", "local_balance_lag1")
RECURSIVE_FEATURES = (
    "week_sin", "week_cos", "month_sin", "month_cos", "hdd", "cdd", "hdd_lag1", "hdd_rolling_4wk", "cdd_rolling_4wk",
    "weekly_change_lag1", "weekly_change_rolling_4wk", "storage_vs_5yr_avg", "storage_vs_last_year",
    "is_injection_season", *BALANCE_FEATURES,
)
MAX_STEPS = 52
MODES = ("seasonal", "observed", "scenario")


def check_request(features: Sequence[str], horizon: int, mode: str) -> None:
    unknown = sorted(set(features) - set(RECURSIVE_FEATURES))
    if unknown:
        raise ValueError(f"These features cannot be rebuilt for future weeks: {unknown}")
    if not 1 <= horizon <= MAX_STEPS:
        raise ValueError(f"horizon must be between 1 and {MAX_STEPS} weeks.")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}.")


def _last_four(df: DataFrame, value: str, keys: Sequence[str]) -> Column:
    """Array of the last four non-null values up to each row."""
    null_side = F.col(value).isNull()
    frame = W.partitionBy(*keys, null_side).orderBy("date").rowsBetween(-3, 0)
    filled = F.when(~null_side, F.collect_list(value).over(frame))
    return filled


def _history_state(df: DataFrame, keys: Sequence[str], balance: bool) -> DataFrame:
    """Per row: everything known about the series once that row is history."""
    lists = {"hdd": "hdd4", "cdd": "cdd4", "weekly_change_bcf": "chg4"}
    profile = list(WEATHER)
    if balance:
        lists |= {"local_balance": "bal4", "net_inflow_balancing": "inf4"}
        profile.append("local_balance")
    week = W.partitionBy(*keys, "week_of_year").orderBy("date")
    upto, before = week.rowsBetween(W.unboundedPreceding, 0), week.rowsBetween(W.unboundedPreceding, -1)
    cols: dict[str, Column] = {}
    for c in profile:
        after, earlier = F.avg(c).over(upto), F.avg(c).over(before)
        cols[f"_m_{c}"] = after
        cols[f"_d_{c}"] = F.coalesce(after, F.lit(0.0)) - F.coalesce(earlier, F.lit(0.0))
        cols[f"_f_{c}"] = (after.isNotNull() & earlier.isNull()).cast("int")
    five = W.partitionBy(*keys, "week_of_year", F.col("storage_bcf").isNull()).orderBy("date").rowsBetween(-4, 0)
    cols["_avg5"] = F.when(F.col("storage_bcf").isNotNull(), F.avg("storage_bcf").over(five))
    rows = df.withColumns(cols).withColumns({name: _last_four(df, c, keys) for c, name in lists.items()})
    run = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    state = {name: F.last(name, ignorenulls=True).over(run) for name in lists.values()}
    state["_storage"] = F.last("storage_bcf", ignorenulls=True).over(run)
    for c in profile:
        # Mean of the current per-week means: their changes and first appearances add up along time.
        state[f"_o_{c}"] = F.sum(f"_d_{c}").over(run) / F.nullif(F.sum(f"_f_{c}").over(run), F.lit(0))
    return rows.withColumns(state)


def _strictly_before(asked: DataFrame, facts: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Attach the last fact dated strictly before ``at`` to every asked row, by one shared window."""
    a = asked.select(*keys, F.unix_date(at).alias("_at"), F.struct(*[c for c in asked.columns if c not in keys]).alias("_a"))
    f = facts.select(*keys, F.unix_date("date").alias("_at"), F.struct(*[c for c in facts.columns if c not in (*keys,)]).alias("_f"))
    w = W.partitionBy(*keys).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    both = a.unionByName(f, allowMissingColumns=True).withColumn("_f", F.last("_f", ignorenulls=True).over(w))
    kept = both.where(F.col("_a").isNotNull())
    return kept.select(
        *keys, *[F.col(f"_a.{c}").alias(c) for c in asked.columns if c not in keys],
        *[F.col(f"_f.{c}").alias(c) for c in facts.columns if c not in (*keys, "date")],
        F.col("_f.date").alias("_fact_date"),
    )


def step_inputs(df: DataFrame, origins: DataFrame, keys: Sequence[str], horizon: int, mode: str = "seasonal",
                scenarios: DataFrame | None = None, balance: bool = False, temp_anomaly: float = 0.0) -> DataFrame:
    """One row per (series, origin): starting state and an array of step inputs.

    ``origins`` holds the keys, ``fold``, ``start_date`` (a Friday), ``n_steps`` and optionally ``as_of``.
    """
    needed = [*keys, "date", "storage_bcf", "weekly_change_bcf", "week_of_year", *WEATHER]
    require_columns(df, needed + (["local_balance"] if balance else []), "feature table")
    if balance and "net_inflow_balancing" not in df.columns:
        df = df.withColumn("net_inflow_balancing", F.col("weekly_change_bcf") - F.col("local_balance"))
    keep = needed + (["local_balance", "net_inflow_balancing"] if balance else [])
    df = df.select(*dict.fromkeys(keep))
    rich = staged(_history_state(df, keys, balance), "states")
    df = rich.select(*df.columns)
    profile = [*WEATHER, *(["local_balance"] if balance else [])]
    lists = ["hdd4", "cdd4", "chg4", *(["bal4", "inf4"] if balance else [])]

    facts = rich.select(*keys, "date", "_storage", *lists, *[f"_o_{c}" for c in profile])
    state = _strictly_before(origins, facts, keys, "start_date").withColumnRenamed("_fact_date", "_history_end")
    as_of = F.coalesce("as_of", "_history_end") if "as_of" in origins.columns else F.col("_history_end")
    state = state.withColumn("forecast_origin", as_of).where(F.col("_storage").isNotNull())

    steps = F.sequence(F.lit(1), F.least(F.col("n_steps"), F.lit(horizon)))
    plan = state.select(*keys, "fold", "start_date", "forecast_origin", F.explode(steps).alias("h"))
    plan = plan.withColumn("target", F.expr("date_add(start_date, 7 * (h - 1))")).withColumns(
        {"prev": F.date_sub("target", 7), "far": F.date_sub("target", 53 * 7)}
    )
    bound = F.least("start_date", "prev")
    asked = plan.select(*keys, "fold", "h", F.explode(F.array(
        F.struct(F.lit("profile").alias("kind"), F.weekofyear("target").alias("week"), F.col("start_date").alias("at")),
        F.struct(F.lit("five").alias("kind"), F.weekofyear("prev").alias("week"), bound.alias("at")),
        F.struct(F.lit("far").alias("kind"), F.weekofyear("far").alias("week"), bound.alias("at")),
    )).alias("q")).select(*keys, "fold", "h", "q.kind", F.col("q.week").alias("week_of_year"), F.col("q.at").alias("at"))
    week_keys = [*keys, "week_of_year"]
    # Same-week averages skip weeks without storage, so their last non-null value is carried on.
    carry = W.partitionBy(*week_keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    week_facts = rich.withColumn("_avg5", F.last("_avg5", ignorenulls=True).over(carry)).select(
        *week_keys, "date", "_avg5", *[f"_m_{c}" for c in profile]
    )
    looked = _strictly_before(asked, week_facts, week_keys, "at")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    per_step = looked.groupBy(*keys, "fold", "h").agg(
        *[pick("profile", f"_m_{c}").alias(f"_m_{c}") for c in profile],
        pick("five", "_avg5").alias("avg5"), pick("far", "_avg5").alias("far_avg"),
    )
    levels = df.where(F.col("storage_bcf").isNotNull())
    year_ago = levels.groupBy(*keys, (iso_year("date") + 1).alias("_iy"), F.weekofyear("date").alias("_iw")).agg(
        F.min_by("storage_bcf", "date").alias("year_ago")
    )
    exact = levels.select(*keys, F.col("date").alias("far"), F.col("storage_bcf").alias("far_level"))
    observed = df.select(*keys, F.col("date").alias("target"), *[F.col(c).alias(f"_w_{c}") for c in profile],
                         F.col("weekly_change_bcf").alias("actual_change"), F.col("storage_bcf").alias("actual_storage"))
    full = (
        plan.withColumns({"_iy": iso_year("prev"), "_iw": F.weekofyear("prev")})
        .join(per_step, [*keys, "fold", "h"])
        .join(year_ago, [*keys, "_iy", "_iw"], "left")
        .join(exact, [*keys, "far"], "left")
        .join(observed, [*keys, "target"], "left")
        .join(state.select(*keys, "fold", *[f"_o_{c}" for c in profile]), [*keys, "fold"])
    )
    weather = {c: F.coalesce(f"_m_{c}", f"_o_{c}", F.lit(WEATHER_DEFAULTS[c])) for c in profile}
    extra = {}
    if mode == "observed":
        weather = {c: F.coalesce(F.col(f"_w_{c}"), weather[c]) for c in profile}
        extra = {"weather_provider": F.lit("observed_oracle")}
    elif mode == "scenario":
        asked_s = full.select(*keys, F.col("target").alias("date"), "fold", "h", F.col("forecast_origin").cast("timestamp").alias("_as_of"))
        wanted = [c for c in (*WEATHER, "provider", "model", "model_run") if c in scenarios.columns]
        known = latest_at_origins(
            asked_s, scenarios.select(*keys, "date", F.col("issued_at").cast("timestamp").alias("issued_at"), *wanted),
            [*keys, "date"], "_as_of", "issued_at",
        ).withColumnRenamed("date", "target").drop("_as_of").withColumnsRenamed({c: f"_s_{c}" for c in wanted})
        full = full.join(known, [*keys, "target", "fold", "h"])
        need = lambda c: F.when(F.col(f"_s_{c}").isNull(), F.raise_error(F.lit(f"weather scenario has no usable {c}"))).otherwise(F.col(f"_s_{c}"))
        weather |= {c: need(c) for c in WEATHER}
        extra = {"weather_provider": F.coalesce("_s_provider", F.lit("archived_forecast")) if "provider" in wanted else F.lit("archived_forecast")}
    if not extra:
        extra = {"weather_provider": F.lit("seasonal_norm")}
    full = full.withColumns({f"x_{c}": v for c, v in weather.items()} | extra)
    full = full.withColumn("x_weather_days", F.greatest("x_weather_days", F.lit(1.0)))
    if temp_anomaly:
        t = F.col("x_temperature_f") + F.lit(float(temp_anomaly))
        full = full.withColumns({
            "x_hdd": at_least(F.lit(DEGREE_DAY_BASE_F) - t, 0.0) * F.col("x_weather_days"),
            "x_cdd": at_least(t - F.lit(DEGREE_DAY_BASE_F), 0.0) * F.col("x_weather_days"),
        })
    step = F.struct(
        "h", "target", "avg5", F.coalesce("year_ago", "far_level", "far_avg").alias("year_ago"), "weather_provider",
        F.weekofyear("target").alias("week"), F.month("target").alias("month"),
        F.col("x_hdd").alias("hdd"), F.col("x_cdd").alias("cdd"), "actual_change", "actual_storage",
        (F.col("x_local_balance") if balance else F.lit(0.0)).alias("local_balance"),
    )
    arrays = full.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return state.select(*keys, "fold", "forecast_origin", "_storage", *lists).join(arrays, [*keys, "fold"])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _append(values: Column, value: Column) -> Column:
    longer = F.concat(values, F.array(value))
    return F.slice(longer, F.greatest(F.size(longer) - 3, F.lit(1)), 4)


def _step_features(s: Column, x: Column, names: Sequence[str]) -> list[Column]:
    """Model inputs of one step from the state ``s`` and the step inputs ``x``."""
    week = F.lit(2 * math.pi / 52) * x["week"]
    month = F.lit(2 * math.pi / 12) * x["month"]
    last = lambda a: F.element_at(s[a], -1)
    table = {
        "week_sin": lambda: F.sin(week), "week_cos": lambda: F.cos(week),
        "month_sin": lambda: F.sin(month), "month_cos": lambda: F.cos(month),
        "hdd": lambda: x["hdd"], "cdd": lambda: x["cdd"],
        "hdd_lag1": lambda: last("hdd4"), "hdd_rolling_4wk": lambda: _mean(s["hdd4"]),
        "cdd_rolling_4wk": lambda: _mean(s["cdd4"]),
        "weekly_change_lag1": lambda: last("chg4"), "weekly_change_rolling_4wk": lambda: _mean(s["chg4"]),
        "storage_vs_5yr_avg": lambda: s["storage"] - F.coalesce(x["avg5"], s["storage"]),
        "storage_vs_last_year": lambda: s["storage"] - F.coalesce(x["year_ago"], s["storage"]),
        "is_injection_season": lambda: x["month"].isin(*INJECTION_MONTHS).cast("double"),
        "net_inflow_balancing_lag1": lambda: last("inf4"),
        "net_inflow_balancing_rolling_4wk": lambda: _mean(s["inf4"]),
        "local_balance_lag1": lambda: last("bal4"),
    }
    return [table[n]().cast("double") for n in names]


def _needs_balance(features: Sequence[str]) -> bool:
    return bool(set(features) & set(BALANCE_FEATURES))


def _next_state(s: Column, x: Column, change: Column, balance: bool) -> list[Column]:
    fields = [
        (s["storage"] + change).alias("storage"),
        _append(s["hdd4"], x["hdd"]).alias("hdd4"),
        _append(s["cdd4"], x["cdd"]).alias("cdd4"),
        _append(s["chg4"], change).alias("chg4"),
    ]
    if balance:
        fields += [
            _append(s["bal4"], x["local_balance"]).alias("bal4"),
            _append(s["inf4"], change - x["local_balance"]).alias("inf4"),
        ]
    return fields


OUT_TYPE = "array<struct<h:int,change:double,storage:double,features:array<double>>>"


def _publish(rows: DataFrame, keys: Sequence[str], model_key: str) -> DataFrame:
    change = F.col("_o.change")
    return rows.select(
        *keys, "fold", F.col("_x.target").alias("date"), "forecast_origin", F.col("_x.h").cast("int").alias("horizon"),
        F.lit(model_key).alias("model_key"), F.lit("unreconciled").alias("reconciliation_method"),
        F.col("_x.weather_provider").alias("weather_provider"),
        change.alias("predicted_weekly_change"), F.lit(None).cast("double").alias("p10"), change.alias("p50"),
        F.lit(None).cast("double").alias("p90"), F.col("_o.storage").alias("projected_storage"),
        F.col("_x.actual_change").alias("actual_weekly_change"), F.col("_x.actual_storage").alias("actual_storage"),
        F.col("_x.week").alias("week_of_year"), F.col("_o.features").alias("features"),
    )


def project_linear(inputs: DataFrame, params: DataFrame, keys: Sequence[str], features: Sequence[str],
                   model_key: str = "linear_regression") -> DataFrame:
    """Fold a linear model over the steps of every (series, origin)."""
    balance = _needs_balance(features)
    rows = inputs.join(params.select(*keys, "fold", "coef"), [*keys, "fold"])
    lists = ["hdd4", "cdd4", "chg4", *(["bal4", "inf4"] if balance else [])]
    start = F.struct(F.col("_storage").alias("storage"), *lists, F.array().cast(OUT_TYPE).alias("out"))

    def advance(s: Column, x: Column) -> Column:
        # Single-element arrays bind the features and the prediction once each.
        def with_features(v: Column) -> Column:
            products = F.zip_with(v, F.slice("coef", 2, len(features)), lambda a, b: a * b)
            change = F.aggregate(products, F.col("coef")[0], lambda a, b: a + b)

            def with_change(p: Column) -> Column:
                record = F.struct(x["h"].alias("h"), p.alias("change"), (s["storage"] + p).alias("storage"), v.alias("features"))
                return F.struct(*_next_state(s, x, p, balance), F.concat(s["out"], F.array(record)).alias("out"))

            return F.transform(F.array(change), with_change)[0]

        return F.transform(F.array(F.array(*_step_features(s, x, features))), with_features)[0]

    folded = rows.withColumn("_out", F.aggregate("steps", start, advance, lambda s: s["out"]))
    return _publish(
        folded.select(*keys, "fold", "forecast_origin", F.explode(F.arrays_zip("steps", "_out")).alias("_z"))
        .select(*keys, "fold", "forecast_origin", F.col("_z.steps").alias("_x"), F.col("_z._out").alias("_o")),
        keys, model_key,
    )


def project_with_model(inputs: DataFrame, model, keys: Sequence[str], features: Sequence[str], horizon: int,
                       model_key: str) -> DataFrame:
    """Advance all origins together with a fitted MLlib model, one transform per step."""
    balance = _needs_balance(features)
    lists = ["hdd4", "cdd4", "chg4", *(["bal4", "inf4"] if balance else [])]
    state = inputs.select(*keys, "fold", "forecast_origin", "steps", F.struct(F.col("_storage").alias("storage"), *lists).alias("_s"))
    parts = []
    for h in range(1, horizon + 1):
        now = state.where(F.size("steps") >= h).withColumn("_x", F.element_at("steps", h))
        cols = _step_features(F.col("_s"), F.col("_x"), features)
        now = model.transform(now.withColumns(dict(zip(features, cols))))
        record = F.struct(
            F.col("prediction").alias("change"), (F.col("_s.storage") + F.col("prediction")).alias("storage"),
            F.array(*[F.col(f).cast("double") for f in features]).alias("features"),
        )
        parts.append(now.select(*keys, "fold", "forecast_origin", "_x", record.alias("_o")))
        state = now.select(*keys, "fold", "forecast_origin", "steps",
                           F.struct(*_next_state(F.col("_s"), F.col("_x"), F.col("prediction"), balance)).alias("_s"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _publish(out, keys, model_key)


def fold_origins(validation: DataFrame, keys: Sequence[str], train_last: DataFrame | None = None) -> DataFrame:
    """Start date, step count and last training date of each fold."""
    out = validation.groupBy(*keys, "fold").agg(F.min("date").alias("start_date"), F.count(F.lit(1)).cast("int").alias("n_steps"))
    return out if train_last is None else out.join(train_last, [*keys, "fold"])


def backtest(df: DataFrame, keys: Sequence[str], features: Sequence[str], spec, model=None, horizon: int = 4,
             mode: str = "seasonal", scenarios: DataFrame | None = None, model_key: str = "linear_regression",
             coverage: float | None = None, minimum: int = 20) -> DataFrame:
    """Recursive rolling-origin backtest of all series and folds in one job."""
    from pitcast.operators import linear, splits
    from pitcast.operators.intervals import rolling_intervals

    check_request(features, horizon, mode)
    target = "weekly_change_bcf"
    balance = _needs_balance(features)
    extra = [c for c in ("local_balance", "net_inflow_balancing") if balance and c in df.columns]
    df = staged(df.select(*dict.fromkeys([*keys, "date", "week_of_year", "storage_bcf", target, *WEATHER, *extra, *features])), "features")
    clean = df.dropna(subset=[*features, target])
    folds = splits.fold_table(clean, "date", spec)
    params = linear.fit_folds(clean, keys, features, target, "date", spec, folds, model or linear.OLS)
    extents = splits.fold_extents(clean, "date", spec, folds, keys).where("n_val > 0 AND n_train > 0")
    origins = extents.select(*keys, "fold", F.col("first_val").alias("start_date"), F.col("n_val").cast("int").alias("n_steps"), F.col("last_train").alias("as_of"))
    inputs = step_inputs(df, origins, keys, horizon, mode, scenarios, balance)
    out = project_linear(inputs, params, keys, features, model_key).withColumn("forecast_input_mode", F.lit(mode))
    if coverage is None:
        return out
    out = rolling_intervals(out, "actual_weekly_change", coverage=coverage, minimum=minimum, group=[*keys, "horizon"])
    if abs(coverage - 0.8) < 1e-9:
        out = out.withColumns({"p10": F.col("interval_lower"), "p90": F.col("interval_upper")})
    return out
