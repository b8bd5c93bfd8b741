"""Hourly power: component histories, physical stack, fuel split and residual correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import cyclic, horizon_bucket, hour_of_week, hours_between, local_time
from pitcast.functions.columns import at_least, at_most
from pitcast.operators import linear
from pitcast.operators.asof import first_origin_knowing, hourly_as_of
from pitcast.operators.intervals import conformal_radius
from pitcast.operators.metrics import bucket_comparison
from pitcast.operators.ordered import framed
from pitcast.session import staged

# Fuel heat content, low/high heat rates, default heat rate, share lags per bucket.
BTU_PER_BCF_MMBTU = 1_037_000.0
LOW_RATE, DEFAULT_RATE, HIGH_RATE = 7.0, 7.5, 8.0
SHARE_ROWS = 720
SHARE_LAGS = {"h001_024": 12, "h025_072": 48, "h073_168": 120}
COMPONENTS = ("load", "wind", "solar")
NONTHERMAL = ("nuclear_mw", "hydro_mw", "other_nonthermal_mw", "net_imports_mw", "battery_net_discharge_mw")
CORRECTION_FEATURES = ("baseline_mw", "horizon_hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "recent_error_mw")
RECENT_HOURS = 24


def _known_from(df: DataFrame, origin: str = "forecast_origin") -> Column:
    """First instant at which a realized forecast row may be used."""
    tick = F.expr("INTERVAL '0.000001' SECOND")
    parts = [F.col(origin) + tick, F.col("delivery_hour") + tick]
    if "retrieved_at" in df.columns:
        parts.append(F.col("retrieved_at"))
    return F.greatest(*parts)


def _merged(mine: Column, other: Column) -> Column:
    """The newest ``RECENT_HOURS`` delivered hours of two such lists, each hour with its latest forecast."""
    both = F.sort_array(F.concat(mine, F.coalesce(other, F.slice(mine, 1, 0))), False)
    latest = F.transform(F.array(both), lambda s: F.slice(
        F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["delivery_hour"] != x["delivery_hour"])), 1, RECENT_HOURS
    ))
    return latest[0]


def _newest_hours(rows: DataFrame, origins: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The last 24 delivered hours known at each origin ``_at``, each with the ``_v.value`` of its latest known forecast.

    What becomes known at an origin is a list of at most 24 hours, and two lists merge into one: an hour that falls out of one
    has 24 newer ones there and so in every merge. The lists are carried along a key's origins by doubling:
    after k steps each origin holds what the last 2^k ones brought. Origins never meet the history, whose rows are read once.
    """
    keyed = first_origin_knowing(
        rows.select(*keys, "forecast_origin", "delivery_hour", *(["retrieved_at"] if "retrieved_at" in rows.columns else []), value.alias("value")),
        origins, "forecast_origin", _known_from(rows), "_at",
    )
    reduced = keyed.groupBy(*keys, "_at", "delivery_hour").agg(F.max(F.struct("forecast_origin", "value")).alias("_v"))
    newest = W.partitionBy(*keys, "_at").orderBy(F.col("delivery_hour").desc())
    brought = reduced.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= RECENT_HOURS)
    asked = origins.select(*keys, F.col("forecast_origin").alias("_at"), F.lit(True).alias("_q")).distinct()
    along = W.partitionBy(*keys).orderBy("_at")
    line = brought.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_at").agg(
        F.sort_array(F.collect_list(F.when(F.col("delivery_hour").isNotNull(), F.struct("delivery_hour", "_v"))), False).alias("_hours"),
        F.coalesce(F.bool_or("_q"), F.lit(False)).alias("_q"),
    )
    line = staged(line, "known_hours")
    longest = line.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    for step in range(max(0, longest - 1).bit_length()):
        line = line.withColumn("_earlier", F.lag("_hours", 1 << step).over(along)).withColumn("_hours", _merged(F.col("_hours"), F.col("_earlier")))
    return line.where("_q").select(*keys, "_at", F.explode("_hours").alias("_h")).select(*keys, "_at", "_h.delivery_hour", "_h._v")


def recent_error(history: DataFrame, origins: DataFrame, keys: Sequence[str] = ("component",)) -> DataFrame:
    """Mean error of the last 24 delivered hours known at each origin."""
    realized = history.where(F.col("actual_mw").isNotNull() & F.col("baseline_mw").isNotNull())
    top = _newest_hours(realized, origins, keys, F.col("actual_mw") - F.col("baseline_mw"))
    return top.groupBy(*keys, F.col("_at").alias("forecast_origin")).agg(F.avg("_v.value").alias("recent_error_mw"))


def realized_history(vintages: DataFrame, actuals: DataFrame) -> DataFrame:
    """Component forecasts of the next week with realized values, horizon and bucket.

    ``vintages``: component, issued_at, valid_at, baseline_mw, actual_mw[, retrieved_at].
    ``actuals``: component, valid_at, actual_mw; a realized value overrides the vendor's own.
    """
    data = vintages.withColumnsRenamed({"issued_at": "forecast_origin", "valid_at": "delivery_hour"})
    real = actuals.select("component", F.col("valid_at").alias("delivery_hour"), F.col("actual_mw").alias("_real"))
    data = data.join(real, ["component", "delivery_hour"], "left").withColumn("actual_mw", F.coalesce("_real", "actual_mw")).drop("_real")
    data = data.withColumn("horizon_hour", hours_between("delivery_hour", "forecast_origin"))
    return data.where(F.col("horizon_hour").between(1, 168)).withColumn("horizon_bucket", horizon_bucket("horizon_hour"))


def component_history(vintages: DataFrame, actuals: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Realized history with the recent error and, if given, the weather known at each origin."""
    data = staged(realized_history(vintages, actuals), "history")
    errors = recent_error(data, data.select("component", "forecast_origin").distinct())
    data = data.join(errors, ["component", "forecast_origin"], "left").withColumn(
        "recent_error_mw", F.coalesce("recent_error_mw", F.lit(0.0))
    )
    return data if weather is None else hourly_as_of(data, weather)


def physical_stack(df: DataFrame, heat_rate: float = DEFAULT_RATE, gas: Column | None = None,
                   gas_source: Column | None = None) -> DataFrame:
    """Hourly system balance. ``gas`` is the unclipped gas forecast; half of thermal when absent."""
    if heat_rate <= 0:
        raise ValueError("heat_rate must be positive.")
    nonthermal = sum((F.col(c) for c in NONTHERMAL[1:]), F.col(NONTHERMAL[0]))
    df = df.withColumn("net_load_mw", F.col("load_forecast_mw") - F.col("wind_forecast_mw") - F.col("solar_forecast_mw"))
    df = df.withColumn("raw_residual_mw", F.col("net_load_mw") - nonthermal)
    zero = F.lit(0.0)
    df = df.withColumns({
        "dispatchable_thermal_mw": at_least(F.col("raw_residual_mw"), zero),
        "curtailment_mw": at_least(-F.col("raw_residual_mw"), zero),
    })
    thermal = F.col("dispatchable_thermal_mw")
    want = gas if gas is not None else thermal * 0.5
    df = df.withColumns({
        "gas_generation_mw": at_most(at_least(want, zero), thermal),
        "gas_generation_source": gas_source if gas_source is not None else F.lit("recent_share_fallback"),
    })
    df = df.withColumn("coal_other_generation_mw", thermal - F.col("gas_generation_mw"))
    burn = {f"gas_burn_bcf_{n}": F.col("gas_generation_mw") * F.lit(float(r)) / BTU_PER_BCF_MMBTU
            for n, r in (("low", LOW_RATE), ("base", heat_rate), ("high", HIGH_RATE))}
    margin = (F.col("available_capacity_mw") if "available_capacity_mw" in df.columns else F.lit(None).cast("double")) - F.col("load_forecast_mw")
    df = df.withColumns({
        **burn,
        "heat_rate_mmbtu_per_mwh": F.lit(float(heat_rate)),
        "capacity_margin_mw": margin,
        "capacity_shortfall_mw": at_least(-margin, zero),
        "balanced_supply_mw": F.col("wind_forecast_mw") + F.col("solar_forecast_mw") + nonthermal
        + F.col("gas_generation_mw") + F.col("coal_other_generation_mw") - F.col("curtailment_mw"),
    })
    return df.withColumn("balance_error_mw", F.col("balanced_supply_mw") - F.col("load_forecast_mw"))


def recent_gas_share(history: DataFrame, origin: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean gas share of gas plus coal over the last 720 hours with any of them.

    The newest hours are found by a limit that every task applies to its own rows first.
    """
    total = F.col("gas_mw") + F.col("coal_mw")
    known = history.where((F.col("valid_at") < origin) & (total > 0))
    w = W.partitionBy(*keys).orderBy(F.col("valid_at").desc())
    newest = known.select(*keys, "valid_at", (F.col("gas_mw") / total).alias("_s")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= SHARE_ROWS)
    share = newest.groupBy(*keys).agg(F.avg("_s").alias("_share"))
    counted = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hours"))
    if not keys:
        return counted.select(F.coalesce(share.select("_share").scalar(), F.lit(0.5)).alias("gas_share"), "n_hours")
    return counted.join(share, list(keys)).select(*keys, F.coalesce("_share", F.lit(0.5)).alias("gas_share"), "n_hours")


FUEL_FEATURES = ("thermal_mw", "hour_sin", "hour_cos", "conventional_outage_mw", "gas_price")


def _fuel_inputs(df: DataFrame, time: str, thermal: str, gas_price: Column) -> DataFrame:
    hour = F.hour(local_time(time))
    hs, hc = cyclic(hour, 24)
    outage = F.col("conventional_outage_mw") if "conventional_outage_mw" in df.columns else F.lit(0.0)
    price = F.col("gas_price") if "gas_price" in df.columns else gas_price
    return df.withColumns({"thermal_mw": F.col(thermal), "hour_sin": hs, "hour_cos": hc,
                           "conventional_outage_mw": outage, "gas_price": price})


def gas_split(stack: DataFrame, history: DataFrame, origin: Column, gas_price: Column, min_hours: int = SHARE_ROWS) -> DataFrame:
    """Gas share of thermal generation: ridge once ``min_hours`` (30 days) are known, else the recent share.

    Adds ``gas_forecast_mw`` (unclipped) and ``gas_split_source``.
    """
    share = recent_gas_share(history, origin)
    thermal = F.col("dispatchable_thermal_mw")
    stack = stack.withColumn("_share", F.coalesce(share.select("gas_share").scalar(), F.lit(0.5)))
    known = history.where((F.col("valid_at") < origin) & F.col("gas_mw").isNotNull() & F.col("coal_mw").isNotNull())
    train = _fuel_inputs(known.withColumn("_thermal", F.col("gas_mw") + F.col("coal_mw")), "valid_at", "_thermal", gas_price)
    medians = {c: train.agg(F.percentile(c, F.lit(0.5))).scalar() for c in FUEL_FEATURES}
    train = train.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in FUEL_FEATURES})
    params = linear.fit(train, [], FUEL_FEATURES, "gas_mw", linear.RIDGE)
    future = _fuel_inputs(stack, "delivery_hour", "dispatchable_thermal_mw", gas_price)
    future = future.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in FUEL_FEATURES}).withColumns(
        {"_coef": params.select("coef").scalar(), "_n": params.select("n_train").scalar()}
    )
    enough = F.coalesce(F.col("_n") >= min_hours, F.lit(False))
    fitted = linear.dot("_coef", FUEL_FEATURES)
    out = future.withColumns({
        "gas_forecast_mw": F.when(enough, fitted).otherwise(thermal * F.col("_share")),
        "gas_split_source": F.when(enough, F.lit("ridge_fuel_split")).otherwise(F.lit("recent_share_fallback")),
    })
    return out.select(*[c for c in stack.columns if c != "_share"], "gas_forecast_mw", "gas_split_source")


def share_residuals(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Absolute error of the lagged trailing gas share, one row per hour and horizon bucket.

    Frames and lags run over blocks of hours that overlap by what they reach back, so one long series is many tasks.
    """
    total = F.col("gas_mw") + F.col("coal_mw")
    rows = history.where(total.isNotNull()).withColumns({"_d": total, "_s": F.when(total > 0, F.col("gas_mw") / total)})
    known = framed(rows.select(*keys, "valid_at", "gas_mw", "_d", "_s"), keys, ["valid_at"], SHARE_ROWS - 1 + max(SHARE_LAGS.values()))
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    frame = w.rowsBetween(-(SHARE_ROWS - 1), 0)
    known = known.withColumn("_t", F.when(F.count("_s").over(frame) >= 24, F.avg("_s").over(frame)))
    lagged = known.withColumn("_l", F.array(*[
        F.struct(F.lit(b).alias("horizon_bucket"), F.lag("_t", k).over(w).alias("share")) for b, k in SHARE_LAGS.items()
    ]))
    long = lagged.where(~F.col("_halo")).select(*keys, "valid_at", "gas_mw", "_d", F.explode("_l").alias("_l"))
    error = F.abs(F.col("gas_mw") - F.col("_d") * F.col("_l.share"))
    return long.select(*keys, "valid_at", F.col("_l.horizon_bucket").alias("horizon_bucket"), error.alias("abs_error")).where(
        F.col("abs_error").isNotNull()
    )


def gas_interval(stack: DataFrame, history: DataFrame, origin: Column, coverage: float = 0.8) -> DataFrame:
    """Bounds of gas generation and burn; the upper bound stays within dispatchable thermal."""
    errors = share_residuals(history.where(F.col("valid_at") < origin))
    radius = conformal_radius(errors, "abs_error", coverage, ["horizon_bucket"]).drop("n")
    out = stack.join(radius, "horizon_bucket", "left")
    gas, r = F.col("gas_generation_mw"), F.col("radius")
    out = out.withColumns({
        "gas_generation_lower_mw": at_least(gas - r, 0.0),
        "gas_generation_upper_mw": at_most(gas + r, F.col("dispatchable_thermal_mw")),
    })
    rate = F.col("heat_rate_mmbtu_per_mwh") / BTU_PER_BCF_MMBTU
    return out.withColumns({
        "gas_burn_bcf_lower": F.col("gas_generation_lower_mw") * rate,
        "gas_burn_bcf_upper": F.col("gas_generation_upper_mw") * rate,
    }).drop("radius")


def net_load_errors(predictions: DataFrame) -> DataFrame:
    """Net-load error where all three components have a validated row; one aggregation, no joins."""
    sign = F.when(F.col("component") == "load", 1.0).otherwise(-1.0)
    gap = F.sum(sign * (F.col("actual_mw") - F.col("corrected_mw")))
    keys = ["forecast_origin", "delivery_hour", "horizon_bucket"]
    rows = predictions.where(F.col("component").isin(*COMPONENTS)).groupBy(*keys).agg(
        F.countDistinct("component").alias("_n"), F.abs(gap).alias("abs_error")
    )
    return rows.where(F.col("_n") == len(COMPONENTS)).drop("_n")


def validation_origins(history: DataFrame, keys: Sequence[str] = ("component",)) -> DataFrame:
    """Origins that validate a correction: at least four exist, the first 60 % only train."""
    w = W.partitionBy(*keys)
    ranked = history.select(*keys, "forecast_origin").distinct().withColumns(
        {"_i": F.row_number().over(w.orderBy("forecast_origin")), "_n": F.count(F.lit(1)).over(w)}
    )
    first = F.greatest(F.lit(2), F.ceil(F.col("_n") * 0.6))
    return ranked.where((F.col("_n") >= 4) & (F.col("_i") > first)).select(*keys, "forecast_origin")


def correction_folds(history: DataFrame, features: Sequence[str] = CORRECTION_FEATURES,
                     keys: Sequence[str] = ("component",), min_train: int = 100) -> DataFrame:
    """Ridge parameters of every validation origin from labels known at that origin.

    Each realized row joins the first origin that may use it; moments then accumulate along origins.
    """
    clean = history.where(F.col("actual_mw").isNotNull() & F.col("baseline_mw").isNotNull())
    origins = validation_origins(clean, keys)
    labelled = clean.withColumn("_y", F.col("actual_mw") - F.col("baseline_mw"))
    stepped = first_origin_knowing(
        labelled.withColumnRenamed("forecast_origin", "_o"), origins, "forecast_origin", _known_from(clean, "_o"), "_at"
    )
    per_origin = linear.moments(stepped, [*keys, "_at"], features, "_y")
    k = len(features)
    asked = origins.select(*keys, F.col("forecast_origin").alias("_at"), F.lit(True).alias("_q"))
    both = per_origin.unionByName(asked, allowMissingColumns=True)
    running = linear.running_moments(both, keys, "_at", k, ["_q"]).where(F.col("_q") & (F.col("m0") >= min_train))
    return linear.solve(running.withColumnRenamed("_at", "forecast_origin"), [*keys, "forecast_origin"], k, linear.RIDGE)


def rolling_corrections(history: DataFrame, features: Sequence[str] = CORRECTION_FEATURES,
                        keys: Sequence[str] = ("component",), min_train: int = 100) -> DataFrame:
    """Validated ridge corrections: one row per validation origin and delivery hour."""
    clean = staged(history.where(F.col("actual_mw").isNotNull() & F.col("baseline_mw").isNotNull()), "labels")
    params = correction_folds(clean, features, keys, min_train)
    rows = clean.join(params, [*keys, "forecast_origin"])
    return rows.select(
        *keys, "forecast_origin", "delivery_hour", "horizon_bucket", "baseline_mw", "actual_mw", "n_train",
        (F.col("baseline_mw") + linear.dot("coef", features)).alias("corrected_mw"),
    )


def promotion(predictions: DataFrame, keys: Sequence[str] = ("component",), model: str = "ridge") -> DataFrame:
    """Promote a candidate that beats the baseline overall and harms no bucket by more than 5 %."""
    m = bucket_comparison(predictions, keys)
    overall = F.col("horizon_bucket") == "overall"
    return m.groupBy(*keys).agg(
        F.max(F.when(overall, F.col("corrected_mae"))).alias("corrected_mae"),
        F.max(F.when(overall, F.col("baseline_mae"))).alias("baseline_mae"),
        F.bool_and(F.when(overall, F.col("corrected_mae") < F.col("baseline_mae"))
                   .otherwise(F.col("corrected_mae") <= F.col("baseline_mae") * 1.05)).alias("promoted"),
    ).withColumn("model_name", F.lit(model))


def known_at(history: DataFrame, origin: Column) -> DataFrame:
    """Realized rows that may be used at ``origin``: forecast and delivered before it, and retrieved by it."""
    return history.where((_known_from(history) <= origin) & F.col("actual_mw").isNotNull() & F.col("baseline_mw").isNotNull())


def validated(known: DataFrame, features: Sequence[str] = CORRECTION_FEATURES, keys: Sequence[str] = ("component",),
              min_train: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(gate, rows)``: the promotion decision per key, and the validation rows of what is published.

    A promoted key gives the rows of its rolling corrections; any other key gives all rows of its validation
    origins with the baseline as ``corrected_mw``, also where no fold had enough rows to train on.
    """
    known = staged(known, "known")
    rolling = staged(rolling_corrections(known, features, keys, min_train), "rolling")
    gate = staged(promotion(rolling, keys), "gate")
    good = gate.where("promoted").select(*keys)
    names = [*keys, "forecast_origin", "delivery_hour", "horizon_bucket", "baseline_mw", "actual_mw"]
    plain = known.join(validation_origins(known, keys), [*keys, "forecast_origin"]).join(good, list(keys), "left_anti")
    rows = rolling.join(good, list(keys), "left_semi").select(*names, "corrected_mw", F.lit(True).alias("promoted"))
    return gate, rows.unionByName(plain.select(*names, F.col("baseline_mw").alias("corrected_mw"), F.lit(False).alias("promoted")))


def correct(history: DataFrame, forecast: DataFrame, origin: Column, features: Sequence[str] = CORRECTION_FEATURES,
            keys: Sequence[str] = ("component",), min_train: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(forecast, validation)``: corrected where the ridge candidate is promoted, else the vendor baseline.

    Only rows known at ``origin`` train, decide and validate.
    """
    known = known_at(history, origin)
    gate, rows = validated(known, features, keys, min_train)
    final = linear.fit(known.withColumn("_y", F.col("actual_mw") - F.col("baseline_mw")), keys, features, "_y", linear.RIDGE)
    joined = forecast.join(gate.where("promoted").select(*keys, "promoted"), list(keys), "left").join(final, list(keys), "left")
    fitted = at_least(F.col("baseline_mw") + linear.dot("coef", features), 0.0)
    use = F.coalesce(F.col("promoted"), F.lit(False)) & fitted.isNotNull()
    return joined.withColumns({
        "forecast_mw": F.when(use, fitted).otherwise(F.col("baseline_mw")),
        "forecast_source": F.when(use, F.lit("ercot_plus_ridge_correction")).otherwise(F.lit("ercot_baseline")),
    }).drop("promoted", "coef", "n_train"), rows


def fallback_predictions(history: DataFrame, rows: DataFrame, keys: Sequence[str] = ("component",)) -> DataFrame:
    """``rows`` with ``fallback_mw``: the hour-of-week profile and level of the hours known at each row's origin.

    Every delivered hour enters the sums of its hour of week at the first origin that may know it, and later forecasts
    of it only move them by the difference, so one running sum along the origins gives every origin's profile.
    """
    real = history.where(F.col("actual_mw").isNotNull())
    origins = staged(rows.select(*keys, "forecast_origin").distinct(), "asked")
    keyed = first_origin_knowing(
        real.select(*keys, F.col("forecast_origin").alias("_o"), "delivery_hour", *(["retrieved_at"] if "retrieved_at" in real.columns else []), "actual_mw"),
        origins, "forecast_origin", _known_from(real.withColumnRenamed("forecast_origin", "_o"), "_o"), "_at",
    )
    seen = keyed.groupBy(*keys, "delivery_hour", "_at").agg(F.max(F.struct("_o", "actual_mw")).alias("_v"))
    w = W.partitionBy(*keys, "delivery_hour").orderBy("_at")
    moved = seen.withColumn("_now", F.max("_v").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_before", F.lag("_now").over(w)).select(
        *keys, hour_of_week("delivery_hour").alias("hour_of_week"), "_at",
        (F.col("_now.actual_mw") - F.coalesce("_before.actual_mw", F.lit(0.0))).alias("_sum"), F.when(F.col("_before").isNull(), 1).otherwise(0).alias("_n"),
    )
    sums = moved.groupBy(*keys, "hour_of_week", "_at").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    asked = origins.select(*keys, F.col("forecast_origin").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(167))).alias("hour_of_week"), F.lit(True).alias("_q"))
    along = W.partitionBy(*keys, "hour_of_week").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    running = sums.unionByName(asked, allowMissingColumns=True).select(
        *keys, F.col("_at").alias("forecast_origin"), "hour_of_week", "_q", F.sum("_sum").over(along).alias("_s"), F.sum("_n").over(along).alias("_c")
    ).where("_q AND _c > 0")
    profile = staged(running.withColumn("profile_mw", F.col("_s") / F.col("_c")), "profile")
    mean = profile.groupBy(*keys, "forecast_origin").agg((F.sum("_s") / F.sum("_c")).alias("mean_mw"))
    last = _newest_hours(real, origins, keys, F.col("actual_mw")).select(
        *keys, F.col("_at").alias("forecast_origin"), hour_of_week("delivery_hour").alias("hour_of_week"), F.col("_v.value").alias("_a")
    )
    level = last.join(profile, [*keys, "forecast_origin", "hour_of_week"]).groupBy(*keys, "forecast_origin").agg(F.avg(F.col("_a") - F.col("profile_mw")).alias("adjust_mw"))
    out = rows.withColumn("hour_of_week", hour_of_week("delivery_hour")).join(
        profile.select(*keys, "forecast_origin", "hour_of_week", "profile_mw"), [*keys, "forecast_origin", "hour_of_week"], "left"
    ).join(mean, [*keys, "forecast_origin"], "left").join(level, [*keys, "forecast_origin"], "left")
    shaped = at_least(F.coalesce("profile_mw", "mean_mw") + F.col("adjust_mw"), 0.0)
    return out.withColumn("fallback_mw", F.coalesce(shaped, F.col("baseline_mw"))).select(*rows.columns, "fallback_mw")


def backtest(history: DataFrame, features: Sequence[str] = CORRECTION_FEATURES, keys: Sequence[str] = ("component",),
             min_train: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(rows, metrics)``: published validation rows with their fallback, and errors per key, bucket and model.

    Selection sees what was known at each key's newest origin. A correction is scored only where it is promoted.
    """
    newest = history.groupBy(*keys).agg(F.max("forecast_origin").alias("_cut"))
    known = known_at(history.join(newest, list(keys)), F.col("_cut")).drop("_cut")
    _, rows = validated(known, features, keys, min_train)
    rows = staged(fallback_predictions(history, rows, keys), "backtest")
    models = F.filter(F.array(
        F.struct(F.lit("ercot_baseline").alias("model"), F.col("baseline_mw").alias("p"), F.lit(False).alias("promoted")),
        F.struct(F.lit("hour_of_week_fallback").alias("model"), F.col("fallback_mw").alias("p"), F.lit(False).alias("promoted")),
        F.when(F.col("promoted"), F.struct(F.lit("ridge").alias("model"), F.col("corrected_mw").alias("p"), F.lit(True).alias("promoted"))),
    ), lambda m: m.isNotNull())
    long = rows.select(*keys, "horizon_bucket", "actual_mw", F.explode(models).alias("m")).select(*keys, "horizon_bucket", "actual_mw", "m.*")
    gap = F.col("actual_mw") - F.col("p")
    scores = long.groupBy(*keys, "horizon_bucket", "model", "promoted").agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), F.count(F.lit(1)).alias("n_samples")
    )
    return rows, scores
