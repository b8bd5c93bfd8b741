"""Monthly state statistics to weekly regional supply and demand, all regions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.columns import at_least
from pitcast.operators import linear
from pitcast.operators.features import interpolate_at
from pitcast.operators.rollups import monthly
from pitcast.session import staged

# National series codes and series prefixes of the state components.
NATIONAL = {
    "N9070US2": "dry", "N9050US2": "marketed", "N9140US2": "consumption", "N9160US2": "lease_plant", "N9170US2": "pipeline",
}
PREFIXES = {
    "N3010": "res", "N3020": "com", "N3035": "ind", "N3045": "power_burn", "N3050": "price",
    "N9050": "marketed_production", "NA1160_S": "dry_production",
}
VOLUMES = ("res", "com", "ind", "power_burn", "marketed_production", "dry_production")
PROFILED = ("dry_production", "ind", "fuel_use")


def component_of(series: Column) -> Column:
    expr = F.lit(None).cast("string")
    for prefix, name in PREFIXES.items():
        expr = F.when(series.startswith(prefix), F.lit(name)).otherwise(expr)
    return expr


def state_of(series: Column) -> Column:
    """Two-letter state code embedded in a series code."""
    return F.when(series.startswith("NA1160_S"), F.regexp_extract(series, "_S([A-Z]{2})_", 1)).otherwise(F.substring(series, 6, 2))


def state_components(monthly_series: DataFrame, states: DataFrame, price: DataFrame) -> DataFrame:
    """Wide state table per (duoarea, abbr, period), forward-filled and scaled to Bcf.

    ``states`` maps ``abbr`` to ``duoarea``; a state may belong to several regions.
    """
    rows = monthly_series.where(~F.col("series").isin(*NATIONAL)).withColumns(
        {"component": component_of(F.col("series")), "abbr": state_of(F.col("series"))}
    )
    rows = rows.where(F.col("component").isNotNull()).join(states.select("abbr", "duoarea"), "abbr")
    wide = rows.groupBy("duoarea", "abbr", "period").pivot("component", list(PREFIXES.values())).agg(F.min("value"))
    hub = monthly(price, "period", means=["value"]).withColumnRenamed("value", "price_hh")
    wide = wide.join(hub, "period", "left")
    w = W.partitionBy("duoarea", "abbr").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in VOLUMES}
    filled["price"] = F.coalesce(F.last("price", ignorenulls=True).over(w), F.col("price_hh"), F.lit(3.0))
    wide = wide.withColumns(filled)
    wide = wide.withColumn("marketed_production", F.when(F.col("dry_production") > 0, 0.0).otherwise(F.col("marketed_production")))
    return wide.withColumns({f"{c}_bcf": F.col(c) / 1000.0 for c in VOLUMES})


def regional_months(state_table: DataFrame) -> DataFrame:
    """Regional monthly sums and the consumption-weighted price."""
    use = F.col("res_bcf") + F.col("com_bcf") + F.col("ind_bcf") + F.col("power_burn_bcf")
    out = state_table.groupBy("duoarea", "period").agg(
        F.sum(F.col("res_bcf") + F.col("com_bcf")).alias("res_com"),
        F.sum("ind_bcf").alias("ind"),
        F.sum("power_burn_bcf").alias("power_burn"),
        F.sum("marketed_production_bcf").alias("marketed_production"),
        F.sum("dry_production_bcf").alias("reported_dry"),
        F.sum(F.col("price") * use).alias("_pw"),
        F.sum(use).alias("_use"),
    )
    price = F.when(F.col("_use") > 0, F.col("_pw") / F.col("_use")).otherwise(F.lit(0.0))
    return out.withColumn("regional_price", price).drop("_pw", "_use")


def regional_balance(regional: DataFrame, monthly_series: DataFrame) -> DataFrame:
    """Add dry production and fuel use through the national ratios, carried over gaps."""
    nat = monthly_series.where(F.col("series").isin(*NATIONAL)).groupBy("period").pivot("series", list(NATIONAL)).agg(F.first("value"))
    nat = nat.select("period", *[(F.col(code) / 1000.0).alias(f"us_{name}") for code, name in NATIONAL.items()])
    both = regional.join(nat, "period")
    w = W.partitionBy("duoarea").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    ratio = lambda num, den: F.coalesce(F.last(F.when(den > 0, num / den), ignorenulls=True).over(w), F.lit(0.0))
    both = both.withColumn("_dm", ratio(F.col("us_dry"), F.col("us_marketed")))
    both = both.withColumn("dry_production", F.col("reported_dry") + F.col("marketed_production") * F.col("_dm"))
    retail = F.col("res_com") + F.col("power_burn") + F.col("ind")
    both = both.withColumn("_cons", ratio(retail, F.col("us_consumption")))
    prod = F.when(F.col("us_dry") > 0, F.col("dry_production") / F.col("us_dry")).otherwise(F.lit(0.0))
    return both.withColumn("fuel_use", F.col("us_lease_plant") * prod + F.col("us_pipeline") * F.col("_cons")).select(
        "duoarea", "period", "dry_production", "res_com", "power_burn", "ind", "fuel_use", "regional_price"
    )


def aligned_months(balance: DataFrame, daily_weather: DataFrame, price: DataFrame) -> DataFrame:
    """Months present in balance, weather and price, with per-day rates and the price basis."""
    weather = monthly(daily_weather, "date", sums=["hdd", "cdd"], keys=["duoarea"])
    hub = monthly(price, "period", means=["value"]).withColumnRenamed("value", "price_hh")
    both = balance.join(weather, ["duoarea", "period"]).join(hub, "period")
    days = F.day(F.last_day("period")).cast("double")
    both = both.withColumns({"days": days, "month": F.month("period"), "basis_spread": F.col("regional_price") - F.col("price_hh")})
    rates = ("res_com", "power_burn", "hdd", "cdd", *PROFILED)
    return both.withColumns({f"{c}_per_day": F.col(c) / F.col("days") for c in rates})


RES_COM_FEATURES = ("hdd_per_day", "cdd_per_day")
POWER_FEATURES = ("hdd_per_day", "cdd_per_day", "regional_price")


def fit(months: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residential-commercial and power-burn regressions, and month profiles, per region."""
    keys = ["duoarea"]
    return (
        linear.fit(months, keys, RES_COM_FEATURES, "res_com_per_day"),
        linear.fit(months, keys, POWER_FEATURES, "power_burn_per_day"),
        months.groupBy("duoarea", "month").agg(
            F.avg("basis_spread").alias("basis_spread"), *[F.avg(f"{c}_per_day").alias(f"{c}_profile") for c in PROFILED]
        ),
    )


def weekly_estimates(months: DataFrame, weather: DataFrame, price: DataFrame) -> DataFrame:
    """Weekly components and local balance per (duoarea, date).

    ``weather``: duoarea, date, hdd, cdd. ``price``: date, value.
    """
    months = staged(months, "months")
    res_com, power, profile = fit(months)
    profile = staged(profile, "profile")
    weekly = weather.select("duoarea", "date", "hdd", "cdd").join(price.select("date", F.col("value").alias("price")), "date")
    weekly = weekly.withColumns({"hdd_per_day": F.col("hdd") / 7.0, "cdd_per_day": F.col("cdd") / 7.0, "month": F.month("date")})
    overall = profile.groupBy("duoarea").agg(*[F.avg(f"{c}_profile").alias(f"{c}_overall") for c in PROFILED])
    weekly = weekly.join(profile, ["duoarea", "month"], "left").join(overall, "duoarea")
    weekly = weekly.withColumn("regional_price", F.col("price") + F.coalesce("basis_spread", F.lit(0.0)))
    weekly = linear.score(weekly, res_com, ["duoarea"], RES_COM_FEATURES, "_rc")
    weekly = linear.score(weekly, power, ["duoarea"], POWER_FEATURES, "_pb")
    weekly = weekly.withColumns({
        "res_com": at_least(F.col("_rc") * 7.0, 0.0), "power_burn": at_least(F.col("_pb") * 7.0, 0.0)
    }).drop("_rc", "_pb")

    newest = months.groupBy("duoarea").agg(
        F.max(F.struct("period", "month", "days", *[f"{c}_per_day" for c in PROFILED])).alias("_l")
    )
    last = newest.select("duoarea", F.col("_l.month").alias("month"), (F.datediff("_l.period", F.lit("1970-01-01").cast("date")) + F.col("_l.days") / 2).alias("last_x"),
                         *[F.col(f"_l.{c}_per_day").alias(f"_a_{c}") for c in PROFILED])
    last = last.join(profile, ["duoarea", "month"])
    scale = {}
    for c in PROFILED:
        a, s = F.col(f"_a_{c}"), F.col(f"{c}_profile")
        ratio = F.least(F.greatest(a / s, F.lit(0.5)), F.lit(1.5))
        scale[f"{c}_scale"] = F.when((s > 0) & (a > 0), ratio).otherwise(F.lit(1.0))
    last = last.select("duoarea", "last_x", *[v.alias(k) for k, v in scale.items()])
    epoch = F.lit("1970-01-01").cast("date")
    knots = months.select("duoarea", (F.datediff("period", epoch) + F.col("days") / 2).alias("x"), *[f"{c}_per_day" for c in PROFILED])
    targets = staged(weekly.withColumn("x", F.datediff("date", epoch).cast("double")), "weekly")
    dates = targets.select("duoarea", "date", "x").distinct()
    inside = interpolate_at(dates, knots, ["duoarea"], "x", [f"{c}_per_day" for c in PROFILED]).drop("x")
    both = targets.join(inside, ["duoarea", "date"]).join(last, "duoarea")
    for c in PROFILED:
        beyond = F.coalesce(F.col(f"{c}_profile"), F.col(f"{c}_overall")) * F.col(f"{c}_scale")
        both = both.withColumn(f"_v_{c}", 7.0 * F.when(F.col("x") <= F.col("last_x"), F.col(f"{c}_per_day")).otherwise(beyond))
    both = both.withColumns({"dry_production": F.col("_v_dry_production"), "industrial": F.col("_v_ind"), "fuel_use": F.col("_v_fuel_use")})
    return add_local_balance(both.select(
        "duoarea", "date", "hdd", "cdd", "price", "regional_price", "res_com", "power_burn", "dry_production", "industrial", "fuel_use"
    ))


def add_local_balance(df: DataFrame) -> DataFrame:
    use = F.col("res_com") + F.col("power_burn") + F.col("industrial") + F.col("fuel_use")
    return df.withColumn("local_balance", F.col("dry_production") - use)


def add_net_inflow(df: DataFrame) -> DataFrame:
    return df.withColumn("net_inflow_balancing", F.col("weekly_change_bcf") - F.col("local_balance"))


def missing_series(available: DataFrame, abbrs: DataFrame) -> DataFrame:
    """Required monthly series that are absent: national baselines and state consumption."""
    national = abbrs.sparkSession.createDataFrame([(c,) for c in NATIONAL], "series string")
    prefixes = F.array(*[F.lit(p) for p in ("N3010", "N3020", "N3035", "N3045")])
    state = abbrs.select("abbr", F.explode(prefixes).alias("_p")).select(F.concat("_p", "abbr", F.lit("2")).alias("series"))
    return national.union(state).join(available.select("series").distinct(), "series", "left_anti")


def require_series(available: DataFrame, abbrs: DataFrame) -> None:
    """Raise unless every required monthly series is there; the list is bounded by the states."""
    missing = sorted(r[0] for r in missing_series(available, abbrs).collect())
    if missing:
        raise ValueError(f"Monthly inputs lack required series: {missing}")


def has_state_production(available: DataFrame) -> DataFrame:
    s = F.col("series")
    found = F.count_if((s.startswith("N9050") & (s != "N9050US2")) | s.startswith("NA1160_S")) > 0
    return available.agg(found.alias("has_state_production"))
