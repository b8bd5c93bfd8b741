"""Daily, weekly, monthly and hourly rollups and seasonal profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import hour_of_week, local_time, week_ending_friday
from pitcast.functions.columns import at_least, require_columns

# The columns of the forecast archive.
ARCHIVE_COLUMNS = (
    "provider", "model", "model_run", "ensemble_member", "issued_at", "valid_start", "valid_end",
    "state", "duoarea", "temperature_f", "hdd", "cdd", "coverage",
)


def weighted_daily_weather(df: DataFrame, keys: Sequence[str] = (), weight: str = "population_weight") -> DataFrame:
    """Population-weighted temperature and degree days per date."""
    require_columns(df, ["date", "temperature_f", "hdd", "cdd", weight], "state weather")
    sums = [F.coalesce(F.sum(F.col(c) * F.col(weight)), F.lit(0.0)).alias(c) for c in ("temperature_f", "hdd", "cdd")]
    return df.groupBy(*keys, "date").agg(*sums)


def weekly_weather(daily: DataFrame, keys: Sequence[str] = (), drop_incomplete: bool = True, expected_days: int = 7) -> DataFrame:
    """Saturday-to-Friday weeks: mean temperature, summed degree days, number of days."""
    out = (
        daily.withColumn("date", week_ending_friday("date"))
        .groupBy(*keys, "date")
        .agg(
            F.avg("temperature_f").alias("temperature_f"),
            F.sum("hdd").alias("hdd"),
            F.sum("cdd").alias("cdd"),
            F.count(F.lit(1)).cast("int").alias("weather_days"),
        )
    )
    return out.where(F.col("weather_days") == expected_days) if drop_incomplete else out


def region_members(archive: DataFrame, weights: DataFrame, by_issue: bool = False) -> DataFrame:
    """Weight state forecasts into one regional value per ensemble member."""
    keys = ["state", "duoarea"] + (["issued_at"] if by_issue else [])
    # a state without weight, or weights of a region that do not sum to one, would lower the regional value unseen
    total = F.sum("weather_weight").over(W.partitionBy(*keys[1:]))
    checked = weights.select(*keys, F.when(F.abs(total - 1) <= 1e-6, F.col("weather_weight")).otherwise(
        F.raise_error(F.concat(F.lit("Weights must sum to one in region "), F.col("duoarea"))).cast("double")
    ).alias("weather_weight"))
    joined = archive.join(checked, keys, "left").withColumn("weather_weight", F.coalesce(
        "weather_weight", F.raise_error(F.concat(F.lit("No weight for state "), F.col("state"))).cast("double")
    ))
    group = ["provider", "model", "model_run", "ensemble_member", "issued_at", "valid_start", "valid_end", "duoarea"]
    sums = [
        F.coalesce(F.sum(F.col(c) * F.col("weather_weight")), F.lit(0.0)).alias(c)
        for c in ("temperature_f", "hdd", "cdd", "coverage")
    ]
    return joined.groupBy(*group).agg(*sums).withColumn("state", F.lit("REGIONAL")).select(*ARCHIVE_COLUMNS)


def unweighted_states(archive: DataFrame, weights: DataFrame) -> DataFrame:
    """States of the archive that have no weight; the caller rejects a non-empty result."""
    keys = ["state", "duoarea"]
    return archive.select(*keys).distinct().join(weights.select(*keys), keys, "left_anti")


def weekly_scenarios(archive: DataFrame, require_complete_weeks: bool = True) -> DataFrame:
    """Two-level ensemble rollup: member weeks, then the scenario over members."""
    scenario = ["provider", "model", "model_run", "issued_at", "duoarea", "date"]
    days = archive.withColumn("date", week_ending_friday("valid_start"))
    member = days.groupBy(*scenario, "ensemble_member").agg(
        F.avg("temperature_f").alias("temperature_f"),
        F.sum("hdd").alias("hdd"),
        F.sum("cdd").alias("cdd"),
        F.countDistinct("valid_start").cast("int").alias("weather_days"),
        F.avg("coverage").alias("coverage"),
    )
    if require_complete_weeks:
        member = member.where((F.col("weather_days") == 7) & (F.col("coverage") >= 0.999))
    spread = []
    for x in ("hdd", "cdd"):
        for name, q in (("p10", 0.1), ("p90", 0.9)):
            spread.append(F.percentile(x, F.lit(q)).alias(f"{x}_{name}"))
    out = member.groupBy(*scenario).agg(
        F.avg("temperature_f").alias("temperature_f"),
        F.avg("hdd").alias("hdd"),
        F.avg("cdd").alias("cdd"),
        F.min("weather_days").alias("weather_days"),
        F.avg("coverage").alias("coverage"),
        F.count("ensemble_member").cast("int").alias("ensemble_members"),
        *spread,
    )
    return out.withColumns({f"{x}_spread": F.col(f"{x}_p90") - F.col(f"{x}_p10") for x in ("hdd", "cdd")})


def weekly_price(daily_price: DataFrame, weeks: DataFrame) -> DataFrame:
    """Mean daily price of each reporting week; weeks without prices stay, with NULL."""
    means = daily_price.groupBy(week_ending_friday("period").alias("date")).agg(F.avg("value").alias("value"))
    return weeks.select("date").distinct().join(means, "date", "left")


def seasonal_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    """Mean by ISO week, with the profile-wide mean alongside as the fallback."""
    weekly = df.groupBy(*keys, "week_of_year").agg(*[F.avg(c).alias(c) for c in columns])
    return weekly.withColumns({f"{c}_overall": F.avg(c).over(W.partitionBy(*keys)) for c in columns})


def profile_value(column: str, default: float) -> Column:
    return F.coalesce(F.col(column), F.col(f"{column}_overall"), F.lit(default))


def week_mean_std(df: DataFrame, value: str = "weekly_change_bcf", keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    """Same-week mean and sample deviation; a missing deviation takes the mean of the others."""
    weekly = df.groupBy(*keys, "week_of_year").agg(
        F.avg(value).alias("predicted_weekly_change"), F.stddev_samp(value).alias("_std")
    )
    fill = F.avg("_std").over(W.partitionBy(*keys))
    return weekly.withColumn("prediction_std", F.coalesce("_std", fill)).drop("_std")


def hour_profile(history: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Hour-of-week mean per series."""
    return history.where(F.col(value).isNotNull()).groupBy(*keys, hour_of_week("valid_at").alias("hour_of_week")).agg(
        F.avg(value).alias("profile_mw")
    )


def hour_level(history: DataFrame, profile: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per series: overall mean and mean gap between the last 24 actuals and their profile.

    The newest 24 rows are found by a limit that every task applies to its own rows before the exchange; only they meet the profile.
    """
    known = history.where(F.col(value).isNotNull())
    recent = W.partitionBy(*keys).orderBy(F.col("valid_at").desc())
    newest = known.select(*keys, "valid_at", F.col(value).alias("_v")).withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= 24)
    gaps = newest.withColumn("hour_of_week", hour_of_week("valid_at")).join(profile, [*keys, "hour_of_week"], "left").groupBy(*keys).agg(
        F.avg(F.col("_v") - F.col("profile_mw")).alias("adjust_mw")
    )
    return known.groupBy(*keys).agg(F.avg(value).alias("mean_mw")).join(gaps, list(keys), "left")


def hour_of_week_forecast(
    history: DataFrame, targets: DataFrame, value: str, keys: Sequence[str], origin: Column, nonnegative: bool = True
) -> DataFrame:
    """Stable hourly forecast: profile of the hour of week plus the latest level."""
    known = history.where(F.col("valid_at") < origin)
    profile = hour_profile(known, value, keys)
    level = hour_level(known, profile, value, keys)
    joined = (
        targets.withColumn("hour_of_week", hour_of_week("delivery_hour"))
        .join(profile, [*keys, "hour_of_week"], "left")
        .join(level, list(keys), "left")
    )
    raw = F.coalesce("profile_mw", "mean_mw") + F.col("adjust_mw")
    shaped = at_least(raw, 0.0) if nonnegative else raw
    return joined.select(
        *targets.columns,
        F.coalesce(shaped, F.lit(0.0)).alias("profile_forecast_mw"),
        F.when(F.col("mean_mw").isNotNull(), F.lit("hour_of_week_adjusted"))
        .otherwise(F.lit("zero_missing_history"))
        .alias("profile_source"),
    )


def fill_missing_baseline(targets: DataFrame, history: DataFrame, value: str, keys: Sequence[str], origin: Column,
                          vendor: str = "ercot") -> DataFrame:
    """Replace missing vendor baselines by the hour-of-week forecast and tag the source."""
    filled = hour_of_week_forecast(history, targets, value, keys, origin)
    missing = F.col("baseline_mw").isNull()
    return filled.select(
        *[c for c in targets.columns if c != "baseline_mw"],
        F.coalesce("baseline_mw", "profile_forecast_mw").alias("baseline_mw"),
        F.when(missing, F.concat(F.lit("fallback_"), "profile_source")).otherwise(F.lit(vendor)).alias("baseline_source"),
    )


def pivot_sum(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], measure: str) -> DataFrame:
    """Long to wide with a declared value list, so no extra pass looks for the values."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.sum(measure))


def last_per_hour(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last non-null value of every column per key."""
    values = [c for c in df.columns if c not in keys and c != order]
    picks = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*picks)


def monthly(df: DataFrame, date: str, sums: Sequence[str] = (), means: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.trunc(date, "month").alias("period")).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means]
    )


def year_week_profile(df: DataFrame, value: str, years: int = 5, keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    """Per ISO week: statistics of the yearly means over the last complete years before the newest."""
    newest = F.max("year").over(W.partitionBy(*keys))
    prior = df.withColumn("_y", newest).where((F.col("year") < F.col("_y")) & (F.col("year") >= F.col("_y") - years))
    yearly = prior.groupBy(*keys, "year", "week_of_year").agg(F.avg(value).alias("_m"))
    return yearly.groupBy(*keys, "week_of_year").agg(
        F.avg("_m").alias("avg_value"),
        F.stddev_samp("_m").alias("std_value"),
        F.min("_m").alias("min_value"),
        F.max("_m").alias("max_value"),
    )


def local_day_totals(df: DataFrame, columns: Sequence[str], time: str = "delivery_hour", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(local_time(time)).alias("date_ct")).agg(*[F.sum(c).alias(c) for c in columns])
