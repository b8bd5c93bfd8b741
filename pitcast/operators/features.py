"""Leakage-free weekly features: every window looks only at earlier rows of its own series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import add_calendar_features
from pitcast.functions.columns import require_columns

# The target, feature and column names of the model tables.
TARGET = "weekly_change_bcf"
CALENDAR_FEATURES = ("week_sin", "week_cos", "month_sin", "month_cos")
WEATHER_FEATURES = (
    "hdd_per_day", "cdd_per_day", "hdd_lag1", "hdd_lag4", "cdd_lag1", "cdd_lag4",
    "hdd_rolling_4wk", "hdd_rolling_8wk", "cdd_rolling_4wk", "cdd_rolling_8wk",
    "hdd_vs_4wk_avg", "cdd_vs_4wk_avg",
)
STORAGE_FEATURES = (
    "weekly_change_lag1", "weekly_change_lag4", "weekly_change_rolling_4wk", "weekly_change_rolling_8wk",
    "storage_bcf_lag52", "storage_vs_last_year", "storage_5yr_avg", "storage_vs_5yr_avg", "weekly_change_yoy",
)
SEASON_FLAGS = ("is_injection_season", "is_withdrawal_season", "is_shoulder_month")
ENGINEERED = CALENDAR_FEATURES + WEATHER_FEATURES + STORAGE_FEATURES + SEASON_FLAGS
BASE_COLUMNS = (
    "date", "duoarea", "storage_bcf", "weekly_change_bcf", "year", "month", "week_of_year",
    "temperature_f", "hdd", "cdd", "weather_days",
)
DEFAULT_MODEL_FEATURES = (
    *CALENDAR_FEATURES, "hdd", "cdd", "hdd_lag1", "hdd_rolling_4wk", "cdd_rolling_4wk",
    "weekly_change_lag1", "weekly_change_rolling_4wk", "storage_vs_5yr_avg", "storage_vs_last_year",
    "is_injection_season",
)


def series_window(keys: Sequence[str] = ("duoarea",), date: str = "date") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(date)


def strict_mean(value: Column | str, frame: WindowSpec, width: int) -> Column:
    """Mean over a frame, NULL unless it holds ``width`` non-null values."""
    return F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))


def prior_mean(value: str, window: WindowSpec, width: int) -> Column:
    return strict_mean(value, window.rowsBetween(-width, -1), width)


def weekly_change(df: DataFrame, value: str = "value", keys: Sequence[str] = ("duoarea",), date: str = "period") -> DataFrame:
    return df.withColumn(TARGET, F.col(value) - F.lag(value).over(series_window(keys, date)))


def same_week_prior_mean(value: str, years: int = 5, keys: Sequence[str] = ("duoarea",)) -> Column:
    """Mean of up to ``years`` earlier observations of the same ISO week."""
    return F.avg(value).over(W.partitionBy(*keys, "week_of_year").orderBy("date").rowsBetween(-years, -1))


def join_weather_storage(storage: DataFrame, weather: DataFrame) -> DataFrame:
    keep = ["date", "duoarea", "temperature_f", "hdd", "cdd", "weather_days"]
    require_columns(storage, ["date", "duoarea"], "storage")
    require_columns(weather, keep, "weather")
    return storage.join(weather.select(*keep), ["date", "duoarea"], "inner")


def add_weather_features(df: DataFrame, lags: Sequence[int] = (1, 4)) -> DataFrame:
    w = series_window()
    out: dict[str, Column] = {f"{x}_per_day": F.col(x) / F.col("weather_days") for x in ("hdd", "cdd")}
    for x in ("hdd", "cdd"):
        out |= {f"{x}_lag{k}": F.lag(x, k).over(w) for k in lags}
        out |= {f"{x}_rolling_{n}wk": prior_mean(x, w, n) for n in (4, 8)}
        out[f"{x}_vs_4wk_avg"] = F.col(x) - prior_mean(x, w, 4)
    return df.withColumns(out)


def add_storage_features(df: DataFrame, lags: Sequence[int] = (1, 4), yoy_lag: int = 52) -> DataFrame:
    w = series_window()
    df = df.withColumn("storage_5yr_avg", same_week_prior_mean("storage_bcf"))
    lag1 = F.lag("storage_bcf", 1).over(w)
    out: dict[str, Column] = {f"weekly_change_lag{k}": F.lag(TARGET, k).over(w) for k in lags}
    out |= {f"weekly_change_rolling_{n}wk": prior_mean(TARGET, w, n) for n in (4, 8)}
    out |= {
        "storage_bcf_lag1": lag1,
        "storage_bcf_lag52": F.lag("storage_bcf", yoy_lag).over(w),
        "storage_vs_last_year": lag1 - F.lag("storage_bcf", 53).over(w),
        "storage_vs_5yr_avg": lag1 - F.lag("storage_5yr_avg", 1).over(w),
        "weekly_change_yoy": F.lag(TARGET, 1).over(w) - F.lag(TARGET, yoy_lag + 1).over(w),
    }
    return df.withColumns(out)


def weekly_model_features(storage: DataFrame, weather: DataFrame, region: str | None = None) -> DataFrame:
    """Joined weekly table with calendar, weather and storage features.

    Two exchanges follow the join: one by series and one by (series, ISO week).
    """
    if region is not None:
        storage, weather = (d.where(F.col("duoarea") == region) for d in (storage, weather))
    joined = join_weather_storage(storage, weather)
    return add_storage_features(add_weather_features(add_calendar_features(joined)))


def last_n_rows(df: DataFrame, n: int, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Most recent ``n`` rows per series."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(date).desc()))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def training_lookback(df: DataFrame, years: int | None, keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    """Rows of the last ``years`` calendar years of each series."""
    if years is None:
        return df
    newest = F.max("year").over(W.partitionBy(*keys))
    return df.withColumn("_newest", newest).where(F.col("year") >= F.col("_newest") - years + 1).drop("_newest")


def trailing_years(df: DataFrame, years: int, date: str = "date") -> DataFrame:
    """Rows no older than ``years`` before the newest row."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) >= F.add_months(newest, -12 * years))


def forward_fill(value: str, keys: Sequence[str], date: str) -> Column:
    return F.last(value, ignorenulls=True).over(
        W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    )


def last_known_before(value: str, keys: Sequence[str], date: str) -> Column:
    return F.last(value, ignorenulls=True).over(
        W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    )


def tightness(df: DataFrame, value: str = "local_balance", keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    """Deviation from a five-year centred norm of the same ISO week, with its trailing trend.

    The centred frame looks ahead on purpose: this is an after-the-fact report, not a model input.
    """
    centred = W.partitionBy(*keys, "week_of_year").orderBy("date").rowsBetween(-2, 2)
    df = df.withColumn("seasonal_balance_norm", F.avg(value).over(centred))
    df = df.withColumn("market_tightness", F.col(value) - F.col("seasonal_balance_norm"))
    w = series_window(keys)
    return df.withColumns(
        {
            "market_tightness_rolling": F.avg("market_tightness").over(w.rowsBetween(-4, 0)),
            "net_border_flows": F.col(value) - F.col(TARGET),
            "net_border_flows_rolling": F.avg(F.col(value) - F.col(TARGET)).over(w.rowsBetween(-11, 0)),
        }
    )


def interpolate_at(targets: DataFrame, knots: DataFrame, keys: Sequence[str], x: str, values: Sequence[str]) -> DataFrame:
    """Linear interpolation of knot values at the target positions, edges held.

    Knots and targets share one ordered window; no join on ranges is needed.
    """
    k = knots.select(*keys, F.col(x).cast("double").alias("_x"), F.struct(F.col(x).cast("double").alias("x"), *values).alias("_k"))
    t = targets.select(*keys, F.col(x).cast("double").alias("_x"), F.struct(*[c for c in targets.columns if c not in keys]).alias("_t"))
    both = k.unionByName(t, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_x")
    before = F.last("_k", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("_k", ignorenulls=True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    both = both.withColumns({"_b": before, "_a": after}).where(F.col("_t").isNotNull())
    share = (F.col("_x") - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    out = []
    for v in values:
        b, a = F.col(f"_b.{v}"), F.col(f"_a.{v}")
        inside = F.when(F.col("_a.x") == F.col("_b.x"), b).otherwise(b + (a - b) * share)
        out.append(F.when(F.col("_b.x").isNull(), a).when(F.col("_a.x").isNull(), b).otherwise(inside).alias(v))
    return both.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in targets.columns if c not in keys], *out)
