"""Calendar expressions shared by every operator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.functions.columns import at_least

# Local market zone, degree-day base, horizon buckets.
LOCAL_ZONE = "America/Chicago"
DEGREE_DAY_BASE_F = 65.0
HORIZON_BUCKETS = (("h001_024", 1, 24), ("h025_072", 25, 72), ("h073_168", 73, 168))
INJECTION_MONTHS = (4, 5, 6, 7, 8, 9, 10)
SHOULDER_MONTHS = (4, 5, 9, 10)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def week_ending_friday(day: Column | str) -> Column:
    """Friday that closes the Saturday-to-Friday reporting week of ``day``."""
    d = F.to_date(_col(day))
    return F.date_add(d, F.pmod(F.lit(4) - F.weekday(d), F.lit(7)).cast("int"))


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(day)).cast("int")


def degree_days(df: DataFrame, temperature: str = "temperature_f") -> DataFrame:
    t = F.col(temperature)
    base = F.lit(DEGREE_DAY_BASE_F)
    return df.withColumns(
        {"hdd": at_least(base - t, 0.0), "cdd": at_least(t - base, 0.0)}
    )


def cyclic(value: Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi * harmonic) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def add_calendar_features(df: DataFrame, date: str = "date", week: str = "week_of_year") -> DataFrame:
    """Cyclic week and month encodings plus the three season flags."""
    month = F.month(date)
    week_sin, week_cos = cyclic(F.col(week), 52)
    month_sin, month_cos = cyclic(month, 12)
    injection = month.isin(*INJECTION_MONTHS)
    return df.withColumns(
        {
            "week_sin": week_sin,
            "week_cos": week_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "is_injection_season": injection.cast("int"),
            "is_withdrawal_season": (~injection).cast("int"),
            "is_shoulder_month": month.isin(*SHOULDER_MONTHS).cast("int"),
        }
    )


def fourier_names(harmonics: int) -> list[str]:
    return [f"{fn}_{k}" for k in range(1, harmonics + 1) for fn in ("sin", "cos")]


def add_fourier(df: DataFrame, harmonics: int, week: str = "week_of_year", period: float = 52.0) -> DataFrame:
    columns = {}
    for k in range(1, harmonics + 1):
        s, c = cyclic(F.col(week), period, k)
        columns[f"sin_{k}"], columns[f"cos_{k}"] = s, c
    return df.withColumns(columns)


def horizon_bucket(hours: Column | str) -> Column:
    h = _col(hours)
    expr = F.lit(None).cast("string")
    for name, low, high in reversed(HORIZON_BUCKETS):
        expr = F.when(h.between(low, high), F.lit(name)).otherwise(expr)
    return expr


def local_time(instant: Column | str) -> Column:
    """Wall-clock time in the market zone of a UTC instant."""
    return F.from_utc_timestamp(_col(instant).cast("timestamp"), LOCAL_ZONE)


def hour_of_week(instant: Column | str) -> Column:
    """Local weekday (Monday 0) times 24 plus local hour."""
    local = local_time(instant)
    return (F.weekday(local) * 24 + F.hour(local)).cast("int")


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole hours between two instants, rounded."""
    seconds = F.unix_timestamp(_col(later).cast("timestamp")) - F.unix_timestamp(_col(earlier).cast("timestamp"))
    return F.round(seconds / F.lit(3600.0)).cast("int")


def add_hourly_features(df: DataFrame, origin: str = "forecast_origin", target: str = "delivery_hour") -> DataFrame:
    """Horizon, local-clock cycles and bucket for hourly forecasts."""
    if "horizon_hour" not in df.columns:
        df = df.withColumn("horizon_hour", hours_between(target, origin))
    local = local_time(target)
    hour_sin, hour_cos = cyclic(F.hour(local), 24)
    dow_sin, dow_cos = cyclic(F.weekday(local), 7)
    df = df.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "horizon_bucket": horizon_bucket("horizon_hour"),
        }
    )
    return df if "recent_error_mw" in df.columns else df.withColumn("recent_error_mw", F.lit(0.0))


def _is_repeated_clock(local_text: Column) -> Column:
    """True for the wall-clock hour that occurs twice when daylight saving ends."""
    first = F.to_utc_timestamp(local_text, LOCAL_ZONE)
    return F.from_utc_timestamp(first + F.expr("INTERVAL 1 HOUR"), LOCAL_ZONE) == local_text.cast("timestamp")


def local_to_utc(local: Column, occurrence: Column | None = None) -> Column:
    """Market wall-clock time to UTC.

    A clock reading skipped in spring moves forward to the first valid instant. A reading that
    occurs twice in autumn takes the instant of its ``occurrence`` (1 or 2).
    """
    utc = F.to_utc_timestamp(local, LOCAL_ZONE)
    skipped = F.from_utc_timestamp(utc, LOCAL_ZONE) != local.cast("timestamp")
    utc = F.when(skipped, F.date_trunc("hour", utc)).otherwise(utc)
    if occurrence is None:
        return utc
    second = (occurrence > 1) & _is_repeated_clock(local)
    return F.when(second, utc + F.expr("INTERVAL 1 HOUR")).otherwise(utc)


def repeated_clock(local: Column) -> Column:
    return _is_repeated_clock(local)


def hour_ending_clock(day: Column | str, hour_ending: Column | str) -> Column:
    """Wall-clock end of a delivery hour given as 1..24, "1:00" or "24:00"."""
    text = F.regexp_extract(_col(hour_ending).cast("string"), r"^\s*(\d{1,2})(?::\d{2})?\s*$", 1)
    number = F.coalesce(_col(hour_ending).cast("string").try_cast("double").cast("int"), text.try_cast("int"))
    return F.timestamp_add("HOUR", number, F.to_date(_col(day)).cast("timestamp"))
