"""Small report tables over published results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.operators import rollups
from pitcast.operators.crude import FORECAST_COMPONENTS

SUBTRACTED = ("refinery_inputs_mmbbl", "exports_mmbbl", "spr_stock_change_mmbbl")


def weekly_report(balance: DataFrame) -> DataFrame:
    """Balance rows with week-over-week price and change deltas."""
    w = W.partitionBy("duoarea").orderBy("date")
    return balance.withColumns({
        "price_delta": F.col("price") - F.lag("price").over(w),
        "change_delta": F.col("weekly_change_bcf") - F.lag("weekly_change_bcf").over(w),
    })


def outlier_weeks(storage: DataFrame) -> DataFrame:
    """Weeks of the newest year against the range of the five years before it."""
    profile = rollups.year_week_profile(storage, "weekly_change_bcf")
    newest = storage.agg(F.max("year")).scalar()
    rows = storage.where(F.col("year") == newest).join(profile, ["duoarea", "week_of_year"])
    x = F.col("weekly_change_bcf")
    return rows.select(
        "duoarea", "date", "weekly_change_bcf", (x - F.col("avg_value")).alias("deviation"),
        ((x < F.col("min_value")) | (x > F.col("max_value"))).alias("outside_5yr_range"),
    )


def coverage_card(predictions: DataFrame, actual: str, lower: str, upper: str) -> DataFrame:
    known = predictions.where(F.col(actual).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull())
    inside = F.col(actual).between(F.col(lower), F.col(upper)).cast("double")
    return known.agg(F.count(F.lit(1)).alias("interval_rows"), F.avg(inside).alias("coverage"), F.avg(F.col(upper) - F.col(lower)).alias("average_width"))


def waterfall(forecast: DataFrame) -> DataFrame:
    """Signed contribution of every component of a crude forecast."""
    terms = [
        F.struct(F.lit(c).alias("term"), (F.col(f"{c.removesuffix('_mmbbl')}_forecast_mmbbl") * (-1.0 if c in SUBTRACTED else 1.0)).alias("value"))
        for c in FORECAST_COMPONENTS
    ]
    return forecast.select("date", F.explode(F.array(*terms)).alias("t")).select("date", "t.term", "t.value")


def staleness(df: DataFrame, date: str, today: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(date).alias("newest")).withColumn("age_days", F.datediff(today, "newest"))


def provenance(vintages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return vintages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("valid_at").alias("first_valid"), F.max("valid_at").alias("last_valid")
    )


def chart_frame(df: DataFrame) -> DataFrame:
    """Actuals, prediction, band, deviation and outlier flag in date order."""
    return df.select(
        "duoarea", "date", "weekly_change_bcf", "predicted_weekly_change", "lower_band", "upper_band", "forecast_deviation", "outside_band"
    ).orderBy("duoarea", "date")
