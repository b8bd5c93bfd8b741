"""Error, interval and summary metrics; all are single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.session import staged


def error_columns(actual: str, predicted: str) -> list[Column]:
    e = F.col(actual) - F.col(predicted)
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    ]


def error_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*error_columns(actual, predicted))


def error_metrics_r2(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    return df.groupBy(*keys).agg(*error_columns(actual, predicted), (1 - F.sum(e * e) / total).alias("r2"))


def fold_metrics(df: DataFrame, actual: str, predicted: str, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per fold and an ``overall`` row per key, from one grouping-sets pass."""
    sets = [[*keys, fold], [*keys]]
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, fold]]
    ).agg(*error_columns(actual, predicted), F.count(F.lit(1)).alias("n_samples"), F.grouping(fold).alias("_all"))
    label = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(fold).cast("string"))
    return rows.select(*keys, label.alias(fold), "mae", "rmse", "bias", "n_samples")


def bucket_comparison(df: DataFrame, keys: Sequence[str] = (), bucket: str = "horizon_bucket",
                      actual: str = "actual_mw", baseline: str = "baseline_mw", corrected: str = "corrected_mw") -> DataFrame:
    """Baseline against corrected error per bucket and overall."""
    rows = df.groupingSets(
        [[F.col(c) for c in [*keys, bucket]], [F.col(c) for c in keys]], *[F.col(c) for c in [*keys, bucket]]
    ).agg(
        F.avg(F.abs(F.col(actual) - F.col(baseline))).alias("baseline_mae"),
        F.avg(F.abs(F.col(actual) - F.col(corrected))).alias("corrected_mae"),
        F.count(F.lit(1)).alias("n_samples"),
        F.grouping(bucket).alias("_all"),
    )
    label = F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(bucket))
    return rows.select(*keys, label.alias(bucket), "baseline_mae", "corrected_mae", "n_samples")


def interval_columns(actual: str, lower: str, upper: str, coverage: float) -> list[Column]:
    crossed = F.raise_error(F.lit("An interval's lower bound exceeds its upper bound.")).cast("boolean")
    valid = F.when(F.col(lower) > F.col(upper), crossed).otherwise(F.col(actual).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull())
    below = (F.col(actual) < F.col(lower)).cast("double")
    above = (F.col(actual) > F.col(upper)).cast("double")
    inside = F.avg(F.when(valid, 1.0 - F.greatest(below, above)))
    return [
        F.lit(coverage).alias("nominal_coverage"),
        inside.alias("empirical_coverage"),
        (inside - coverage).alias("coverage_error"),
        F.avg(F.when(valid, F.col(upper) - F.col(lower))).alias("average_interval_width"),
        F.avg(F.when(valid, below)).alias("below_interval_rate"),
        F.avg(F.when(valid, above)).alias("above_interval_rate"),
        F.count_if(valid).alias("interval_samples"),
    ]


def interval_metrics(df: DataFrame, actual: str, lower: str, upper: str, coverage: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*interval_columns(actual, lower, upper, coverage))


def crossed_bounds(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """Rows whose lower bound exceeds the upper one; callers reject a non-empty result."""
    return df.where(F.col(lower) > F.col(upper))


ABLATION_DIMENSIONS = ("weather_input", "weather_weighting", "reconciliation_method", "model_key", "region", "horizon")


def ablation_summary(df: DataFrame, dims: Sequence[str] = ABLATION_DIMENSIONS,
                     actual: str = "actual_weekly_change", predicted: str = "predicted_weekly_change") -> DataFrame:
    """Errors and interval coverage over experiment dimensions; NULL dimensions are groups too."""
    scored = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    has_band = F.col("p10").isNotNull() & F.col("p90").isNotNull()
    covered = F.avg(F.when(has_band, F.col(actual).between(F.col("p10"), F.col("p90")).cast("double")))
    columns = [*error_columns(actual, predicted), F.count(F.lit(1)).alias("n_samples")]
    if {"p10", "p90"} <= set(df.columns):
        columns.append(covered.alias("interval_coverage"))
    return scored.groupBy(*dims).agg(*columns)


def best_by(df: DataFrame, metric: str, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Row with the smallest metric per key; ``ties`` order equal metrics."""
    row = F.min_by(F.struct(*df.columns), F.struct(metric, *ties))
    return df.groupBy(*keys).agg(row.alias("_b")).select("_b.*")


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, quartiles and extremes; quartiles interpolate linearly."""
    from pitcast.operators.intervals import exact_quantiles

    if not keys:
        return distribution(df.withColumn("_all", F.lit(1)), value, ["_all"]).drop("_all")
    df = staged(df.select(*keys, value), "distribution")
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    quartiles = exact_quantiles(df, value, (0.25, 0.5, 0.75), ("q25", "median", "q75"), keys)
    return basic.join(quartiles, list(keys))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    bucket = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")
    return df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))


def extreme_rows(df: DataFrame, value: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Labels of the smallest and largest value; equal values take the earliest label."""
    return df.groupBy(*keys).agg(
        F.min(F.struct(value, label)).alias("_lo"), F.min(F.struct((-F.col(value)).alias("_neg"), F.col(label))).alias("_hi")
    ).select(
        *keys, F.col(f"_lo.{label}").alias("argmin"), F.col(f"_lo.{value}").alias("min_value"),
        F.col(f"_hi.{label}").alias("argmax"), (-F.col("_hi._neg")).alias("max_value"),
    )
