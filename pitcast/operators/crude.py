"""Weekly crude balance and its seasonal-level component forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.columns import at_least, require_columns
from pitcast.session import staged

# Component names of the weekly series and of the forecast.
RAW_COMPONENTS = (
    "production_kbpd", "refinery_inputs_kbpd", "imports_kbpd", "exports_kbpd", "commercial_stocks_kb", "spr_stocks_kb",
)
FORECAST_COMPONENTS = (
    "production_mmbbl", "imports_mmbbl", "refinery_inputs_mmbbl", "exports_mmbbl", "spr_stock_change_mmbbl",
    "balance_adjustment_mmbbl",
)
NONNEGATIVE = ("production_mmbbl", "imports_mmbbl", "refinery_inputs_mmbbl", "exports_mmbbl")
CHANGE = "commercial_stock_change_mmbbl"
ISO_WEEKS_PER_YEAR = 53


def weekly_balance(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long weekly series to the balance table: daily rates to weekly volumes, stocks to changes."""
    require_columns(long, ["period", "component", "value"], "weekly crude data")
    wide = long.groupBy(*keys, F.col("period").alias("date")).pivot("component", list(RAW_COMPONENTS)).agg(F.first("value"))
    w = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy("date")
    flows = ("production", "imports", "refinery_inputs", "exports")
    out = wide.select(
        *keys, "date",
        *[(F.col(f"{f}_kbpd") * 7.0 / 1000.0).alias(f"{f}_mmbbl") for f in flows],
        (F.col("commercial_stocks_kb") / 1000.0).alias("commercial_stocks_mmbbl"),
        (F.col("spr_stocks_kb") / 1000.0).alias("spr_stocks_mmbbl"),
    )
    out = out.withColumns(
        {
            CHANGE: F.col("commercial_stocks_mmbbl") - F.lag("commercial_stocks_mmbbl").over(w),
            "spr_stock_change_mmbbl": F.col("spr_stocks_mmbbl") - F.lag("spr_stocks_mmbbl").over(w),
        }
    )
    out = out.withColumn(
        "fundamental_balance_mmbbl",
        F.col("production_mmbbl") + F.col("imports_mmbbl") - F.col("refinery_inputs_mmbbl")
        - F.col("exports_mmbbl") - F.col("spr_stock_change_mmbbl"),
    )
    return out.withColumn("balance_adjustment_mmbbl", F.col(CHANGE) - F.col("fundamental_balance_mmbbl"))


def _long(balance: DataFrame, keys: Sequence[str]) -> DataFrame:
    return balance.unpivot([*keys, "date"], list(FORECAST_COMPONENTS), "component", "value").where(F.col("value").isNotNull())


def component_forecasts(balance: DataFrame, targets: DataFrame, keys: Sequence[str] = (),
                        lookback_years: int = 5, recent_weeks: int = 4) -> DataFrame:
    """Seasonal-level forecast of every component at every target date from strictly earlier rows.

    The history of a target is the last ``lookback_years * 53`` rows before it. Rows are numbered
    once per series, so a target meets exactly that many rows through an equality on the row number
    it needs; the number of copies per row is bounded by the lookback.
    """
    if lookback_years < 1 or recent_weeks < 1:
        raise ValueError("lookback_years and recent_weeks must be positive.")
    span = lookback_years * ISO_WEEKS_PER_YEAR
    part = [*keys, "component"]
    w = W.partitionBy(*part).orderBy("date")
    history = _long(balance, keys).withColumns({"_n": F.row_number().over(w), "week": F.weekofyear("date")})
    components = F.array(*[F.lit(c) for c in FORECAST_COMPONENTS])
    asked = targets.select(*keys, F.col("date").alias("target"), F.explode(components).alias("component"))
    # Position of each target in its component's history.
    marks = history.select(*part, F.col("date").alias("_d"), F.lit(0).alias("_o"), "_n").unionByName(
        asked.select(*part, F.col("target").alias("_d"), F.lit(-1).alias("_o"), F.lit(None).cast("int").alias("_n"))
    )
    upto = W.partitionBy(*part).orderBy("_d", "_o").rowsBetween(W.unboundedPreceding, -1)
    last = marks.withColumn("_last", F.max("_n").over(upto)).where((F.col("_o") == -1) & F.col("_last").isNotNull())
    wanted = last.select(
        *part, F.col("_d").alias("target"), "_last",
        F.explode(F.sequence(F.greatest(F.col("_last") - span + 1, F.lit(1)), F.col("_last"))).alias("_n"),
    )
    seen = wanted.join(history, [*part, "_n"])
    per_week = seen.groupBy(*part, "target", "week").agg(
        F.sum("value").alias("_s"),
        F.count(F.lit(1)).alias("_c"),
        F.max("date").alias("_origin"),
        F.sum(F.when(F.col("_last") - F.col("_n") < recent_weeks, F.col("value"))).alias("_rs"),
        F.count_if(F.col("_last") - F.col("_n") < recent_weeks).alias("_rc"),
    )
    mean = F.col("_s") / F.col("_c")
    grouped = per_week.groupBy(*part, "target").agg(
        F.max(F.when(F.col("week") == F.weekofyear("target"), mean)).alias("_same"),
        (F.sum("_s") / F.sum("_c")).alias("_all"),
        F.sum(F.coalesce("_rs", F.lit(0.0)) - F.col("_rc") * mean).alias("_gap"),
        F.sum("_rc").alias("_recent"),
        F.max("_origin").alias("_origin"),
    )
    raw = F.coalesce("_same", "_all") + F.col("_gap") / F.col("_recent")
    clipped = F.when(F.col("component").isin(*NONNEGATIVE), at_least(raw, 0.0)).otherwise(raw)
    return grouped.select(*part, F.col("target").alias("date"), clipped.alias("forecast"), "_origin")


def forecast(balance: DataFrame, targets: DataFrame, keys: Sequence[str] = (), lookback_years: int = 5,
             recent_weeks: int = 4) -> DataFrame:
    """Component forecasts recombined by the physical identity, with the last-change baseline."""
    parts = component_forecasts(balance, targets, keys, lookback_years, recent_weeks)
    wide = parts.groupBy(*keys, "date").pivot("component", list(FORECAST_COMPONENTS)).agg(F.max("forecast"))
    names = {c: f"{c.removesuffix('_mmbbl')}_forecast_mmbbl" for c in FORECAST_COMPONENTS}
    wide = wide.withColumnsRenamed(names)
    known = balance.select(*keys, "date", CHANGE).unionByName(
        targets.select(*keys, "date", F.lit(True).alias("_q")), allowMissingColumns=True
    )
    before = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy(F.unix_date("date")).rangeBetween(W.unboundedPreceding, -1)
    baseline = known.select(
        *keys, "date", "_q",
        F.max(F.when(F.col("_q").isNull(), F.col("date"))).over(before).alias("forecast_origin"),
        F.last(CHANGE, ignorenulls=True).over(before).alias("last_change_baseline_mmbbl"),
    ).where(F.col("_q")).drop("_q")
    fundamental = (
        F.col("production_forecast_mmbbl") + F.col("imports_forecast_mmbbl") - F.col("refinery_inputs_forecast_mmbbl")
        - F.col("exports_forecast_mmbbl") - F.col("spr_stock_change_forecast_mmbbl")
    )
    return wide.join(baseline, [*keys, "date"]).select(
        *keys, "forecast_origin", "date", F.lit("seasonal_level_fundamentals").alias("model"),
        fundamental.alias("fundamental_balance_forecast_mmbbl"),
        (fundamental + F.col("balance_adjustment_forecast_mmbbl")).alias("prediction_mmbbl"),
        "last_change_baseline_mmbbl", *names.values(),
    )


def next_week_target(balance: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return balance.groupBy(*keys).agg(F.date_add(F.max("date"), 7).alias("date"))


def backtest(balance: DataFrame, keys: Sequence[str] = (), initial_train_weeks: int = 156, coverage: float = 0.8,
             min_calibration: int = 30, lookback_years: int = 5, recent_weeks: int = 4) -> DataFrame:
    """One-week-ahead predictions from every weekly origin after the initial rows, with intervals."""
    from pitcast.operators.intervals import horizon_intervals

    clean = staged(balance.where(F.col(CHANGE).isNotNull()), "balance")
    w = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy("date")
    targets = clean.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > initial_train_weeks).select(*keys, "date")
    predicted = forecast(clean, targets, keys, lookback_years, recent_weeks)
    actual = clean.select(*keys, "date", F.col(CHANGE).alias("actual_mmbbl"))
    rows = predicted.join(actual, [*keys, "date"]).withColumn("horizon_bucket", F.lit("h1"))
    return horizon_intervals(
        rows, "actual_mmbbl", "prediction_mmbbl", target="date", coverage=coverage, minimum=min_calibration,
        lower="lower_bound_mmbbl", upper="upper_bound_mmbbl", keys=keys,
    )


def backtest_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of the model and of the last-change baseline."""
    from pitcast.operators.metrics import error_columns

    long = predictions.select(
        *keys, "actual_mmbbl",
        F.explode(F.create_map(
            F.lit("seasonal_level_fundamentals"), F.col("prediction_mmbbl"),
            F.lit("last_change_baseline"), F.col("last_change_baseline_mmbbl"),
        )).alias("model", "_p"),
    )
    return long.groupBy(*keys, "model").agg(*error_columns("actual_mmbbl", "_p"), F.count(F.lit(1)).alias("n_samples"))
