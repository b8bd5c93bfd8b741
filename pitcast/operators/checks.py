"""Table contracts as aggregates.

Every check returns one small row of violation counts, computed in a single pass where it can be;
``enforce`` turns a non-zero count into an error. Nothing but that row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.columns import require_columns
from pitcast.operators.crude import FORECAST_COMPONENTS, NONNEGATIVE, RAW_COMPONENTS
from pitcast.operators.features import BASE_COLUMNS, ENGINEERED
from pitcast.operators.reconcile import ALL_REGIONS

PROVENANCE = ("source", "product_id", "issued_at", "retrieved_at", "valid_at", "geography", "source_hash")


class ContractError(ValueError):
    """A table breaks its contract."""


def enforce(report: DataFrame, what: str = "table") -> None:
    """Raise when any violation count of the one-row report is not zero."""
    row = report.first()
    broken = {k: v for k, v in row.asDict().items() if v}
    if broken:
        raise ContractError(f"{what} violates its contract: {broken}")


def _any_null(columns: Sequence[str]) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out = out | F.col(c).isNull()
    return out


def _counts(df: DataFrame, **rules: Column) -> DataFrame:
    return df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])


def _with_duplicates(df: DataFrame, keys: Sequence[str], **rules: Column) -> DataFrame:
    """Row rules and duplicate keys from one aggregation by key, then one total."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(r).alias(n) for n, r in rules.items()])
    return per_key.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rules],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def vintage_contract(df: DataFrame) -> DataFrame:
    require_columns(df, PROVENANCE, "vintage table")
    return _counts(df, null_provenance=_any_null(PROVENANCE), issued_after_retrieved=F.col("issued_at") > F.col("retrieved_at"))


def weekly_storage(df: DataFrame) -> DataFrame:
    return _counts(df, null_values=_any_null(["period", "value"]), negative_values=F.col("value") < 0)


def consecutive_weeks(df: DataFrame, keys: Sequence[str] = ("duoarea",), date: str = "period") -> DataFrame:
    """Per series: repeated periods and steps that are not seven days."""
    step = F.datediff(F.col(date), F.lag(date).over(W.partitionBy(*keys).orderBy(date)))
    return df.select(*keys, step.alias("_s")).groupBy(*keys).agg(
        F.count_if(F.col("_s") == 0).alias("duplicate_periods"),
        F.count_if((F.col("_s") != 7) & (F.col("_s") != 0)).alias("gaps"),
    )


def weekly_weather(df: DataFrame, keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    return _with_duplicates(df, [*keys, "date"], not_friday=F.weekday("date") != 4, incomplete_weeks=F.col("weather_days") != 7)


def locations(df: DataFrame, expected: DataFrame | None = None, name: str = "state", weight: str = "weight") -> DataFrame:
    out = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w")).agg(
        F.sum(F.col("_n") - 1).alias("duplicate_names"), (F.abs(F.sum("_w") - 1) > 1e-6).cast("bigint").alias("weight_not_one")
    )
    if expected is None:
        return out
    a, b = df.select(name).distinct(), expected.select(name).distinct()
    lacking = b.join(a, name, "left_anti").agg(F.count(F.lit(1))).scalar()
    unknown = a.join(b, name, "left_anti").agg(F.count(F.lit(1))).scalar()
    return out.withColumns({"missing_states": lacking, "unexpected_states": unknown})


def state_grid(df: DataFrame, expected_states: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per check: repeated (date, state) rows and dates without all states."""
    cells = df.groupBy(*keys, "date", "state").agg(F.count(F.lit(1)).alias("_n"))
    days = cells.groupBy(*keys, "date").agg(F.sum(F.col("_n") - 1).alias("_dup"), F.count(F.lit(1)).alias("_states"))
    return days.agg(F.sum("_dup").alias("duplicate_rows"), F.count_if(F.col("_states") != expected_states).alias("incomplete_dates"))


def weather_scenarios(df: DataFrame) -> DataFrame:
    keys = [c for c in ("date", "duoarea", "issued_at", "provider", "model", "model_run") if c in df.columns]
    return _with_duplicates(df, keys, null_keys=_any_null(["date", "duoarea", "issued_at"]), nonpositive_days=F.col("weather_days") <= 0)


def forecast_archive(df: DataFrame) -> DataFrame:
    text = ("provider", "model", "model_run", "ensemble_member", "state", "duoarea")
    blank = F.lit(False)
    for c in text:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    keys = ["provider", "model", "model_run", "ensemble_member", "issued_at", "valid_start", "state", "duoarea"]
    return _with_duplicates(
        df, keys,
        empty_period=F.col("valid_end") <= F.col("valid_start"),
        issued_after_end=F.col("issued_at") >= F.col("valid_end"),
        bad_coverage=~F.col("coverage").between(0.0, 1.0) | F.col("coverage").isNull(),
        blank_text=blank,
    )


def balance_vintages(df: DataFrame) -> DataFrame:
    values = ["date", "duoarea", "available_at", "local_balance", "net_inflow_balancing"]
    return _with_duplicates(df, ["date", "duoarea", "available_at"], null_values=_any_null(values))


def origins(df: DataFrame) -> DataFrame:
    return _with_duplicates(df, ["date", "duoarea"], null_keys=_any_null(["date", "duoarea"]) | (F.col("duoarea") == ""))


def model_features(df: DataFrame, region: str | None = None) -> DataFrame:
    require_columns(df, (*BASE_COLUMNS, *ENGINEERED), "model feature table")
    other = (F.col("duoarea") != region) if region else F.lit(False)
    return _with_duplicates(df, ["date", "duoarea"], null_dates=F.col("date").isNull(), nonpositive_days=F.col("weather_days") <= 0, other_regions=other)


def crude_long(df: DataFrame) -> DataFrame:
    """Row rules, completeness of the six components per week, and consecutive weeks."""
    rows = df.where(F.col("component").isin(*RAW_COMPONENTS))
    cells = rows.groupBy("period", "component").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("_bad"),
        F.count_if(F.col("value") < 0).alias("_neg"),
    )
    weeks = cells.groupBy("period").agg(
        F.sum(F.col("_n") - 1).alias("_dup"), F.sum("_bad").alias("_bad"), F.sum("_neg").alias("_neg"),
        (F.count(F.lit(1)) != len(RAW_COMPONENTS)).cast("int").alias("_part"),
    )
    step = F.datediff("period", F.lag("period").over(W.orderBy("period")))
    return weeks.withColumn("_s", step).agg(
        F.sum("_dup").alias("duplicate_keys"), F.sum("_bad").alias("not_finite"), F.sum("_neg").alias("negative_values"),
        F.sum("_part").cast("bigint").alias("incomplete_weeks"), F.count_if(F.weekday("period") != 4).alias("not_friday"),
        F.count_if(F.col("_s") != 7).alias("gaps"),
    )


def crude_balance(df: DataFrame) -> DataFrame:
    """Fridays, unique and consecutive weeks, flows not negative, no interior gaps.

    Differences may be missing in the first row only.
    """
    w = W.orderBy("date")
    interior = F.row_number().over(w) > 1
    diffs = ["commercial_stock_change_mmbbl", "spr_stock_change_mmbbl", "balance_adjustment_mmbbl"]
    infinite = F.lit(False)
    for c in FORECAST_COMPONENTS:
        infinite = infinite | F.isnan(c) | (F.abs(c) == float("inf"))
    negative = F.lit(False)
    for c in NONNEGATIVE:
        negative = negative | (F.col(c) < 0)
    marked = df.select(
        "date", F.datediff("date", F.lag("date").over(w)).alias("_s"),
        (_any_null([c for c in FORECAST_COMPONENTS if c not in diffs]) | (interior & _any_null(diffs))).alias("_null"),
        negative.alias("_neg"), infinite.alias("_inf"),
    )
    return marked.agg(
        F.count_if(F.weekday("date") != 4).alias("not_friday"), F.count_if(F.col("_s") == 0).alias("duplicate_dates"),
        F.count_if((F.col("_s") != 7) & (F.col("_s") != 0)).alias("gaps"), F.count_if("_null").alias("missing_values"),
        F.count_if("_neg").alias("negative_values"), F.count_if("_inf").alias("not_finite"),
    )


def reconcilable(df: DataFrame, group: Sequence[str] = ("date", "horizon"), value: str = "predicted_weekly_change") -> DataFrame:
    cells = df.groupBy(*group, "region").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value).isNull()).alias("_null"))
    groups = cells.groupBy(*group).agg(
        F.sum(F.col("_n") - 1).alias("_dup"), F.sum("_null").alias("_null"),
        (F.count_if(F.col("region").isin(*ALL_REGIONS)) != len(ALL_REGIONS)).cast("bigint").alias("_part"),
    )
    return groups.agg(
        F.sum("_dup").alias("duplicate_keys"), F.sum("_null").alias("missing_values"), F.sum("_part").alias("incomplete_groups")
    )


def recursive_inputs(df: DataFrame, keys: Sequence[str] = ("duoarea",)) -> DataFrame:
    return _with_duplicates(df, [*keys, "date"], null_dates=F.col("date").isNull())


def recursive_origins(origins_table: DataFrame) -> DataFrame:
    return _counts(
        origins_table, not_friday=F.weekday("start_date") != 4, late_origin=F.to_date("as_of") >= F.col("start_date")
    )
