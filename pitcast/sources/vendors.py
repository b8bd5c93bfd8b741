"""Drifting hourly vendor reports normalized to one vintage contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import hour_ending_clock, local_to_utc, repeated_clock
from pitcast.functions.columns import find_column, normalized_name, require_columns, to_double, to_timestamp
from pitcast.operators.asof import keep_latest

# Product codes and accepted column names.
PRODUCTS = {
    "load": "NP3-560-CD", "load_actual": "NP6-345-CD", "wind": "NP4-732-CD", "solar": "NP4-745-CD",
    "outages": "NP3-233-CD", "adequacy": "NP3-763-CD",
}
GEOGRAPHY = "ERCOT"
SYSTEM_NAMES = ("ERCOT", "TOTAL", "SYSTEM", "SYSTEMWIDE", "ERCOTTOTAL")
TIME_NAMES = ("valid_at", "delivery_hour", "timestamp", "datetime", "delivery_datetime")
DAY_NAMES = ("delivery_date", "deliverydate", "operating_date", "operating_day", "operatingday", "date")
HOUR_NAMES = ("hour_ending", "hourending", "he", "hour")
ISSUE_NAMES = ("issued_at", "posted_at", "posted_datetime", "posteddatetime", "publish_time", "created_at")
PLACE_NAMES = ("geography", "region", "zone", "forecast_zone", "weather_zone", "load_zone")
BASELINE_NAMES = {
    "load": ("baseline_mw", "forecast_mw", "system_total", "load_forecast", "forecast", "mw"),
    "wind": ("baseline_mw", "stwpf_system_wide", "stwpf", "wgrpp_system_wide", "wgrpp", "wind_forecast", "forecast", "mw"),
    "solar": ("baseline_mw", "stppf_system_wide", "stppf", "pvgrpp_system_wide", "pvgrpp", "solar_forecast", "forecast", "mw"),
}
ACTUAL_NAMES = {
    "load": ("actual_mw", "actual_load", "system_load", "actual"),
    "wind": ("actual_mw", "gen_system_wide", "gen", "wind_generation", "actual"),
    "solar": ("actual_mw", "gen_system_wide", "gen", "solar_generation", "actual"),
}
ACTUAL_LOAD_NAMES = ("actual_mw", "actual_load", "system_load", "system_total", "total", "load", "mw")
OUTAGE_ZONES = {
    "conventional_outage_mw": ("totalresourcemwzone",),
    "renewable_outage_mw": ("totalirrmwzone",),
    "new_equipment_outage_mw": ("totalnewequipmentresourcemwzone", "totalnewequipresourcemwzone"),
}
OUTAGE_NAMES = {
    "conventional_outage_mw": ("conventional_outage_mw", "total_resource_out_mw", "resource_outage", "total_outage"),
    "renewable_outage_mw": ("renewable_outage_mw", "irr_out_mw", "irr_outage"),
    "new_equipment_outage_mw": ("new_equipment_outage_mw", "new_equip_out_mw", "new_equipment_outage"),
}
ADEQUACY_NAMES = {
    "available_capacity_mw": ("available_capacity_mw", "avail_cap_gen", "total_cap_gen", "total_generation_capacity", "available_generation"),
}
WEATHER_NAMES = {
    "temperature_f": ("temperature_f", "temperature_2m_f", "temperature_2m"),
    "wind_speed_100m_mph": ("wind_speed_100m_mph", "wind_speed_100m"),
    "shortwave_radiation_wm2": ("shortwave_radiation_wm2", "shortwave_radiation"),
    "cloud_cover_pct": ("cloud_cover_pct", "cloud_cover"),
}
HOURLY_ACTUALS = {
    "load_actual_mw": ("load_actual_mw", "demand", "actual_demand", "load"),
    "wind_actual_mw": ("wind_actual_mw", "wind"),
    "solar_actual_mw": ("solar_actual_mw", "solar"),
    "gas_generation_actual_mw": ("gas_generation_actual_mw", "natural_gas", "naturalgas", "gas"),
    "coal_generation_actual_mw": ("coal_generation_actual_mw", "coal"),
    "nuclear_actual_mw": ("nuclear_actual_mw", "nuclear"),
    "hydro_actual_mw": ("hydro_actual_mw", "hydro", "hydroelectric"),
    "other_nonthermal_actual_mw": ("other_nonthermal_actual_mw", "other", "other_energy_sources"),
    "net_imports_actual_mw": ("net_imports_actual_mw", "net_imports", "total_interchange", "interchange"),
    "battery_net_discharge_actual_mw": ("battery_net_discharge_actual_mw", "battery", "battery_storage"),
}
SIGN_FLIPPED = ("totalinterchange", "interchange")
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def vendor_instant(text: Column) -> Column:
    """Vendor timestamp text to UTC; text without an offset is market wall-clock time."""
    text = text.cast("string")
    return F.when(text.rlike(OFFSET), to_timestamp(text)).otherwise(local_to_utc(to_timestamp(text)))


def mixed_offsets(df: DataFrame, column: str) -> DataFrame:
    """Counts of offset-aware and offset-free texts; a report with both is rejected."""
    aware = F.col(column).cast("string").rlike(OFFSET)
    return df.agg(F.count_if(aware).alias("aware"), F.count_if(~aware).alias("local"))


def _one_kind_of_time(df: DataFrame, column: str, report: Sequence[str]) -> DataFrame:
    """``df``, unless a report mixes offset-aware and offset-free texts in ``column`` or holds an unreadable one; these stop the job."""
    text = F.col(column).cast("string")
    bad = F.raise_error(F.lit(f"Vendor times in {column} cannot mix offset-aware and offset-free values.")).cast("boolean")
    lost = F.raise_error(F.lit(f"The report holds an unreadable time in {column}.")).cast("boolean")
    readable = F.when(text.isNull() | vendor_instant(text).isNull(), lost).otherwise(True)
    if report:
        mixed = df.groupBy(*report).agg((F.bool_or(text.rlike(OFFSET)) & F.bool_or(~text.rlike(OFFSET))).alias("_mixed"))
        return df.join(mixed, list(report)).where(F.when(F.col("_mixed"), bad).otherwise(readable)).drop("_mixed")
    mixed = mixed_offsets(df, column).select((F.col("aware") > 0) & (F.col("local") > 0)).scalar()
    return df.where(F.when(mixed, bad).otherwise(readable))


def system_rows(df: DataFrame, report: Sequence[str] = ()) -> DataFrame:
    """System-wide rows of each report, or all its rows when it names none."""
    place = find_column(df, PLACE_NAMES, required=False)
    if place is None:
        return df
    name = F.regexp_replace(F.upper(F.col(place).cast("string")), "[^A-Z0-9]", "")
    marked = df.withColumn("_sys", name.isin(*SYSTEM_NAMES))
    if report:
        known = marked.groupBy(*report).agg(F.bool_or("_sys").alias("_any"))
        marked = marked.join(known, list(report))
    else:
        marked = marked.withColumn("_any", df.agg(F.bool_or(name.isin(*SYSTEM_NAMES))).scalar())
    return marked.where(F.col("_sys") | ~F.coalesce("_any", F.lit(False))).drop("_sys", "_any")


def valid_instant(df: DataFrame, order: str | None = None, report: Sequence[str] = ()) -> DataFrame:
    """Add ``valid_at`` from a timestamp column or from delivery day and hour ending.

    The autumn hour that the clock shows twice is told apart by ``order``, the row order inside a report. It stops the job where
    no order is given, or where a place's report does not hold both passes. Only that hour's rows are ranked.
    """
    time = find_column(df, TIME_NAMES, required=False)
    if time is not None:
        return _one_kind_of_time(df, time, report).withColumn("valid_at", vendor_instant(F.col(time)))
    clock = hour_ending_clock(find_column(df, DAY_NAMES), find_column(df, HOUR_NAMES))
    lost = F.raise_error(F.lit("The report holds an unreadable delivery day or hour.")).cast("timestamp")
    marked = df.withColumn("_clock", F.coalesce(clock, lost))
    unclear = F.raise_error(F.lit("Ambiguous local hours need ordered duplicate rows or a time with an offset."))
    if order is None:
        utc = F.when(repeated_clock(F.col("_clock")), unclear.cast("timestamp")).otherwise(local_to_utc(F.col("_clock")))
        return marked.withColumn("valid_at", utc).drop("_clock")
    place = find_column(df, PLACE_NAMES, required=False)
    keys = [*report, *([place] if place else []), "_clock"]
    w = W.partitionBy(*keys)
    twice = F.when(F.count(F.lit(1)).over(w) == 2, F.row_number().over(w.orderBy(order))).otherwise(unclear.cast("int"))
    repeated = marked.where(repeated_clock(F.col("_clock"))).withColumn("_occ", twice)
    plain = marked.where(~repeated_clock(F.col("_clock"))).withColumn("_occ", F.lit(1))
    return plain.unionByName(repeated).withColumn("valid_at", local_to_utc(F.col("_clock"), F.col("_occ"))).drop("_clock", "_occ")


def issue_instant(df: DataFrame, issued: Column | None) -> Column:
    name = find_column(df, ISSUE_NAMES, required=False)
    if name is not None:
        return vendor_instant(F.col(name))
    if issued is None:
        raise ValueError("The report has no publication time; pass one.")
    return issued


def _provenance(df: DataFrame, product: str, issued: Column | None, retrieved: Column, source_hash: Column | None,
                order: str | None, report: Sequence[str]) -> DataFrame:
    rows = valid_instant(system_rows(df, report), order, report)
    return rows.withColumn("_issued", issue_instant(rows, issued)).withColumns({
        "retrieved_at_": retrieved, "source_": F.lit("ERCOT"), "product_": F.lit(product.upper()),
        "hash_": source_hash if source_hash is not None else F.lit(""),
    })


def _keys() -> list[Column]:
    return [
        F.col("valid_at"), F.col("_issued").alias("issued_at"), F.col("retrieved_at_").alias("retrieved_at"),
        F.col("source_").alias("source"), F.col("product_").alias("product_id"), F.lit(GEOGRAPHY).alias("geography"),
        F.col("hash_").alias("source_hash"),
    ]


def _readable(value: Column, what: str) -> Column:
    """The value; a missing one stops the job, as a sum or a series without it would be short unseen."""
    return F.coalesce(value, F.raise_error(F.lit(f"The report holds an unreadable {what}.")).cast("double"))


def component_product(df: DataFrame, component: str, retrieved: Column, product: str | None = None, issued: Column | None = None,
                      source_hash: Column | None = None, order: str | None = None, report: Sequence[str] = ()) -> DataFrame:
    """Load, wind or solar report as vintages; zone rows of one instant are summed."""
    if component not in BASELINE_NAMES:
        raise ValueError("component must be load, wind or solar.")
    base = find_column(df, BASELINE_NAMES[component])
    actual = find_column(df, ACTUAL_NAMES[component], required=False)
    rows = _provenance(df, product or PRODUCTS[component], issued, retrieved, source_hash, order, report)
    out = rows.select(
        *_keys(), F.lit(component).alias("component"), _readable(to_double(base), f"{component} baseline").alias("baseline_mw"),
        (to_double(actual) if actual else F.lit(None).cast("double")).alias("actual_mw"),
    )
    group = [c for c in out.columns if c not in ("baseline_mw", "actual_mw")]
    # SUM is NULL when every actual is NULL, which is the wanted "unknown".
    summed = out.groupBy(*group).agg(F.sum("baseline_mw").alias("baseline_mw"), F.sum("actual_mw").alias("actual_mw"))
    return keep_latest(summed, ["product_id", "issued_at", "valid_at", "component"], ["retrieved_at"])


def actual_load(df: DataFrame, retrieved: Column, issued: Column | None = None, source_hash: Column | None = None,
                order: str | None = None, report: Sequence[str] = ()) -> DataFrame:
    value = find_column(df, ACTUAL_LOAD_NAMES)
    rows = _provenance(df, PRODUCTS["load_actual"], issued, retrieved, source_hash, order, report)
    out = rows.select(*_keys(), _readable(to_double(value), "actual load").alias("load_actual_mw"))
    return keep_latest(out, ["product_id", "issued_at", "valid_at"], ["retrieved_at"])


def _row_sum(names: Sequence[str]) -> Column:
    """Sum across columns, NULL only when all are NULL."""
    values = F.filter(F.array(*[to_double(n) for n in names]), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def _capacity(df: DataFrame, product: str, names: dict[str, Sequence[str]], retrieved: Column, issued: Column | None,
              source_hash: Column | None, order: str | None, report: Sequence[str]) -> DataFrame:
    found = {out: find_column(df, aliases, required=False) for out, aliases in names.items()}
    if not any(found.values()):
        raise ValueError(f"Product {product} has no recognized capacity column.")
    rows = _provenance(df, product, issued, retrieved, source_hash, order, report)
    values = [(to_double(c) if c else F.lit(0.0)).alias(out) for out, c in found.items()]
    flat = rows.select(*_keys(), *values)
    group = [c for c in flat.columns if c not in names]
    # Zones of one instant are added; a lone unknown stays NULL.
    summed = flat.groupBy(*group).agg(*[
        F.when(F.count(F.lit(1)) > 1, F.coalesce(F.sum(v), F.lit(0.0))).otherwise(F.sum(v)).alias(v) for v in names
    ])
    return keep_latest(summed, ["product_id", "issued_at", "valid_at"], ["retrieved_at"])


def outages(df: DataFrame, retrieved: Column, issued: Column | None = None, source_hash: Column | None = None,
            order: str | None = None, report: Sequence[str] = ()) -> DataFrame:
    """Outages; zone columns are added across the row."""
    for out, prefixes in OUTAGE_ZONES.items():
        for prefix in prefixes:
            zones = [c for c in df.columns if normalized_name(c).startswith(prefix)]
            if zones:
                df = df.withColumn(out, _row_sum(zones))
                break
    return _capacity(df, PRODUCTS["outages"], OUTAGE_NAMES, retrieved, issued, source_hash, order, report)


def adequacy(df: DataFrame, retrieved: Column, issued: Column | None = None, source_hash: Column | None = None,
             order: str | None = None, report: Sequence[str] = ()) -> DataFrame:
    return _capacity(df, PRODUCTS["adequacy"], ADEQUACY_NAMES, retrieved, issued, source_hash, order, report)


def weather_forecasts(df: DataFrame) -> DataFrame:
    """Archived hourly weather issues; absent measures are zero."""
    valid = find_column(df, ("valid_at", "delivery_hour", "time", "datetime"))
    issued = find_column(df, ("issued_at", "run_time", "initialization_time"))
    measures = []
    for out, names in WEATHER_NAMES.items():
        c = find_column(df, names, required=False)
        measures.append((to_double(c) if c else F.lit(0.0)).alias(out))
    return df.select(to_timestamp(valid).alias("valid_at"), to_timestamp(issued).alias("issued_at"), *measures, F.lit(GEOGRAPHY).alias("geography"))


def hourly_actuals(df: DataFrame, fuels: Sequence[str], time: str = "period", kind: str = "type_name", value: str = "value",
                   place: str = "respondent") -> DataFrame:
    """Long hourly fuel rows of one balancing area to one wide row per UTC hour.

    ``fuels`` lists the known type labels, so the pivot needs no discovery pass.
    """
    require_columns(df, [time, kind, value], "hourly actuals")
    if place in df.columns:
        df = df.where(F.upper(place).isin("ERCO", "ERCOT"))
    label = F.lower(F.replace(F.col(kind), F.lit(" "), F.lit("_")))
    names = [f.lower().replace(" ", "_") for f in fuels]
    wide = df.select(to_timestamp(time).alias("valid_at"), label.alias("_k"), to_double(value).alias("_v"))
    wide = wide.groupBy("valid_at").pivot("_k", names).agg(F.sum("_v"))
    out = []
    for target, aliases in HOURLY_ACTUALS.items():
        c = find_column(wide, aliases, required=False)
        expr = F.col(c) if c else F.lit(None).cast("double")
        out.append((-expr if c and normalized_name(c) in SIGN_FLIPPED else expr).alias(target))
    return wide.select("valid_at", *out, F.lit(GEOGRAPHY).alias("geography"))


def merge_actuals(fuel: DataFrame, region: DataFrame, keys: Sequence[str] = ("valid_at",)) -> DataFrame:
    """Full outer join of two actuals tables; the first table's values win column by column."""
    shared = [c for c in fuel.columns if c in region.columns and c not in keys]
    only = [c for c in region.columns if c not in fuel.columns]
    right = region.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    both = fuel.join(right, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(c, f"_r_{c}").alias(c) if c in shared else F.col(c) for c in fuel.columns if c not in keys], *only)


def override_load(actuals: DataFrame, load_vintages: DataFrame) -> DataFrame:
    """Latest vendor load per hour overrides the load of the actuals table."""
    latest = keep_latest(load_vintages.select("valid_at", "issued_at", "load_actual_mw"), ["valid_at"], ["issued_at"])
    return merge_actuals(latest.select("valid_at", "load_actual_mw"), actuals)
