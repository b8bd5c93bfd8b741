"""Landed JSON payloads to rows, inside the JVM.

A payload column holds one response as text. Landed files are read with ``read_payloads``; nothing
here talks to a network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitcast.functions.calendar import degree_days
from pitcast.functions.columns import to_timestamp
from pitcast.operators.rollups import ARCHIVE_COLUMNS

MEMBER_PREFIX = "temperature_2m_mean"
LEAD_PATTERN = r"^temperature_2m_mean_previous_day(\d+)$"
DAILY = "struct<daily: map<string, array<string>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file."""
    return spark.read.option("wholetext", "true").text(path).select(
        F.col("value").alias("payload"), F.input_file_name().alias("file")
    )


def statistical_rows(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """``response.data[]`` records with period, series and value; a payload without them is an error."""
    shape = "struct<response: struct<data: array<struct<period: string, series: string, duoarea: string, value: string>>>>"
    data = F.from_json(payload, shape)["response"]["data"]
    checked = F.when(data.isNull(), F.raise_error(F.lit("payload has no response.data node"))).otherwise(data)
    rows = df.select(*keep, F.explode(checked).alias("r"))
    return rows.select(
        *keep, F.col("r.period").try_cast("date").alias("period"), F.col("r.series").alias("series"),
        F.col("r.duoarea").alias("duoarea"), F.col("r.value").try_cast("double").alias("value"),
    )


def labelled_components(rows: DataFrame, names: dict[str, str], start: Column, end: Column) -> DataFrame:
    """Name the components of known series codes inside a period window; a component without any row there stops the job."""
    label = F.lit(None).cast("string")
    for code, name in names.items():
        label = F.when(F.col("series") == code, F.lit(name)).otherwise(label)
    out = rows.withColumn("component", label).where(F.col("component").isNotNull() & F.col("period").between(start, end))
    absent = sorted(r[0] for r in absent_components(out, list(names.values())).collect())
    if absent:
        raise ValueError(f"The window holds no rows of components {absent}.")
    return out.select("period", "component", "value")


def absent_components(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    want = rows.sparkSession.createDataFrame([(n,) for n in names], "component string")
    return want.join(rows.select("component").distinct(), "component", "left_anti")


def spot_prices(rows: DataFrame) -> DataFrame:
    """One price per day."""
    return rows.where(F.col("period").isNotNull() & F.col("value").isNotNull()).groupBy("period").agg(F.max("value").alias("value"))


def latest_price(prices: DataFrame, default: float = 3.0) -> DataFrame:
    """Newest non-null price, or the default."""
    return prices.agg(F.coalesce(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period"))), F.lit(default)).alias("gas_price"))


def daily_temperatures(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ("state",), field: str = MEMBER_PREFIX) -> DataFrame:
    """Parallel daily arrays to rows; arrays of different length are an error."""
    daily = F.from_json(payload, DAILY)["daily"]
    parts = df.select(*keep, daily["time"].alias("t"), daily[field].alias("v"))
    zipped = F.when(F.size("t") == F.size("v"), F.arrays_zip("t", "v")).otherwise(F.raise_error(F.lit("daily arrays differ in length")))
    return parts.select(*keep, F.explode(zipped).alias("z")).select(
        *keep, F.col("z.t").try_cast("date").alias("date"), F.col("z.v").try_cast("double").alias("temperature_f")
    )


def _members(df: DataFrame, payload: str, keep: Sequence[str], wanted) -> DataFrame:
    daily = F.from_json(payload, DAILY)["daily"]
    parts = df.select(*keep, daily["time"].alias("t"), F.map_filter(daily, wanted).alias("m"))
    checked = F.when(F.size(F.map_keys("m")) > 0, F.col("m")).otherwise(F.raise_error(F.lit("payload has no temperature members")))
    long = parts.select(*keep, "t", F.explode(checked).alias("variable", "v"))
    zipped = F.when(F.size("t") == F.size("v"), F.arrays_zip("t", "v")).otherwise(F.raise_error(F.lit("member length differs from its dates")))
    return long.select(*keep, "variable", F.explode(zipped).alias("z")).select(
        *keep, "variable", F.col("z.t").try_cast("timestamp").alias("valid_start"), F.col("z.v").try_cast("double").alias("temperature_f")
    )


def _iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def ensemble_archive(df: DataFrame, issued: str = "issued_at", payload: str = "payload", provider: str = "open-meteo",
                     model: str = "gfs_seamless") -> DataFrame:
    """Every member of an ensemble payload as archive rows, with the share of the day still ahead."""
    rows = _members(df, payload, ["state", "duoarea", issued], lambda k, _: k.startswith(MEMBER_PREFIX))
    end = F.col("valid_start") + F.expr("INTERVAL 1 DAY")
    ahead = F.unix_timestamp(end) - F.unix_timestamp(F.greatest(F.col("valid_start"), F.col(issued)))
    suffix = F.ltrim(F.substring("variable", len(MEMBER_PREFIX) + 1, 1000), F.lit("_"))
    out = degree_days(rows).withColumns({
        "provider": F.lit(provider), "model": F.lit(model), "model_run": _iso(F.col(issued)),
        "ensemble_member": F.when(suffix == "", F.lit("control")).otherwise(suffix),
        "issued_at": F.col(issued), "valid_end": end,
        "coverage": F.least(F.greatest(ahead / F.lit(86400.0), F.lit(0.0)), F.lit(1.0)),
    })
    return out.select(*ARCHIVE_COLUMNS)


def fixed_lead_archive(df: DataFrame, payload: str = "payload", provider: str = "open-meteo", model: str = "gfs_seamless") -> DataFrame:
    """Fixed-lead payloads: each lead is its own issue, whole days before the valid day."""
    rows = _members(df, payload, ["state", "duoarea"], lambda k, _: k.rlike(LEAD_PATTERN)).where(F.col("temperature_f").isNotNull())
    lead = F.regexp_extract("variable", LEAD_PATTERN, 1).cast("int")
    issued = F.timestamp_add("DAY", -lead, F.col("valid_start"))
    out = degree_days(rows).withColumns({
        "provider": F.lit(provider), "model": F.lit(model), "model_run": _iso(issued), "ensemble_member": F.lit("deterministic"),
        "issued_at": issued, "valid_end": F.col("valid_start") + F.expr("INTERVAL 1 DAY"), "coverage": F.lit(1.0),
    })
    return out.select(*ARCHIVE_COLUMNS)


def fielded_rows(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Records as a map column ``r`` from field lists, lists of objects or an ``_embedded`` list."""
    shape = "struct<fields: array<struct<name: string>>, data: array<string>, _embedded: map<string, array<map<string, string>>>>"
    p = F.from_json(payload, shape)
    names = F.transform(p["fields"], lambda f: f["name"])
    is_object = F.element_at(p["data"], 1).startswith("{")
    records = F.transform(p["data"], lambda d: F.when(
        is_object, F.from_json(d, "map<string,string>")
    ).otherwise(F.map_from_arrays(names, F.slice(F.from_json(d, "array<string>"), F.lit(1), F.size(names)))))
    embedded = F.element_at(F.map_values(p["_embedded"]), 1)
    return df.select(*keep, F.explode(F.when(F.size(p["data"]) > 0, records).otherwise(embedded)).alias("r"))


def columns_of(records: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return records.select(*keep, *[F.col("r")[n].alias(n) for n in names])


def posted_time(row_time: Column, product_time: Column) -> Column:
    """The row's own publication time, else the product's."""
    return F.coalesce(to_timestamp(row_time), to_timestamp(product_time))


# Latitude, longitude and weight of the six weather points.
WEATHER_POINTS = (
    (32.7767, -96.7970, 0.27), (29.7604, -95.3698, 0.25), (30.2672, -97.7431, 0.18),
    (29.4241, -98.4936, 0.16), (33.5779, -101.8552, 0.08), (26.2034, -98.2300, 0.06),
)


def blend_points(df: DataFrame, weights: DataFrame, measures: Sequence[str], point: str = "point", keys: Sequence[str] = ("valid_at",)) -> DataFrame:
    """Weighted sum of point measures; the weight table has one row per point."""
    return df.join(weights, point).groupBy(*keys).agg(*[F.sum(F.col(m) * F.col("weight")).alias(m) for m in measures])
