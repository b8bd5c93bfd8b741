"""Parquet tables: immutable vintages, upserts, versions and gaps.

A published table is a folder of versions plus a small pointer table; a reader resolves the pointer
first, so a version under construction is never visible and a path being read is never overwritten. A version
is a whole table, or a list of delivery days and the folder that holds each, so that a batch writes only the days it touches.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitcast.functions.columns import require_columns
from pitcast.operators import checks
from pitcast.session import staged

#: Partition column of tables that are kept by delivery day.
DAY = "delivery_day"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One file or a folder of parts with a declared schema; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _stamp() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version, then move the pointer to it. Returns the version path."""
    version = _version()
    path = f"{root}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _point(df.sparkSession, root, version, False)
    return path


def _version() -> str:
    return f"{_stamp()}_{uuid.uuid4().hex[:12]}"


def _point(spark: SparkSession, root: str, version: str, by_day: bool) -> None:
    spark.createDataFrame([(version, by_day)], "version string, by_day boolean").coalesce(1).write.mode("append").json(f"{root}/_latest")


def _newest(spark: SparkSession, root: str) -> tuple[str, bool] | None:
    """Name of the newest published version and whether it is a list of days."""
    try:
        row = spark.read.schema("version string, by_day boolean").json(f"{root}/_latest").agg(F.max(F.struct("version", "by_day")).alias("v")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row["v"]["version"], bool(row["v"]["by_day"])) if row["v"] else None


def latest_path(spark: SparkSession, root: str) -> str | None:
    """Path of the newest published version, or None."""
    newest = _newest(spark, root)
    return f"{root}/version={newest[0]}" if newest else None


def latest_days(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of each delivery day of the newest version; one entry per calendar day of the table."""
    newest = _newest(spark, root)
    if not newest or not newest[1]:
        return {}
    rows = spark.read.schema("day string, part string").json(f"{root}/version={newest[0]}").collect()
    return {r["day"]: f"{root}/parts/part={r['part']}/{DAY}={r['day']}" for r in rows}


def _read_days(spark: SparkSession, root: str, folders: Sequence[str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.option("basePath", f"{root}/parts")
    reader = reader.option("mergeSchema", "true") if schema is None else reader.schema(schema)
    return reader.parquet(*folders).drop("part", DAY)


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    newest = _newest(spark, root)
    if newest is None:
        if schema is None:
            raise FileNotFoundError(f"Nothing has been published under {root}.")
        return spark.createDataFrame([], schema)
    if newest[1]:
        return _read_days(spark, root, list(latest_days(spark, root).values()), schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/version={newest[0]}")


def _checked(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The batch, evaluated once, after its provenance checks."""
    require_columns(df, required, "vintage batch")
    batch = staged(df, "batch")
    checks.enforce(checks.vintage_contract(batch), "vintage batch")
    if batch.isEmpty():
        raise ValueError("A vintage batch must not be empty.")
    return batch


def _append(batch: DataFrame, root: str, partition: str, number: int | None) -> None:
    folder = f"u{_version()}" if number is None else str(number)
    batch.write.mode("overwrite").partitionBy(partition).parquet(f"{root}/batch={folder}")


def append_vintage(df: DataFrame, root: str, required: Sequence[str] = checks.PROVENANCE, partition: str = "product_id",
                   batch: int | None = None) -> None:
    """Append immutable vintage parts after the provenance checks; the batch is evaluated once.

    Every batch owns a folder ``batch=...``. A numbered batch that is written again replaces its folder; others have a fresh name.
    """
    _append(_checked(df, required), root, partition, batch)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables, one per key: new rows win, then the greatest ``order``, then all columns."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = sorted(c for c in both.columns if c not in (*keys, *order, "_p"))
    best = both.groupBy(*keys).agg(F.max(F.struct("_p", *order, *rest)).alias("_v"))
    columns = [c for c in both.columns if c != "_p"]
    return best.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in columns])


VINTAGE_KEYS = ("product_id", "component", "issued_at", "valid_at", "geography")


def materialize(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest row per vintage key; the batch overrides what is stored, later retrievals win inside it."""
    keys = [k for k in VINTAGE_KEYS if k in batch.columns]
    return upsert(existing, batch, keys, ["retrieved_at"] if "retrieved_at" in batch.columns else [])


def append_and_materialize(batch: DataFrame, vintage_root: str, latest_root: str, number: int | None = None) -> str:
    """Append the batch to the vintages and publish the refreshed latest table. Returns the version path.

    A vintage key holds its delivery time, so a batch can change only the days it delivers. These are merged and written anew, and the new version
    takes all other days from the folders of the version before, whose files stay untouched.
    """
    spark = batch.sparkSession
    batch = _checked(batch, checks.PROVENANCE)
    _append(batch, vintage_root, "product_id", number)
    newest = _newest(spark, latest_root)
    known = latest_days(spark, latest_root)
    day = F.coalesce(F.date_format("valid_at", "yyyy-MM-dd"), F.lit("none"))
    version = _version()
    if newest and not newest[1]:  # a whole table becomes days
        touched = read_latest(spark, latest_root, batch.schema)
    else:
        folders = [known[r["day"]] for r in batch.select(day.alias("day")).distinct().collect() if r["day"] in known]
        touched = _read_days(spark, latest_root, folders, batch.schema) if folders else spark.createDataFrame([], batch.schema)
    merged = materialize(touched, batch).withColumn(DAY, day).hint("rebalance", DAY)
    part = f"{latest_root}/parts/part={version}"
    merged.write.mode("errorifexists").partitionBy(DAY).parquet(part)
    written = spark.read.schema(f"{DAY} string").parquet(part).select(DAY).distinct().collect()
    days = {d: path.split("/part=")[1].split("/")[0] for d, path in known.items()} | {str(r[DAY]): version for r in written}
    path = f"{latest_root}/version={version}"
    spark.createDataFrame(sorted(days.items()), "day string, part string").coalesce(1).write.json(path)
    _point(spark, latest_root, version, True)
    return path


def recover_actuals(vintages: DataFrame, existing: DataFrame, keys: Sequence[str] = ("valid_at", "geography")) -> DataFrame:
    """Latest vintage per key, overridden by rows already materialized."""
    from pitcast.operators.asof import keep_latest

    drop = [c for c in ("issued_at", "retrieved_at", "source", "product_id", "source_hash") if c in vintages.columns]
    recovered = keep_latest(vintages, keys, ["issued_at", "retrieved_at"]).drop(*drop)
    return upsert(recovered, existing, keys)


def refresh_tail(existing: DataFrame, landed: DataFrame, keys: Sequence[str], period: str, tail_days: int,
                 floor: Column | None = None) -> DataFrame:
    """Upsert only the landed rows not older than ``tail_days`` before the newest stored period."""
    newest = existing.agg(F.date_sub(F.max(period), tail_days)).scalar()
    start = F.coalesce(newest, floor) if floor is not None else newest
    tail = landed.where(F.col(period) >= start)
    out = upsert(existing, tail, keys)
    return out if floor is None else out.where(F.col(period) >= floor)


def overlap_start(known: DataFrame, origin: Column, time: str = "valid_at", overlap_hours: int = 48, first_days: int = 180) -> DataFrame:
    """Where the next hourly pull starts: the last known hour minus the overlap, or a cold start."""
    last = F.max(F.when(F.col(time) <= origin, F.col(time)))
    return known.agg(F.coalesce(last - F.make_dt_interval(hours=F.lit(overlap_hours)), origin - F.make_dt_interval(days=F.lit(first_days))).alias("start_at"))


def refresh_hours(existing: DataFrame, landed: DataFrame, origin: Column, keys: Sequence[str] = ("valid_at", "geography")) -> DataFrame:
    start = overlap_start(existing, origin).scalar()
    return upsert(existing, landed.where(F.col("valid_at") >= start), keys)


def date_gaps(known: DataFrame, start: Column, end: Column, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Contiguous runs of missing days inside [start, end] per key.

    Stored days are sorted per key together with the two bounds; the holes between neighbours are the
    gaps, so no calendar is expanded.
    """
    d = F.col(date)
    inside = known.where(d.between(start, end)).select(*keys, d.alias("_d")).distinct()
    entities = known.select(*keys).distinct() if keys else None
    edge = F.explode(F.array(F.date_sub(start, 1), F.date_add(end, 1))).alias("_d")
    bounds = (entities if keys else known.sparkSession.range(1)).select(*keys, edge)
    w = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy("_d")
    rows = inside.unionByName(bounds).withColumn("_next", F.lead("_d").over(w))
    return rows.where(F.datediff("_next", "_d") > 1).select(
        *keys, F.date_add("_d", 1).alias("gap_start"), F.date_sub("_next", 1).alias("gap_end")
    )


def year_periods(gaps: DataFrame, keep_days: int | None = 31) -> DataFrame:
    """Split ranges at calendar-year bounds; ranges of at most ``keep_days`` stay whole."""
    years = F.sequence(F.year("gap_start"), F.year("gap_end"))
    short = F.datediff("gap_end", "gap_start") + 1 <= keep_days if keep_days is not None else F.lit(False)
    parts = gaps.withColumn("_y", F.explode(F.when(short, F.array(F.year("gap_start"))).otherwise(years)))
    first = F.greatest(F.col("gap_start"), F.make_date(F.col("_y"), F.lit(1), F.lit(1)))
    last = F.when(short, F.col("gap_end")).otherwise(F.least(F.col("gap_end"), F.make_date(F.col("_y"), F.lit(12), F.lit(31))))
    other = [c for c in gaps.columns if c not in ("gap_start", "gap_end")]
    return parts.select(*other, first.alias("period_start"), last.alias("period_end"))


def require_region(df: DataFrame, region: str, column: str = "duoarea") -> DataFrame:
    """The table, after proving every row belongs to the requested region and there is one."""
    require_columns(df, [column], "regional table")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(column).eqNullSafe(region)).alias("other")).first()
    if row["n"] == 0 or row["other"]:
        raise ValueError(f"Table does not hold only region {region}: {row.asDict()}")
    return df


def merge_chunks(spark: SparkSession, glob: str, schema: T.StructType, target: str, keys: Sequence[str] = ("state", "date")) -> None:
    """Regroup many small landed files into one folder per state, one row per key."""
    rows = spark.read.schema(schema).parquet(glob)
    rest = sorted(c for c in rows.columns if c not in keys)
    merged = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
    merged.repartition("state").write.mode("append").partitionBy("state").parquet(target)
