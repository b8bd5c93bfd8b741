"""Conformal intervals from earlier errors only.

The radius is an exact order statistic: the ceil((n + 1) * coverage)-th smallest of the n
residuals released before a row. Residuals are numbered within their group by value, ties by row, so equal
values are told apart and a large group spreads over tasks. A radius over a whole group is the row with the wanted
number. A rolling radius descends by number: running counts over time say which block of numbers holds the
wanted rank, blocks split by a fixed factor until one residual is left. Counts are aggregated per time before they run, so a
window holds a group's distinct times, which the calendar bounds, and never its residuals. Nothing is gathered at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.columns import at_least
from pitcast.operators.ordered import ranked
from pitcast.session import staged

#: Blocks that a block of ranks splits into.
BLOCKS = 64


def rank_for(count: Column | str, coverage: float) -> Column:
    n = F.col(count) if isinstance(count, str) else count
    return F.least(n, F.ceil((n + 1) * F.lit(coverage)).cast("bigint"))


def _require_coverage(coverage: float) -> None:
    if not 0 < coverage < 1:
        raise ValueError("coverage must be between 0 and 1.")


def _numbered(values: DataFrame, stored: bool = False) -> DataFrame:
    """``_g, _r`` rows with their position from 1 by value within the group; ``stored`` values need not be written down first."""
    rows = values if stored else staged(values, "values")
    return staged(ranked(rows.withColumn("_id", F.monotonically_increasing_id()), ["_g"], ["_r", "_id"]).drop("_id"), "positions")


def _before(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows``, one per key and time, with ``sums`` replaced by their sums over earlier times."""
    earlier = W.partitionBy(*keys).orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})


def _group(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(1).alias("one"))


def conformal_radius(df: DataFrame, residual: str, coverage: float, keys: Sequence[str] = ()) -> DataFrame:
    """Radius per key over all its residuals."""
    _require_coverage(coverage)
    rows = _numbered(df.where(F.col(residual).isNotNull()).select(*keys, F.col(residual).alias("_r"), _group(keys).alias("_g")))
    asked = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).withColumn("_pos", rank_for("n", coverage))
    return rows.join(asked, ["_g", "_pos"]).select(*keys, "n", F.col("_r").alias("radius"))


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float], names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per key, from the two order statistics around each."""
    rows = _numbered(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_r"), _group(keys).alias("_g")))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in quantiles]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array((F.floor(p) + 1).cast("bigint"), (F.ceil(p) + 1).cast("bigint")) for p in place])))
    hits = rows.join(sizes.withColumn("_pos", F.explode(wanted)), ["_g", "_pos"])
    at = lambda p, side: F.max(F.when(F.col("_pos") == side(p) + 1, F.col("_r")))
    out = []
    for p, name in zip(place, names):
        low, high = at(p, F.floor), at(p, F.ceil)
        share = F.max(p - F.floor(p))
        out.append((low + (high - low) * share).alias(name))
    return hits.groupBy("_g", *keys).agg(*out).drop("_g")


def _select_ranks(queries: DataFrame, residuals: DataFrame) -> DataFrame:
    """The rank-th smallest residual with an earlier time, for every (group, time, rank) query; integer times."""
    rows = _numbered(residuals, True).withColumn("_p", F.col("_pos") - 1)
    largest = rows.agg(F.max("_pos")).first()[0] or 1
    levels = 1
    while BLOCKS**levels < largest:
        levels += 1
    names = [f"c{i}" for i in range(BLOCKS)]
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("upto"))
    walk = F.aggregate(
        F.array(*names), start,
        lambda s, c: F.when(s["upto"] >= F.col("rank"), s).otherwise(F.struct((s["b"] + 1).alias("b"), s["upto"].alias("below"), (s["upto"] + c).alias("upto"))),
    )
    asked = queries.select("_g", "_t", "rank", F.lit(0).cast("bigint").alias("_path"))
    for level in reversed(range(levels)):
        width = BLOCKS**level
        block = F.floor(F.col("_p") / width)
        inside = rows.select("_g", "_t", F.floor(block / BLOCKS).alias("_path"), (block % BLOCKS).alias("_b"))
        inside = inside.join(asked.select("_g", "_path").distinct(), ["_g", "_path"], "left_semi")
        counts = inside.groupBy("_g", "_path", "_t").agg(*[F.count_if(F.col("_b") == i).alias(f"c{i}") for i in range(BLOCKS)])
        both = counts.join(asked, ["_g", "_path", "_t"], "full").na.fill(0, names)
        moved = _before(both, ["_g", "_path"], names).where(F.col("rank").isNotNull()).withColumn("_w", walk)
        asked = staged(moved.select(
            "_g", "_t", (F.col("rank") - F.col("_w.below")).alias("rank"), (F.col("_path") * BLOCKS + F.col("_w.b")).alias("_path")
        ), "descent")
    return asked.select("_g", "_t", F.col("_path").alias("_p")).join(rows.select("_g", "_p", F.col("_r").alias("_value")), ["_g", "_p"]).drop("_p")


def _calibrated(data: DataFrame, group: Sequence[str], query_time: Column, release_time: Column, residual: Column,
                prediction: str, coverage: float, minimum: int, names: dict[str, str]) -> DataFrame:
    """Attach count, radius and bounds. Times are integers; a residual released at r serves queries with r < q."""
    _require_coverage(coverage)
    if minimum < 1:
        raise ValueError("The minimum calibration size must be at least 1.")
    rows = staged(
        data.withColumns({"_g": _group(group), "_t": query_time.cast("bigint"), "_rt": release_time.cast("bigint"), "_r": residual}), "calibration"
    )
    residuals = rows.where(F.col("_r").isNotNull()).select("_g", F.col("_rt").alias("_t"), "_r")
    per_time = residuals.groupBy("_g", "_t").agg(F.count(F.lit(1)).alias("_count"))
    asked = rows.select("_g", "_t").distinct().withColumn("_q", F.lit(True))
    both = per_time.join(asked, ["_g", "_t"], "full").na.fill(0, ["_count"])
    counts = staged(_before(both, ["_g"], ["_count"]).where(F.col("_q")).select("_g", "_t", "_count"), "counts")
    queries = counts.where(F.col("_count") >= minimum).select("_g", "_t", rank_for("_count", coverage).alias("rank"))
    radius = _select_ranks(queries, residuals)
    out = rows.join(counts.join(radius, ["_g", "_t"], "left"), ["_g", "_t"], "left")
    return out.withColumns(
        {
            names["lower"]: F.col(prediction) - F.col("_value"),
            names["upper"]: F.col(prediction) + F.col("_value"),
            names["radius"]: F.col("_value"),
            names["count"]: F.col("_count").cast("int"),
        }
    ).drop("_g", "_t", "_rt", "_r", "_count", "_value")


def rolling_intervals(df: DataFrame, actual: str, prediction: str = "predicted_weekly_change", date: str = "date",
                      coverage: float = 0.8, minimum: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """Intervals from residuals of strictly earlier target dates in the same group."""
    day = F.unix_date(F.to_date(date))
    out = _calibrated(
        df, group, day, day, F.abs(F.col(actual) - F.col(prediction)), prediction, coverage, minimum,
        {"lower": "interval_lower", "upper": "interval_upper", "radius": "interval_radius", "count": "calibration_samples"},
    )
    return out.withColumn("nominal_coverage", F.lit(coverage))


def horizon_intervals(df: DataFrame, actual: str, prediction: str, origin: str = "forecast_origin",
                      bucket: str = "horizon_bucket", target: str | None = None, coverage: float = 0.8,
                      minimum: int = 30, lower: str = "lower_bound", upper: str = "upper_bound",
                      keys: Sequence[str] = ()) -> DataFrame:
    """Intervals per horizon bucket from residuals realized by the current origin.

    A residual is released at the later of its target time and the instant after its own origin.
    Without a target column only strictly earlier origins count.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    release = micros(origin) if target is None else F.greatest(micros(target) - 1, micros(origin))
    return _calibrated(
        df, [*keys, bucket], micros(origin), release, F.abs(F.col(actual) - F.col(prediction)), prediction, coverage,
        minimum, {"lower": lower, "upper": upper, "radius": "interval_radius", "count": "calibration_count"},
    ).drop("interval_radius")


def bucket_bounds(forecast: DataFrame, errors: DataFrame, value: str, prefix: str, error: str = "abs_error",
                  coverage: float = 0.8, clip: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds of one current forecast from the radius of each horizon bucket."""
    radius = conformal_radius(errors, error, coverage, [*keys, "horizon_bucket"]).drop("n")
    joined = forecast.join(radius, [*keys, "horizon_bucket"], "left")
    low = F.col(value) - F.col("radius")
    low = at_least(low, 0.0) if clip else low
    return joined.withColumns(
        {f"{prefix}_lower_mw": low, f"{prefix}_upper_mw": F.col(value) + F.col("radius")}
    ).drop("radius")
