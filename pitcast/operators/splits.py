"""Rolling-origin folds as tables.

Fold membership is arithmetic on the row's own time, so rows meet their folds without a range
join. Counts, bounds and linear fits are running sums along the folds; only validation rows, and what a fold of
fixed length trains on, are copied once per fold that uses them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


@dataclass(frozen=True)
class FoldSpec:
    """Half-open windows in seconds; fold k shifts everything by ``k * step``."""

    train_end: dt.datetime
    horizon: int
    step: int
    train_start: dt.datetime | None = None
    lookback: int | None = None
    embargo: int = 0

    def __post_init__(self) -> None:
        if self.horizon <= 0 or self.step <= 0:
            raise ValueError("Validation horizon and step must be positive.")
        if self.lookback is not None and self.lookback <= 0:
            raise ValueError("Lookback must be positive when given.")


def _midnight(day: str | dt.date) -> dt.datetime:
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc)


def expanding_weeks(train_start: str, train_end: str, val_weeks: int, step_weeks: int) -> FoldSpec:
    """Inclusive training dates that grow; validation covers the next weeks."""
    return FoldSpec(_midnight(train_end) + dt.timedelta(days=1), 7 * val_weeks * DAY, 7 * step_weeks * DAY, _midnight(train_start))


def rolling_weeks(train_start: str, train_end: str, val_weeks: int, step_weeks: int) -> FoldSpec:
    """As :func:`expanding_weeks`, with a training window of fixed length."""
    end = _midnight(train_end) + dt.timedelta(days=1)
    return FoldSpec(end, 7 * val_weeks * DAY, 7 * step_weeks * DAY, None, int((end - _midnight(train_start)).total_seconds()))


def _seconds(time: str) -> Column:
    return F.unix_timestamp(F.col(time).cast("timestamp"))


def _end(spec: FoldSpec) -> int:
    return int(spec.train_end.timestamp())


def _floor_div(value: Column, step: int) -> Column:
    return F.floor(value / F.lit(float(step))).cast("int")


def _validation_range(time: str, spec: FoldSpec) -> tuple[Column, Column]:
    since = _seconds(time) - F.lit(_end(spec) + spec.embargo)
    low = F.greatest(_floor_div(since - F.lit(spec.horizon), spec.step) + 1, F.lit(0))
    return low, _floor_div(since, spec.step)


def _explode_range(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.where(low <= high).withColumn("_k", F.explode(F.sequence(low, high)))


def fold_table(df: DataFrame, time: str, spec: FoldSpec) -> DataFrame:
    """Folds that hold validation rows, numbered from 1, with their half-open bounds."""
    low, high = _validation_range(time, spec)
    used = _explode_range(df.select(time).distinct(), low, high).select("_k").distinct()
    shift = F.col("_k") * F.lit(spec.step)
    end = F.lit(_end(spec)) + shift
    if spec.lookback is not None:
        start = end - F.lit(spec.lookback)
    elif spec.train_start is not None:
        start = F.lit(int(spec.train_start.timestamp()))
    else:
        start = F.lit(None).cast("bigint")
    stamp = lambda c: F.timestamp_seconds(c)
    return used.select(
        "_k",
        F.row_number().over(W.orderBy("_k")).cast("int").alias("fold"),
        stamp(start).alias("train_start"),
        stamp(end).alias("train_end"),
        stamp(end + F.lit(spec.embargo)).alias("val_start"),
        stamp(end + F.lit(spec.embargo + spec.horizon)).alias("val_end"),
    )


def validation_rows(df: DataFrame, time: str, spec: FoldSpec, folds: DataFrame) -> DataFrame:
    """Rows repeated for each fold that validates on them, with the fold's bounds."""
    low, high = _validation_range(time, spec)
    return _explode_range(df, low, high).join(folds, "_k").drop("_k")


def _trainable(df: DataFrame, time: str, spec: FoldSpec) -> DataFrame:
    return df if spec.train_start is None else df.where(_seconds(time) >= F.lit(int(spec.train_start.timestamp())))


def _training_range(time: str, spec: FoldSpec, folds: DataFrame) -> tuple[Column, Column]:
    last = folds.agg(F.max("_k")).scalar()
    if spec.lookback is None:
        return first_training_step(time, spec), last
    return first_training_step(time, spec), F.least(last, _floor_div(_seconds(time) - F.lit(_end(spec)) + F.lit(spec.lookback), spec.step))


def training_rows(df: DataFrame, time: str, spec: FoldSpec, folds: DataFrame) -> DataFrame:
    """Rows repeated for each fold that trains on them."""
    return _explode_range(_trainable(df, time, spec), *_training_range(time, spec, folds)).join(folds, "_k").drop("_k")


def first_training_step(time: str, spec: FoldSpec) -> Column:
    """Smallest shift whose training window already ends after the row."""
    return F.greatest(_floor_div(_seconds(time) - F.lit(_end(spec)), spec.step) + 1, F.lit(0))


def _extents(df: DataFrame, time: str, keys: Sequence[str], low: Column, high: Column, folds: DataFrame, newest: bool) -> DataFrame:
    """Per key and fold: how many rows have the fold's shift in ``[low, high]``, and the newest or oldest time of them.

    A row adds one at its first shift and takes it back after its last, and running sums give every fold. Both bounds grow with
    time, so a fold's newest row is the newest one begun by then, and its oldest the oldest one not yet ended.
    """
    edge = F.max(time) if newest else F.min(time)
    spans = df.select(*keys, time, low.alias("_low"), high.alias("_high")).where("_low <= _high").groupBy(*keys, "_low", "_high").agg(
        F.count(F.lit(1)).alias("_n"), edge.alias("_edge")
    )
    begun = spans.select(*keys, F.col("_low").alias("_k"), F.col("_n"), *([F.col("_edge")] if newest else []))
    ended = spans.select(*keys, (F.col("_high") + 1).alias("_k"), (-F.col("_n")).alias("_n"))
    last = [] if newest else [spans.select(*keys, F.col("_high").alias("_k"), F.lit(0).cast("bigint").alias("_n"), "_edge")]
    steps = folds.agg(F.sort_array(F.collect_set("_k"))).scalar()
    asked = (spans.select(*keys).distinct() if keys else df.sparkSession.range(1)).select(
        *keys, F.explode(steps).alias("_k"), F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_asked")
    )
    events = begun
    for more in (ended, *last, asked):
        events = events.unionByName(more, allowMissingColumns=True)
    small = events.groupBy(*keys, "_k").agg(F.sum("_n").alias("_n"), (F.max if newest else F.min)("_edge").alias("_edge"), F.bool_or("_asked").alias("_asked"))
    along = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    edges = F.max("_edge").over(along) if newest else F.min("_edge").over(along.orderBy(F.col("_k").desc()))
    told = small.withColumns({"n": F.sum("_n").over(along), "edge": edges}).where("_asked").select(*keys, "_k", "n", F.when(F.col("n") > 0, F.col("edge")).alias("edge"))
    return told.join(folds.select("_k", "fold"), "_k").drop("_k")


def fold_extents(df: DataFrame, time: str, spec: FoldSpec, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key and fold: ``n_train, last_train, n_val, first_val``, without a copy of a row per fold."""
    low, high = _training_range(time, spec, folds)
    train = _extents(_trainable(df, time, spec), time, keys, low, high, folds, True)
    val = _extents(df, time, keys, *_validation_range(time, spec), folds, False)
    return val.select(*keys, "fold", F.col("n").alias("n_val"), F.col("edge").alias("first_val")).join(
        train.select(*keys, "fold", F.col("n").alias("n_train"), F.col("edge").alias("last_train")), [*keys, "fold"], "left"
    ).fillna(0, ["n_train"])


def fold_sizes(df: DataFrame, time: str, spec: FoldSpec) -> DataFrame:
    """Rows used per fold, with the dates that prove training precedes validation."""
    extents = fold_extents(df, time, spec, fold_table(df, time, spec))
    return extents.where("n_val > 0").select("fold", "n_train", "n_val", "last_train", "first_val")


def require_training_rows(sizes: DataFrame) -> None:
    """Reject folds without training rows or with training dates inside the validation window."""
    bad = sizes.where((F.col("n_train") == 0) | (F.col("last_train") >= F.col("first_val")))
    if bad.limit(1).count():
        raise ValueError("Every fold needs training rows that precede its validation rows.")


def holdout(df: DataFrame, date: str, train_end: str | None = None, val_start: str | None = None,
            train_start: str | None = None, val_end: str | None = None) -> DataFrame:
    """One inclusive train/validation split; each kept row carries its ``role``."""
    if train_end is None and val_start is None:
        raise ValueError("Give train_end or val_start.")
    one = dt.timedelta(days=1)
    parse = lambda v: None if v is None else dt.date.fromisoformat(v)
    te, vs, ts, ve = map(parse, (train_end, val_start, train_start, val_end))
    te = te or vs - one
    vs = vs or te + one
    if te >= vs or (ts and ts > te) or (ve and vs > ve):
        raise ValueError("Training dates must precede validation dates and bounds must be ordered.")
    d = F.col(date)
    train = (d <= F.lit(te)) & (d >= F.lit(ts) if ts else F.lit(True))
    val = (d >= F.lit(vs)) & (d <= F.lit(ve) if ve else F.lit(True))
    return df.withColumn("role", F.when(train, F.lit("train")).when(val, F.lit("validation"))).where(F.col("role").isNotNull())
