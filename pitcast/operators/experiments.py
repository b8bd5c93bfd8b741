"""Paired comparisons, bootstrap and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.hashing import hashed_below, permuted
from pitcast.operators.ordered import ranked
from pitcast.session import staged

KEYS = ("date", "region", "horizon")


def pair(baseline: DataFrame, challenger: DataFrame, keys: Sequence[str] = KEYS, actual: str = "actual_weekly_change") -> DataFrame:
    """One-to-one pairs; measures get a suffix for their side.

    A key that either side holds twice, or whose actual values differ between the sides, stops the job.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
        twice = F.raise_error(F.lit(f"The {s} predictions hold a key twice.")).cast("boolean")
        return one.where(F.when(F.col("_n") == 1, True).otherwise(twice)).select(*keys, *[F.col(f"_r.{c}").alias(f"{c}_{s}") for c in rest])

    both = side(baseline, "baseline").join(side(challenger, "challenger"), list(keys))
    if actual not in baseline.columns or actual not in challenger.columns:
        return both
    a, b = F.col(f"{actual}_baseline"), F.col(f"{actual}_challenger")
    unlike = F.raise_error(F.lit("Baseline and challenger actuals do not match.")).cast("boolean")
    return both.where(F.when(F.abs(a - b) > 1e-8 + 1e-5 * F.abs(b), unlike).otherwise(True))


def paired_errors(paired: DataFrame) -> DataFrame:
    a, b, c = (F.col(x) for x in ("actual_weekly_change_baseline", "predicted_weekly_change_baseline", "predicted_weekly_change_challenger"))
    return paired.withColumn("error_gain", F.abs(a - b) - F.abs(a - c))


def block_bootstrap(errors: DataFrame, order: Sequence[str], gain: str = "error_gain", keys: Sequence[str] = (),
                    block: int = 4, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Circular block bootstrap of a paired mean, every draw in parallel.

    A key's gains become one array of running sums, as long as its calendar has dates. A block is the difference of two of them, so a draw
    reads two numbers per block and no row is copied, joined or exchanged for it. The last block is cut to the series length. Starts are
    hashes of the seed, draw and block, which another engine can replay.
    """
    w = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = errors.where(F.col(gain).isNotNull()).select(*keys, F.row_number().over(w).alias("_i"), F.sum(gain).over(w).alias("_s"), F.col(gain).alias("_g"))
    sums = rows.groupBy(*keys).agg(
        F.concat(F.array(F.lit(0.0)), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"])).alias("_p"),
        F.count(F.lit(1)).alias("_n"), F.avg("_g").alias("mae_improvement"),
    )
    n = F.col("_n")
    blocks = F.ceil(n / F.lit(float(block))).cast("int")

    def upto(at: Column) -> Column:
        """Sum of the first ``at`` gains around the circle."""
        return F.floor(at / n) * F.get("_p", n.cast("int")) + F.get("_p", F.pmod(at, n).cast("int"))

    def picked(b: Column) -> Column:
        start = hashed_below(F.concat_ws(":", F.lit(seed), F.col("draw"), b), n)
        size = F.when(b == blocks, F.pmod(n - 1, F.lit(block)) + 1).otherwise(F.lit(block))
        return upto(start + size) - upto(start)

    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select(
        *keys, (F.aggregate(F.sequence(F.lit(1), blocks), F.lit(0.0), lambda total, b: total + picked(b)) / n).alias("_m")
    )
    interval = drawn.groupBy(*keys).agg(
        F.percentile("_m", F.lit(0.025)).alias("ci_lower"), F.percentile("_m", F.lit(0.975)).alias("ci_upper")
    )
    if keys:
        return sums.select(*keys, "mae_improvement").join(interval, list(keys))
    return interval.select(sums.select("mae_improvement").scalar().alias("mae_improvement"), "ci_lower", "ci_upper")


def region_degradation(paired: DataFrame) -> DataFrame:
    """Relative change of week-one error per region."""
    a = F.col("actual_weekly_change_baseline")
    mae = lambda side: F.avg(F.abs(a - F.col(f"predicted_weekly_change_{side}")))
    out = paired.where(F.col("horizon") == 1).groupBy("region").agg(mae("baseline").alias("baseline_mae"), mae("challenger").alias("challenger_mae"))
    change = F.when(F.col("baseline_mae") > 0, (F.col("challenger_mae") - F.col("baseline_mae")) / F.col("baseline_mae")).otherwise(
        (F.col("challenger_mae") > 0).cast("double")
    )
    return out.withColumn("degradation", change)


def promotion_gate(baseline: DataFrame, challenger: DataFrame, parent: str = "R48", min_improvement: float = 1.0,
                   max_degradation: float = 0.10, target_coverage: float = 0.80, tolerance: float = 0.05) -> DataFrame:
    """One row with the measures and the pass flags of the promotion rule; fewer than two pairs of the parent's first week stop the job."""
    paired = staged(paired_errors(pair(baseline, challenger)), "pairs")
    primary = paired.where((F.col("region") == parent) & (F.col("horizon") == 1))
    if primary.limit(2).count() < 2:
        raise ValueError("Promotion needs at least two paired first-week rows of the parent region.")
    boot = block_bootstrap(primary, ["date"])
    worst = region_degradation(paired).agg(F.max("degradation")).scalar()
    band = F.col("p10_challenger").isNotNull() & F.col("p90_challenger").isNotNull()
    inside = F.col("actual_weekly_change_challenger").between(F.col("p10_challenger"), F.col("p90_challenger")).cast("double")
    coverage = primary.agg(F.avg(F.when(band, inside))).scalar()
    out = boot.withColumns({"max_region_degradation": F.coalesce(worst, F.lit(0.0)), "interval_coverage": coverage})
    out = out.withColumns({
        "accuracy_pass": F.col("mae_improvement") >= min_improvement,
        "significance_pass": F.col("ci_lower") > 0,
        "region_pass": F.col("max_region_degradation") <= max_degradation,
        "coverage_pass": F.coalesce(F.abs(F.col("interval_coverage") - target_coverage) <= tolerance, F.lit(False)),
    })
    return out.withColumn("promote", F.col("accuracy_pass") & F.col("significance_pass") & F.col("region_pass") & F.col("coverage_pass"))


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, predict, repeats: int = 10, seed: int = 42,
                           order: Sequence[str] | None = None) -> DataFrame:
    """Mean error increase when one feature is shuffled, for all features and repeats at once.

    ``predict`` maps a dict of feature columns to a prediction column. Each repeat moves values between rows by a keyed permutation of the row
    numbers; nothing is sorted per repeat. Rows are numbered along ``order``, which must be unique, or else by their place in a stored copy.
    """
    rows = df.select(*dict.fromkeys([*(order or []), *features, target]))
    if order:
        numbered = ranked(rows, [], order, "_i").withColumn("_i", F.col("_i").cast("bigint") - 1)
    else:
        numbered = numbered_rows(rows)
    numbered = staged(numbered.select(*features, target, "_i"), "rows")
    n = F.lit(numbered.count()).cast("bigint")
    base = numbered.agg(F.avg(F.abs(F.col(target) - predict({f: F.col(f) for f in features})))).scalar()
    names = F.array(*[F.lit(f) for f in features])
    plan = numbered.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    plan = plan.withColumn("_from", permuted(F.col("_i"), F.concat_ws(":", F.lit(seed), "repeat"), n))
    donor = numbered.select(F.col("_i").alias("_from"), F.struct(*features).alias("_d"))
    long = plan.join(donor, "_from").select("*", F.explode(names).alias("feature"))
    swapped = {f: F.when(F.col("feature") == f, F.col(f"_d.{f}")).otherwise(F.col(f)) for f in features}
    per = long.groupBy("feature", "repeat").agg((F.avg(F.abs(F.col(target) - predict(swapped))) - base).alias("_gain"))
    return per.groupBy("feature").agg(F.avg("_gain").alias("importance_mean"), F.stddev_pop("_gain").alias("importance_std"))


def numbered_rows(df: DataFrame) -> DataFrame:
    """Rows numbered 0..n-1 in ``_i`` without sorting them.

    The table is written once; a row's number is its place in its file plus the rows of earlier files.
    Only the per-file counts pass through a window.
    """
    stored = staged(df, "numbered")
    marked = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.withColumn("_s", F.sum("_c").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)))
    return marked.join(starts, "_file").select(*df.columns, (F.coalesce("_s", F.lit(0)) + F.col("_row")).cast("bigint").alias("_i"))
