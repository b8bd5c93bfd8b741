"""Point-in-time selection over versioned (bitemporal) tables.

A row is knowable at an origin when it was issued and retrieved no later than that origin.
Versions are compared by (issued, retrieved, remaining columns in name order), a total order,
so the choice among equal timestamps never depends on row order.

Both forms reduce the versions of a key with a partial aggregate before the shuffle. One key
may therefore hold any share of all rows: only one candidate per key (and origin interval)
leaves each map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.columns import require_columns
from pitcast.session import staged


def _version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """All non-key columns, ordering columns first, as one comparable struct."""
    rest = sorted(c for c in df.columns if c not in keys and c not in order)
    return F.struct(*[F.col(c) for c in [*order, *rest]])


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` columns, ties by the other columns."""
    best = df.groupBy(*keys).agg(F.max(_version(df, keys, order)).alias("_v"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_v.{k}").alias(k) for k in df.columns])


def select_as_of(
    df: DataFrame,
    origin: Column,
    entity_keys: Sequence[str],
    valid: str = "valid_at",
    issued: str = "issued_at",
    retrieved: str | None = "retrieved_at",
) -> DataFrame:
    """Latest version per (entity, valid time) that was knowable at one origin."""
    order = [issued] if retrieved is None else [issued, retrieved]
    require_columns(df, [*entity_keys, valid, *order], "versioned table")
    known = df
    for column in order:
        known = known.where(F.col(column) <= origin)
    return keep_latest(known, [*entity_keys, valid], order)


def missing_targets(selected: DataFrame, required: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys the selection does not cover."""
    return required.select(*keys).join(selected.select(*keys), list(keys), "left_anti")


def origin_calendar(origins: DataFrame, origin: str) -> DataFrame:
    """Day table over the span of all origins: (day, origins that day, first origin after it).

    It has one row per calendar day, so its size is bounded by the span of the data in days.
    """
    per_day = (
        origins.select(F.col(origin).alias("_o"))
        .groupBy(F.to_date("_o").alias("day"))
        .agg(F.sort_array(F.collect_set("_o")).alias("in_day"))
    )
    span = per_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    ahead = W.orderBy("day").rowsBetween(1, W.unboundedFollowing)
    return days.join(per_day, "day", "left").select(
        "day", "in_day", F.first(F.col("in_day")[0], ignorenulls=True).over(ahead).alias("later")
    )


def first_origin_knowing(df: DataFrame, origins: DataFrame, origin: str, known: Column, name: str = "_first") -> DataFrame:
    """Add the earliest origin at or after ``known``; rows no origin can know are dropped."""
    origins = staged(origins.select(origin).distinct(), "origins")
    calendar = origin_calendar(origins, origin)
    first_day = origins.agg(F.min(F.to_date(origin))).scalar()
    last = origins.agg(F.max(origin)).scalar()
    keyed = df.withColumn("_known", known).where(F.col("_known") <= last)
    keyed = keyed.withColumn("day", F.greatest(F.to_date("_known"), first_day))
    same_day = F.element_at(F.filter("in_day", lambda o: o >= F.col("_known")), 1)
    has_same_day = F.exists("in_day", lambda o: o >= F.col("_known"))
    return (
        keyed.join(calendar, "day")
        .withColumn(name, F.when(has_same_day, same_day).otherwise(F.col("later")))
        .drop("day", "in_day", "later", "_known")
    )


def latest_at_origins(
    targets: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    origin: str,
    issued: str,
    retrieved: str | None = None,
) -> DataFrame:
    """For each target row (key, origin): the latest version of the key knowable at the origin.

    Versions are assigned to the first origin that may see them and reduced to one candidate
    per (key, origin interval) by a partial aggregate. The running maximum of the candidates
    along the origins then answers all origins in one linear pass, without an inequality join.
    Targets without a knowable version keep NULLs.
    """
    order = [issued] if retrieved is None else [issued, retrieved]
    require_columns(versions, [*keys, *order], "versioned table")
    require_columns(targets, [*keys, origin], "target table")
    payload = _version(versions, keys, order)
    known = F.greatest(*order) if len(order) > 1 else F.col(issued)
    bucketed = first_origin_knowing(versions, targets.select(origin), origin, known, "_t")
    reduced = bucketed.groupBy(*keys, "_t").agg(F.max(payload).alias("_v"))

    extra = [c for c in targets.columns if c not in keys and c != origin]
    asked = targets.select(
        *keys, F.col(origin).alias("_t"), F.struct(F.lit(True).alias("_asked"), *extra).alias("_q")
    )
    both = reduced.unionByName(asked, allowMissingColumns=True)
    run = W.partitionBy(*keys).orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    filled = both.withColumn("_v", F.max("_v").over(run)).where(F.col("_q._asked"))
    value_columns = [c for c in versions.columns if c not in keys]
    return filled.select(
        *keys,
        F.col("_t").alias(origin),
        *[F.col(f"_q.{c}").alias(c) for c in extra],
        *[F.col(f"_v.{c}").alias(c) for c in value_columns],
    )


def scenario_as_of(
    scenarios: DataFrame,
    as_of: Column,
    region: str | None = None,
    target_dates: DataFrame | None = None,
    provider: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """Latest scenario per (region, target date) issued by ``as_of``.

    ``n_models`` counts the scenario rows sharing the latest issue; a value above one with neither
    provider nor model chosen is the ambiguity that :func:`require_single_model` rejects. Each of ``target_dates`` needs
    a scenario of the region, or of every region that has any; a missing one stops the job.
    """
    require_columns(scenarios, ["date", "duoarea", "issued_at"], "scenario table")
    known = scenarios.where(F.col("issued_at") <= as_of)
    for column, wanted in (("duoarea", region), ("provider", provider), ("model", model)):
        if wanted is not None:
            require_columns(known, [column], "scenario table")
            known = known.where(F.col(column) == wanted)
    dates = None if target_dates is None else target_dates.select("date").distinct()
    if dates is not None:
        regions = known.select("duoarea").distinct() if region is None else known.sparkSession.range(1).select(F.lit(region).alias("duoarea"))
        known = known.join(dates, "date", "left_semi")
    keys = ["date", "duoarea"]
    per_issue = known.groupBy(*keys, "issued_at").agg(
        F.max(_version(known, keys, ["issued_at"])).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    best = per_issue.groupBy(*keys).agg(
        F.max_by(F.struct("_v", "_n"), "issued_at").alias("_b")
    )
    if dates is not None:
        wanted = regions.select("duoarea", F.explode(dates.agg(F.collect_list("date")).scalar()).alias("date"))
        lost = F.raise_error(F.concat_ws(" ", F.lit("No weather scenario is known at the origin for"), "duoarea", F.col("date").cast("string"))).cast("boolean")
        best = wanted.join(best, keys, "left").where(F.when(F.col("_b").isNull(), lost).otherwise(True))
    return best.select(
        *[F.col(c) if c in keys else F.col(f"_b._v.{c}").alias(c) for c in known.columns],
        F.col("_b._n").alias("n_models"),
    )


def require_single_model(selected: DataFrame) -> DataFrame:
    """Raise when the latest issue of some target holds more than one model."""
    stop = F.raise_error(F.lit("Multiple weather models are available; choose a provider or model.")).cast("long")
    return selected.withColumn("n_models", F.when(F.col("n_models") > 1, stop).otherwise(F.col("n_models"))).where("n_models IS NOT NULL").drop("n_models")


def normalized_weights(selected: DataFrame, weight: str) -> DataFrame:
    """Share of each state within its region; a negative weight or a region without weight stops the job."""
    whole = F.sum(weight).over(W.partitionBy("duoarea"))
    negative = F.min(weight).over(W.partitionBy("duoarea")) < 0
    bad = F.raise_error(F.concat(F.lit("Weights must not be negative and need a positive total in region "), F.col("duoarea"))).cast("double")
    total = F.when(negative | (whole <= 0), bad).otherwise(whole)
    return selected.select(
        "state", "duoarea", "available_at", (F.col(weight) / total).alias("weather_weight")
    )


def state_weights_as_of(history: DataFrame, as_of: Column, weight: str) -> DataFrame:
    """Latest knowable weight per (region, state), normalized within the region; no weight known at the origin at all stops the job."""
    require_columns(history, ["state", "duoarea", "available_at", weight], "weight history")
    known = history.where(F.col("available_at") <= as_of)
    if known.isEmpty():
        raise ValueError("No state weight is known at the requested origin.")
    return normalized_weights(keep_latest(known, ["duoarea", "state"], ["available_at"]), weight)


def balance_features_at_origins(origins: DataFrame, vintages: DataFrame, as_of: str | None = None) -> DataFrame:
    """Lagged balance features per (date, region), each from the revision known at its origin."""
    origin = F.col(as_of) if as_of else F.col("date")
    spine = origins.select(
        F.col("date").alias("target_date"), "duoarea", origin.cast("timestamp").alias("balance_as_of")
    )
    asked = spine.select(
        "*", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("lag")
    ).withColumn("date", F.expr("date_sub(target_date, 7 * lag)"))
    values = vintages.select(
        "date", "duoarea", F.col("available_at").cast("timestamp").alias("available_at"),
        "local_balance", "net_inflow_balancing",
    )
    known = latest_at_origins(asked, values, ["duoarea", "date"], "balance_as_of", "available_at")
    found = F.col("available_at").isNotNull()
    first = F.col("lag") == 1
    grouped = known.groupBy("target_date", "duoarea", "balance_as_of").agg(
        F.max(F.when(first, F.col("local_balance"))).alias("local_balance_lag1"),
        F.max(F.when(first, F.col("net_inflow_balancing"))).alias("net_inflow_balancing_lag1"),
        F.avg("net_inflow_balancing").alias("_mean"),
        F.count_if(found).cast("int").alias("balance_history_weeks"),
        F.max(F.when(first & found, F.col("date"))).alias("balance_lag1_source_date"),
        F.max(F.when(first, F.col("available_at"))).alias("balance_lag1_available_at"),
        F.max("available_at").alias("_latest"),
    )
    complete = F.col("balance_history_weeks") == 4
    return grouped.select(
        F.col("target_date").alias("date"),
        "duoarea",
        "balance_as_of",
        "local_balance_lag1",
        "net_inflow_balancing_lag1",
        F.when(complete, F.col("_mean")).alias("net_inflow_balancing_rolling_4wk"),
        "balance_history_weeks",
        "balance_lag1_source_date",
        "balance_lag1_available_at",
        F.when(complete, F.col("_latest")).alias("balance_rolling_4wk_latest_available_at"),
    )


def friday_targets(origins: DataFrame, horizon_weeks: int) -> DataFrame:
    """The next ``horizon_weeks`` Fridays of each origin date, starting at the origin if it is one."""
    first = F.date_add(F.col("origin_date"), F.pmod(F.lit(4) - F.weekday("origin_date"), F.lit(7)).cast("int"))
    steps = F.sequence(F.lit(0), F.lit(horizon_weeks - 1))
    return origins.select("*", F.posexplode(steps).alias("_p", "_k")).select(
        *origins.columns,
        (F.col("_p") + 1).cast("int").alias("horizon"),
        F.date_add(first, (F.col("_k") * 7).cast("int")).alias("date"),
    )


def scenarios_at_origins(origins: DataFrame, scenarios: DataFrame, horizon_weeks: int = 4) -> DataFrame:
    """One row per origin and target Friday with the scenario known at the origin's midnight.

    Targets without a knowable scenario keep NULLs; ``issued_at IS NULL`` marks them.
    """
    spine = origins.select(F.col("date").alias("origin_date"), "duoarea")
    targets = friday_targets(spine, horizon_weeks).withColumn("_as_of", F.col("origin_date").cast("timestamp"))
    data = scenarios.withColumn("issued_at", F.col("issued_at").cast("timestamp"))
    return latest_at_origins(targets, data, ["duoarea", "date"], "_as_of", "issued_at").drop("_as_of")


def weights_at_issues(archive: DataFrame, history: DataFrame, weight: str) -> DataFrame:
    """Normalized state weights known at each distinct issue time of the archive."""
    issues = archive.select("duoarea", "state", "issued_at").distinct()
    data = history.select("duoarea", "state", "available_at", weight)
    known = latest_at_origins(issues, data, ["duoarea", "state"], "issued_at", "available_at")
    total = F.sum(weight).over(W.partitionBy("duoarea", "issued_at"))
    return known.where(F.col("available_at").isNotNull()).select(
        "duoarea", "state", "issued_at", (F.col(weight) / total).alias("weather_weight")
    )


def hourly_as_of(forecasts: DataFrame, weather: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach the weather issue known at each forecast origin to every delivery hour."""
    drop = [c for c in ("source", "product_id", "source_hash", "geography") if c in weather.columns]
    data = weather.drop(*drop).withColumnRenamed("valid_at", "delivery_hour")
    clash = [c for c in data.columns if c in forecasts.columns and c not in (*keys, "delivery_hour")]
    data = data.withColumnsRenamed({c: f"_w_{c}" for c in clash})
    issued = "_w_issued_at" if "issued_at" in clash else "issued_at"
    retrieved = next((c for c in ("_w_retrieved_at", "retrieved_at") if c in data.columns), None)
    joined = latest_at_origins(forecasts, data, [*keys, "delivery_hour"], "forecast_origin", issued, retrieved)
    return joined.drop(*[f"_w_{c}" for c in clash], issued, *([retrieved] if retrieved else []))
