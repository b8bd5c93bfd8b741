"""Regional forecasts made coherent with their total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The parent region and its five children.
PARENT = "R48"
CHILDREN = ("R31", "R32", "R33", "R34", "R35")
ALL_REGIONS = (PARENT, *CHILDREN)
QUANTILES = ("p10", "p50", "p90")


def direct(df: DataFrame) -> DataFrame:
    return df.where(F.col("region") == PARENT).withColumn("reconciliation_method", F.lit("direct"))


def bottom_up(df: DataFrame, group: Sequence[str] = ("date", "horizon"), values: Sequence[str] = ("predicted_weekly_change",)) -> DataFrame:
    """Children as forecast; the parent is their sum and takes other columns from the first child."""
    children = df.where(F.col("region").isin(*CHILDREN))
    other = [c for c in df.columns if c not in (*group, *values, "region")]
    first = F.min_by(F.struct(*other), "region") if other else F.lit(None)
    parent = children.groupBy(*group).agg(*[F.sum(v).alias(v) for v in values], first.alias("_f")).select(
        *group, F.lit(PARENT).alias("region"), *values, *[F.col(f"_f.{c}").alias(c) for c in other]
    )
    both = children.unionByName(parent).withColumn("reconciliation_method", F.lit("bottom_up"))
    return finalize(both, group, values)


def finalize(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sort complete child quantiles and set the parent to the sum of its children."""
    is_child = F.col("region").isin(*CHILDREN)
    has_quantiles = set(QUANTILES) <= set(df.columns)
    if has_quantiles:
        complete = is_child & F.col("p10").isNotNull() & F.col("p50").isNotNull() & F.col("p90").isNotNull()
        df = df.withColumn("_s", F.array_sort(F.array(*QUANTILES)))
        df = df.withColumns({q: F.when(complete, F.col("_s")[i]).otherwise(F.col(q)) for i, q in enumerate(QUANTILES)}).drop("_s")
    w = W.partitionBy(*group)
    is_parent = F.col("region") == PARENT
    out = {v: F.when(is_parent, F.sum(F.when(is_child, F.col(v))).over(w)).otherwise(F.col(v)) for v in values}
    if has_quantiles and not set(QUANTILES) <= set(values):
        out |= {q: F.when(~is_parent, F.col(q)) for q in QUANTILES}
    return df.withColumns(out)


def coherence_error(df: DataFrame, value: str = "predicted_weekly_change", group: Sequence[str] = ("date", "horizon")) -> DataFrame:
    sign = F.when(F.col("region") == PARENT, F.col(value)).when(F.col("region").isin(*CHILDREN), -F.col(value))
    return df.groupBy(*group).agg(F.sum(sign).alias("reconciliation_error"))


def complete_groups(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Keep groups in which all six regions are present; the set per group never exceeds six codes."""
    known = F.when(F.col("region").isin(*ALL_REGIONS), F.col("region"))
    seen = F.size(F.collect_set(known).over(W.partitionBy(*group)))
    return df.withColumn("_n", seen).where(F.col("_n") == len(ALL_REGIONS)).drop("_n")


def residual_vectors(residuals: DataFrame, residual: str = "residual", keys: Sequence[str] = ()) -> DataFrame:
    """Complete six-region residual vectors per (keys, date, horizon)."""
    wide = residuals.groupBy(*keys, "date", "horizon").pivot("region", list(ALL_REGIONS)).agg(F.min(residual))
    return wide.dropna(subset=list(ALL_REGIONS))


def residual_moments(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of all monomials up to degree four that the covariance and its shrinkage need, per date.

    They are additive, so prior moments at every origin are running sums along the dates. Residuals are taken about the earliest vector of
    their key: the covariance and its shrinkage do not depend on the point, sums near it do not cancel, and no later date moves it.
    """
    first = F.min_by(F.struct(*ALL_REGIONS), F.struct("date", "horizon")).alias("_first")
    if keys:
        held = vectors.join(vectors.groupBy(*keys).agg(first), list(keys))
    else:
        held = vectors.withColumn("_first", vectors.agg(first).scalar())
    vectors = held
    x = [F.col(r) - F.col("_first")[r] for r in ALL_REGIONS]
    norm2 = _total([c * c for c in x])
    sums = [F.sum(F.lit(1.0)), *[F.sum(c) for c in x]]
    sums += [F.sum(x[i] * x[j]) for i in range(P) for j in range(i, P)]
    sums += [F.sum(norm2 * c) for c in x]
    sums += [F.sum(norm2 * norm2)]
    return vectors.groupBy(*keys, "date").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)])


P = len(ALL_REGIONS)
N_PAIRS = P * (P + 1) // 2
N_SUMS = 1 + P + N_PAIRS + P + 1


def _moment(i: int, j: int) -> Column:
    """Raw sum of products of residuals i and j."""
    i, j = min(i, j), max(i, j)
    return F.col(f"s{1 + P + i * P - i * (i - 1) // 2 + (j - i)}")


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _cov(i: int, j: int) -> Column:
    return F.col(f"c{min(i, j)}{max(i, j)}")


def _with_covariance(df: DataFrame) -> DataFrame:
    """Means, covariances and the scalars of the Ledoit-Wolf intensity as columns of the raw sums."""
    n = F.col("s0")
    df = df.withColumns({f"u{i}": F.col(f"s{1 + i}") / n for i in range(P)})
    mu = [F.col(f"u{i}") for i in range(P)]
    df = df.withColumns({f"c{i}{j}": _moment(i, j) / n - mu[i] * mu[j] for i in range(P) for j in range(i, P)})
    m2 = _total([m * m for m in mu])
    trace = _total([_moment(i, i) for i in range(P)])
    cubic = _total([mu[i] * F.col(f"s{1 + P + N_PAIRS + i}") for i in range(P)])
    quad = _total([mu[i] * mu[j] * _moment(i, j) * (1 if i == j else 2) for i in range(P) for j in range(i, P)])
    df = df.withColumns({
        "_scale": _total([_cov(i, i) for i in range(P)]) / P,
        "_squared": _total([_cov(i, j) * _cov(i, j) * (1 if i == j else 2) for i in range(P) for j in range(i, P)]),
        # Sum of |x - mu|^4 expanded in the raw sums.
        "_fourth": F.col(f"s{N_SUMS - 1}") - 4 * cubic + 4 * quad + 2 * m2 * trace - 3 * n * m2 * m2,
    })
    distance = F.col("_squared") / P - F.col("_scale") * F.col("_scale")
    spread = (F.col("_fourth") / n - F.col("_squared")) / (P * n)
    return df.withColumn(
        "_shrink", F.when((spread <= 0) | (distance <= 0), F.lit(0.0)).otherwise(F.least(spread, distance) / distance)
    )


def _adjustment() -> Column:
    """Share of the coherence gap each of the six values gives up.

    The hierarchy has one constraint, u'y = 0 with u = (1, -1, ..., -1), so the minimum-trace
    projection is I - C u u' / (u' C u) for the error covariance C, which is the sample covariance
    shrunk towards a scaled identity.
    """
    u = [1.0] + [-1.0] * (P - 1)
    w = F.col("_shrink")
    cu = [(1 - w) * _total([_cov(i, j) * u[j] for j in range(P)]) + w * F.col("_scale") * u[i] for i in range(P)]
    packed = F.array(*cu)

    def shares(v: Column) -> Column:
        ucu = v[0] - v[1] - v[2] - v[3] - v[4] - v[5]
        return F.transform(v, lambda x: F.try_divide(x, ucu))

    return F.transform(F.array(packed), shares)[0]


def _rank_one() -> Column:
    """Row-major projection when only two prior vectors exist.

    Two vectors leave a covariance v v' of rank one, whose pseudo-inverse gives each child the share
    (v0 + vj) v'y / sum_k (v0 + vk)^2; the parent is the sum of the children.
    """
    norm = _total([_cov(0, 0) + 2 * _cov(0, k) + _cov(k, k) for k in range(1, P)])
    child = [[_cov(0, i) + _cov(j, i) for i in range(P)] for j in range(1, P)]
    parent = [_total([row[i] for row in child]) for i in range(P)]
    flat = F.array(*parent, *[x for row in child for x in row], norm)
    return F.transform(F.array(flat), lambda v: F.transform(
        F.slice(v, 1, P * P), lambda x: F.coalesce(F.try_divide(x, F.element_at(v, P * P + 1)), F.lit(0.0))
    ))[0]


def mint_adjustments(vectors: DataFrame, origins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adjustment shares per origin from residuals dated strictly before it.

    Prior moments are running sums along the dates. Origins with fewer than two prior vectors get none.
    """
    sums = residual_moments(vectors, keys)
    asked = origins.select(*keys, F.to_date("forecast_origin").alias("date")).distinct().withColumn("_q", F.lit(True))
    w = W.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy(F.unix_date("date")).rangeBetween(W.unboundedPreceding, -1)
    names = [f"s{i}" for i in range(N_SUMS)]
    both = sums.unionByName(asked, allowMissingColumns=True)
    prior = both.select(*keys, "date", "_q", *[F.sum(s).over(w).alias(s) for s in names]).where(
        F.col("_q") & (F.col("s0") >= 2)
    )
    return _with_covariance(prior).select(
        *keys, F.col("date").alias("forecast_origin"), F.col("s0").cast("bigint").alias("n_vectors"), _adjustment().alias("adjustment"),
        F.when(F.col("s0") == 2, _rank_one()).alias("rank_one"),
    )


def mint(df: DataFrame, residuals: DataFrame, keys: Sequence[str] = (), values: Sequence[str] = ("predicted_weekly_change",)) -> DataFrame:
    """Minimum-trace reconciliation of every origin in one job.

    Every value gives up its share of the gap between the parent and the sum of the children.
    """
    group = [*keys, "forecast_origin", "date", "horizon"]
    shares = mint_adjustments(residual_vectors(residuals, keys=keys), df, keys).drop("n_vectors")
    base = complete_groups(df, group).where(F.col("region").isin(*ALL_REGIONS)).join(shares, [*keys, "forecast_origin"])
    index = F.array_position(F.array(*[F.lit(r) for r in ALL_REGIONS]), F.col("region")).cast("int")
    w = W.partitionBy(*group)
    base = base.withColumn("_i", index)
    out = {}
    for v in values:
        y = F.array(*[F.max(F.when(F.col("_i") == j, F.col(v))).over(w) for j in range(1, P + 1)])
        gap = F.sum(F.when(F.col("region") == PARENT, F.col(v)).otherwise(-F.col(v))).over(w)
        row = F.slice("rank_one", (F.col("_i") - 1) * P + 1, P)
        two = F.aggregate(F.zip_with(row, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        out[v] = F.when(F.col("rank_one").isNull(), F.col(v) - F.element_at("adjustment", F.col("_i")) * gap).otherwise(two)
    fixed = base.withColumns(out).drop("_i", "adjustment", "rank_one").withColumn("reconciliation_method", F.lit("mint_shrink"))
    return finalize(fixed, group, values)


def all_paths(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Direct, bottom-up and minimum-trace paths of base predictions.

    Quantiles are reconciled only for origins whose every quantile is present; other origins
    publish none. Actuals are attached from the base rows.
    """
    group = [*keys, "forecast_origin", "date", "horizon"]
    data = complete_groups(df, group)
    residuals = data.withColumn("residual", F.col("actual_weekly_change") - F.col("predicted_weekly_change")).where(
        F.col("residual").isNotNull()
    )
    actuals = data.select(*group, "region", "actual_weekly_change")
    base = data.drop("actual_weekly_change")
    with_quantiles = set(QUANTILES) <= set(df.columns)
    values = ["predicted_weekly_change"]
    if with_quantiles:
        w = W.partitionBy(*keys, "forecast_origin")
        gaps = F.count_if(F.col("p10").isNull() | F.col("p50").isNull() | F.col("p90").isNull()).over(w)
        base = base.withColumn("_gaps", gaps)
        base = base.withColumns({q: F.when(F.col("_gaps") == 0, F.col(q)) for q in QUANTILES}).drop("_gaps")
        values += list(QUANTILES)
    paths = direct(base).unionByName(bottom_up(base, group, values)).unionByName(mint(base, residuals, keys, values))
    return paths.join(actuals, [*group, "region"], "left")
