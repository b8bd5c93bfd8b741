"""Quality rules: text statistics and robust multivariate outliers per language and source."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import SPACE, WORD, stage

KEYS = ["lang_key", "source_key"]
#: Statistics that enter the vector, in order, with the least scale (standard deviation) each one is granted. One symbol or
#: repeated line in 50 words, the shortest text judged, lies within ``CUT`` of a group that has none.
FLOORS = {"word_length": 0.06, "symbols": 0.75, "dup_lines": 1.0, "repeats": 0.1}
AXES = list(FLOORS)
PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[: i + 1]]
#: Share of a group's rows that the determinant is minimised over, and the normal-consistency factor for four axes.
SUBSET, CONSISTENCY = 0.75, 1.49
#: Rows of pooled evidence that a group's own moments are weighed against.
PRIOR_ROWS = 40.0
STEPS = 3
#: Squared distance beyond which a row goes: the chi-square quantile of four degrees of freedom at 0.999.
CUT = 18.47


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_key, source_key`` and the text statistics of every whole text.

    A null text has no words. All of it is one projection over array functions; three-word windows of a text
    are compared by content after a sort inside the row, and only in texts where a window occurs twice.
    """
    base = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang_key"), F.coalesce("source", F.lit("")).alias("source_key"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    split = base.select(
        "doc_id", *KEYS,
        F.filter(F.split("body", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "doc_id", *KEYS, "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.transform(F.slice("words", F.lit(1), F.size("words") - 2), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))),
        ).alias("windows"),
    )
    ordered = counted.withColumn(
        "windows",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )
    twins = ordered.withColumn(
        "windows",
        F.filter(
            F.zip_with("windows", F.slice("windows", F.lit(2), F.size("windows")), lambda a, b: F.when(a["w"] == b["w"], F.struct(a["i"].alias("a"), b["i"].alias("b")))),
            lambda p: p.isNotNull(),
        ),
    )
    covered = F.array_distinct(F.flatten(F.transform(
        "windows", lambda p: F.array(p["a"], p["a"] + 1, p["a"] + 2, p["b"], p["b"] + 1, p["b"] + 2)
    )))
    out = twins.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    out = out.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), 0).otherwise(F.col("n_repeat_words")).cast("long"))
    return out.select("doc_id", *KEYS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def with_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics: log word length, log symbol and repeated-line rates, share of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.log1p(1000.0 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(1000.0 * F.col("n_dup_lines") / n),
        "repeats": F.col("n_repeat_words") / n,
    })


def _cov(a: str, b: str) -> str:
    return f"cov_{a}_{b}"


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances per group, shrunk to those of the language by the number of rows behind them."""
    own = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in AXES], *[F.covar_pop(a, b).alias(_cov(a, b)) for a, b in PAIRS]
    )
    names = [f"mean_{a}" for a in AXES] + [_cov(a, b) for a, b in PAIRS]
    pooled = own.groupBy("lang_key").agg(*[(F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias(f"all_{x}") for x in names])
    joined = own.join(pooled, "lang_key")
    return joined.select(*KEYS, *[
        ((F.col("n") * F.col(x) + PRIOR_ROWS * F.col(f"all_{x}")) / (F.col("n") + PRIOR_ROWS)).alias(x) for x in names
    ])


def _factored(moments: DataFrame) -> DataFrame:
    """Cholesky factors of the scaled covariances; what is left of each variance is no less than its floor, so they stay regular."""
    out, factor = moments, {}
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[: i + 1]):
            value = F.col(_cov(a, b)) * CONSISTENCY
            for k in range(j):
                value = value - factor[i, k] * factor[j, k]
            if i == j:
                value = F.greatest(value, F.lit(FLOORS[a] ** 2))
            out = out.withColumn(f"f_{i}_{j}", F.sqrt(value) if i == j else value / factor[j, j])
            factor[i, j] = F.col(f"f_{i}_{j}")
    return out.select(*KEYS, *[f"mean_{a}" for a in AXES], *[f"f_{i}_{j}" for i in range(len(AXES)) for j in range(i + 1)])


def _distance() -> list[tuple[str, Column]]:
    """Columns of the forward substitution, one per axis."""
    steps = []
    for i, a in enumerate(AXES):
        rest = F.col(a) - F.col(f"mean_{a}")
        for j in range(i):
            rest = rest - F.col(f"f_{i}_{j}") * F.col(f"z_{j}")
        steps.append((f"z_{i}", rest / F.col(f"f_{i}_{i}")))
    return steps


def with_distance(rows: DataFrame, scatter: DataFrame) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance from their group."""
    out = rows.join(scatter, KEYS, "left")
    for name, value in _distance():
        out = out.withColumn(name, value)
    return out.withColumn("distance", reduce(add, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(AXES))]))


def scatter(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant location and scatter per group, as Cholesky factors.

    A deterministic start from medians and median absolute deviations is improved by concentration steps: the
    three quarters of a group's rows that lie nearest to its centre give the next centre and scatter. Every
    statistic is a mergeable aggregate, so a group with a third of all rows leaves each task as one row. Each
    step's table has one row per group and is written to the shared folder.
    """
    medians = stage(rows.groupBy(*KEYS).agg(*[F.percentile_approx(a, 0.5, 2000).alias(f"mean_{a}") for a in AXES]), "medians")
    spread = rows.join(medians, KEYS).groupBy(*KEYS).agg(*[
        F.percentile_approx(F.abs(F.col(a) - F.col(f"mean_{a}")), 0.5, 2000).alias(f"mad_{a}") for a in AXES
    ])
    start = medians.join(spread, KEYS).select(*KEYS, *[f"mean_{a}" for a in AXES], *[
        (F.pow(1.4826 * F.col(f"mad_{a}"), 2) if a == b else F.lit(0.0)).alias(_cov(a, b)) for a, b in PAIRS
    ])
    current = stage(_factored(start), "scatter")
    for _ in range(STEPS):
        near = with_distance(rows, current)
        radius = stage(near.groupBy(*KEYS).agg(F.percentile_approx("distance", SUBSET, 2000).alias("radius")), "radius")
        inside = near.join(radius, KEYS).where("distance <= radius")
        current = stage(_factored(_moments(inside)), "scatter")
    return current


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its statistics, ``base_failed``, ``distance`` and ``kept``.

    Texts under 50 words or with more than half of their words in repeated three-word windows fail at once
    and do not shape the estimates. Of the others, those whose vector lies beyond ``CUT`` from the robust centre
    of their language and source go. Null languages and sources form groups of their own; a group too
    small to show scatter leans on its language and on the floors, so a lone document stays. Repeated rows and
    ids are scored row by row; other columns are ignored.
    """
    stats = stage(with_vector(statistics(docs)), "statistics")
    scored = with_distance(stats, scatter(stats.where(~F.col("base_failed"))))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"), "distance",
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; ids are taken as unique."""
    kept = quality_rules(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
