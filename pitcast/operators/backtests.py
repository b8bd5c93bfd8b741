"""Any model in the one-step rolling-origin backtest: linear, tree, quantile, or an average of several."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.operators import linear, splits, tree_growth
from pitcast.operators.linear import LinearSpec
from pitcast.operators.tree_growth import TreeSpec
from pitcast.session import staged


@dataclass(frozen=True)
class Blend:
    """The plain average of models, each fit in every fold."""

    models: tuple[LinearSpec | TreeSpec | Blend, ...]


LINEAR_BOOSTING = Blend((linear.OLS, tree_growth.BOOSTING))


def one_step(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, date: str, spec: splits.FoldSpec,
             model: LinearSpec | TreeSpec | Blend = linear.OLS, prediction: str = "predicted_weekly_change") -> DataFrame:
    """``keys, date, target, fold, n_train``, the prediction and its deviation; quantile models give one column per quantile instead.

    Every model is fit per series and fold from rows before the fold's validation.
    """
    if isinstance(model, LinearSpec):
        return linear.backtest(df, keys, features, target, date, spec, model, prediction)
    if isinstance(model, TreeSpec):
        out = tree_growth.backtest(df, keys, features, target, date, spec, model)
        if model.outputs != ["prediction"]:
            return out
        return out.withColumnRenamed("prediction", prediction).withColumn("forecast_deviation", F.col(target) - F.col(prediction))
    if any(isinstance(m, TreeSpec) and m.outputs != ["prediction"] for m in model.models):
        raise ValueError("Only models with one prediction can be averaged.")
    rows = staged(df.dropna(subset=[*features, target]).select(*dict.fromkeys([*keys, date, target, *features])), "blend")
    parts = [one_step(rows, keys, features, target, date, spec, m, prediction).withColumn(target, F.col(target).cast("double")) for m in model.models]
    both = reduce(DataFrame.unionByName, parts).groupBy(*keys, date, target, "fold").agg(
        F.max("n_train").alias("n_train"), F.avg(prediction).alias(prediction), F.count(F.lit(1)).alias("_n")
    )
    # a series that one of the models could not fit has no average
    return both.where(F.col("_n") == len(parts)).drop("_n").withColumn("forecast_deviation", F.col(target) - F.col(prediction))
