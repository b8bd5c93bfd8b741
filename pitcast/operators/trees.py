"""One tree model over all series through MLlib, which trains it over the whole cluster; ``tree_growth`` fits one per series and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pipeline(features: Sequence[str], learner) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_fv", handleInvalid="keep"), learner])


def fit_boosting(df: DataFrame, features: Sequence[str], target: str, rounds: int = 300, rate: float = 0.05, seed: int = 42, depth: int = 5):
    """Histogram-binned gradient boosting with squared loss."""
    gbt = GBTRegressor(featuresCol="_fv", labelCol=target, maxIter=rounds, stepSize=rate, seed=seed, maxDepth=depth)
    return _pipeline(features, gbt).fit(df.dropna(subset=[*features, target]))


def predict(model, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    out = model.transform(df.dropna(subset=list(features)))
    return out.select(*df.columns, F.col("prediction").alias(name))


def blend(df: DataFrame, columns: Sequence[str], name: str = "prediction") -> DataFrame:
    """Plain average of several model columns."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn(name, total / len(columns))
