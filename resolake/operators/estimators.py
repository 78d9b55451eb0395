"""Classical classifiers over per-position features, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positions import neighbours, relative_position

SEED = 42


def neighbour_features(df: DataFrame, value: str, category: str, k: int = 1) -> DataFrame:
    """Value, category, place and the k neighbours' values and categories of each position, by windows that share one shuffle."""
    w = Window.partitionBy("name").orderBy("i")
    cats = {f"prev_{n}_cat": F.lag(category, n, "START").over(w) for n in range(1, k + 1)} | {f"next_{n}_cat": F.lead(category, n, "END").over(w) for n in range(1, k + 1)}
    return relative_position(neighbours(df, value, k, 0.0).withColumns(cats))


def feature_pipeline(numeric: list[str], categorical: list[str], estimator=None) -> Pipeline:
    index = [StringIndexer(inputCol=c, outputCol=f"_{c}_n", handleInvalid="keep") for c in categorical]
    hot = [OneHotEncoder(inputCols=[f"_{c}_n" for c in categorical], outputCols=[f"_{c}_v" for c in categorical])] if categorical else []
    pack = VectorAssembler(inputCols=[*numeric, *[f"_{c}_v" for c in categorical]], outputCol="features")
    return Pipeline(stages=[*index, *hot, pack, *([estimator] if estimator is not None else [])])


def logistic(label: str = "label", **params) -> LogisticRegression:
    return LogisticRegression(labelCol=label, **({"maxIter": 50, "regParam": 0.01} | params))


def forest(label: str = "label", **params) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, seed=SEED, **({"numTrees": 20, "maxDepth": 5} | params))


def grid_search(pipeline: Pipeline, estimator, grid: dict[str, list], label: str = "label", folds: int = 5, parallelism: int = 4) -> CrossValidator:
    """Accuracy over a parameter grid by cross-validation; models of one fold are fitted side by side."""
    g = ParamGridBuilder()
    for name, values in grid.items():
        g = g.addGrid(estimator.getParam(name), values)
    return CrossValidator(estimator=pipeline, estimatorParamMaps=g.build(), evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"), numFolds=folds, seed=SEED, parallelism=parallelism)
