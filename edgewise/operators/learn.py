"""Learned heads on vector tables, fitted by Spark's own learners."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("__x", array_to_vector("v"))


def fit_head(train: DataFrame, components: int = 32, ridge: float = 1e-3) -> PipelineModel:
    """scale, principal components, logistic head; sees training rows only."""
    stages = [StandardScaler(inputCol="__x", outputCol="__s", withMean=True), PCA(k=components, inputCol="__s", outputCol="__p"), LogisticRegression(featuresCol="__p", labelCol="y", regParam=ridge, probabilityCol="__q", rawPredictionCol="__r", predictionCol="__c")]
    return Pipeline(stages=stages).fit(_vectors(train))


def score_head(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """row_id, y and the head's probability."""
    return model.transform(_vectors(rows)).select("row_id", "y", F.round(F.element_at(vector_to_array("__q"), 2), 6).alias("probability"))


def frozen_logit(vector: Column, weights: list[float], bias: float) -> Column:
    """stored coefficients applied to an array column."""
    products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(float(bias)), lambda s, x: s + x)


def cross_fit(rows: DataFrame, folds: int, components: int = 32) -> DataFrame:
    """each fold scored by a head fitted on the others (``fold`` is a column); the fits are few, the rows stay in Spark."""
    parts = [score_head(fit_head(rows.filter(F.col("fold") != k), components), rows.filter(F.col("fold") == k)).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def boosted_values(train: DataFrame, rows: DataFrame, trees: int = 100, depth: int = 5) -> DataFrame:
    """boosted regression trees of an entity's value."""
    model = GBTRegressor(featuresCol="__x", labelCol="y", maxIter=trees, maxDepth=depth, seed=7, predictionCol="value").fit(_vectors(train))
    return model.transform(_vectors(rows)).select("row_id", F.round("value", 6).alias("value"))
