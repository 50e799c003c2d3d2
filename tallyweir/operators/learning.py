"""Models of long flows: grouped split, logistic regression and random forest on the features of the first packets."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.operators.evaluate import areas, confusion
from tallyweir.operators.features import feature_names
from tallyweir.operators.forest import Forest
from tallyweir.schema import KEY


def in_test(group, percent: int = 20, seed: int = 7):
    """Whether a group of rows is held out: a seeded hash of its name, so that groups stay together."""
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(100)) < percent


def balanced(rows: DataFrame) -> DataFrame:
    """rows with a weight that makes both labels count the same."""
    n = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    pos = max(1, n.p or 0)
    neg = max(1, n.n - pos)
    return rows.withColumn("weight", F.when(F.col("label") == 1, n.n / (2 * pos)).otherwise(n.n / (2 * neg)))


def logistic(n: int) -> Pipeline:
    names = feature_names(n)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="vector", withMean=True), LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=2000)])


def forest(n: int, trees: int = 400, depth: int = 30) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=feature_names(n), outputCol="vector"), Forest(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=7)])


def train(rows: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """A fitted pipeline. The rows are kept while it fits, as each of its passes reads them; a lost part is made again."""
    kept = rows.fillna(0.0).persist()
    try:
        return pipeline.fit(balanced(kept))
    finally:
        kept.unpersist()


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of label 1. The model must know the features by name."""
    missing = set(model.stages[0].getInputCols()) - set(rows.columns)
    if missing:
        raise ValueError(f"features are missing: {sorted(missing)}")
    return model.transform(rows.fillna(0.0)).select(*KEY, "label", vector_to_array("probability")[1].alias("p"))


def report(scored: DataFrame) -> DataFrame:
    """Areas under curves, and precision, recall and F1 at 0.5."""
    return areas(scored).crossJoin(confusion(scored).select("precision", "recall", "f1"))  # one row each


def as_scorer(model: PipelineModel) -> Callable[[list[float]], float]:
    """A plain function of a feature list, for duels: weights only, nothing of Spark."""
    scaler, last = model.stages[1], model.stages[2]
    mean, scale = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    weights, intercept = last.coefficients.toArray().tolist(), float(last.intercept)

    def p(features: list[float]) -> float:
        if len(features) != len(weights):
            raise ValueError(f"{len(features)} features, not {len(weights)}")
        z = intercept + sum(w * (x - m) / s for w, x, m, s in zip(weights, features, mean, scale) if s)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    return p


def save(model: PipelineModel, path: str, n: int) -> None:
    """The model, and beside it what it expects."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"first_n": n, "features": feature_names(n), "target": 40}),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
