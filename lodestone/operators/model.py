"""Match classifiers on spark.ml, and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as ft
from . import metrics


def require(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError("missing features: " + ", ".join(missing))


def _weighted(train: DataFrame, balanced: bool) -> DataFrame:
    counts = metrics.class_balance(train).first()
    n, pos, neg = counts["n_pos"] + counts["n_neg"], max(1, counts["n_pos"]), max(1, counts["n_neg"])
    up, down = (n / 2 / pos, n / 2 / neg) if balanced else (counts["scale_pos_weight"], 1.0)
    return train.withColumn("_weight", F.when(F.col("label") == 1, up).otherwise(down))


def _assembled(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")


def fit_logistic(train: DataFrame, names: list[str], max_iter: int = 1000) -> PipelineModel:
    """Logistic regression with balanced classes and unit L2 penalty on the summed loss."""
    require(train, names)
    train = _weighted(train, True).fillna(0.0, names)
    model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=max_iter, standardization=False, elasticNetParam=0.0, regParam=1.0 / max(1, train.count()))
    return Pipeline(stages=[_assembled(names), model]).fit(train)


def fit_trees(train: DataFrame, names: list[str] = ft.NAMES, trees: int = 500, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees: 0.05 steps, 0.85 of rows and features, positives weighted."""
    require(train, names)
    train = _weighted(train, False).fillna(0.0, names)
    model = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=3, seed=seed)
    return Pipeline(stages=[_assembled(names), model]).fit(train)


def score(model: PipelineModel, pairs: DataFrame, names: list[str] = ft.NAMES, threshold: float = 0.5) -> DataFrame:
    """Add probability and predicted."""
    require(pairs, names)
    scored = model.transform(pairs.fillna(0.0, names)).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("predicted", F.col("probability") >= threshold).drop("_features", "rawPrediction", "prediction")


def coefficients(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Feature and coefficient, the largest in absolute value first."""
    return sorted(zip(names, map(float, model.stages[-1].coefficients)), key=lambda x: (-abs(x[1]), x[0]))


def importances(model: PipelineModel, names: list[str] = ft.NAMES) -> list[tuple[str, float]]:
    return sorted(zip(names, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
