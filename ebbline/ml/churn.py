"""Gradient-boosted trees over scaled features, cross-validated, gated by improvement."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from ebbline.operators.clean import hash_split
from ebbline.operators.features import FEATURES

LABEL = "is_churned"


def model_features(leakage: bool = False) -> list[str]:
    """All features, less the one that the label is made from unless ``leakage``."""
    return [f for f in FEATURES if leakage or f != "days_since_last_activity"]


def build_pipeline(features: Sequence[str], max_iter: int = 100, seed: int = 42) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            GBTClassifier(labelCol=LABEL, featuresCol="features", maxIter=max_iter, seed=seed),
        ]
    )


def prepare(df: DataFrame, features: Sequence[str]) -> DataFrame:
    typed = df.selectExpr("user_id", *[f"cast(`{f}` as double) as `{f}`" for f in features], f"cast({LABEL} as double) as {LABEL}")
    return typed.na.fill(0.0, subset=list(features))


def evaluate(scored: DataFrame) -> dict[str, float]:
    score = lambda m: BinaryClassificationEvaluator(labelCol=LABEL, metricName=m).evaluate(scored)
    return {"auc_roc": round(score("areaUnderROC"), 4), "auc_pr": round(score("areaUnderPR"), 4)}


def cross_validate(train: DataFrame, features: Sequence[str], depths=(3, 5, 7), steps=(0.05, 0.1), bins=(16, 32), folds: int = 3, max_iter: int = 100, parallelism: int = 4, seed: int = 42):
    pipeline = build_pipeline(features, max_iter, seed)
    gbt = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.stepSize, list(steps)).addGrid(gbt.maxBins, list(bins)).build()
    judge = BinaryClassificationEvaluator(labelCol=LABEL, metricName="areaUnderROC")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, parallelism=parallelism, seed=seed).fit(train)


def train_churn(features_df: DataFrame, path: str | None = None, leakage: bool = False, max_iter: int = 100, tune: bool = True, **tuning: Any) -> tuple[PipelineModel, dict[str, float]]:
    """The model and its held-out metrics; users are split by hash, 80 to 20."""
    features = model_features(leakage)
    data = prepare(features_df, features)
    train, test = hash_split(data, ["user_id"], 0.8)
    train = train.cache()
    try:
        model = cross_validate(train, features, max_iter=max_iter, **tuning).bestModel if tune else build_pipeline(features, max_iter).fit(train)
    finally:
        train.unpersist()
    metrics = evaluate(model.transform(test))
    if path:
        model.write().overwrite().save(path)
    return model, metrics


def should_deploy(new_auc: float, baseline_auc: float = 0.5, least_gain: float = 0.01) -> bool:
    return round(new_auc - baseline_auc, 10) >= least_gain
