"""Node classifier: a multilayer perceptron of Spark ML on assembled features."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import node_micro
from .features import NodeFeatures


def fit(train: DataFrame, features: list[str], label: str, classes: int, hidden: tuple[int, ...] = (100, 10), steps: int = 50, seed: int = 42) -> PipelineModel:
    """Fits scaler and network on training rows only; features are numeric columns, label a number below classes."""
    layers = [len(features), *hidden, classes]
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(layers=layers, labelCol=label, maxIter=steps, seed=seed, blockSize=128)]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with logits, probabilities and the predicted class."""
    out = model.transform(df)
    return out.withColumn("logits", vector_to_array("rawPrediction")).withColumn("probabilities", vector_to_array("probability")).withColumn("predicted", F.col("prediction").cast("int")).drop("_raw", "features", "rawPrediction", "probability", "prediction")


class Checkpoint(NamedTuple):
    """A fitted model with its place in training, and what it needs beside the weights."""

    model: PipelineModel
    epoch: int
    step: int
    best: float
    labels: list[str]
    features: str


def train(train_: DataFrame, val: DataFrame, features: NodeFeatures, label: str, labels: list[str], path: str, epochs: int = 3, steps: int = 20, patience: int = 2, hidden: tuple[int, ...] = (100, 10), seed: int = 42) -> Checkpoint:
    """Trains by epochs of `steps` iterations, each from the weights of the one before, and keeps the best by F1 on val.

    train_ and val are nodes with a class number in `label`; labels names the classes from 1. Features must be frozen.
    Every epoch that is better than all before is written to path; training ends after `patience` epochs that are not.
    """
    state, names = features.freeze(), features.names
    shape = [len(names), *hidden, len(labels) + 1]
    prepared = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(features.compute(train_))
    rows = prepared.transform(features.compute(train_)).select("features", label)
    weights, best, worse = None, None, 0
    for epoch in range(1, epochs + 1):
        network = MultilayerPerceptronClassifier(layers=shape, labelCol=label, maxIter=steps, seed=seed, blockSize=128)
        fitted = (network.setInitialWeights(weights) if weights is not None else network).fit(rows)
        weights = fitted.weights
        model = PipelineModel([*prepared.stages, fitted])
        score = float(node_micro(predict(model, features.compute(val)), "predicted", label).first()["f1"] or 0.0)
        if best is None or score > best.best:
            best, worse = Checkpoint(model, epoch, epoch * steps, score, labels, state), 0
            save_checkpoint(train_.sparkSession, best, path)
        elif (worse := worse + 1) >= patience:
            break
    return best


def save_checkpoint(spark: SparkSession, point: Checkpoint, path: str) -> None:
    save(point.model, f"{path}/model")
    row = (point.epoch, point.step, point.best, point.labels, point.features)
    spark.createDataFrame([row], "epoch int, step int, best double, labels array<string>, features string").coalesce(1).write.mode("overwrite").json(f"{path}/state")


def load_checkpoint(spark: SparkSession, path: str) -> Checkpoint:
    r = spark.read.schema("epoch int, step int, best double, labels array<string>, features string").json(f"{path}/state").first()
    return Checkpoint(load(f"{path}/model"), r["epoch"], r["step"], r["best"], list(r["labels"]), r["features"])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
