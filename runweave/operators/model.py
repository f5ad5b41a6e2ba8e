"""Gradient-boosted scoring of tests on Spark ML."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import ranks
from runweave.operators.features import NAMES
from runweave.session import materialize

LEAST_RUNS = 100


def fit(training: DataFrame, *, trees: int = 100, depth: int = 3, step: float = 0.1, share: float = 0.8, seed: int = 42) -> PipelineModel:
    """A fitted pipeline over the eight features and ``label``."""
    assemble = VectorAssembler(inputCols=list(NAMES), outputCol="features", handleInvalid="keep")
    booster = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=seed)
    return Pipeline(stages=[assemble, booster]).fit(materialize(training.select(*NAMES, "label"), "training"))


def label_shares(training: DataFrame) -> DataFrame:
    """rows, positives, positive_share of a training set."""
    return training.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), (F.sum("label") / F.count(F.lit(1))).alias("positive_share"))


def scored(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with ``score``, the probability of a failure."""
    return model.transform(features).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def ranked(scores: DataFrame, runs_by_repo: DataFrame, least: int = LEAST_RUNS) -> DataFrame:
    """repo_id, test_path, score, place: repositories with too few runs, or whose scores are all zero, get 0.5 throughout. Places are taken in stretches."""
    rows = materialize(scores.select("repo_id", "test_path", "score"), "scores")  # read three times below, scored once
    top = rows.groupBy("repo_id").agg(F.max("score").alias("top")).join(runs_by_repo.select("repo_id", "run_count"), "repo_id", "left")
    idle = top.select("repo_id", ((F.coalesce("run_count", F.lit(0)) < least) | (F.col("top") == 0)).alias("idle"))
    rows = rows.join(idle, "repo_id").select("repo_id", "test_path", F.when(F.col("idle"), 0.5).otherwise(F.col("score")).alias("score"))
    return ranks.placed(rows, ["repo_id"], [F.col("score").desc(), F.col("test_path")])


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline, over an older one if there is one."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The pipeline at a path; None if there is none or it can't be read, so that scoring goes on without it."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - an absent or broken model means no model
        return None


def scored_or_zero(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """``scored``, or features with a score of 0 where there is no model; ``ranked`` turns scores that are all 0 into 0.5."""
    return features.withColumn("score", F.lit(0.0)) if model is None else scored(model, features)
