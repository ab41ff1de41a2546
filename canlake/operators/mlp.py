"""Multilayer perceptrons of Spark ML on frames and windows; ``descent`` trains them."""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from canlake.functions.hexfields import decoded
from canlake.operators import descent, normalise
from canlake.operators.scoring import macro_metrics
from canlake.operators.windows import flattened_vectors
from canlake.storage import settle

# Hidden layers of the frame detector; the window detector takes its own.
FRAME_HIDDEN = (16, 8, 8)
WINDOW_HIDDEN = (32, 16)


@dataclass(frozen=True)
class Detector:
    """A trained network with the statistics its inputs were scaled by."""

    model: MultilayerPerceptronClassificationModel
    stats: normalise.NormStats
    val_f1: list[float]

    def save(self, path: str) -> None:
        """The network and its statistics in one folder."""
        self.model.write().overwrite().save(f"{path}/network")
        facts = self.model.uid, [float(x) for x in self.stats.mean], [float(x) for x in self.stats.std], self.val_f1
        session = SparkSession.active()
        session.createDataFrame([facts], "uid string, mean array<double>, std array<double>, val_f1 array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @classmethod
    def load(cls, path: str) -> Detector:
        schema = "uid string, mean array<double>, std array<double>, val_f1 array<double>"
        facts = SparkSession.active().read.schema(schema).json(f"{path}/facts").first()
        stats = normalise.NormStats(tuple(normalise.NUMERIC_COLUMNS), tuple(facts["mean"]), tuple(facts["std"]))
        return cls(MultilayerPerceptronClassificationModel.load(f"{path}/network"), stats, list(facts["val_f1"]))


def frame_inputs(frames: DataFrame, stats: normalise.NormStats) -> DataFrame:
    return decoded(frames).withColumn("features", array_to_vector(normalise.scaled_frame_vector(stats))).withColumn(
        "label", F.col("Class").cast("double")
    )


def window_inputs(frames: DataFrame, size: int, stride: int, stats: normalise.NormStats) -> DataFrame:
    vectors = flattened_vectors(frames, size, stride, stats)
    return vectors.withColumn("features", array_to_vector("vector")).withColumn("label", F.col("label").cast("double"))


def network(spark: SparkSession, layers: list[int], seed: int = 42, weights=None) -> MultilayerPerceptronClassificationModel:
    """Spark ML's network with the given weights, or with its initial ones: fitted for no round."""
    learner = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=layers, maxIter=0, seed=seed)
    if weights is not None:
        learner.setInitialWeights(Vectors.dense(weights))
    return learner.fit(spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"]))


def train(blocks: DataFrame, layers: list[int], rounds: int, seed: int = 42, weights=None) -> MultilayerPerceptronClassificationModel:
    """A network after ``rounds`` more rounds over ``row_blocks``, from the given weights or from random ones."""
    spark = blocks.sparkSession
    start = network(spark, layers, seed).weights if weights is None else weights
    best = descent.minimise(lambda w: descent.loss_and_gradient(blocks, layers, w), start.toArray(), rounds)
    return network(spark, layers, seed, best)


def train_best(
    train_inputs: DataFrame, val_inputs: DataFrame, layers: list[int], rounds: tuple[int, ...]
) -> tuple[MultilayerPerceptronClassificationModel, list[float]]:
    """Train stage by stage, each from the weights of the one before, and keep the stage that is best on validation.

    Returns the model and the validation macro F1 after every stage.
    """
    best, model, scores = None, None, []
    blocks = descent.row_blocks(train_inputs)
    for count in rounds:
        model = train(blocks, layers, count, weights=None if model is None else model.weights)
        scores.append(macro_metrics(predictions(model, val_inputs)).first()["f1_macro"] or 0.0)
        if best is None or scores[-1] > best[0]:
            best = (scores[-1], model)
    blocks.unpersist()
    return best[1], scores


def predictions(model: MultilayerPerceptronClassificationModel, inputs: DataFrame) -> DataFrame:
    """``y_true`` and ``y_pred`` per row, scored where the data lies."""
    return model.transform(inputs).select(
        *[c for c in ("row_id", "start_row_id", "session_id", "split") if c in inputs.columns],
        F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
    )


def train_frame_detector(split_frames: DataFrame, num_classes: int, rounds: tuple[int, ...] = (20, 20, 20)) -> Detector:
    """Frame network on ``split_frames`` (with ``split``); statistics come from train only."""
    training = split_frames.where("split = 'train'")
    stats = normalise.fit(normalise.frame_stats(training))
    layers = [11 + len(normalise.NUMERIC_COLUMNS), *FRAME_HIDDEN, num_classes]
    inputs = settle(frame_inputs(split_frames, stats).select("split", "features", "label"), "frame-inputs")
    model, scores = train_best(inputs.where("split = 'train'"), inputs.where("split = 'val'"), layers, rounds)
    return Detector(model, stats, scores)


def train_window_detector(
    frames: DataFrame,
    index: DataFrame,
    sessions: DataFrame,
    size: int,
    stride: int,
    num_classes: int,
    rounds: tuple[int, ...] = (20, 20, 20),
) -> tuple[Detector, DataFrame]:
    """Window network over an index with ``split``; also returns the labelled inputs."""
    stats = normalise.fit(normalise.window_stats(frames, sessions, size, stride))
    vectors = flattened_vectors(frames, size, stride, stats).drop("label")
    inputs = (
        vectors.join(index.select("session_id", "start_row_id", "label", "split"), ["session_id", "start_row_id"])
        .withColumn("features", array_to_vector("vector"))
        .withColumn("label", F.col("label").cast("double"))
        .drop("vector")
    )
    inputs = settle(inputs, "window-inputs")
    layers = [size * (11 + len(normalise.NUMERIC_COLUMNS)), *WINDOW_HIDDEN, num_classes]
    model, scores = train_best(inputs.where("split = 'train'"), inputs.where("split = 'val'"), layers, rounds)
    return Detector(model, stats, scores), inputs


def measured_scoring(scored: DataFrame, path: str) -> DataFrame:
    """Writes the scored rows and tells how fast: frames, seconds, frames_per_second, ms_per_frame.

    Rows are counted by the job that writes them; the time is that of the job.
    """
    seen = Observation()
    began = perf_counter()
    scored.observe(seen, F.count(F.lit(1)).alias("frames")).write.parquet(path)
    seconds, frames = perf_counter() - began, seen.get["frames"]
    row = (frames, seconds, frames / seconds, 1000 * seconds / frames if frames else None)
    return scored.sparkSession.createDataFrame([row], "frames long, seconds double, frames_per_second double, ms_per_frame double")
