"""A small feed-forward network on vectors: training, accuracy by split."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_of(key: str, validation: int = 1, test: int = 1, parts: int = 10):
    """train, validation or test by the hash of a key: the same for the same key."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    return F.when(part < validation, "validation").when(part < validation + test, "test").otherwise("train")


def train(rows: DataFrame, hidden: list[int], labels: int, epochs: int = 30, seed: int = 1) -> MultilayerPerceptronClassificationModel:
    """A network with sigmoid hidden layers and a soft-max output, on (embedding array<float>, label int)."""
    width = len(rows.select("embedding").first()[0])
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[width, *hidden, labels], maxIter=epochs, seed=seed, blockSize=128).fit(data)


def accuracy(model: MultilayerPerceptronClassificationModel, rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, n, correct)."""
    data = rows.select(split, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return model.transform(data).groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("correct"))


def losses(model: MultilayerPerceptronClassificationModel, spark: SparkSession) -> DataFrame:
    """(iteration, loss): the mean loss over the training rows before the first and after each iteration of a fit."""
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.summary().objectiveHistory)], "iteration int, loss double")
