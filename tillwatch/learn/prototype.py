"""Nearest-prototype scoring: k-means centres of each class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.neighbours import prototype_score


def centers(df: DataFrame, k: int, seed: int) -> list[list[float]]:
    """Up to k centres; never more than there are rows."""
    n = df.limit(k).count()
    if n <= 1:
        return [[float(x) for x in r["features"]] for r in df.select("features").limit(1).collect()]
    model = KMeans(k=min(k, n), seed=seed, featuresCol="features", initMode="k-means||").fit(df)
    return [[float(x) for x in c] for c in model.clusterCenters()]


@dataclass(frozen=True)
class Prototypes:
    positive: list[list[float]]
    negative: list[list[float]]

    @staticmethod
    def fit(train: DataFrame, mules: int = 3, legits: int = 8, seed: int = 42) -> "Prototypes":
        return Prototypes(centers(train.where("label = 1"), mules, seed),
                          centers(train.where("label = 0"), legits, seed))

    def score(self, df: DataFrame) -> DataFrame:
        v = df.withColumn("_v", vector_to_array("features"))
        return prototype_score(v, self.positive, self.negative, "_v").withColumnRenamed(
            "proto", "score").drop("_v")
