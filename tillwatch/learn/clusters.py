"""Unsupervised views: triage clusters, mule sub-types and the 3-D projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.learn.data import assemble
from tillwatch.operators.prep import QuantileMap, as_array
from tillwatch.operators.profiles import cluster_top_features
from tillwatch.session import settle


@dataclass(frozen=True)
class RankSpace:
    """Frozen rank space with its k-means triage and its centred PCA."""

    cols: list[str]
    ranks: QuantileMap
    kmeans: KMeansModel
    center: StandardScalerModel
    pca: PCAModel

    @staticmethod
    def fit(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42) -> "RankSpace":
        """Labels are never looked at."""
        ranks = QuantileMap.fit(df, cols)
        ready = settle(df.select("account_id", array_to_vector(ranks.column(as_array(cols))).alias("_rank")))
        kmeans = KMeans(k=k, seed=seed, featuresCol="_rank", predictionCol="cluster").fit(ready)
        center = StandardScaler(withMean=True, withStd=False, inputCol="_rank", outputCol="_centered").fit(ready)
        pca = PCA(k=3, inputCol="_centered", outputCol="_xyz").fit(center.transform(ready))
        return RankSpace(list(cols), ranks, kmeans, center, pca)

    def add(self, df: DataFrame) -> DataFrame:
        """Add cluster and x, y, z; transform only, no shuffle."""
        v = df.withColumn("_rank", array_to_vector(self.ranks.column(as_array(self.cols))))
        v = self.pca.transform(self.center.transform(self.kmeans.transform(v)))
        v = v.withColumn("_p", vector_to_array("_xyz"))
        return v.select(*df.columns, "cluster", *[F.round(F.col("_p")[i], 4).alias(n) for i, n in enumerate("xyz")])

    def assign(self, df: DataFrame) -> DataFrame:
        return self.add(df).select("account_id", "cluster", "x", "y", "z")


def mule_types(df: DataFrame, cols: list[str], k: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Cluster confirmed mules only: assignments, and sizes with the top features per type."""
    mules = settle(df.where("label = 1").select("account_id", *cols))
    n = mules.count()
    k = k if n >= k else max(2, n // 2)
    ready = assemble(mules, cols, ("account_id",))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready)
    placed = settle(model.transform(ready).select("account_id", "cluster"))
    long = mules.join(placed, "account_id").unpivot(["account_id", "cluster"], cols, "feature", "value")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_mules"))
    top = cluster_top_features(long).join(sizes, "cluster").withColumn("share", F.col("n_mules") / F.lit(float(n)))
    return placed, top
