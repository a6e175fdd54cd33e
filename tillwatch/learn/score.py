"""Scored uploads: persistence, lookup and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions.severity import band_score
from tillwatch.operators.metrics import ranking_quality

TIERS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]


def persist_upload(scored: DataFrame, root: str, upload_id: str) -> None:
    """Write one upload under its own partition; an existing id is an error, never overwritten."""
    scored.write.mode("error").parquet(f"{root.rstrip('/')}/scored/upload_id={upload_id}")


def record_upload(scored: DataFrame, root: str, upload_id: str, uploaded_at: Column) -> None:
    """``persist_upload`` and one summary row in the index; an id already stored is an error.

    The rows are written first, so the index never names an upload that is not there.
    """
    persist_upload(scored, root, upload_id)
    stored = load_upload(scored.sparkSession, root, upload_id)
    row = summarize_uploads(stored).drop("upload_id").withColumn("uploaded_at", uploaded_at)
    row.write.mode("error").parquet(f"{root.rstrip('/')}/index/upload_id={upload_id}")


def list_uploads(spark: SparkSession, root: str) -> DataFrame:
    """The index: one row per upload."""
    base = f"{root.rstrip('/')}/index"
    return spark.read.option("basePath", base).parquet(base)


def load_upload(spark: SparkSession, root: str, upload_id: str) -> DataFrame:
    """Rows of one upload; partition pruning reads no other upload's files."""
    return spark.read.option("basePath", f"{root.rstrip('/')}/scored").parquet(
        f"{root.rstrip('/')}/scored").where(F.col("upload_id") == upload_id)


def summarize_uploads(scored: DataFrame, score: str = "mule_score", label: str = "label") -> DataFrame:
    """Per upload: size, tier counts and, where labels exist, ranking quality (NULL otherwise)."""
    tiers = scored.withColumn("severity", band_score(F.col(score))).groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("n_accounts"),
        *[F.count_if(F.col("severity") == t).alias(f"n_{t.lower()}") for t in TIERS])
    if label not in scored.columns:
        none = F.lit(None).cast("double")
        return tiers.withColumns({"has_labels": F.lit(False), "auc_pr": none, "auc_roc": none})
    q = ranking_quality(scored, score, label, ["upload_id"])
    return tiers.join(q.select("upload_id", "auc_pr", "auc_roc"), "upload_id", "left").withColumn(
        "has_labels", F.lit(True))
