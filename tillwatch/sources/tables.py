"""Readers and writers of the stored artifacts; every artifact has its own path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.model import ACTION, DICTIONARY
from tillwatch.operators.ledger import latest_per_key
from tillwatch.session import Scratch, folder_exists


def account_schema(numeric: list[str], text: list[str], key: str = "account_id") -> T.StructType:
    """Explicit schema of the wide account table; nothing is inferred."""
    fields = [T.StructField(key, T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in numeric]
    fields += [T.StructField(c, T.StringType()) for c in text]
    return T.StructType(fields)


def read_accounts(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The raw account table from Parquet (preferred) or CSV with a header."""
    reader = spark.read.schema(schema)
    return reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Feature dictionary from CSV in the column order of the schema."""
    return spark.read.schema(DICTIONARY).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """(account_id, mule_score 0-100)."""
    write_table(scored.select("account_id", "mule_score"), path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Alerts or explanations as JSON lines, one object per row."""
    df.write.mode(mode).json(path)


def write_clusters(summary: DataFrame, assignment: DataFrame, root: str) -> None:
    write_table(summary, f"{root}/clusters")
    write_table(assignment, f"{root}/assignments")


def write_oof(scores: DataFrame, path: str) -> None:
    """(account_id, fold, score, model): replaces only the models present in ``scores``."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("model").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int, partitions: tuple[str, ...] = ()) -> None:
    """Idempotent append of one micro-batch: a replay rewrites exactly its own partitions."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(path)


def insert_once(new: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows to append: one per key, none whose key is already stored."""
    fresh = new.dropDuplicates(keys)
    if existing is None:
        return fresh
    return fresh.join(existing.select(*keys), keys, "left_anti")


def insert_predictions(new: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Predictions are unique per (account, model version)."""
    return insert_once(new, existing, ["account_id", "model_version"])


def alert_rows(scored: DataFrame) -> DataFrame:
    """(account_id, mule_score, severity) of every account that has an alert band."""
    return scored.select("account_id", "mule_score", "severity").where("severity <> 'NONE'")


def metric_rows(quality: DataFrame, model_version: str, drift_status: Column) -> DataFrame:
    """Run metrics in stored form."""
    return quality.select("auc_pr", "auc_roc", drift_status.alias("drift_status"), F.lit(model_version).alias("model_version"))


def upsert_buckets(rows: DataFrame, path: str, key: str, order: str, buckets: int) -> None:
    """Last write wins per ``key`` in a table of hash buckets; only buckets with new rows are rewritten.

    ``rows`` has one row per key and is read more than once. Merging the same rows
    again changes nothing, so a replayed batch does no harm. One writer at a time.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    with Scratch(spark) as scratch:
        if folder_exists(spark, path):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            held = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            new = scratch.settle(latest_per_key(new.unionByName(held), [key], order).select(*new.columns))
        new.repartition(buckets, "bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def online_features(spark: SparkSession, path: str) -> DataFrame:
    """Current features per account: last write wins over all appended batches."""
    return latest_per_key(spark.read.parquet(path), ["account_id"], "written_at")


def compact_online(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite the online table to one row per account under a new path."""
    online_features(spark, path).write.mode("error").parquet(target)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The action ledger; with an explicit schema it reads even before the first action."""
    return spark.read.schema(ACTION).parquet(path)
