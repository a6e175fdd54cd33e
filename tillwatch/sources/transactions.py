"""Core-banking batch exports and account metadata as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.model import MONEY

# ---- fixed values: export columns -------------------------------------------
REQUIRED = ["ACCT_ID", "TXN_DATE", "TXN_TIME", "CHANNEL", "DR_CR", "AMOUNT"]
OPTIONAL = ["BALANCE"]
CREDIT_CODES = ["CR", "CREDIT"]
# -----------------------------------------------------------------------------


class ExportFormatError(ValueError):
    """A batch export lacks a required column."""


def export_schema(spark: SparkSession, directory: str) -> T.StructType:
    """All-text schema in the header's order, after checking the required columns."""
    cols = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(directory).columns
    missing = [c for c in REQUIRED if c not in cols]
    if missing:
        raise ExportFormatError(f"batch export is missing required columns {missing}; found {cols}")
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def parse_export(rows: DataFrame) -> DataFrame:
    """Export rows in the transaction schema; unreadable dates or amounts fail the job."""
    balance = F.col("BALANCE") if "BALANCE" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("ACCT_ID").alias("account_id"),
        F.to_timestamp(F.concat_ws(" ", "TXN_DATE", "TXN_TIME"), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.col("CHANNEL").alias("channel"),
        F.when(F.upper("DR_CR").isin(CREDIT_CODES), "CREDIT").otherwise("DEBIT").alias("direction"),
        F.col("AMOUNT").cast(MONEY).alias("amount"),
        F.when(F.length(balance) > 0, balance).cast(MONEY).alias("balance_after"),
        F.lit(True).alias("is_customer_induced"))


def read_exports(spark: SparkSession, directory: str, since: Column | None = None,
                 until: Column | None = None) -> DataFrame:
    """All ``*.csv`` exports of a directory, optionally from ``since`` to ``until`` (both closed).

    ``enforceSchema`` is off: a file whose header differs from the checked one
    fails the read instead of shifting its columns.
    """
    schema = export_schema(spark, directory)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False) \
        .option("pathGlobFilter", "*.csv").csv(directory)
    tx = parse_export(raw)
    if since is not None:
        tx = tx.where(F.col("ts") >= since)
    if until is not None:
        tx = tx.where(F.col("ts") <= until)
    return tx


def stream_exports(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """The same exports as a stream; the checkpoint takes the place of ``since``."""
    schema = export_schema(spark, directory)
    raw = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv") \
        .option("maxFilesPerTrigger", files_per_batch).csv(directory)
    return parse_export(raw)


def with_metadata(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach occupation, tenure, opening bucket, age and label; unknown accounts keep NULLs."""
    cols = [c for c in ["account_id", "occupation", "tenure", "open_bucket", "age", "label"]
            if c in accounts.columns]
    return df.join(accounts.select(*cols), "account_id", "left")
