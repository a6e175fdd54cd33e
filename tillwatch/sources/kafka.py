"""Kafka endpoints. They need the Spark Kafka connector on the cluster's classpath."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.model import MESSAGE, MONEY

TOPIC = "transactions"


def position(raw: DataFrame) -> Column:
    """Where a message stands in its source: topic, partition and offset, or file and line.

    It names messages that bring no id, so two equal transfers stay two events
    and a message read again keeps its name. A frame without positions falls back
    to a hash of the payload, which cannot tell equal messages apart.
    """
    for cols in (("topic", "partition", "offset"), ("file", "line")):
        if set(cols) <= set(raw.columns):
            return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    return F.sha2(F.col("value").cast("string"), 256)


def parse_messages(raw: DataFrame, value: Column | None = None, keep_bad: bool = False) -> DataFrame:
    """JSON payloads as typed events.

    A payload that is not JSON or has no account or no readable time is bad. With
    ``keep_bad`` such rows stay, with the text in ``payload`` (null for good
    rows), so that a job can put them aside; otherwise they are left out.
    """
    v = (F.col("value") if value is None else value).cast("string")
    m = raw.select(F.from_json(v, MESSAGE).alias("m"), v.alias("_payload"), position(raw).alias("_position"))
    m = m.select("m.*", "_payload", "_position").withColumn("ts", F.col("timestamp").try_cast("timestamp"))
    bad = F.col("account_id").isNull() | F.col("ts").isNull()
    out = m.select(
        F.coalesce("event_id", "_position").alias("event_id"), "account_id", "ts", "channel", "direction",
        F.col("amount").cast(MONEY).alias("amount"), F.col("balance_after").cast(MONEY).alias("balance_after"),
        F.coalesce("is_customer_induced", F.lit(True)).alias("is_customer_induced"),
        F.when(bad, F.col("_payload")).alias("payload"), bad.alias("_bad"))
    return out.drop("_bad") if keep_bad else out.where(~F.col("_bad")).drop("_bad", "payload")


def read_kafka(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """Events of a topic from the earliest offset; progress lives in the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers) \
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_messages(raw, keep_bad=True)


def read_json_files(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """The same payloads from files, one JSON object per line.

    A file is read as one value so that lines keep their numbers; producers roll
    their files at sizes a task can hold.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(directory, wholetext=True)
    lines = raw.select(F.col("_metadata.file_path").alias("file"),
                       F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return parse_messages(lines.where(F.trim("value") != ""), keep_bad=True)


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish rows as JSON keyed by account, confirmed by all replicas."""
    out = df.select(F.col("account_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers) \
        .option("topic", topic).option("kafka.acks", "all").option("checkpointLocation", checkpoint).start()
