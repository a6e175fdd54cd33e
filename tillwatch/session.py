"""Session helpers: local sessions for tests, durable lineage cuts and their lifetime."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "tillwatch") -> SparkSession:
    """A small local session with the settings the jobs assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TILLWATCH_DRIVER_MEMORY", "12g"))
        # Call-site capture costs milliseconds per Column; wide features build thousands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable_folder(spark: SparkSession) -> str:
    """The shared folder that survives executor loss.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder; anywhere else a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tillwatch-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str = "settled") -> str:
    """A fresh path inside the durable folder; nothing is created yet."""
    return f"{durable_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the durable folder and read it back.

    Cuts lineage like a reliable checkpoint, but computes the plan once and
    leaves Catalyst real file statistics. Losing an executor afterwards costs a
    re-read, never a recomputation with different row placement.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this program wrote, through whatever file system holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Settled tables that one computation owns and deletes when its result is written.

    >>> with Scratch(spark) as scratch:
    ...     pairs = scratch.settle(costly)
    ...     result = settle(pairs.join(...))     # settled outside: it stays

    Never return a frame that still reads a table of a closed scope.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []

    def folder(self, kind: str = "scratch") -> str:
        self._paths.append(new_folder(self.spark, kind))
        return self._paths[-1]

    def settle(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self._paths:
            delete_folder(self.spark, path)
        self._paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_exc) -> None:
        self.close()


def broadcast_when_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Call it on settled or otherwise cheap frames: the check reads ``df`` up to
    ``max_rows + 1`` rows. Above the bound the plain frame is returned and the
    join shuffles.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
