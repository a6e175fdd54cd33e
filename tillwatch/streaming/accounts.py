"""Scoring of account rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.severity import band_stream


def score_rows(rows: DataFrame, features: list[str], scorer: Callable[[DataFrame], DataFrame],
               key: str = "account_id") -> DataFrame:
    """Absent features and NULLs become 0; ``scorer`` adds ``score`` on [0, 1]."""
    have = set(rows.columns)
    cols = [(F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c in have
             else F.lit(0.0)).alias(c) for c in features]
    scored = scorer(rows.select(key, *cols))
    s = F.col("score") * F.lit(100.0)
    return scored.select(key, s.alias("mule_score"), band_stream(s).alias("severity"))


def start_scoring(rows: DataFrame, features: list[str], scorer, target: str, checkpoint: str):
    """Stateless scoring needs no callback: transform the stream and append."""
    return score_rows(rows, features, scorer).writeStream.format("parquet").option("path", target) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
