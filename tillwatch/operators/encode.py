"""Categorical encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"


def as_level(c: Column) -> Column:
    """Trimmed lower-case text; a missing value is the level ``nan``."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("nan"))))


def ordinal(c: Column, table: dict[str, int]) -> Column:
    """Ordered code of a trimmed level, -1 when unknown."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.trim(c.cast("string"))), F.lit(-1)).cast("double")


def safe_level(c: Column) -> Column:
    """Level name usable in a column name: non-alphanumerics become ``_``, 20 characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, 20)


def frequent_levels(df: DataFrame, column: str, keep: int = 10) -> list[str]:
    """The ``keep`` most frequent levels (ties by name), via a top-k, never a full collect."""
    rows = df.groupBy(as_level(F.col(column)).alias("level")).count().orderBy(
        F.desc("count"), "level").limit(keep).collect()
    return [r["level"] for r in rows]


def capped(column: str, levels: list[str]) -> Column:
    lv = as_level(F.col(column))
    return F.when(lv.isin(levels), lv).otherwise(F.lit(OTHER))


def one_hot(df: DataFrame, column: str, key: str = "account_id", keep: int = 10) -> DataFrame:
    """``<column>_<level>`` indicators for the frequent levels and one for the rest."""
    levels = frequent_levels(df, column, keep)
    value = capped(column, levels)
    tail = df.where(~as_level(F.col(column)).isin(levels)).limit(1).count()
    shown = sorted(set(levels) | ({OTHER} if tail else set()))
    names = df.sparkSession.createDataFrame([(x,) for x in shown], "level string").select(
        "level", safe_level(F.col("level")).alias("safe")).collect()
    cols = {f"{column}_{r['safe']}": (value == r["level"]).cast("double") for r in names}
    return df.select(key, *[c.alias(n) for n, c in cols.items()])
