"""Label-free cleaning of the account matrix and alignment to a frozen schema."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.model import LEAK_COLUMNS
from tillwatch.operators.ordering import exact_quantiles
from tillwatch.operators.wide import column_quantiles


def drop_leaks(df: DataFrame) -> DataFrame:
    """Remove target, row index, batch month and resolution flags when present."""
    return df.drop(*LEAK_COLUMNS)


def unique_columns(names: list[str]) -> list[str]:
    """First occurrence of every column name, in order."""
    return list(dict.fromkeys(names))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("account_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def extract(df: DataFrame, key: str = "account_id") -> DataFrame:
    """The raw table without leaks, text and repeated names: the key and its numeric columns."""
    safe = drop_leaks(df)
    return safe.select(key, *unique_columns(numeric_columns(safe, (key,))))


def to_long(df: DataFrame, cols: list[str], key: str = "account_id") -> DataFrame:
    """(key, feature, value double); the wide working form of thousands of columns."""
    return stack_columns(df, [key], cols)


def stack_columns(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Columns to rows as one SQL text, which stays fast to build for any width."""
    pairs = ", ".join(f"{quoted(c)}, CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*[f"`{i}`" for i in ids], f"stack({len(cols)}, {pairs}) AS (feature, value)")


def quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def profile(long: DataFrame) -> DataFrame:
    """Per feature: rows, NULLs, sample deviation, minimum. One map-side-combined pass."""
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min_value"))


def medians(long: DataFrame) -> DataFrame:
    return exact_quantiles(long, ["feature"], "value", [0.5]).select(
        "feature", F.col("q")[0].alias("median"))


def varying_features(long: DataFrame) -> list[str]:
    """Features with a positive sample deviation; all-NULL ones have none and drop out.

    The list is as long as the schema is wide, so it may live on the driver.
    """
    return [r["feature"] for r in profile(long).where(F.col("std") > 0).select("feature").collect()]


def median_table(long: DataFrame) -> dict[str, float]:
    """Exact medians per feature on the driver (one number per column)."""
    return {r["feature"]: r["median"] for r in medians(long).collect()}


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """``median_table`` of the columns of a matrix, without its long form."""
    return {c: q[0] for (_, c), (q, _) in column_quantiles(df, cols, [0.5]).items()}


def impute(df: DataFrame, cols: list[str], table: dict[str, float]) -> DataFrame:
    """Replace NULL by the given medians; 0.0 where a feature has none."""
    filled = set(cols)
    return df.selectExpr(*[
        f"coalesce(CAST(`{c}` AS DOUBLE), {float(table.get(c, 0.0))!r}D) AS `{c}`" if c in filled else f"`{c}`"
        for c in df.columns])


def correlated_columns(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Columns whose absolute correlation with any EARLIER column exceeds ``limit``.

    A pruned column still prunes later ones. The correlation is one tree
    aggregate; only the columns x columns matrix reaches the driver.
    """
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(
        df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in cols])).select("_v")
    corr = Correlation.corr(vec, "_v").first()[0].toArray()
    return [cols[j] for j in range(len(cols))
            if any(abs(corr[i][j]) > limit for i in range(j))]


def clean_matrix(df: DataFrame, cols: list[str], key: str = "account_id") -> tuple[DataFrame, list[str]]:
    """Drop constants, impute medians, prune correlated columns; never looks at labels."""
    keep = set(varying_features(to_long(df, cols, key)))
    kept = [c for c in cols if c in keep]
    filled = impute(df, kept, column_medians(df, kept))
    gone = set(correlated_columns(filled, kept))
    final = [c for c in kept if c not in gone]
    return filled.select(key, *final), final


class SchemaMismatch(ValueError):
    """Too few of the expected columns are present to score honestly."""


def align_schema(new: DataFrame, expected: list[str], ref_medians: dict[str, float],
                 key: str = "account_id", strict: bool = True,
                 carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """New rows on the frozen schema, and a one-row report of what differed.

    Missing columns and NULLs take the REFERENCE median (0.0 without one); extra
    columns are dropped, but for those named in ``carry``; unparsable text counts
    as NULL.
    """
    have = set(new.columns)
    missing = [c for c in expected if c not in have]
    extra = [c for c in new.columns if c not in set(expected) and c != key and c not in carry]
    share = len(missing) / max(len(expected), 1)
    if strict and share > 0.5:
        raise SchemaMismatch(f"{len(missing)} of {len(expected)} expected columns are missing")
    cols = []
    for c in expected:
        ref = f"{float(ref_medians.get(c) or 0.0)!r}D"
        cols.append(f"{ref} AS `{c}`" if c not in have else f"coalesce(try_cast(`{c}` AS DOUBLE), {ref}) AS `{c}`")
    report = new.sparkSession.createDataFrame(
        [(len(expected), len(expected) - len(missing), ",".join(missing), ",".join(extra), share)],
        "expected int, matched int, missing string, extra string, missing_fraction double")
    return new.selectExpr(*[f"`{c}`" for c in (key, *carry)], *cols), report
