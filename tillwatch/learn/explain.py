"""Per-account contributions to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.text import account_explanation, direction


def strongest(entries: Column, n: int) -> Column:
    """The n entries with the largest absolute contribution (ties by feature)."""
    keyed = F.transform(entries, lambda e: F.struct(
        (-F.abs(e["value"])).alias("o"), e["feature"].alias("feature"), e["value"].alias("value")))
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("shap_value"),
        F.abs(e["value"]).alias("abs_value"), direction(e["value"]).alias("direction")))


def linear_contributions(df: DataFrame, weights: dict[str, float], means: dict[str, float],
                         n: int = 10, key: str = "account_id") -> DataFrame:
    """Exact additive contributions ``w (x - mean)`` of a linear score, strongest first."""
    parts = F.array(*[F.struct(
        F.lit(f).alias("feature"),
        (F.lit(float(w)) * (F.col(f"`{f}`") - F.lit(float(means[f])))).alias("value"))
        for f, w in weights.items()])
    return df.select(key, strongest(parts, n).alias("contributions"))


def behaviour_texts(features: DataFrame, cols: list[str], scores: DataFrame, clusters: DataFrame | None = None,
                    n: int = 5, key: str = "account_id") -> DataFrame:
    """Investigator text per scored account: strongest raw features, and its mule type when clustered.

    ``scores`` has the key and ``score`` on [0, 1]; ``clusters`` the key and ``cluster``.
    """
    pairs = ", ".join(f"named_struct('feature', '{c}', 'value', CAST(`{c}` AS DOUBLE))" for c in cols)
    df = features.join(scores.select(key, "score"), key)
    df = df.join(clusters.select(key, "cluster"), key, "left") if clusters is not None \
        else df.withColumn("cluster", F.lit(None).cast("int"))
    top = F.transform(strongest(F.expr(f"array({pairs})"), n), lambda e: F.struct(
        e["feature"].alias("feature"), e["shap_value"].alias("value")))
    return df.select(key, account_explanation(F.col(key), F.col("score"), top, F.col("cluster")).alias("explanation"))
