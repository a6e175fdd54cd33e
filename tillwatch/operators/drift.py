"""Population stability of features and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.model import PSI_BINS, PSI_FLOOR, PSI_MODERATE, PSI_SIGNIFICANT
from tillwatch.operators.ordering import exact_quantiles
from tillwatch.session import broadcast_when_small, settle

EDGE_BROADCAST_ROWS = 20_000


def bin_of(value: Column, edges: Column) -> Column:
    """1-based bin among ascending ``edges``; half-open, the last one closed; NULL outside."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    last = F.size(edges)
    return F.when((below >= 1) & (below < last), below).when(
        value == F.element_at(edges, -1), last - 1)


def psi_by_feature(baseline: DataFrame, current: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """PSI per feature of two long (feature, value) frames.

    Edges are the exact baseline quantiles; values outside them fall in no bin
    yet count in the denominator. There is one edge array per feature, as many
    as the schema is wide. Counting combines map-side.
    """
    real = F.col("value").isNotNull() & ~F.isnan("value")
    both = baseline.select("feature", "value", F.lit(0).alias("side")).unionByName(
        current.select("feature", "value", F.lit(1).alias("side"))).where(real)
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(baseline.where(real), ["feature"], "value", probs).select(
        "feature", F.array_distinct("q").alias("edges"))
    edges = broadcast_when_small(settle(edges), EDGE_BROADCAST_ROWS)
    binned = both.join(edges, "feature", "left").groupBy(
        "feature", F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(-1)).alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("c"),
        F.max(F.size("edges")).alias("n_edges"))
    per = binned.groupBy("feature").agg(
        F.sum("b").alias("nb"), F.sum("c").alias("nc"), F.max("n_edges").alias("n_edges"),
        F.sort_array(F.collect_list(F.when(F.col("bin") > 0, F.struct("bin", "b", "c")))).alias("bins"))

    def term(x):
        pb = F.greatest(x["b"] / F.when(F.col("nb") > 0, F.col("nb")), F.lit(PSI_FLOOR))
        pc = F.greatest(x["c"] / F.when(F.col("nc") > 0, F.col("nc")), F.lit(PSI_FLOOR))
        return (pc - pb) * F.ln(pc / pb)

    total = F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + term(x))
    usable = (F.col("nb") > 0) & (F.col("nc") > 0) & (F.col("n_edges") >= 2)
    return per.select("feature", F.when(usable, total).otherwise(F.lit(0.0)).alias("psi"))


def psi_severity(psi: Column) -> Column:
    return F.when(psi < PSI_MODERATE, "STABLE").when(psi < PSI_SIGNIFICANT, "MODERATE_SHIFT") \
            .otherwise("SIGNIFICANT_SHIFT")


def drift_report(baseline: DataFrame, current: DataFrame, features: list[str] | None = None,
                 bins: int = PSI_BINS) -> DataFrame:
    """Features present on both sides, worst first, with the overall recommendation."""
    if features is not None:
        baseline = baseline.where(F.col("feature").isin(features))
        current = current.where(F.col("feature").isin(features))
    rows = settle(psi_by_feature(baseline, current, bins).withColumn("severity", psi_severity(F.col("psi"))))
    bad = rows.agg(F.count_if(F.col("severity") == "SIGNIFICANT_SHIFT")).scalar()
    return rows.withColumn("n_significant_shift", bad).withColumn(
        "overall_recommendation",
        F.when(F.col("n_significant_shift") > 0, "RETRAIN_REVIEW_RECOMMENDED").otherwise("NO_ACTION_NEEDED"),
    ).orderBy(F.desc("psi"), "feature")


def score_drift(baseline: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    """PSI of the model's own output distribution."""
    one = lambda d: d.select(F.lit("score").alias("feature"), F.col(score).cast("double").alias("value"))
    return psi_by_feature(one(baseline), one(current)).select(
        "psi", psi_severity(F.col("psi")).alias("severity"))
