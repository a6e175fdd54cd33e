"""Replace a model only when the retrained one ranks better."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.metrics import ranking_quality


def compare_scores(df: DataFrame, old: str, new: str, label: str = "label") -> DataFrame:
    """Old and new PR-AUC, relative improvement in percent and the decision.

    Both score columns must be out-of-fold, or the comparison flatters the newer
    model.
    """
    both = df.select(F.col(label).alias("label"), F.inline(F.array(
        F.struct(F.lit("old").alias("which"), F.col(old).alias("score")),
        F.struct(F.lit("new").alias("which"), F.col(new).alias("score")))))
    q = ranking_quality(both, keys=["which"])
    one = q.agg(F.max(F.when(F.col("which") == "old", F.col("auc_pr"))).alias("old_auc"),
                F.max(F.when(F.col("which") == "new", F.col("auc_pr"))).alias("new_auc"))
    gain = F.when(F.col("old_auc") > 0, (F.col("new_auc") - F.col("old_auc"))
                  / F.when(F.col("old_auc") > 0, F.col("old_auc")) * 100).otherwise(F.lit(0.0))
    return one.select("old_auc", "new_auc", gain.alias("improvement"), (gain > 0).alias("replace"))
