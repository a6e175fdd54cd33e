"""Population profiles: clusters, flags, ensembles and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.functions.safe import ratio_or_zero, row_mean, total
from tillwatch.operators.ordering import join_per_value, join_totals, ranked_values

# ---- fixed values: words that mark a time-like column -----------------------
TIME_WORDS = ["time", "hour", "day", "date", "period"]
# -----------------------------------------------------------------------------


def temporal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in TIME_WORDS)]


def flag_profile(long: DataFrame) -> DataFrame:
    """Mean of feature means and mean of feature deviations, flagged accounts against the rest."""
    per = long.groupBy("flagged", "feature").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return per.groupBy("flagged").agg(F.avg("m").alias("mean_of_means"), F.avg("s").alias("mean_of_stds"))


def cluster_top_features(long: DataFrame, n: int = 5) -> DataFrame:
    """The n features with the largest absolute mean per cluster (clusters x columns rows are ranked)."""
    per = long.groupBy("cluster", "feature").agg(F.avg("value").alias("mean_value"))
    w = W.partitionBy("cluster").orderBy(F.desc(F.abs("mean_value")), "feature")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_triage(df: DataFrame) -> DataFrame:
    """Per cluster: accounts, mules, rate, lift; whether it is densest and what share of mules it holds."""
    per = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("accounts"), F.sum("label").alias("mules"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("m"))
    rate = F.col("mules") / F.col("accounts")
    base = whole.select(F.col("m") / F.col("n")).scalar()
    mules = whole.select(F.col("m").cast("double")).scalar()
    out = per.select("cluster", "accounts", "mules", rate.alias("rate"),
                     ratio_or_zero(rate, base).alias("lift_vs_population"),
                     ratio_or_zero(F.col("mules"), mules).alias("coverage"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("rate"), "cluster")  # one row per cluster
    return out.withColumn("densest", F.row_number().over(w) == 1)


def agreement(df: DataFrame, scores: list[str], cut: float = 0.5) -> DataFrame:
    """Equal-weight mean of the model scores and how many exceed ``cut``."""
    cols = [F.col(c) for c in scores]
    return df.withColumn("ensemble", row_mean(cols)).withColumn(
        "agreement", total([(c > cut).cast("int") for c in cols]))


def score_range(df: DataFrame, score: str) -> tuple[float, float]:
    """Range to freeze with a model."""
    r = df.agg(F.min(score), F.max(score)).first()
    return float(r[0]), float(r[1])


def frozen_minmax(df: DataFrame, score: str, lo: float, hi: float) -> DataFrame:
    """Scale by a frozen range and clip to [0, 1]."""
    x = (F.col(score) - F.lit(lo)) / F.lit(hi - lo + 1e-10)
    return df.withColumn(score, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def batch_minmax(df: DataFrame, score: str) -> DataFrame:
    """Scale by the batch's own range."""
    lo, hi = df.agg(F.min(score)).scalar(), df.agg(F.max(score)).scalar()
    return df.withColumn(score, (F.col(score) - lo) / (hi - lo + F.lit(1e-10)))


def ecod_raw(long: DataFrame, key: str = "account_id") -> DataFrame:
    """Empirical-CDF outlier score: the largest of left, right and skew-selected tail sums.

    Tail probabilities are computed once per distinct value of each feature and
    joined back; a value shared by a third of all accounts is served by broadcast.
    """
    ranks = ranked_values(long, ["feature"], "value")
    shape = long.groupBy("feature").agg(
        F.count("value").alias("total"), F.skewness("value").alias("skew"))
    t = join_totals(ranks, shape, ["feature"])
    left = -F.ln(F.col("cum_n") / F.col("total"))
    right = -F.ln((F.col("total") - F.col("cum_n") + F.col("n")) / F.col("total"))
    tails = t.select("feature", "value", "n", left.alias("l"), right.alias("r"),
                     F.when(F.col("skew") < 0, left).otherwise(right).alias("a"))
    joined = join_per_value(long.where(F.col("value").isNotNull()), tails, ["feature", "value"])
    return joined.groupBy(key).agg(
        F.greatest(F.sum("l"), F.sum("r"), F.sum("a")).alias("ecod"))


def ecod(long: DataFrame, key: str = "account_id") -> DataFrame:
    return batch_minmax(ecod_raw(long, key), "ecod")
