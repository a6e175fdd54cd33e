"""Ranking quality measures, exact under ties and under very large tables.

Every curve starts from one row per distinct score (ties collapse map-side),
then runs cumulatively over pieces of the score axis. No window without a
partition ever sees table-sized input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.functions.safe import ratio_or_zero
from tillwatch.operators.ordering import average_ranks, exact_quantiles, ranked_values


def ranking_curve(df: DataFrame, score: str = "score", label: str = "label",
                  keys: list[str] | None = None) -> DataFrame:
    """Distinct scores from the top: ``n``, ``pos``, ``cum_n``, ``cum_pos``."""
    return ranked_values(df, keys or [], score, {"pos": F.col(label)}, descending=True)


def ranking_quality(df: DataFrame, score: str = "score", label: str = "label",
                    keys: list[str] | None = None) -> DataFrame:
    """PR-AUC (trapezoid, anchored at recall 0 / precision 1) and ROC-AUC, per key.

    Both reduce to sums over the curve, so one aggregate yields them; totals are
    not needed beforehand. NULL where a class is absent.
    """
    c = ranking_curve(df, score, label, keys)
    pos, n = F.col("pos"), F.col("n")
    here = F.col("cum_pos") / F.col("cum_n")
    prev_n = F.col("cum_n") - n
    before = F.when(prev_n == 0, F.lit(1.0)).otherwise(
        (F.col("cum_pos") - pos) / F.when(prev_n != 0, prev_n))
    neg = n - pos
    above = (F.col("cum_n") - F.col("cum_pos")) - neg / F.lit(2.0)
    out = c.groupBy(*(keys or [])).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"),
        F.sum(pos * (here + before) / F.lit(2.0)).alias("_pr"),
        F.sum(pos * above).alias("_lost"))
    p, q = F.col("n_pos").cast("double"), (F.col("n_rows") - F.col("n_pos")).cast("double")
    return out.select(
        *(keys or []), "n_rows", "n_pos",
        F.when(p > 0, F.col("_pr") / F.when(p > 0, p)).alias("auc_pr"),
        F.when((p > 0) & (q > 0), F.lit(1.0) - F.col("_lost") / F.when(p * q > 0, p * q)).alias("auc_roc"))


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "account_id") -> DataFrame:
    """The k best rows, ties by key; a per-task heap, not a full sort."""
    return df.orderBy(F.desc(score), key).limit(k)


def precision_at_k(df: DataFrame, k: int = 100, score: str = "score", label: str = "label") -> DataFrame:
    """Hits among the top k, precision over k, recall over all positives."""
    hits = top_k(df, k, score).agg(F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("caught"))
    total = df.agg(F.sum(label).cast("double")).scalar()
    return hits.select(
        "caught", (F.col("caught") / F.lit(float(k))).alias("precision_at_k"),
        ratio_or_zero(F.col("caught"), total).alias("recall_at_k"))


def threshold_metrics(df: DataFrame, share: float = 0.9, score: str = "score",
                      label: str = "label") -> DataFrame:
    """Confusion counts, precision, recall and F1 at the exact ``share`` percentile."""
    cut = exact_quantiles(df, [], score, [share]).select(F.col("q")[0]).scalar()
    hit, pos = F.col("_score") >= F.col("_cut"), F.col("_label") == 1
    counts = df.select(F.col(score).alias("_score"), F.col(label).alias("_label"), cut.alias("_cut")).agg(
        F.max("_cut").alias("threshold"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*", ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"))


def depth_curve(df: DataFrame, depths: list[int], score: str = "score", label: str = "label") -> DataFrame:
    """Positives caught, precision and recall when keeping the best d rows, for each depth."""
    best = top_k(df, max(depths), score)
    w = W.partitionBy(F.lit(0)).orderBy(F.desc(score), "account_id")  # at most max(depths) rows
    ranked = best.select(F.row_number().over(w).alias("r"), F.col(label).alias("y"))
    total = df.agg(F.sum(label).cast("double")).scalar()
    agg = ranked.agg(*[F.struct(
        F.lit(d).alias("depth"),
        F.coalesce(F.sum(F.when(F.col("r") <= d, F.col("y"))), F.lit(0)).cast("long").alias("caught"),
    ).alias(f"d{d}") for d in depths])
    out = agg.select(F.inline(F.array(*[F.col(f"d{d}") for d in depths])))
    return out.select("depth", "caught", (F.col("caught") / F.col("depth")).alias("precision"),
                      ratio_or_zero(F.col("caught"), total).alias("recall"))


def score_summary(df: DataFrame, score: str = "mule_score") -> DataFrame:
    """Detection rate (>= 50), flagged (>= 90), mean and range of 0-100 scores."""
    s = F.col(score)
    return df.agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.avg(F.when(s >= 50, 1.0).otherwise(0.0)).alias("detection_rate"),
        F.count_if(s >= 90).alias("n_flagged"),
        F.avg(s).alias("mean_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"))


def monitor_status(df: DataFrame, stable_above: float = 0.95) -> DataFrame:
    """Quality of 0-100 scores with the stability verdict on PR-AUC."""
    q = ranking_quality(df.withColumn("_s", F.col("mule_score") / F.lit(100.0)), "_s")
    rate = df.agg(F.avg(F.when(F.col("mule_score") >= 50, 1.0).otherwise(0.0))).scalar()
    return q.select(
        "auc_pr", "auc_roc", rate.alias("mule_detection_rate"),
        F.when(F.col("auc_pr") > stable_above, "STABLE").otherwise("DRIFT_DETECTED").alias("model_status"))


def fold_stats(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population deviation over folds of the per-fold PR-AUC."""
    per = ranking_quality(df, keys=[fold])
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc_pr").alias("mean_auc_pr"),
                   F.stddev_pop("auc_pr").alias("std_auc_pr"))


def rank_average(df: DataFrame, run: str = "seed", key: str = "account_id") -> DataFrame:
    """Mean over runs of average rank / n: only the ordering of each run counts."""
    ranked = average_ranks(df, [run], "score")
    return ranked.groupBy(key).agg(F.avg(F.col("avg_rank") / F.col("group_n")).alias("rank_score"))


def normal_interval(df: DataFrame, score: str = "score") -> DataFrame:
    """``p ± 1.96 sqrt(p (1 - p) / n)`` clipped to [0, 1]; n counts all rows."""
    n = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    p = F.col(score)
    margin = F.lit(1.96) * F.sqrt(p * (1 - p) / n)
    return df.withColumn("_m", margin).select(
        *df.columns, F.greatest(p - F.col("_m"), F.lit(0.0)).alias("lower"),
        F.least(p + F.col("_m"), F.lit(1.0)).alias("upper"))


def class_balance(df: DataFrame, label: str = "label", beta: float = 0.999) -> DataFrame:
    """n_pos, n_neg, positive weight n_neg / n_pos, and the effective-number alpha in [0.5, 0.99]."""
    one = df.agg(F.greatest(F.count_if(F.col(label) == 1), F.lit(1)).alias("n_pos"),
                 F.greatest(F.count_if(F.col(label) == 0), F.lit(1)).alias("n_neg"))

    def weight(n):
        return F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), F.col(n).cast("double")))

    share = weight("n_pos") / (weight("n_pos") + weight("n_neg"))
    return one.select("n_pos", "n_neg", (F.col("n_neg") / F.col("n_pos")).alias("pos_weight"),
                      F.least(F.greatest(share, F.lit(0.5)), F.lit(0.99)).alias("alpha"))
