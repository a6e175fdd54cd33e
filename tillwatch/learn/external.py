"""Does the method transfer? Two switches, four arms, one labelled table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.learn import boost
from tillwatch.learn.data import assemble
from tillwatch.learn.folds import out_of_fold
from tillwatch.operators.metrics import class_balance, fold_stats, precision_at_k, rank_average, ranking_quality
from tillwatch.operators.prep import RobustScale, stable_features, top_features
from tillwatch.session import settle

ARMS = [("baseline", False, False), ("focal", True, False), ("stability", False, True), ("full", True, True)]


def _learner(cols, n_select, focal, stable, rounds, runs, seed):
    def fit(train):
        top = stable_features(train, cols, n_select, runs, seed=seed) if stable \
            else top_features(train, cols, n_select)
        scale = RobustScale.fit(train, top)

        def ready(d):
            keep = tuple(c for c in ("account_id", "label") if c in d.columns)
            return assemble(scale.transform(d.select(*keep, *top), top), top, keep)

        data = settle(ready(train))
        if focal:
            alpha = float(class_balance(data).first()["alpha"])
            model = boost.fit_newton(data, boost.focal_objective(alpha), rounds, seed=seed)
            return lambda d: model.score(ready(d))
        gbt = boost.fit_weighted_gbt(data, rounds, 5, seed)
        return lambda d: boost.probability(gbt, ready(d))
    return fit


def compare_arms(df: DataFrame, cols: list[str], n_select: int = 25, rounds: int = 20, runs: int = 5,
                 seeds=(42, 202), k: int = 5, depth: int = 100, arms=ARMS) -> DataFrame:
    """Per arm: PR-AUC, precision and recall at ``depth``, fold deviation, and deltas to the first arm."""
    rows = []
    for name, focal, stable in arms:
        scored = [out_of_fold(df, _learner(cols, n_select, focal, stable, rounds, runs, s), k, s).withColumn(
            "seed", F.lit(s)) for s in seeds]
        allr = settle(reduce(DataFrame.unionByName, scored))
        mean = rank_average(allr).withColumnRenamed("rank_score", "score").join(
            df.select("account_id", "label"), "account_id")
        mean = settle(mean)
        auc = ranking_quality(mean).first()["auc_pr"]
        at = precision_at_k(mean, depth).first()
        spread = fold_stats(allr.withColumn("fold", F.col("fold") + F.col("seed") * 1000)).first()["std_auc_pr"]
        rows.append((name, auc, at["precision_at_k"], at["recall_at_k"], at["caught"], spread))
    base = rows[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[1] - base[1], r[5] - base[5]) for r in rows],
        "arm string, auc_pr double, precision_at_k double, recall_at_k double, caught long, "
        "fold_std double, delta_auc double, delta_std double")
