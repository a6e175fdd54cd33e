"""Stacking, ablation, second-stage refinement and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.learn import boost
from tillwatch.learn.data import assemble
from tillwatch.operators.joins import lookalike_pool
from tillwatch.operators.metrics import depth_curve, precision_at_k, ranking_quality, top_k
from tillwatch.operators.prep import stratified_folds, top_features
from tillwatch.session import settle

DEFAULT_EXCLUDE = ["ecod", "iforest"]


def pivot_scores(oof: DataFrame, models: list[str]) -> DataFrame:
    """(account_id, model, score) to one column per model; the value list is fixed."""
    return oof.groupBy("account_id").pivot("model", models).agg(F.first("score"))


def balanced(df: DataFrame) -> DataFrame:
    """Weights n / (2 n_class), as in a class-balanced logistic fit."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    p, q = max(int(r["p"] or 0), 1), max(int(r["n"]) - int(r["p"] or 0), 1)
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(r["n"] / (2.0 * p)))
                         .otherwise(F.lit(r["n"] / (2.0 * q))))


def fit_meta(train: DataFrame):
    """Logistic regression over the model scores (L2, unit strength, balanced classes)."""
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=200,
                              regParam=1.0 / max(n, 1), standardization=False).fit(balanced(train))


def meta_score(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select(
        *[c for c in df.columns if c != "features"], vector_to_array("probability")[1].alias("score"))


def stack(scores: DataFrame, models: list[str], k: int = 5, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """Honest out-of-fold scores of the meta-learner and the weights of its final refit.

    ``scores`` has account_id, label and one out-of-fold column per model.
    """
    if len(models) < 2:
        raise ValueError("stacking needs at least two base models")
    dealt = stratified_folds(scores.select("account_id", "label", *models), k, seed=seed)
    ready = settle(assemble(dealt, models, ("account_id", "label", "fold")))
    parts = [meta_score(fit_meta(ready.where(F.col("fold") != f)), ready.where(F.col("fold") == f))
             for f in range(k)]
    final = fit_meta(ready)
    return settle(reduce(DataFrame.unionByName, parts)), dict(zip(models, [float(x) for x in final.coefficients]))


def ablation(scores: DataFrame, models: list[str], depth: int = 100) -> DataFrame:
    """Refit the stack without each model: change in PR-AUC and recall, and a verdict.

    Recall at ``depth`` decides, PR-AUC breaks ties.
    """
    def quality(which):
        s, _ = stack(scores, which)
        return (ranking_quality(s).first()["auc_pr"], precision_at_k(s, depth).first()["recall_at_k"])

    base_auc, base_rec = quality(models)
    rows = []
    for m in models:
        auc, rec = quality([x for x in models if x != m])
        d_auc, d_rec = auc - base_auc, rec - base_rec
        hurts = d_rec > 0 or (d_rec == 0 and d_auc > 0)
        rows.append((m, auc, d_auc, rec, d_rec, "HURTS" if hurts else "helps"))
    return scores.sparkSession.createDataFrame(
        rows, "model string, auc_pr double, delta_auc double, recall double, delta_recall double, verdict string")


def cascade(ranked: DataFrame, features: DataFrame, cols: list[str], pool_size: int = 400, n_features: int = 80,
            depth: int = 100, rounds: int = 20, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Re-rank the main ranking's top rows with a model trained on look-alikes only.

    ``ranked`` has account_id, label, score. Returns the pool's out-of-fold
    scores and the caught counts at each depth of the re-ranked top.
    """
    pool = lookalike_pool(ranked.select("account_id", "label", "score"), pool_size).drop("score")
    data = settle(stratified_folds(pool.join(features.select("account_id", *cols), "account_id"), k, seed=seed))
    parts = []
    for f in range(k):
        train, held = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        top = top_features(train, cols, n_features)
        keep = ("account_id", "label")
        model = boost.fit_weighted_gbt(settle(assemble(train, top, keep)), rounds, 5, seed)
        parts.append(settle(boost.probability(model, assemble(held, top, keep)).select(*keep, "score")))
    oof = reduce(DataFrame.unionByName, parts)
    best = top_k(ranked, depth).select("account_id")
    again = settle(oof.join(best, "account_id", "left_semi"))
    hits = int(again.agg(F.coalesce(F.sum("label"), F.lit(0))).first()[0])
    depths = sorted({max(hits, 1), 70, 80, 90})
    return oof, depth_curve(again, depths)


def calibrate(df: DataFrame, score: str = "score") -> tuple[object, DataFrame]:
    """Isotonic fit, and one row with mean absolute calibration error and its status."""
    model = IsotonicRegression(featuresCol=score, labelCol="label", isotonic=True).fit(df)
    err = model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("calibration_error"))
    return model, err.withColumn(
        "status", F.when(F.col("calibration_error") < 0.05, "GOOD").otherwise("ACCEPTABLE"))
