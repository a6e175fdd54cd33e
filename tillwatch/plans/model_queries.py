"""Registered queries that fit models on the given vectors (checked by rows and by test floors)."""


from pyspark.sql import functions as F

from tillwatch.learn import folds as L
from tillwatch.learn import stack as K
from tillwatch.learn.anomaly import IsolationForest
from tillwatch.learn.boost import fit_newton, focal_objective
from tillwatch.learn.bundle import Bundle
from tillwatch.learn.clusters import RankSpace, mule_types
from tillwatch.learn.data import Prepared
from tillwatch.learn.external import compare_arms
from tillwatch.learn.retrain import compare_scores
from tillwatch.learn.treeshap import tree_contributions
from tillwatch.operators.joins import overlay_feedback
from tillwatch.operators.profiles import cluster_triage
from tillwatch.plans.registry import query
from tillwatch.plans.views import scored_labels, table
from tillwatch.session import settle

VECTOR_COLS = [f"v{i}" for i in range(64)]
#: Leaves about one vector in eight positive.
CUT = 0.28


def vector_matrix(spark, sf):
    """Embeddings as 64 plain columns; the positive class is one side of a fixed linear form.

    The classes given with the vectors hold no signal; this label is one that a
    model can learn, so that scores mean something.
    """
    e = [F.col("embedding")[i].cast("double") for i in range(64)]
    form = e[0] + e[1] + e[2] - e[3]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("account_id"), (form > CUT).cast("int").alias("label"),
        *[x.alias(c) for x, c in zip(e, VECTOR_COLS)])


def _settled(spark, sf):
    return settle(vector_matrix(spark, sf))


@query("gbt_oof")
def gbt_oof(spark, sf):
    return L.out_of_fold(_settled(spark, sf), L.gbt_learner(VECTOR_COLS, 64))


@query("forest_oof")
def forest_oof(spark, sf):
    return L.out_of_fold(_settled(spark, sf), L.forest_learner(VECTOR_COLS, 64, trees=20, depth=5))


@query("focal_boost")
def focal_boost(spark, sf):
    learner = lambda s: L.focal_learner(VECTOR_COLS, 64, stability_runs=3, seed=s)
    return L.seed_averaged(_settled(spark, sf), learner, (42, 43, 44))


@query("nnpu_boost")
def nnpu_boost(spark, sf):
    return L.out_of_fold(_settled(spark, sf), L.nnpu_learner(VECTOR_COLS, 64, prior=0.1))


@query("prototype_oof")
def prototype_oof(spark, sf):
    return L.out_of_fold(_settled(spark, sf), L.prototype_learner(VECTOR_COLS, 64))


@query("iforest")
def iforest(spark, sf):
    m = _settled(spark, sf)
    return IsolationForest.fit(m, VECTOR_COLS).score(m)


def _simple_scores(spark, sf, k=3):
    """Out-of-fold columns of three quick learners."""
    m = _settled(spark, sf)
    out = m.select("account_id", "label")
    for name, learner in [("forest", L.forest_learner(VECTOR_COLS, 12, trees=10, depth=4)),
                          ("proto", L.prototype_learner(VECTOR_COLS, 12))]:
        s = L.out_of_fold(m, learner, k).select("account_id", F.col("score").alias(name))
        out = out.join(s, "account_id")
    iso = IsolationForest.fit(m, VECTOR_COLS, trees=20, size=128).score(m)
    return m, settle(out.join(iso, "account_id"))


@query("stack_scores")
def stack_scores(spark, sf):
    _, s = _simple_scores(spark, sf, 2)
    return K.stack(s, ["forest", "proto"], 3)[0]


@query("stack_ablation")
def stack_ablation(spark, sf):
    _, s = _simple_scores(spark, sf, 2)
    return K.ablation(s, ["forest", "proto", "iforest"], 50)


@query("cascade")
def cascade(spark, sf):
    m = _settled(spark, sf)
    ranked = L.out_of_fold(m, L.forest_learner(VECTOR_COLS, 12, trees=10, depth=4), 2)
    return K.cascade(ranked, m, VECTOR_COLS, pool_size=100, n_features=12, rounds=4, k=2)[1]


@query("isotonic")
def isotonic(spark, sf):
    df = settle(scored_labels(spark, sf).select("account_id", "label", "score"))
    model, _ = K.calibrate(df)
    return model.transform(df).select("account_id", F.col("prediction").alias("calibrated"))


@query("kmeans_triage")
def kmeans_triage(spark, sf):
    m = _settled(spark, sf)
    placed = RankSpace.fit(m, VECTOR_COLS).assign(m)
    return cluster_triage(settle(placed.join(m.select("account_id", "label"), "account_id")))


@query("pca3")
def pca3(spark, sf):
    m = _settled(spark, sf)
    return RankSpace.fit(m, VECTOR_COLS).assign(m)


@query("mule_clusters")
def mule_clusters(spark, sf):
    return mule_types(_settled(spark, sf), VECTOR_COLS)[1]


@query("tree_contributions")
def contributions(spark, sf):
    m = _settled(spark, sf)
    prep = Prepared.fit(m, VECTOR_COLS, 8)
    ready = settle(prep.transform(m))
    model = fit_newton(ready, focal_objective(0.9), rounds=3, depth=3)
    return tree_contributions(model.trees, [model.rate] * len(model.trees), ready, prep.engineered.names, 5).select(
        "account_id", F.posexplode("contributions").alias("rank", "c")).select("account_id", "rank", "c.*")


@query("retrain_feedback")
def retrain_feedback(spark, sf):
    m = _settled(spark, sf)
    fb = table(spark, sf, "events").select(
        F.col("user_id").alias("account_id"), (F.col("event_type") == "purchase").cast("int").alias("true_label"),
        F.col("event_id").alias("created_at"))
    new = settle(overlay_feedback(m, fb).drop("changed"))
    learner = L.forest_learner(VECTOR_COLS, 64, trees=10, depth=4)
    a = L.out_of_fold(m, learner).select("account_id", F.col("score").alias("old"))
    b = L.out_of_fold(new, learner).select("account_id", "label", F.col("score").alias("new"))
    return compare_scores(settle(a.join(b, "account_id")), "old", "new")


def small_bundle(spark, sf):
    """The bundle with every learner's own rounds, columns, resamples and five folds, fitted on all vectors,
    which also play the new upload. Tests know it by this name."""
    m = _settled(spark, sf)
    learners = {
        "gbt": L.gbt_learner(VECTOR_COLS), "forest": L.forest_learner(VECTOR_COLS),
        "nnpu": L.nnpu_learner(VECTOR_COLS, prior=0.1), "focal": L.focal_learner(VECTOR_COLS),
        "proto": L.prototype_learner(VECTOR_COLS)}
    oof = m.select("account_id", "label")
    for name, scores in L.side_by_side(m, learners).items():
        oof = oof.join(scores.select("account_id", F.col("score").alias(name)), "account_id")
    return Bundle.fit(m, VECTOR_COLS, settle(oof), prior=0.1), m


@query("score_new_data")
def score_new_data(spark, sf):
    bundle, new = small_bundle(spark, sf)
    return bundle.score(new.drop("v63"), explain=3)[0]


@query("external_arms")
def external_arms(spark, sf):
    return compare_arms(_settled(spark, sf), VECTOR_COLS, n_select=8, rounds=3, runs=2, seeds=(42,), k=2, depth=50)


