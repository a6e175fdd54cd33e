"""Model quality floors, leak-freedom and exactness of the building blocks."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.learn import boost
from tillwatch.learn import folds as L
from tillwatch.learn.anomaly import FrozenEcod, IsolationForest, subsamples
from tillwatch.learn.data import Prepared
from tillwatch.learn.stack import calibrate, stack
from tillwatch.learn.treeshap import leaves_of, shap_values
from tillwatch.operators.clean import SchemaMismatch, align_schema, clean_matrix, to_long
from tillwatch.operators.metrics import ranking_quality
from tillwatch.operators import neighbours
from tillwatch.operators.neighbours import mean_knn_distance
from tillwatch.operators.prep import Engineered, QuantileMap, as_array, half_samples
from tillwatch.operators.profiles import ecod_raw
from tillwatch.session import settle


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = int(i % 10 == 0)
        rows.append((i, y, float(rng.normal(3 * y, 1)), float(rng.normal()), float(rng.normal(-2 * y, 1))))
    return settle(spark.createDataFrame(rows, "account_id int, label int, a double, b double, c double"))


COLS = ["a", "b", "c"]


def auc(df):
    return ranking_quality(df).first().auc_roc


def test_out_of_fold_learners_beat_chance(toy):
    for learner in (L.gbt_learner(COLS, 3, 5, 3), L.forest_learner(COLS, 3, 10, 4), L.prototype_learner(COLS, 3),
                    L.focal_learner(COLS, 3, 5, 3, stability_runs=0), L.nnpu_learner(COLS, 3, 5, 3, prior=0.1)):
        oof = L.out_of_fold(toy, learner, 3)
        assert oof.count() == 300 and oof.select("account_id").distinct().count() == 300
        assert auc(oof) > 0.8


def test_validation_labels_never_reach_the_fit(toy):
    """Flipping one fold's labels leaves that fold's scores unchanged."""
    from tillwatch.operators.prep import stratified_folds
    dealt = settle(stratified_folds(toy, 3))
    train, held = dealt.where("fold <> 0").drop("fold"), dealt.where("fold = 0").drop("fold")
    learner = L.forest_learner(COLS, 2, 5, 3)
    one = {r.account_id: r.score for r in learner(train)(held).collect()}
    two = {r.account_id: r.score for r in learner(train)(held.withColumn("label", 1 - F.col("label"))).collect()}
    assert one == two


def test_first_newton_leaf_is_minus_gradient_over_hessian(spark, toy):
    ready = settle(Prepared.fit(toy, COLS, 3).transform(toy))
    model = boost.fit_newton(ready, boost.nnpu_objective(0.3), rounds=1, rate=1.0, depth=1, min_rows=1)
    state = ready.withColumn("m", F.lit(0.0))
    g, h = boost.nnpu_objective(0.3)(state)
    leaf = model.margin(ready).select("account_id", F.col("m").alias("leaf"))
    rows = state.select("account_id", g.alias("g"), h.alias("h")).join(leaf, "account_id").groupBy("leaf").agg(
        (-F.sum("g") / F.sum("h")).alias("step")).collect()
    for r in rows:
        assert r.leaf == pytest.approx(r.step, rel=1e-6)


def test_focal_derivatives_point_the_right_way(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0)], "m double, label int")
    g, h = boost.focal_objective(0.75)(df)
    pos, neg = df.select(g.alias("g"), h.alias("h")).collect()
    assert pos.g < 0 < neg.g and min(pos.h, neg.h) >= 1e-6


def test_tree_attributions_equal_brute_force_shapley(spark, toy):
    ready = settle(Prepared.fit(toy, COLS, 3).transform(toy))
    tree = boost.fit_newton(ready, boost.focal_objective(0.9), 1, depth=3).trees[0]
    leaves = leaves_of(tree)
    x = np.array([r.features.toArray() for r in ready.limit(5).collect()])
    got = shap_values([leaves], [1.0], x)
    used = sorted({f for _, parts in leaves for f, *_r in parts})

    def value(row, known):
        out = 0.0
        for v, parts in leaves:
            p = v
            for f, rules, z in parts:
                p *= float(all((row[f] <= t) == left for t, left in rules)) if f in known else z
            out += p
        return out

    for i, row in enumerate(x):
        for f in used:
            rest, n, phi = [u for u in used if u != f], len(used), 0.0
            for size in range(len(rest) + 1):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                for s in combinations(rest, size):
                    phi += w * (value(row, {*s, f}) - value(row, set(s)))
            assert got[i, f] == pytest.approx(phi, abs=1e-9)


def test_isolation_forest_and_ecod_flag_the_outlier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))] + [(999, 9.0, -9.0)]
    df = settle(spark.createDataFrame(rows, "account_id int, a double, b double"))
    iso = IsolationForest.fit(df, ["a", "b"], trees=40, size=64).score(df)
    assert iso.orderBy(F.desc("iforest")).first().account_id == 999
    exact = {r.account_id: r.ecod for r in ecod_raw(to_long(df, ["a", "b"])).collect()}
    frozen = {r.account_id: r.e for r in df.select("account_id", FrozenEcod.fit(df, ["a", "b"]).column().alias("e")).collect()}
    assert max(exact, key=exact.get) == 999
    for k, v in exact.items():
        assert frozen[k] == pytest.approx(v)


def test_subsamples_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("account_id"))
    sizes = [r["count"] for r in subsamples(df, 7, 50).groupBy("tree").count().collect()]
    assert sizes == [50] * 7


def test_half_samples_are_halves(toy):
    got = {(r.b, r.label): r["count"] for r in half_samples(toy, 2).groupBy("b", "label").count().collect()}
    assert got == {(b, y): n for b in (1, 2) for y, n in ((0, 135), (1, 15))}


def test_least_distances_need_few_differences(monkeypatch):
    """Bit for bit the distances of all pairs, of which few are computed by differences."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 24)), rng.normal(size=(1100, 24))
    b[700:] = b[:400]  # copies tie
    want = np.sort(neighbours._distances(a, b), axis=1)
    real, pairs = neighbours._distances, []
    monkeypatch.setattr(neighbours, "_distances", lambda x, y: (pairs.append(len(x) * len(y)), real(x, y))[1])
    assert np.array_equal(np.sort(neighbours.nearest_distances(a, b, 7), axis=1), want[:, :7]) and not pairs
    assert np.array_equal(np.sort(neighbours.nearest_distances(a, b, 2000), axis=1), want)
    far = np.sort(neighbours.nearest_distances(a + 1e9, b + 1e9, 7), axis=1)
    assert np.array_equal(far, np.sort(real(a + 1e9, b + 1e9), axis=1)[:, :7])
    a[3, 2], b[5, 1] = np.inf, np.nan
    assert np.isfinite(neighbours.nearest_distances(a, b, 7)).all(1).sum() == 299


def test_small_blocks_of_neighbours_equal_large_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = settle(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))],
                                      "account_id long, vec array<double>"))
    got = []
    for at_once in (1, 32):
        monkeypatch.setattr(neighbours, "BLOCKS_AT_ONCE", at_once)
        rows = mean_knn_distance(df, df, 4, pivots=3, block_rows=6).collect()
        got.append({r.account_id: r.peer_distance for r in rows})
    assert got[0] == pytest.approx(got[1], rel=1e-12) and len(got[0]) == 90


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_nearest_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)), np.zeros((40, 4)) + rng.normal(scale=1e-3, size=(40, 4))])
    df = settle(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "account_id int, vec array<double>"))
    got = {r.account_id: r.peer_distance for r in
           mean_knn_distance(df, df.where("account_id % 3 <> 0"), 5, pivots=6, block_rows=block_rows).collect()}
    refs = x[[i for i in range(100) if i % 3]]
    for i, row in enumerate(x):
        assert got[i] == pytest.approx(np.sort(np.linalg.norm(refs - row, axis=1))[:5].mean())


def test_quantile_map_is_frozen(spark):
    train = spark.createDataFrame([(i, float(i)) for i in range(11)], "account_id int, a double")
    q = QuantileMap.fit(train, ["a"])
    new = spark.createDataFrame([(0, -5.0), (1, 2.5), (2, 99.0)], "account_id int, a double")
    got = [r.r[0] for r in new.orderBy("account_id").select(q.column(as_array(["a"])).alias("r")).collect()]
    assert got == pytest.approx([0.0, 0.25, 1.0])


def test_log_columns_are_decided_on_fit_rows(spark):
    fit = spark.createDataFrame([(1, 1.0, -1.0), (2, 2.0, 1.0)], "account_id int, a double, b double")
    eng = Engineered.fit(fit, ["a", "b"])
    assert eng.log_cols == ["a"]
    row = eng.transform(spark.createDataFrame([(3, -4.0, 5.0)], "account_id int, a double, b double")).first()
    assert row.a_log == 0.0 and row.a_x_b == -20.0 and row.top_10_mean == 0.5


def test_cleaning_drops_constants_and_correlated_columns(spark):
    rows = [(i, float(i), 2.0 * i, 1.0, None if i == 3 else float((i * 7) % 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "account_id int, a double, b double, k double, d double")
    out, cols = clean_matrix(df, ["a", "b", "k", "d"])
    assert cols == ["a", "d"] and out.where("d IS NULL").count() == 0


def test_alignment_refuses_a_foreign_schema(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "account_id int, a string, z double")
    out, report = align_schema(df, ["a", "b"], {"a": 7.0})
    assert out.first().asDict() == {"account_id": 1, "a": 7.0, "b": 0.0}
    assert report.first().extra == "z" and report.first().missing == "b"
    with pytest.raises(SchemaMismatch):
        align_schema(df, ["p", "q", "a"], {})


def test_stacking_and_calibration(spark, toy):
    s = settle(toy.select("account_id", "label", F.col("a").alias("m1"), F.col("b").alias("m2")))
    scores, weights = stack(s, ["m1", "m2"], 3)
    assert auc(scores) > 0.9 and weights["m1"] > abs(weights["m2"])
    _, err = calibrate(settle(scores))
    assert err.first().calibration_error < 0.2


def test_bundle_survives_a_round_trip(spark, sf, tmp_path):
    from tillwatch.learn.bundle import Bundle, score_and_persist
    from tillwatch.plans.model_queries import small_bundle
    bundle, new = small_bundle(spark, sf)
    records, report = bundle.score(new.drop("v63"), explain=3)
    assert report.first().missing == "v63"
    before = {r.account_id: (r.main, r.cluster, r.cascade) for r in records.collect()}
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    bundle.save(spark, str(tmp_path / "bundle"))
    again = Bundle.load(spark, str(tmp_path / "bundle"))
    after = {r.account_id: (r.main, r.cluster, r.cascade) for r in again.score(new.drop("v63"), explain=0)[0].collect()}
    assert before == after
    stored = score_and_persist(again, new.drop("v63"), str(tmp_path / "up"), "u1")
    assert stored.count() == len(before)


def test_vector_label_is_learnable(spark, sf):
    """The label the model queries use can be learnt; a scorer at chance level fails here."""
    from tillwatch.plans.model_queries import VECTOR_COLS, vector_matrix
    matrix = settle(vector_matrix(spark, sf))
    assert auc(L.out_of_fold(matrix, L.prototype_learner(VECTOR_COLS, 12), 2)) > 0.7


def test_nnpu_and_retraining_use_all_columns_and_five_folds(spark, sf, monkeypatch):
    from tillwatch.plans import model_queries as q
    selected, folds = [], []

    class Stop(Exception):
        pass

    def learner(cols, n_select, **_):
        selected.append(n_select)

    def out_of_fold(df, learner, k=5):
        folds.append(k)
        if len(folds) < 2:
            return df.selectExpr("account_id", "label", "0.5D AS score")
        raise Stop

    monkeypatch.setattr(q.L, "nnpu_learner", learner)
    monkeypatch.setattr(q.L, "forest_learner", learner)
    monkeypatch.setattr(q.L, "out_of_fold", out_of_fold)
    q.nnpu_boost(spark, sf)
    with pytest.raises(Stop):
        q.retrain_feedback(spark, sf)
    assert selected == [64, 64] and folds == [5, 5]
