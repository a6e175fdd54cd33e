"""Ledgers, notices, registry, drift, severity and selection."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tillwatch.functions import severity as S
from tillwatch.operators import alerts as A
from tillwatch.operators import drift as D
from tillwatch.operators import joins as J
from tillwatch.operators import ledger as L
from tillwatch.operators import metrics as Q

ACTION = "action_id long, account_id long, action_type string, status string, created_at timestamp_ntz, expires_at timestamp_ntz"
OVERRIDE = "override_id long, action_id long, investigator_id string, reason string, override_type string"


def ts(spark, text):
    return F.lit(text).cast("timestamp_ntz")


def test_switch_follows_its_newest_event(spark):
    log = spark.createDataFrame([(1, "ACTIVATE"), (2, "DEACTIVATE"), (3, "ACTIVATE")], "id int, event string")
    s = spark.createDataFrame([("a", 0.97), ("b", 0.1)], "account_id string, score double")
    got = lambda lg: {r.account_id: r.action for r in L.gate(s, lg).collect()}
    assert got(log) == {"a": L.SUPPRESSED, "b": None}
    assert got(log.where("id < 3")) == {"a": L.AUTO_HOLD, "b": None}
    assert got(log.where("id > 9")) == {"a": L.AUTO_HOLD, "b": None}
    assert [r.id for r in L.history(log.withColumn("k", F.lit(1)), "k", 1, "id").collect()] == [3, 2, 1]


def test_expiry_skips_overridden_and_fresh_actions(spark):
    from datetime import datetime, timedelta
    now = datetime(2024, 1, 10)
    acts = spark.createDataFrame([(i, i, "AUTO-HOLD", "ACTIVE", now, now + timedelta(hours=h))
                                  for i, h in [(1, -1), (2, 48), (3, 6), (4, -5)]], ACTION)
    ovs = spark.createDataFrame([(1, 4, "inv", "ok", "HUMAN")], OVERRIDE)
    due = L.expired_overrides(acts, ovs, F.lit(now).cast("timestamp_ntz"))
    assert [(r.action_id, r.override_type) for r in due.collect()] == [(1, "AUTO_EXPIRED")]
    status = {r.action_id: r.status for r in L.action_status(acts, ovs).collect()}
    assert status == {1: "ACTIVE", 2: "ACTIVE", 3: "ACTIVE", 4: "OVERRIDDEN"}
    assert [r.action_id for r in L.active_actions(acts, ovs).collect()] == [3, 2, 1]


def test_override_requests_are_judged(spark):
    acts = spark.createDataFrame([(1, 1, "AUTO-HOLD", "ACTIVE", None, None), (2, 2, "AUTO-HOLD", "ACTIVE", None, None)], ACTION)
    ovs = spark.createDataFrame([(1, 2, "inv", "ok", "HUMAN")], OVERRIDE)
    req = spark.createDataFrame([(1, 1, 5, "i", "r"), (2, 1, 4, "i", "r"), (3, 1, 1, "i", " "), (4, 9, 1, "i", "r"),
                                 (5, 2, 1, "i", "r")], "request_id int, action_id long, ts int, investigator_id string, reason string")
    got = {r.request_id: r.cause for r in L.judge_overrides(req, acts, ovs).collect()}
    assert got == {1: "already overridden", 2: None, 3: "investigator and reason are required",
                   4: "no such action", 5: "already overridden"}


def test_recorded_action_has_a_deadline_and_stable_id(spark):
    held = spark.sql("SELECT 'A' account_id, 'e1' event_id, 'AUTO-HOLD' action_type, 'd' action_detail, "
                     "timestamp'2024-01-01 00:00:00' created_at")
    a, b = (L.record_actions(held, "v1").first() for _ in range(2))
    assert a.action_id == b.action_id and str(a.expires_at) == "2024-01-03 00:00:00"


def test_promotion_guard_and_rollback(spark):
    ev = spark.createDataFrame([(1, "m", 1, 0.80, "PROMOTE"), (2, "m", 2, 0.85, "PROMOTE"), (3, "m", 1, 0.80, "ROLLBACK")],
                               "event_id int, model_name string, version int, auc_pr double, event string")
    cand = spark.createDataFrame([("m", 7, 0.70), ("m", 8, 0.85), ("new", 1, 0.1)], "model_name string, version int, auc_pr double")
    assert L.champions(ev).first().version == 1
    got = {(r.model_name, r.version): r.promote for r in L.judge_promotions(cand, ev).collect()}
    assert got == {("m", 7): False, ("m", 8): True, ("new", 1): True}
    assert L.promotion_events(L.judge_promotions(cand, ev), "ann").where("actor = 'ann'").count() == 2


def test_notices_and_watchlist_error(spark):
    ok = spark.createDataFrame([(1, "AUTO-HOLD", 7)], "account_id int, action_type string, action_id int")
    r = A.notices(ok, "Example Bank").first()
    assert r.reference_id == "CASE-1-7" and "call Example Bank and quote CASE-1-7." in r.message
    with pytest.raises(PySparkException):
        A.notices(ok.withColumn("action_type", F.lit("WATCHLIST"))).collect()


def test_encryption_round_trip(spark):
    df = spark.createDataFrame([("secret",)], "t string")
    k, w = F.lit("0123456789abcdef"), F.lit("0000000000000000")
    x = L.encrypt_text(F.col("t"), k)
    r = df.select(x.alias("x"), L.decrypt_text(x, k).alias("p"), L.decrypt_text(x, w).alias("q")).first()
    assert r.x != "secret" and r.p == "secret" and r.q is None


def test_severity_forms_differ_below_the_cuts(spark):
    df = spark.createDataFrame([(95.0,), (85.0,), (70.0,), (50.0,), (49.9,)], "s double")
    rows = df.select(S.band_alert(F.col("s")), S.band_score(F.col("s")), S.band_stream(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", None]
    assert [r[1] for r in rows][-1] == "NONE" and [r[2] for r in rows][-2:] == ["LOW", "LOW"]


def test_legacy_uncertainty_is_always_empty(spark):
    df = spark.range(0, 101).select(F.col("id").alias("account_id"), F.col("id").cast("double").alias("mule_score"))
    assert A.uncertain_queue(df, legacy=True).count() == 0
    ids = [r.account_id for r in A.uncertain_queue(df).collect()]
    assert ids[0] == 50 and set(ids) <= set(range(40, 61))


def test_psi_levels(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(50000, 15000, 5000)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "score double")
    psi = lambda a, b: D.score_drift(frame(a), frame(b)).first().psi
    assert psi(base, rng.normal(50000, 15000, 1000)) < 0.1
    assert psi(base, rng.normal(150000, 15000, 1000)) > 0.25
    assert psi(base, base) < 0.01
    assert psi([1.0] * 20, [2.0] * 20) == 0.0


def test_ranking_quality_against_a_loop(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 12, 200) / 12, rng.integers(0, 2, 200)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "account_id int, score double, label int")
    q = Q.ranking_quality(df).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert q.auc_roc == pytest.approx(np.mean(pairs))
    pts = [(0.0, 1.0)] + [((y[s >= t]).sum() / y.sum(), y[s >= t].mean()) for t in sorted(set(s), reverse=True)]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert q.auc_pr == pytest.approx(area)


def test_ranking_quality_without_positives_is_null(spark):
    df = spark.createDataFrame([(1, 0.5, 0)], "account_id int, score double, label int")
    q = Q.ranking_quality(df).first()
    assert q.auc_pr is None and q.auc_roc is None


def test_newest_feedback_wins_and_changes_are_marked(spark):
    y = spark.createDataFrame([(1, 0), (2, 1)], "account_id int, label int")
    fb = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "account_id int, true_label int, created_at int")
    got = {r.account_id: (r.label, r.changed) for r in J.overlay_feedback(y, fb).collect()}
    assert got[1] == (1, True) and got[2][0] == 1


def test_sampling_keeps_every_positive(spark):
    df = spark.range(1000).select(F.col("id").alias("account_id"), (F.col("id") % 100 == 0).cast("int").alias("label"))
    out = J.keep_positives(df, 200)
    assert out.count() == 200 and out.where("label = 1").count() == 10
    assert J.keep_positives(df, 5000).count() == 1000


def test_switch_events_need_actor_and_reason(spark):
    req = spark.sql("SELECT * FROM VALUES (1, 'ACTIVATE', 'ann', 'drill', 5), (2, 'ACTIVATE', '', 'x', 6), "
                    "(3, 'TOGGLE', 'ann', 'x', 7), (4, 'DEACTIVATE', 'ann', NULL, 8) AS t(id, event, actor, reason, ts)")
    assert [r.id for r in L.switch_events(req).collect()] == [1]
