"""Registered queries: ledgers, guards, registry and account joins."""

import secrets

from pyspark.sql import functions as F

from tillwatch.operators import joins as J
from tillwatch.operators import ledger as L
from tillwatch.operators import metrics as Q
from tillwatch.operators.rolling import channel_windows
from tillwatch.plans.quality_queries import auc_sql, rounded
from tillwatch.plans.registry import query
from tillwatch.plans.rolling_queries import _in, _stats
from tillwatch.plans.views import AS_OF, SC, TX, as_of_col, scored_labels, table, transactions

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def switch_log(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.when(_k() % 2 == 1, "ACTIVATE").otherwise("DEACTIVATE").alias("event"),
        F.concat(F.lit("op"), F.col("user_id")).alias("actor"), "ts")


def actions(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("action_id"), F.col("user_id").alias("account_id"),
        F.when(_k() % 3 == 0, "AUTO-HOLD").otherwise("PRIORITY_REVIEW").alias("action_type"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.when(_k() % 2 == 0, 48).otherwise(600))).alias("expires_at"),
        F.lit("ACTIVE").alias("status"))


def overrides(spark, sf):
    return table(spark, sf, "events").where("event_type = 'click'").select(
        F.col("event_id").alias("override_id"), (F.col("event_id") + 1 - _k() % 2 * 3).alias("action_id"),
        F.concat(F.lit("inv"), _k()).alias("investigator_id"), F.lit("checked").alias("reason"),
        F.when(_k() % 5 == 0, "AUTO_EXPIRED").otherwise("HUMAN").alias("override_type"))


def requests(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("event_id").alias("request_id"),
        F.when(_k() % 4 == 0, F.lit(7)).otherwise(F.col("event_id") + 2).cast("long").alias("action_id"), "ts",
        F.when(_k() % 10 == 0, " ").otherwise(F.concat(F.lit("inv"), _k())).alias("investigator_id"),
        F.when(_k() % 7 != 0, "customer called").alias("reason"))


LEDGER = f"""sw AS (SELECT event_id AS id, CASE WHEN {_K} % 2 = 1 THEN 'ACTIVATE' ELSE 'DEACTIVATE' END AS event
  FROM events WHERE event_type = 'error'),
act AS (SELECT event_id AS action_id, user_id AS account_id,
  CASE WHEN {_K} % 3 = 0 THEN 'AUTO-HOLD' ELSE 'PRIORITY_REVIEW' END AS action_type, ts AS created_at,
  ts + to_hours(CASE WHEN {_K} % 2 = 0 THEN 48 ELSE 600 END) AS expires_at FROM events WHERE event_type = 'purchase'),
ov AS (SELECT event_id AS override_id, event_id + 1 - {_K} % 2 * 3 AS action_id, 'inv' || {_K} AS investigator_id,
  'checked' AS reason, CASE WHEN {_K} % 5 = 0 THEN 'AUTO_EXPIRED' ELSE 'HUMAN' END AS override_type
  FROM events WHERE event_type = 'click'),
rq AS (SELECT event_id AS request_id, CASE WHEN {_K} % 4 = 0 THEN 7 ELSE event_id + 2 END AS action_id, ts,
  CASE WHEN {_K} % 10 = 0 THEN ' ' ELSE 'inv' || {_K} END AS investigator_id,
  CASE WHEN {_K} % 7 <> 0 THEN 'customer called' END AS reason FROM events WHERE event_type = 'view'),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY override_id DESC) AS r FROM ov) WHERE r = 1),
st AS (SELECT act.*, lo.override_id, lo.investigator_id, lo.reason, lo.override_type,
  CASE WHEN lo.override_id IS NULL THEN 'ACTIVE' ELSE 'OVERRIDDEN' END AS status
  FROM act LEFT JOIN lo ON lo.action_id = act.action_id)"""


@query("kill_switch_gate", f"""WITH {LEDGER}, {SC}, s AS (SELECT arg_max(event = 'ACTIVATE', id) AS active FROM sw)
SELECT account_id, score, CASE WHEN score >= 0.95 THEN CASE WHEN active THEN 'SUPPRESSED_BY_KILL_SWITCH'
 ELSE 'AUTO-HOLD' END END AS action FROM sc, s""")
def kill_switch_gate(spark, sf):
    return L.gate(scored_labels(spark, sf).select("account_id", "score"), switch_log(spark, sf))


@query("switch_history", f"""WITH {LEDGER} SELECT id, event FROM sw ORDER BY id DESC LIMIT 20""")
def switch_history(spark, sf):
    return L.history(switch_log(spark, sf).withColumn("one", F.lit(1)), "one", 1, "id", 20).select("id", "event")


@query("latest_explanation", f"""SELECT account_id, id, top_feature FROM (
 SELECT user_id AS account_id, event_id AS id, {_K} AS top_feature,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'signup') WHERE r = 1""")
def latest_explanation(spark, sf):
    log = table(spark, sf, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("account_id"), F.col("event_id").alias("id"), "props")
    return L.latest_per_key(log, ["account_id"], "id").select(
        "account_id", "id", F.from_json("props", "map<string,int>")["k"].alias("top_feature"))


@query("action_status", f"""WITH {LEDGER} SELECT action_id, account_id, action_type, status, override_id,
 investigator_id, reason, override_type FROM st""")
def action_status(spark, sf):
    return L.action_status(actions(spark, sf), overrides(spark, sf)).select(
        "action_id", "account_id", "action_type", "status", "override_id", "investigator_id", "reason", "override_type")


@query("active_actions", f"""WITH {LEDGER} SELECT action_id, account_id, created_at, expires_at FROM st
WHERE status = 'ACTIVE' AND action_type = 'AUTO-HOLD'""")
def active_actions(spark, sf):
    return L.active_actions(actions(spark, sf), overrides(spark, sf), "AUTO-HOLD").select(
        "action_id", "account_id", "created_at", "expires_at")


@query("sla_expiry", f"""WITH {LEDGER} SELECT action_id, 'SYSTEM_AUTO_EXPIRY' AS investigator_id,
 'Auto-expired: no investigator response within SLA window' AS reason, 'AUTO_EXPIRED' AS override_type
FROM st WHERE status = 'ACTIVE' AND expires_at < {_NOW}""")
def sla_expiry(spark, sf):
    return L.expired_overrides(actions(spark, sf), overrides(spark, sf), as_of_col()).drop("timestamp")


@query("override_guard", f"""WITH {LEDGER}, q AS (SELECT rq.*,
 coalesce(length(trim(investigator_id)), 0) > 0 AND coalesce(length(trim(reason)), 0) > 0 AS sound FROM rq),
w AS (SELECT action_id, arg_min(request_id, {{'t': ts, 'i': request_id}}) AS first FROM q WHERE sound GROUP BY action_id),
c AS (SELECT q.request_id, q.action_id, CASE WHEN NOT sound THEN 'investigator and reason are required'
 WHEN q.action_id NOT IN (SELECT action_id FROM act) THEN 'no such action'
 WHEN q.action_id IN (SELECT action_id FROM ov) OR q.request_id <> w.first THEN 'already overridden' END AS cause
 FROM q LEFT JOIN w USING (action_id))
SELECT request_id, action_id, cause, cause IS NULL AS accepted FROM c""")
def override_guard(spark, sf):
    return L.judge_overrides(requests(spark, sf), actions(spark, sf), overrides(spark, sf)).select(
        "request_id", "action_id", "cause", "accepted")


@query("ledger_input", f"""WITH {LEDGER} SELECT request_id, coalesce(length(trim(investigator_id)), 0) > 0
 AND coalesce(length(trim(reason)), 0) > 0 AS accepted FROM rq""")
def ledger_input(spark, sf):
    return L.split_requests(requests(spark, sf)).select("request_id", "accepted")


@query("alert_list", f"""SELECT event_id AS alert_id, user_id AS account_id, ts AS created_at FROM events
WHERE {_K} % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def alert_list(spark, sf):
    from tillwatch.operators.alerts import list_alerts
    log = table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("created_at"),
        F.when(_k() % 3 == 0, "OPEN").otherwise("CLOSED").alias("status"))
    return list_alerts(log).drop("status")


# ---- registry ---------------------------------------------------------------
def registry_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("model"), F.col("user_id") % 40).alias("model_name"),
        F.col("event_id").alias("version"), (F.col("value") / F.lit(500.0)).alias("auc_pr"),
        F.when(F.col("event_type") == "signup", "PROMOTE").when(F.col("event_type") == "error", "ROLLBACK")
        .otherwise("REGISTER").alias("event"))


_REG = """reg AS (SELECT event_id, 'model' || user_id % 40 AS model_name, event_id AS version,
 value / 500.0::DOUBLE AS auc_pr, CASE event_type WHEN 'signup' THEN 'PROMOTE' WHEN 'error' THEN 'ROLLBACK'
 ELSE 'REGISTER' END AS event FROM events),
champ AS (SELECT model_name, arg_max(version, event_id) AS version, arg_max(auc_pr, event_id) AS auc_pr
 FROM reg WHERE event IN ('PROMOTE', 'ROLLBACK') GROUP BY model_name)"""


@query("champion_select", f"WITH {_REG} SELECT * FROM champ")
def champion_select(spark, sf):
    return L.champions(registry_events(spark, sf))


@query("promote_guard", f"""WITH {_REG} SELECT r.model_name, r.version, r.auc_pr, c.version AS champion_version,
 c.auc_pr AS champion_auc, c.auc_pr IS NULL OR r.auc_pr >= c.auc_pr - 0.01::DOUBLE AS promote
 FROM reg r LEFT JOIN champ c USING (model_name) WHERE r.event = 'REGISTER'""")
def promote_guard(spark, sf):
    ev = registry_events(spark, sf)
    cand = ev.where("event = 'REGISTER'").select("model_name", "version", "auc_pr")
    return L.judge_promotions(cand, ev, 0.01)


@query("encrypt_roundtrip", "SELECT c_custkey AS account_id, c_name AS plain, true AS hidden, true AS wrong_key_fails FROM customer")
def encrypt_roundtrip(spark, sf):
    # Keys made for this run, so that no plan or event log shows one in use.
    key, wrong = (F.lit(secrets.token_hex(16)) for _ in range(2))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), "c_name", L.encrypt_text(F.col("c_name"), key).alias("x"))
    return c.select("account_id", L.decrypt_text(F.col("x"), key).alias("plain"),
                    (F.col("x") != F.col("c_name")).alias("hidden"),
                    L.decrypt_text(F.col("x"), wrong).isNull().alias("wrong_key_fails"))


# ---- joins ------------------------------------------------------------------
_TOT31 = f"SELECT account_id, {_stats(31)['total_amt']} AS total_amt FROM tx WHERE {_in(31)} GROUP BY account_id"


@query("cross_bank_merge", f"""WITH {TX}, t AS ({_TOT31}) SELECT t.account_id, total_amt,
 CAST(s_acctbal < 0 AS INTEGER) AS cross_bank_flagged, s_nationkey AS cross_bank_counterparty_count,
 s_acctbal / 10000.0::DOUBLE AS cross_bank_velocity FROM t LEFT JOIN supplier ON s_suppkey = t.account_id""")
def cross_bank_merge(spark, sf):
    tx = transactions(spark, sf).withColumn("channel", F.lit("_ALL"))
    feats = channel_windows(tx, as_of_col(), [31]).select("account_id", "total_amt")
    sig = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("account_id"), (F.col("s_acctbal") < 0).alias("flagged"),
        F.col("s_nationkey").alias("counterparty_flagged_count"),
        (F.col("s_acctbal") / F.lit(10000.0)).alias("cross_bank_velocity_score"))
    return J.merge_cross_bank(feats, sig)


@query("counterparty_exposure", f"""SELECT user_id AS account_id, count(DISTINCT CASE WHEN s_acctbal < 0 THEN s_suppkey END)
 AS counterparty_flagged_count FROM events LEFT JOIN supplier ON s_suppkey = {_K} GROUP BY user_id""")
def counterparty_exposure(spark, sf):
    edges = table(spark, sf, "events").select(
        F.col("user_id").alias("account_id"), _k().cast("long").alias("counterparty_id"))
    flagged = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("counterparty_id"))
    return J.counterparty_exposure(edges, flagged)


@query("feedback_overlay", f"""WITH {SC}, fb AS (SELECT user_id AS account_id,
 arg_max({_K} % 2, event_id) AS fl FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT account_id, coalesce(fl, label) AS label, coalesce(fl, label) <> label AS changed
FROM sc LEFT JOIN fb USING (account_id)""")
def feedback_overlay(spark, sf):
    fb = table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("user_id").alias("account_id"), (_k() % 2).alias("true_label"), F.col("event_id").alias("created_at"))
    return J.overlay_feedback(scored_labels(spark, sf).select("account_id", "label"), fb)


@query("offline_lookup", f"""WITH {TX}, t AS ({_TOT31}), ids AS (SELECT DISTINCT c_custkey AS account_id FROM customer
 WHERE c_mktsegment = 'BUILDING') SELECT account_id, total_amt FROM ids LEFT JOIN t USING (account_id)""")
def offline_lookup(spark, sf):
    tx = transactions(spark, sf).withColumn("channel", F.lit("_ALL"))
    feats = channel_windows(tx, as_of_col(), [31]).select("account_id", "total_amt")
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account_id"))
    return J.lookup(ids, feats)


@query("explanation_scope", f"""WITH {SC} SELECT account_id, score FROM sc WHERE score >= 0.95 OR score_b >= 0.95 OR label = 1""")
def explanation_scope(spark, sf):
    sc = scored_labels(spark, sf)
    return J.in_scope(sc.select("account_id", "score"), sc.where("score >= 0.95"),
                      sc.where("score_b >= 0.95"), sc.where("label = 1"))


@query("positive_keeping_sample", f"""WITH {SC}, n AS (SELECT account_id, label, row_number() OVER (
 ORDER BY md5(account_id || ':42')) AS r FROM sc WHERE label = 0), p AS (SELECT count(*) AS k FROM sc WHERE label = 1)
SELECT account_id, label FROM sc WHERE label = 1 UNION ALL SELECT account_id, label FROM n, p WHERE r <= 200 - k""")
def positive_keeping_sample(spark, sf):
    return J.keep_positives(scored_labels(spark, sf).select("account_id", "label"), 200)


@query("lookalike_pool", f"""WITH {SC}, l AS (SELECT account_id, label, score FROM sc WHERE label = 0
 ORDER BY score DESC, account_id LIMIT 100)
SELECT account_id, label, score FROM sc WHERE label = 1 UNION ALL SELECT * FROM l""")
def lookalike_pool(spark, sf):
    return J.lookalike_pool(scored_labels(spark, sf).select("account_id", "label", "score"), 100)


@query("retrain_compare", f"""WITH {SC},
a AS (WITH {auc_sql("sc", "score", "label")} SELECT auc_pr FROM auc),
b AS (WITH {auc_sql("sc", "score_b", "label")} SELECT auc_pr FROM auc)
SELECT round(a.auc_pr, 9) AS old_auc, round(b.auc_pr, 9) AS new_auc,
 round(CASE WHEN a.auc_pr > 0 THEN (b.auc_pr - a.auc_pr) / a.auc_pr * 100 ELSE 0 END, 6) AS improvement,
 b.auc_pr > a.auc_pr AS replace FROM a, b""")
def retrain_compare(spark, sf):
    from tillwatch.learn.retrain import compare_scores
    df = compare_scores(scored_labels(spark, sf), "score", "score_b")
    return rounded(rounded(df, "old_auc", "new_auc"), "improvement", digits=6)
