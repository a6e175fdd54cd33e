"""Append-only decision ledgers. Status is always derived, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.model import AUTO_HOLD_SCORE, DEFAULT_SLA_HOURS
from tillwatch.operators.ordering import join_per_value

# ---- fixed values: ledger texts ---------------------------------------------
AUTO_HOLD = "AUTO-HOLD"
SUPPRESSED = "SUPPRESSED_BY_KILL_SWITCH"
EXPIRY_ACTOR = "SYSTEM_AUTO_EXPIRY"
EXPIRY_REASON = "Auto-expired: no investigator response within SLA window"
# -----------------------------------------------------------------------------


def latest_per_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of every key. An aggregate, so a key with a huge history combines map-side."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def history(log: DataFrame, key: str, value, order: str, limit: int | None = None) -> DataFrame:
    """All rows of one key, newest first."""
    out = log.where(F.col(key) == value).orderBy(F.desc(order))
    return out if limit is None else out.limit(limit)


def stable_id(*parts: Column) -> Column:
    """Ledger id from the row's natural key: a replayed write produces the same id."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def well_formed(actor: str, reason: str) -> Column:
    """Actor and reason are mandatory."""
    given = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    return given(actor) & given(reason)


def split_requests(requests: DataFrame, actor: str = "investigator_id", reason: str = "reason") -> DataFrame:
    """Requests with ``accepted`` and, for the rejected ones, the cause."""
    ok = well_formed(actor, reason)
    return requests.withColumn("accepted", ok).withColumn(
        "cause", F.when(~ok, F.lit("actor and reason are required")))


# ---- kill switch ------------------------------------------------------------
def switch_active(log: DataFrame) -> Column:
    """Scalar: is the newest event ACTIVATE? An empty log is inactive."""
    return F.coalesce(
        log.agg(F.max_by(F.col("event") == "ACTIVATE", "id")).scalar(), F.lit(False))


def gate(scores: DataFrame, switch_log: DataFrame, threshold: float = AUTO_HOLD_SCORE) -> DataFrame:
    """Automatic action per score: hold, suppressed by the switch, or none."""
    act = F.when(F.col("score") >= threshold,
                 F.when(F.col("_on"), F.lit(SUPPRESSED)).otherwise(F.lit(AUTO_HOLD)))
    return scores.withColumn("_on", switch_active(switch_log)).withColumn("action", act).drop("_on")


def switch_events(requests: DataFrame) -> DataFrame:
    """Ledger rows of well-formed ACTIVATE / DEACTIVATE requests; the rest is rejected upstream."""
    known = F.col("event").isin("ACTIVATE", "DEACTIVATE")
    return requests.where(well_formed("actor", "reason") & known).select(
        stable_id(F.col("ts"), F.col("actor"), F.col("event")).alias("event_key"),
        "id", "event", "actor", "reason", "ts")


# ---- actions and overrides --------------------------------------------------
def record_actions(held: DataFrame, model_version: str, sla_hours: int = DEFAULT_SLA_HOURS) -> DataFrame:
    """Action rows for (account_id, event_id, action_type, action_detail, created_at)."""
    return held.select(
        stable_id(F.col("account_id"), F.col("event_id")).alias("action_id"),
        "account_id", "action_type", "action_detail", F.lit(model_version).alias("model_version"),
        F.lit("ACTIVE").alias("status"), "created_at",
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(sla_hours))).alias("expires_at"))


def action_status(actions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every action with its newest override; one row per action on both join sides."""
    last = latest_per_key(
        overrides.select("action_id", F.col("override_id"), "investigator_id", "reason", "override_type"),
        ["action_id"], "override_id")
    return actions.drop("status").join(last, "action_id", "left").withColumn(
        "status", F.when(F.col("override_id").isNull(), "ACTIVE").otherwise("OVERRIDDEN"))


def active_actions(actions: DataFrame, overrides: DataFrame, action_type: str | None = None) -> DataFrame:
    out = action_status(actions, overrides).where(F.col("status") == "ACTIVE")
    if action_type:
        out = out.where(F.col("action_type") == action_type)
    return out.orderBy(F.desc("created_at"), F.desc("action_id"))


def expired_overrides(actions: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """System override rows for active actions whose deadline has passed."""
    due = actions.where(F.col("expires_at") < now)
    return due.join(overrides.select("action_id").distinct(), "action_id", "left_anti").select(
        "action_id", F.lit(EXPIRY_ACTOR).alias("investigator_id"), F.lit(EXPIRY_REASON).alias("reason"),
        now.alias("timestamp"), F.lit("AUTO_EXPIRED").alias("override_type"))


def judge_overrides(requests: DataFrame, actions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Accept or reject override requests, with the cause.

    Verdict facts are found once per requested action; of several sound requests
    for one action the earliest (ts, request_id) wins. Attaching the facts to the
    requests tolerates an action that very many requests name.
    """
    sound = well_formed("investigator_id", "reason")
    asked = requests.groupBy("action_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(sound, F.struct("ts", "request_id")))["request_id"].alias("_first"))
    known = actions.select("action_id", F.lit(True).alias("_known"))
    done = overrides.select("action_id").distinct().withColumn("_done", F.lit(True))
    facts = asked.join(known, "action_id", "left").join(done, "action_id", "left")
    cause = (F.when(~F.col("_sound"), "investigator and reason are required")
              .when(F.col("_known").isNull(), "no such action")
              .when(F.col("_done") | (F.col("request_id") != F.col("_first")), "already overridden"))
    judged = join_per_value(requests.withColumn("_sound", sound), facts, ["action_id"])
    return judged.withColumn("cause", cause).withColumn("accepted", F.col("cause").isNull()).drop(
        "_sound", "_first", "_known", "_done")


# ---- explanations -----------------------------------------------------------
def explanation_rows(explained: DataFrame, model_version: str) -> DataFrame:
    """Ledger form: contributions (ARRAY<STRUCT>) as JSON text plus the model version."""
    return explained.withColumn("contributions_json", F.to_json("contributions")).drop(
        "contributions").withColumn("model_version", F.lit(model_version))


# ---- model registry ---------------------------------------------------------
def champions(events: DataFrame) -> DataFrame:
    """Current champion per model: the version named by the newest PROMOTE or ROLLBACK."""
    moves = events.where(F.col("event").isin("PROMOTE", "ROLLBACK"))
    return latest_per_key(moves.select("model_name", "event_id", "version", "auc_pr"),
                          ["model_name"], "event_id").drop("event_id")


def judge_promotions(candidates: DataFrame, events: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Promote a challenger unless it regresses below the champion minus ``tolerance``."""
    champ = champions(events).select(
        "model_name", F.col("version").alias("champion_version"), F.col("auc_pr").alias("champion_auc"))
    per = candidates.groupBy("model_name").agg(F.count(F.lit(1)).alias("n")).join(champ, "model_name", "left")
    out = join_per_value(candidates, per, ["model_name"])
    return out.withColumn("promote", F.col("champion_auc").isNull()
                          | (F.col("auc_pr") >= F.col("champion_auc") - F.lit(tolerance)))


def promotion_events(judged: DataFrame, actor: str) -> DataFrame:
    """PROMOTE rows of the accepted candidates, with who asked."""
    return judged.where("promote").select(
        "model_name", "version", "auc_pr", F.lit("PROMOTE").alias("event"), F.lit(actor).alias("actor"))


def register_events(candidates: DataFrame, actor: str) -> DataFrame:
    """REGISTER rows; registering never makes a version the champion."""
    return candidates.select(
        "model_name", "version", "auc_pr", F.lit("REGISTER").alias("event"), F.lit(actor).alias("actor"))


def rollback_events(requests: DataFrame, events: DataFrame, actor: str) -> DataFrame:
    """ROLLBACK rows for (model_name, version) requests that name a registered version.

    No regression guard applies. Requests for unknown versions give no row; find
    them with an anti-join on the result.
    """
    known = events.where("event = 'REGISTER'").groupBy("model_name", "version").agg(F.max("auc_pr").alias("auc_pr"))
    return requests.select("model_name", "version").distinct().join(known, ["model_name", "version"]).select(
        "model_name", "version", "auc_pr", F.lit("ROLLBACK").alias("event"), F.lit(actor).alias("actor"))


def list_versions(events: DataFrame) -> DataFrame:
    """One row per registered version with its newest registration, and whether it is the champion."""
    listed = latest_per_key(events.where("event = 'REGISTER'").select("model_name", "version", "event_id", "auc_pr"),
                            ["model_name", "version"], "event_id")
    champ = champions(events).select("model_name", "version", F.lit(True).alias("is_champion"))
    return listed.join(champ, ["model_name", "version"], "left").na.fill({"is_champion": False}).withColumnRenamed(
        "event_id", "registered")


# ---- sensitive text ---------------------------------------------------------
def encrypt_text(c: Column, key: Column) -> Column:
    """Authenticated symmetric encryption (AES-GCM), base64 text."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt_text(c: Column, key: Column) -> Column:
    """Plain text; a wrong key or altered text yields NULL."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
