"""Alerts, work queues and filings from scored accounts (0-100 ``mule_score``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import severity as S
from tillwatch.functions import text as X


def make_alerts(scores: DataFrame, at: Column) -> DataFrame:
    """One OPEN alert per account at or above the lowest cut."""
    band = S.band_alert(F.col("mule_score"))
    return scores.withColumn("severity", band).where(F.col("severity").isNotNull()).select(
        at.alias("timestamp"), "account_id", "mule_score", "severity",
        S.recommended_action(F.col("severity")).alias("recommended_action"),
        F.lit("OPEN").alias("status"), F.lit(None).cast("string").alias("investigator_id"),
        F.lit("").alias("notes"))


def severity_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy(S.band_score(F.col("mule_score")).alias("severity")).agg(
        F.count(F.lit(1)).alias("n_accounts"))


def uncertain_queue(scores: DataFrame, threshold: float = 0.2, legacy: bool = False,
                    uncertainty: str | None = None) -> DataFrame:
    """Accounts to label next, priority HIGH.

    Default: nearest to the decision boundary, ``|s - 0.5| < threshold / 2``.
    ``legacy`` keeps ``|s - 0.5| > 1 - threshold``, which no score can satisfy for
    small thresholds. A supplied uncertainty column uses ``> 1 - threshold``.
    """
    if uncertainty:
        u, keep, order = F.col(uncertainty), F.col(uncertainty) > 1 - threshold, F.desc("uncertainty")
    else:
        u = F.abs(F.col("mule_score") / F.lit(100.0) - F.lit(0.5))
        keep = (u > 1 - threshold) if legacy else (u < threshold / 2)
        order = F.desc("uncertainty") if legacy else F.asc("uncertainty")
    return scores.where(keep).select(
        "account_id", "mule_score", u.alias("uncertainty"), F.lit("HIGH").alias("priority"),
    ).orderBy(order, "account_id")


def str_summary(scores: DataFrame, at: Column, threshold: float = 0.95) -> DataFrame:
    """Accounts to report (score on [0, 1] above ``threshold``) with the report text."""
    s = F.col("mule_score") / F.lit(100.0)
    return scores.where(s > threshold).select(
        "account_id", s.alias("risk_score"), at.alias("str_generated"),
        F.lit("PENDING_FILING").alias("status"),
        X.suspicious_report(F.col("account_id"), s, at).alias("report_text"))


def notices(actions: DataFrame, institution: str = "your bank") -> DataFrame:
    """Customer notice per action; non customer-facing actions fail the job."""
    ref = X.reference_id(F.col("account_id"), F.col("action_id"))
    return actions.select(
        "account_id", "action_type", ref.alias("reference_id"),
        X.notice(F.col("action_type"), ref, institution).alias("message"))


def list_alerts(alerts: DataFrame, status: str = "OPEN", limit: int = 100) -> DataFrame:
    return alerts.where(F.col("status") == status).orderBy(
        F.desc("created_at"), F.desc("alert_id")).limit(limit)
