"""Text built per row: notices, reports, explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Customer notices by action type; {institution} and {reference} are filled in.
NOTICES = {
    "AUTO-HOLD":
        "One of your recent payments is on hold while {institution} checks it. Holds like this "
        "follow automatic rules and usually end the same day. You need not do anything now; to "
        "dispute the hold, call {institution} and quote {reference}.",
    "PRIORITY_REVIEW":
        "A specialist is looking at recent activity on your account. You can go on using the "
        "account as usual. Quote {reference} if you ask us about it.",
    "STANDARD_QUEUE":
        "Your account is part of a scheduled check of customer accounts. Nothing changes for "
        "you. Quote {reference} if you ask us about it.",
}


def reference_id(account: Column, action: Column, prefix: str = "CASE") -> Column:
    return F.concat_ws("-", F.lit(prefix), account.cast("string"), action.cast("string"))


def notice(action_type: Column, reference: Column, institution: str = "your bank") -> Column:
    """Customer text of an action; other action types are not customer facing and raise."""
    out = None
    for kind, text in NOTICES.items():
        head, tail = text.replace("{institution}", institution).split("{reference}")
        body = F.concat(F.lit(head), reference, F.lit(tail))
        out = F.when(action_type == kind, body) if out is None else out.when(action_type == kind, body)
    return out.otherwise(F.raise_error(F.concat(F.lit("no customer notice for action "), action_type))
                         .cast("string"))


def suspicious_report(account: Column, score: Column, issued: Column) -> Column:
    """Body of one suspicious-transaction report; ``score`` on [0, 1]."""
    return F.concat_ws(
        "\n",
        F.lit("SUSPICIOUS TRANSACTION REPORT (STR)"),
        F.concat(F.lit("Report Date: "), issued.cast("string")),
        F.concat(F.lit("Account ID: "), account.cast("string")),
        F.format_string("Risk Score: %.1f%%", score * F.lit(100.0)),
        F.lit("Classification: HIGH-RISK MULE ACCOUNT"),
        F.lit("Indicators: the ensemble agrees and the score exceeds the filing threshold."),
        F.lit("Next steps: hold pending investigation, enhanced due diligence, file with the "
              "financial intelligence unit, notify compliance, preserve records."),
        F.lit("Attachments: features, transactions, model confidence, peer comparison."))


def account_explanation(account: Column, score: Column, top: Column, cluster: Column) -> Column:
    """Investigator text: score, class, strongest features, behaviour type when clustered.

    ``top`` is ARRAY<STRUCT<feature, value>>; ``cluster`` is 0-based or NULL.
    """
    lines = F.transform(top, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), x["feature"], F.lit(": "), F.format_string("%.4f", x["value"])))
    kind = F.when(score > 0.5, "MULE (High Risk)").otherwise("LEGITIMATE (Low Risk)")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("ACCOUNT BEHAVIORAL ANALYSIS - ACCOUNT "), account.cast("string")),
        F.format_string("RISK SCORE: %.1f%%", score * F.lit(100.0)),
        F.concat(F.lit("CLASSIFICATION: "), kind),
        F.array_join(lines, "\n"),
        F.when(cluster.isNotNull(), F.concat(F.lit("BEHAVIOR TYPE: Mule Type "), (cluster + 1).cast("string"))))


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, "increases").otherwise("decreases")
