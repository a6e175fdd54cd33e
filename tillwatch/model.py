"""Schemas and fixed domain values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# Channel codes, windows, member lists and thresholds. Other systems read the
# feature names built from them, so they must not change.
CHANNELS = [
    "CASH", "CHEQUE", "UPI", "NEFT", "IMPS", "RTGS", "ATM", "POS",
    "STDNG_INSTR", "APB", "BBPS", "MBNKING", "NET_BNKING", "GST", "LOAN", "FEES_CHRGS",
]
WINDOW_DAYS = [7, 14, 31]
RATIO_PAIRS = [(7, 14), (14, 31)]
ELEC_XFER_MEMBERS = ["NEFT", "IMPS", "RTGS"]
NON_CASH_CHQ_EXCLUDES = ["CASH", "CHEQUE"]

SEVERITY_CUTS = [(95.0, "CRITICAL"), (85.0, "HIGH"), (70.0, "MEDIUM"), (50.0, "LOW")]
RECOMMENDED_ACTION = {
    "CRITICAL": "AUTO-HOLD: temporary step-up verification on large outgoing transfers "
                "(reversible, not a freeze) — pending same-day review",
    "HIGH": "PRIORITY MANUAL REVIEW — same-day queue",
    "MEDIUM": "STANDARD QUEUE — review within the week",
    "LOW": "WATCHLIST — periodic batch review, no immediate action",
    "NONE": "No alert",
}
AUTO_HOLD_SCORE = 0.95
DEFAULT_SLA_HOURS = 48

OPEN_BUCKET_ORDINAL = {"L14D": 0, "L31D": 1, "L90D": 2, "L180D": 3, "L365D": 4, "G365D": 5}
OPEN_BUCKET_DAYS = {"l14d": 14, "l31d": 31, "l90d": 90, "l180d": 180, "l365d": 365, "g365d": 730}
OPEN_DAYS_UNKNOWN = 365

LABEL_COLUMN = "F3924"
LEAK_COLUMNS = ["F3924", "Unnamed: 0", "F2230", "F3912", "F3913", "F3914", "F3915"]
EXCLUDED_ATTRIBUTES = ["F3892", "F3888"]
ORDINAL_COLUMNS = ["F3889"]
ONE_HOT_COLUMNS = ["F3886", "F3890", "F3891", "F3893"]
TYPOLOGY_SOURCES = {
    "amt_total_31": "F3799", "amt_cr_31": "F3800", "amt_db_31": "F3801",
    "amt_cr_7": "F3812", "amt_db_7": "F3813",
    "txn_total_31": "F3796", "txn_cr_31": "F3797", "txn_db_31": "F3798",
    "avg_bal_14": "F3836", "tenure": "F3887", "open_bucket": "F3889",
    "occupation": "F3891", "age": "F3894",
    "alerts_total": "F3919", "alerts_night": "F3923",
}

PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25
PSI_BINS = 10
PSI_FLOOR = 1e-6
# -----------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)

TRANSACTION = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("direction", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("balance_after", MONEY, True),
    T.StructField("is_customer_induced", T.BooleanType(), True),
])

MESSAGE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("balance_after", T.DoubleType()),
    T.StructField("is_customer_induced", T.BooleanType()),
])

ACTION = T.StructType([
    T.StructField("action_id", T.StringType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("action_detail", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
])

DICTIONARY = T.StructType([
    T.StructField("row_no", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("variable_name", T.StringType()),
    T.StructField("description", T.StringType()),
])
