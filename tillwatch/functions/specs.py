"""Feature-dictionary grammar: variable name and description to a typed spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.safe import pick

# ---- fixed values: dictionary phrases, in matching order ---------------------
CATEGORY_PHRASES = [
    ("non cash non cheque", "NON_CASH_CHQ"),
    ("cash", "CASH"),
    ("cheque", "CHEQUE"),
    ("upi", "UPI"),
    ("online transfer", "ELEC_XFER"),
    ("atm", "ATM"),
    ("merchant payment", "POS"),
    ("standing instruction", "STDNG_INSTR"),
    ("aadhar payment bridge", "APB"),
    ("aadhaar payment bridge", "APB"),
    ("bharat bill payment system", "BBPS"),
    ("mobile banking", "MBNKING"),
    ("net banking", "NET_BNKING"),
    ("gst", "GST"),
    ("loan", "LOAN"),
    ("customer induced fees charges", "FEES_CHRGS"),
    ("account balance", "_BAL"),
]
STATISTIC_PREFIXES = [
    ("ratio of avgs: of", "RA"),
    ("ratio of", "R"),
    ("deviation of avgs: of", "DA"),
    ("deviation of total from avg:", "D_TA"),
    ("deviation of", "D"),
    ("difference of max and min:", "MM"),
    ("min ", "MIN"),
    ("max ", "MAX"),
    ("average ", "AVG"),
    ("total ", "TOT"),
]
INDUCED_PHRASE = "customer induced"
WINDOW_PATTERN = r"last\s+(\d+)\s*(?:to\s*(\d+))?\s*d(?:ays)?"
PEER_SUFFIX_PATTERN = r"_OCC?$"
# -----------------------------------------------------------------------------


def parse_specs(dictionary: DataFrame) -> DataFrame:
    """Add category, stat, cr_db, metric, windows, occ and ci_filter.

    NULL category, stat or windows means the text is not understood; nothing is
    defaulted except the cross-channel readings of customer-induced and bare
    total features.
    """
    low = F.lower(F.trim("description"))
    named = pick([(low.contains(p), F.lit(c)) for p, c in CATEGORY_PHRASES])
    stat = pick([(low.startswith(p), F.lit(s)) for p, s in STATISTIC_PREFIXES])
    induced = low.contains(INDUCED_PHRASE)
    first = F.regexp_extract(low, WINDOW_PATTERN, 1)
    second = F.regexp_extract(low, WINDOW_PATTERN, 2)
    spec = F.struct(
        induced.alias("ci_filter"),
        stat.alias("stat"),
        F.coalesce(named, F.when(induced | (stat == "TOT"), F.lit("_ALL"))).alias("category"),
        F.when(low.contains("credit"), "CR").when(low.contains("debit"), "DB")
         .otherwise("TOTAL").alias("cr_db"),
        F.when(low.contains("amount") | low.contains("balance"), "AMT")
         .otherwise("TXNS").alias("metric"),
        F.when(first == "", None)
         .when(second == "", F.array(first.try_cast("int")))
         .otherwise(F.array(first.try_cast("int"), second.try_cast("int"))).alias("windows"),
        F.col("variable_name").rlike(PEER_SUFFIX_PATTERN).alias("occ"))
    # One-element inline instead of plain columns: later filters then test the
    # parsed values, where pushed-down copies of the long phrase chains would
    # outgrow generated code.
    return dictionary.select("*", F.inline(F.array(spec)))


def reverse_index(specs: DataFrame) -> DataFrame:
    """First dictionary feature per (window, metric, cr_db) among plain cross-channel totals."""
    plain = specs.where(
        (F.col("stat") == "TOT") & (F.size("windows") == 1) & ~F.col("ci_filter")
        & (F.col("category") == "_ALL"))
    return plain.groupBy(
        F.col("windows")[0].alias("window_days"), "metric", "cr_db",
    ).agg(F.min_by("feature", "row_no").alias("feature"))
