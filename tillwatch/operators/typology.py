"""Behaviour signatures: each amount against the account's own or its peers' baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.safe import finite_or_zero, number_or_zero
from tillwatch.model import OPEN_BUCKET_DAYS, OPEN_DAYS_UNKNOWN, TYPOLOGY_SOURCES
from tillwatch.operators.ordering import exact_quantiles, join_per_value
from tillwatch.session import settle

EPS = 1.0


def peer_median(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Exact median of ``value`` per peer group, with the group's row count ``n``.

    Groups can be huge (a third of all customers in one occupation), so the
    median is found piecewise.
    """
    return exact_quantiles(df, [group], value, [0.5]).select(group, F.col("q")[0].alias(name), "n")


def typology(df: DataFrame, sources: dict[str, str] | None = None, key: str = "account_id") -> DataFrame:
    """``TYP_*`` features; a feature is left out when one of its sources is absent."""
    src = {k: v for k, v in (sources or TYPOLOGY_SOURCES).items() if v in df.columns}
    text = {"open_bucket", "occupation"}
    work = df.select(
        key,
        *[(F.lower(F.trim(F.coalesce(F.col(v).cast("string"), F.lit("nan")))) if k in text
           else number_or_zero(F.col(v))).alias(k) for k, v in src.items()])
    have = set(src)
    peers = []
    if {"occupation", "amt_cr_31"} <= have:
        peers.append(("occupation", "med_occ"))
    if {"age", "amt_cr_31"} <= have:
        work = work.withColumn("age_band", F.floor(F.col("age") / F.lit(10.0)))
        peers.append(("age_band", "med_age"))
    work = settle(work)
    for group, name in peers:
        work = join_per_value(work, peer_median(work, group, "amt_cr_31", name), [group])
    c = F.col
    eps = F.lit(EPS)

    def over(num: Column, den: Column) -> Column:
        return num / (den + eps)

    def symmetry(x: Column, y: Column) -> Column:
        return over(F.least(x, y), F.greatest(x, y))

    def velocity(short: Column, full: Column) -> Column:
        return over(short / F.lit(7.0), full / F.lit(31.0))

    open_days = F.lit(float(OPEN_DAYS_UNKNOWN))
    if "open_bucket" in have:
        table = F.create_map(*[F.lit(x) for kv in OPEN_BUCKET_DAYS.items() for x in kv])
        open_days = F.coalesce(F.try_element_at(table, c("open_bucket")), F.lit(OPEN_DAYS_UNKNOWN)).cast("double")
    avg_credit = over(c("amt_cr_31"), c("txn_cr_31"))
    quiet = F.greatest(c("amt_cr_31") - c("amt_cr_7"), F.lit(0.0)) < c("amt_cr_7") * F.lit(0.1)
    woke = F.when((c("amt_cr_7") > 0) & quiet, F.lit(1.0)).otherwise(F.lit(0.0))
    # Formulas are fixed by the feature contract: (name, sources needed, expression).
    rules: list[tuple[str, set[str], Column]] = [
        ("turnover_mult", {"amt_total_31", "avg_bal_14"}, over(c("amt_total_31"), F.abs("avg_bal_14"))),
        ("cr_db_symmetry_31", {"amt_cr_31", "amt_db_31"}, symmetry(c("amt_cr_31"), c("amt_db_31"))),
        ("cr_db_symmetry_7", {"amt_cr_7", "amt_db_7"}, symmetry(c("amt_cr_7"), c("amt_db_7"))),
        ("velocity_cr", {"amt_cr_7", "amt_cr_31"}, velocity(c("amt_cr_7"), c("amt_cr_31"))),
        ("velocity_db", {"amt_db_7", "amt_db_31"}, velocity(c("amt_db_7"), c("amt_db_31"))),
        ("new_acct_thruput", {"amt_cr_31", "open_bucket"}, over(c("amt_cr_31"), open_days)),
        ("thruput_per_tenure", {"amt_cr_31", "tenure"}, over(c("amt_cr_31"), F.abs("tenure"))),
        ("dormant_wake", {"amt_cr_7", "amt_cr_31", "tenure"}, woke * F.log1p(F.abs("tenure"))),
        ("fanout_ratio", {"txn_db_31", "txn_cr_31"}, over(c("txn_db_31"), c("txn_cr_31"))),
        ("smurf_index", {"txn_cr_31", "amt_cr_31"}, over(c("txn_cr_31"), avg_credit)),
        ("avg_credit_size", {"txn_cr_31", "amt_cr_31"}, avg_credit),
        ("night_share", {"alerts_total", "alerts_night"}, over(c("alerts_night"), c("alerts_total"))),
        ("occp_mismatch", {"occupation", "amt_cr_31"}, over(c("amt_cr_31"), F.abs("med_occ"))),
        ("age_mismatch", {"age", "amt_cr_31"}, over(c("amt_cr_31"), F.abs("med_age"))),
        ("retention", {"avg_bal_14", "amt_cr_31"}, over(F.abs("avg_bal_14"), c("amt_cr_31"))),
    ]
    return work.select(key, *[finite_or_zero(e).alias(f"TYP_{n}") for n, need, e in rules if need <= have])
