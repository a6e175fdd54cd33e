"""From rolling aggregates to the described feature schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.safe import pick, ratio_or_zero
from tillwatch.model import CHANNELS, LABEL_COLUMN, WINDOW_DAYS
from tillwatch.operators.rolling import (
    BALANCE, EXTENDED, balance_windows, channel_wide, combined_wide)
from tillwatch.session import broadcast_when_small

CATEGORIES = CHANNELS + ["_ALL", "NON_CASH_CHQ", "ELEC_XFER", "_BAL"]
DICTIONARY_BROADCAST_ROWS = 20_000


def _window_map(stats: list[str]) -> Column:
    """Window -> (statistic -> double), from ``<stat>_<w>`` columns."""
    parts = []
    for w in WINDOW_DAYS:
        named = [x for s in stats
                 for x in (F.lit(s), F.coalesce(F.col(f"{s}_{w}"), F.lit(0)).cast("double"))]
        parts += [F.lit(w), F.create_map(*named)]
    return F.create_map(*parts)


def account_categories(tx: DataFrame, as_of: Column) -> DataFrame:
    """Every account with all 20 categories, each a map window -> statistics.

    Inputs are at most 20 small rows per account, so gathering them into one map
    per account is bounded. Absent categories stay NULL and read as zero later.
    """
    wide = channel_wide(tx, as_of)
    per_cat = wide.where(F.col("channel").isin(CHANNELS)).select(
        "account_id", F.col("channel").alias("category"), _window_map(EXTENDED).alias("stats"))
    comb = combined_wide(wide).select("account_id", "category", _window_map(EXTENDED).alias("stats"))
    named = [x for b in BALANCE for x in (F.lit(b), F.col(b))]
    bal = balance_windows(tx, as_of).groupBy("account_id").agg(F.map_from_entries(F.collect_list(
        F.struct("window_days", F.create_map(*named)))).alias("stats"))
    bal = bal.select("account_id", F.lit("_BAL").alias("category"), "stats")
    per_account = per_cat.unionByName(comb).unionByName(bal).groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "stats"))).alias("m"))
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return per_account.select("account_id", F.explode(cats).alias("category"), "m").select(
        "account_id", "category", F.try_element_at("m", F.col("category")).alias("stats"))


def spec_lookups() -> dict[str, Column]:
    """The numbers a spec may need from its category row; absent ones are 0."""
    stat, cr_db = F.col("stat"), F.col("cr_db")
    a = F.get("windows", F.lit(0))
    b = F.get("windows", F.lit(1))
    base = F.concat(F.lower(F.when(cr_db == "TOTAL", "total").otherwise(cr_db)),
                    F.when(F.col("metric") == "AMT", "_amt").otherwise("_txns"))
    key = F.when(F.col("ci_filter") & (cr_db == "TOTAL"), F.concat(F.lit("ci_"), base)).otherwise(base)
    bal_key = F.when(stat == "MIN", "min_bal").when(stat == "MAX", "max_bal") \
               .when(stat == "AVG", "avg_bal").otherwise("total_bal")
    name = F.when(F.col("category") == "_BAL", bal_key).otherwise(key)

    def at(window: Column, field: Column) -> Column:
        return F.coalesce(F.try_element_at(F.try_element_at("stats", window), field), F.lit(0.0))

    return {
        "va": at(a, name), "vb": at(b, name), "v_long": at(F.lit(max(WINDOW_DAYS)), name),
        "v_min": at(a, F.lit("min_amt")), "v_max": at(a, F.lit("max_amt")),
        "v_avg": at(a, F.lit("avg_amt")),
    }


def feature_value() -> tuple[Column, Column]:
    """(value, status) of one spec on one account's category row."""
    stat, cr_db, win = F.col("stat"), F.col("cr_db"), F.col("windows")
    one, two = F.size(win) == 1, F.size(win) == 2
    amt = F.col("metric") == "AMT"
    day_a = F.get(win, F.lit(0)).cast("double")
    day_b = F.get(win, F.lit(1)).cast("double")
    split = F.col("ci_filter") & (cr_db != "TOTAL")
    ok = F.when(split, "CI_SPLIT_NOT_AVAILABLE").otherwise("OK")
    confirm, unresolved = F.lit("NEEDS_CONFIRMATION"), F.lit("UNRESOLVED")
    va, vb = F.col("va"), F.col("vb")
    longest = max(WINDOW_DAYS)
    bal = F.col("category") == "_BAL"
    nothing = F.col("category").isNull() | stat.isNull() | win.isNull()
    zero = F.lit(0.0)
    simple = stat.isin("MIN", "MAX", "AVG", "TOT")

    cases: list[tuple[Column, Column, Column]] = [
        (nothing, zero, unresolved),
        (bal & one & simple, va, F.lit("OK")),
        (bal & two & (stat == "TOT"), va + vb, confirm),
        (bal & two, va - vb, confirm),
        (bal, zero, unresolved),
        (one & (stat == "TOT"), va, ok),
        (one & (stat == "MIN") & amt, F.col("v_min"), ok),
        (one & (stat == "MAX") & amt, F.col("v_max"), ok),
        (one & stat.isin("MIN", "MAX"), va, confirm),
        (one & (stat == "AVG") & amt, F.col("v_avg"), ok),
        (one & (stat == "AVG"), va / day_a, ok),
        (one & (stat == "MM") & amt, F.col("v_max") - F.col("v_min"), ok),
        (one & (stat == "MM"), zero, confirm),
        (one & F.col("occ") & (stat == "D"), va, F.lit("OCC_NOT_ADJUSTED")),
        (one & F.col("occ") & (stat == "DA"), va / day_a, F.lit("OCC_NOT_ADJUSTED")),
        (two & (stat == "R"), ratio_or_zero(va, vb), ok),
        (two & (stat == "RA"), ratio_or_zero(va / day_a, vb / day_b), ok),
        (two & (stat == "D"), va - vb, confirm),
        (two & (stat == "DA"), va / day_a - vb / day_b, confirm),
        (two & (stat == "D_TA"), va - F.col("v_long") / F.lit(float(longest)), confirm),
        (two & (stat == "TOT"), va + vb, confirm),
    ]
    value = pick([(c, v) for c, v, _ in cases], zero)
    status = pick([(c, s) for c, _, s in cases], unresolved)
    return value, status


def map_features(tx: DataFrame, specs: DataFrame, as_of: Column) -> DataFrame:
    """One row per account x dictionary feature: value and mapping status.

    The dictionary joins on its category. A spec without a known category rides
    on ``_ALL``, which every account has, so it still yields its zero row. The
    dictionary has as many rows as the schema has features; it is counted before
    it may be broadcast.
    """
    known = reduce(lambda x, y: x | y, [F.col("category") == c for c in CATEGORIES])
    side = specs.where(F.col("feature") != LABEL_COLUMN).withColumn(
        "_cat", F.when(known, F.col("category")).otherwise("_ALL"))
    rows = account_categories(tx, as_of).withColumnRenamed("category", "_cat")
    joined = rows.join(broadcast_when_small(side, DICTIONARY_BROADCAST_ROWS), "_cat")
    joined = joined.withColumns(spec_lookups())
    value, status = feature_value()
    return joined.select("account_id", "row_no", "feature", "variable_name",
                         value.alias("value"), status.alias("status"))


def coverage(mapped: DataFrame, examples: int = 10) -> DataFrame:
    """Per account: counts by status, resolved and exact fractions, first unresolved features."""
    n = F.count(F.lit(1))
    by = {s: F.count_if(F.col("status") == s) for s in [
        "OK", "UNRESOLVED", "NEEDS_CONFIRMATION", "OCC_NOT_ADJUSTED", "CI_SPLIT_NOT_AVAILABLE"]}
    bad = F.when(F.col("status") == "UNRESOLVED", F.struct("row_no", "feature"))
    first = F.slice(F.sort_array(F.collect_list(bad)), 1, examples)
    return mapped.groupBy("account_id").agg(
        n.alias("total_features"), *[c.alias(f"n_{s.lower()}") for s, c in by.items()],
        ((n - by["UNRESOLVED"]) / n).alias("resolved_fraction"),
        (by["OK"] / n).alias("exact_fraction"),
        F.concat_ws(",", F.transform(first, lambda x: x["feature"])).alias("unresolved_examples"))


def occupation_benchmark(mapped: DataFrame, specs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Mean of each direct single-window feature per occupation.

    Raises when the account table has no occupation column.
    """
    if "occupation" not in accounts.columns:
        raise ValueError("no occupation column found: benchmarks not built")
    direct = specs.where(F.col("stat").isin("TOT", "MIN", "MAX", "AVG") & (F.size("windows") == 1))
    kept = mapped.join(broadcast_when_small(direct.select("feature"), DICTIONARY_BROADCAST_ROWS),
                       "feature", "left_semi")
    return kept.join(accounts.select("account_id", "occupation"), "account_id").groupBy(
        "feature", "occupation").agg(F.avg("value").alias("mean_value"))
