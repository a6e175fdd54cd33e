"""Rolling account features over closed 7/14/31-day windows.

All windows of one account x channel come from one scan and one hash
aggregate with conditional sums, which combines map-side: a very active
account sends one partial row per task and channel, not its history.
Nothing is repartitioned by account first, since that would move raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.safe import ratio_or_zero
from tillwatch.model import (
    CHANNELS, ELEC_XFER_MEMBERS, NON_CASH_CHQ_EXCLUDES, RATIO_PAIRS, WINDOW_DAYS)
from tillwatch.operators.ordering import running

BASIC = ["total_amt", "cr_amt", "db_amt", "total_txns", "cr_txns", "db_txns"]
EXTENDED = BASIC + ["min_amt", "max_amt", "avg_amt", "ci_total_amt", "ci_total_txns"]
BALANCE = ["min_bal", "max_bal", "avg_bal", "total_bal"]


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def in_window(as_of: Column, n_days: int) -> Column:
    """``as_of - n days <= ts <= as_of``, both ends closed."""
    return (F.col("ts") >= as_of - days(n_days)) & (F.col("ts") <= as_of)


# Wide feature sets are written as SQL text: the plan is the same, and building
# thousands of Column objects from Python would cost more than planning them.

def _inside(w: int) -> str:
    return f"ts >= _as_of - INTERVAL {int(w)} DAYS AND ts <= _as_of"


def _sum(cond: str, value: str = "amount") -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {cond}), 0) AS DOUBLE)"


def _count(cond: str) -> str:
    return f"count(1) FILTER (WHERE {cond})"


def _window_aggs(w: int, extended: bool) -> dict[str, str]:
    inside = _inside(w)
    credit, debit = f"{inside} AND direction = 'CREDIT'", f"{inside} AND direction = 'DEBIT'"
    out = {
        f"total_amt_{w}": _sum(inside), f"cr_amt_{w}": _sum(credit), f"db_amt_{w}": _sum(debit),
        f"total_txns_{w}": _count(inside), f"cr_txns_{w}": _count(credit), f"db_txns_{w}": _count(debit),
    }
    if extended:
        induced = f"{inside} AND is_customer_induced"
        n = f"nullif({_count(inside)}, 0)"
        out |= {
            f"min_amt_{w}": f"CAST(min(amount) FILTER (WHERE {inside}) AS DOUBLE)",
            f"max_amt_{w}": f"CAST(max(amount) FILTER (WHERE {inside}) AS DOUBLE)",
            f"avg_amt_{w}": f"coalesce({_sum(inside)} / {n}, 0D)",
            f"ci_total_amt_{w}": _sum(induced), f"ci_total_txns_{w}": _count(induced),
        }
    return out


def named(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS `{n}`" for n, e in exprs.items()]


def aggregate(df: DataFrame, keys: list[str], exprs: dict[str, str]) -> DataFrame:
    """``groupBy(keys).agg`` with the aggregates given as SQL text."""
    return df.groupBy(*keys).agg(*[F.expr(e) for e in named(exprs)])


def _horizon(tx: DataFrame, as_of: Column, windows: list[int]) -> DataFrame:
    """Keep only events some window can see; reaches the scan as a pushed filter."""
    return tx.where(in_window(as_of, max(windows))).withColumn("_as_of", as_of)


def stack_windows(wide: DataFrame, ids: list[str], stats: list[str], windows: list[int]) -> DataFrame:
    """``<stat>_<w>`` columns to one row per window."""
    rows = ", ".join(f"{w}, " + ", ".join(f"`{x}_{w}`" for x in stats) for w in windows)
    names = ", ".join(["window_days", *stats])
    return wide.selectExpr(*ids, f"stack({len(windows)}, {rows}) AS ({names})")


def channel_wide(tx: DataFrame, as_of: Column, windows=WINDOW_DAYS, extended: bool = True) -> DataFrame:
    """One row per account x channel with every window as its own columns."""
    aggs = {n: e for w in windows for n, e in _window_aggs(w, extended).items()}
    return aggregate(_horizon(tx, as_of, windows), ["account_id", "channel"], aggs)


def channel_windows(tx: DataFrame, as_of: Column, windows=WINDOW_DAYS, extended: bool = False) -> DataFrame:
    """Long form: (account, channel, window) with 6 basic or 11 extended statistics."""
    stats = EXTENDED if extended else BASIC
    wide = channel_wide(tx, as_of, windows, extended)
    out = stack_windows(wide, ["account_id", "channel"], stats, windows)
    if extended:
        out = out.withColumn("min_amt", F.coalesce("min_amt", F.lit(0.0))) \
                 .withColumn("max_amt", F.coalesce("max_amt", F.lit(0.0)))
    return out


def amount_ratios(wide: DataFrame, pairs=RATIO_PAIRS) -> DataFrame:
    """Short-to-long window amount ratios per account x channel, 0 on empty denominators."""
    return wide.select(
        "account_id", "channel",
        *[ratio_or_zero(F.col(f"total_amt_{a}"), F.col(f"total_amt_{b}")).alias(f"r_amt_{a}_{b}")
          for a, b in pairs])


def combined_of(channel: Column) -> Column:
    """The derived categories a channel belongs to."""
    return F.array_compact(F.array(
        F.lit("_ALL"),
        F.when(~channel.isin(NON_CASH_CHQ_EXCLUDES), F.lit("NON_CASH_CHQ")),
        F.when(channel.isin(ELEC_XFER_MEMBERS), F.lit("ELEC_XFER"))))


def combined_wide(wide: DataFrame, windows=WINDOW_DAYS) -> DataFrame:
    """Derived categories from the per-channel rows (at most 16 per account).

    Downstream names expect min/max/avg to be **summed** over channels; the
    genuine extremes and mean are added as ``true_*``. Codes outside the fixed
    list do not count, as no derived category contains them.
    """
    parts = wide.where(F.col("channel").isin(CHANNELS)).withColumn(
        "category", F.explode(combined_of(F.col("channel"))))
    aggs = {}
    for w in windows:
        aggs |= {f"{x}_{w}": f"sum(coalesce(`{x}_{w}`, 0))" for x in EXTENDED}
        aggs[f"true_min_amt_{w}"] = f"coalesce(min(min_amt_{w}), 0D)"
        aggs[f"true_max_amt_{w}"] = f"coalesce(max(max_amt_{w}), 0D)"
        aggs[f"true_avg_amt_{w}"] = f"coalesce(sum(total_amt_{w}) / nullif(sum(total_txns_{w}), 0), 0D)"
    return aggregate(parts, ["account_id", "category"], aggs)


def combined_windows(wide: DataFrame, windows=WINDOW_DAYS) -> DataFrame:
    stats = EXTENDED + ["true_min_amt", "true_max_amt", "true_avg_amt"]
    return stack_windows(combined_wide(wide, windows), ["account_id", "category"], stats, windows)


def balance_windows(tx: DataFrame, as_of: Column, windows=WINDOW_DAYS) -> DataFrame:
    """Min/max/avg/total of the non-null balances per account x window; empty is 0."""
    aggs = {}
    for w in windows:
        seen = f"{_inside(w)} AND balance_after IS NOT NULL"
        aggs[f"min_bal_{w}"] = f"coalesce(CAST(min(balance_after) FILTER (WHERE {seen}) AS DOUBLE), 0D)"
        aggs[f"max_bal_{w}"] = f"coalesce(CAST(max(balance_after) FILTER (WHERE {seen}) AS DOUBLE), 0D)"
        aggs[f"avg_bal_{w}"] = f"coalesce({_sum(seen, 'balance_after')} / nullif({_count(seen)}, 0), 0D)"
        aggs[f"total_bal_{w}"] = _sum(seen, "balance_after")
    return stack_windows(aggregate(_horizon(tx, as_of, windows), ["account_id"], aggs),
                         ["account_id"], BALANCE, windows)


def flat_columns(channels=CHANNELS, windows=WINDOW_DAYS, pairs=RATIO_PAIRS) -> list[str]:
    """Zero-filled ``<channel>_L<w>D_<STAT>`` and ratio expressions over pivoted columns."""
    out = []
    for c in channels:
        for w in windows:
            for x in BASIC:
                name = f"{c}_L{w}D_{x.upper()}"
                kind = "DOUBLE" if x.endswith("amt") else "BIGINT"
                out.append(f"CAST(coalesce(`{name}`, 0) AS {kind}) AS `{name}`")
        for a, b in pairs:
            num, den = f"`{c}_L{a}D_TOTAL_AMT`", f"`{c}_L{b}D_TOTAL_AMT`"
            out.append(f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0D), 0D) "
                       f"AS `R_{c}_AMT_L{a}_{b}D`")
    return out


def _pivot_channels(df: DataFrame, keys: list[str], channels, windows) -> DataFrame:
    """One row per key; inputs hold one row per key and channel. The value list is fixed."""
    keep = [F.expr(f"first(`{x}_{w}`) AS `L{w}D_{x.upper()}`") for w in windows for x in BASIC]
    return df.groupBy(*keys).pivot("channel", channels).agg(*keep)


def flat_features(tx: DataFrame, as_of: Column, channels=CHANNELS, windows=WINDOW_DAYS,
                  pairs=RATIO_PAIRS) -> DataFrame:
    """One row per account: ``<channel>_L<w>D_<STAT>`` and ``R_<channel>_AMT_L<a>_<b>D``.

    The pivot runs on the aggregated account x channel rows with a fixed value
    list, so it needs no extra job and its schema never depends on the data.
    """
    wide = channel_wide(tx, as_of, windows, extended=False)
    piv = _pivot_channels(wide, ["account_id"], channels, windows)
    return piv.selectExpr("account_id", *flat_columns(channels, windows, pairs))


def window_bands(windows_long: DataFrame, measures: list[str], windows=WINDOW_DAYS,
                 key: str = "account_id") -> DataFrame:
    """Cumulative window totals to disjoint bands, each floored at 0.

    The band of a window is its total minus the total of the nearest shorter
    window that is not NULL; a NULL window yields no band. There are only a
    few windows per account, so this is one aggregate with fixed columns.
    """
    aggs = [F.max(F.when(F.col("window_days") == w, F.col(m))).alias(f"{m}_{w}")
            for m in measures for w in windows]
    one = windows_long.groupBy(key).agg(*aggs)
    bands = []
    for i, w in enumerate(windows):
        shorter = list(reversed(windows[:i]))
        fields = [F.lit(windows[i - 1] if i else 0).alias("band_from"), F.lit(w).alias("band_to")]
        for m in measures:
            prev = F.coalesce(*[F.col(f"{m}_{s}") for s in shorter], F.lit(0)) if shorter else F.lit(0)
            fields.append(F.greatest(F.col(f"{m}_{w}") - prev, F.lit(0)).alias(m))
        bands.append(F.when(F.col(f"{measures[0]}_{w}").isNotNull(), F.struct(*fields)))
    return one.select(key, F.explode(F.array_compact(F.array(*bands))).alias("b")).select(key, "b.*")


def _cents() -> Column:
    """Amounts as whole cents: sums stay exact and run on plain longs, not decimals."""
    return F.expr("CAST(amount * 100 AS BIGINT) AS _cents")


def event_rolling(tx: DataFrame, windows=WINDOW_DAYS, bucket_hours: int = 6) -> DataFrame:
    """Per event: amount and count of the account's events in the closed window ending at it.

    Written as a sweep instead of RANGE frames: every event adds its amount at
    ``ts`` and takes it back just after ``ts + w``. A rolling total is then a
    running total, which can be split by (account, time bucket), so an account
    with a third of all events is spread over its buckets. Offsets hold one row
    per account and bucket.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = tx.select("event_id", "account_id", _cents(), (micros * 2).alias("_at"))
    steps = [F.struct(F.col("_at").alias("at"), F.lit(0).alias("w"))]
    steps += [F.struct((F.col("_at") + F.lit(w * 86_400_000_000 * 2 + 1)).alias("at"),
                       F.lit(w).alias("w")) for w in windows]
    sweep = base.withColumn("s", F.explode(F.array(*steps))).select(
        "event_id", "account_id", "_cents", F.col("s.at").alias("_at"), F.col("s.w").alias("_w"))
    sums = {}
    for w in windows:
        sign = f"CASE _w WHEN 0 THEN 1 WHEN {w} THEN -1 ELSE 0 END"
        sums[f"n_{w}"] = sign
        sums[f"amt_{w}"] = f"_cents * {sign}"
    bucket = F.floor(F.col("_at") / F.lit(bucket_hours * 3_600_000_000 * 2))
    done = running(sweep, ["account_id"], "_at", sums, bucket).where(F.col("_w") == 0)
    return done.select(
        "event_id", "account_id",
        *[(F.col(f"amt_{w}") / F.lit(100.0)).alias(f"amt_{w}") for w in windows],
        *[F.col(f"n_{w}").cast("long").alias(f"n_{w}") for w in windows])


def features_at(points: DataFrame, tx: DataFrame, channels=CHANNELS, windows=WINDOW_DAYS,
                pairs=RATIO_PAIRS, bucket_hours: int = 6) -> DataFrame:
    """The flat features of every point (event_id, account_id, ts) as of its own time.

    The same sweep as ``event_rolling``, keyed by account and channel, with the
    points as extra rows that read the running totals. Cost is linear in
    events and points; no event is paired with another.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp")) * 2
    steps = [F.struct(F.lit(0).cast("long").alias("shift"), F.lit(0).alias("w"))]
    steps += [F.struct(F.lit(w * 86_400_000_000 * 2 + 1).cast("long").alias("shift"), F.lit(w).alias("w"))
              for w in windows]
    moves = tx.where(F.col("channel").isin(channels)).select(
        F.lit(None).cast(points.schema["event_id"].dataType).alias("event_id"), "account_id", "channel",
        "direction", _cents(), micros.alias("_m"), F.explode(F.array(*steps)).alias("s"))
    moves = moves.select("event_id", "account_id", "channel", "direction", "_cents",
                         (F.col("_m") + F.col("s.shift")).alias("_at"), F.col("s.w").alias("_w"))
    reads = points.select(
        "event_id", "account_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"),
        F.lit(None).cast("string").alias("direction"), F.lit(0).cast("long").alias("_cents"),
        micros.alias("_at"), F.lit(-1).alias("_w"))
    sums = {}
    for w in windows:
        for tag, cond in [("total", "true"), ("cr", "direction = 'CREDIT'"), ("db", "direction = 'DEBIT'")]:
            sign = f"CASE WHEN _w = 0 AND {cond} THEN 1 WHEN _w = {w} AND {cond} THEN -1 ELSE 0 END"
            sums[f"{tag}_amt_{w}"] = f"_cents * {sign}"
            sums[f"{tag}_txns_{w}"] = sign
    bucket = F.floor(F.col("_at") / F.lit(bucket_hours * 3_600_000_000 * 2))
    done = running(moves.unionByName(reads), ["account_id", "channel"], "_at", sums, bucket)
    done = done.where(F.col("_w") == -1)
    amounts = [c for c in done.columns if "_amt_" in c]
    done = done.selectExpr(*[f"{c} / 100D AS {c}" if c in amounts else c for c in done.columns])
    piv = _pivot_channels(done, ["event_id", "account_id"], channels, windows)
    return piv.selectExpr("event_id", "account_id", *flat_columns(channels, windows, pairs))
