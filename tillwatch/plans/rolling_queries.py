"""Registered rolling-feature queries and their SQL."""

from pyspark.sql import functions as F

from tillwatch.model import CHANNELS, RATIO_PAIRS, WINDOW_DAYS
from tillwatch.operators import rolling as R
from tillwatch.plans.registry import query
from tillwatch.plans.views import AS_OF, TX, as_of_col, transactions

_T = f"TIMESTAMP '{AS_OF}'"


def _in(w):
    return f"ts >= {_T} - INTERVAL {w} DAY AND ts <= {_T}"


def _stats(w, extra=""):
    cond = _in(w) + extra
    return {
        "total_amt": f"CAST(coalesce(sum(amount) FILTER (WHERE {cond}), 0) AS DOUBLE)",
        "cr_amt": f"CAST(coalesce(sum(amount) FILTER (WHERE {cond} AND direction = 'CREDIT'), 0) AS DOUBLE)",
        "db_amt": f"CAST(coalesce(sum(amount) FILTER (WHERE {cond} AND direction = 'DEBIT'), 0) AS DOUBLE)",
        "total_txns": f"count(*) FILTER (WHERE {cond})",
        "cr_txns": f"count(*) FILTER (WHERE {cond} AND direction = 'CREDIT')",
        "db_txns": f"count(*) FILTER (WHERE {cond} AND direction = 'DEBIT')",
        "min_amt": f"CAST(coalesce(min(amount) FILTER (WHERE {cond}), 0) AS DOUBLE)",
        "max_amt": f"CAST(coalesce(max(amount) FILTER (WHERE {cond}), 0) AS DOUBLE)",
        "avg_amt": f"coalesce(CAST(sum(amount) FILTER (WHERE {cond}) AS DOUBLE) / count(*) FILTER (WHERE {cond}), 0)",
        "ci_total_amt": f"CAST(coalesce(sum(amount) FILTER (WHERE {cond} AND is_customer_induced), 0) AS DOUBLE)",
        "ci_total_txns": f"count(*) FILTER (WHERE {cond} AND is_customer_induced)",
    }


def _select(w, names):
    s = _stats(w)
    return ", ".join(f"{s[n]} AS {n}" for n in names)


def _long(names, source="tx"):
    return " UNION ALL ".join(
        f"SELECT account_id, channel, {w} AS window_days, {_select(w, names)} FROM {source} "
        f"WHERE {_in(31)} GROUP BY account_id, channel" for w in WINDOW_DAYS)


EXT = f"ext AS ({_long(R.EXTENDED)})"


def combined_sql(cat, cond):
    sums = ", ".join(
        f"CAST(sum({s}) AS {'BIGINT' if s.endswith('txns') else 'DOUBLE'}) AS {s}" for s in R.EXTENDED)
    return (f"SELECT account_id, '{cat}' AS category, window_days, {sums}, "
            "coalesce(min(min_amt) FILTER (WHERE total_txns > 0), 0.0) AS true_min_amt, "
            "coalesce(max(max_amt) FILTER (WHERE total_txns > 0), 0.0) AS true_max_amt, "
            "CASE WHEN sum(total_txns) = 0 THEN 0.0 ELSE sum(total_amt) / sum(total_txns) END AS true_avg_amt "
            f"FROM ext WHERE {cond} GROUP BY account_id, window_days")


COMBINED = "comb AS (" + " UNION ALL ".join([
    combined_sql("_ALL", "true"),
    combined_sql("NON_CASH_CHQ", "channel NOT IN ('CASH', 'CHEQUE')"),
    combined_sql("ELEC_XFER", "channel IN ('NEFT', 'IMPS', 'RTGS')"),
]) + ")"


def _round_amounts(df, names):
    return df.select(*[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns])


_BAL = "bal AS (" + " UNION ALL ".join(
    f"""SELECT account_id, {w} AS window_days,
    coalesce(CAST(min(balance_after) FILTER (WHERE {_in(w)}) AS DOUBLE), 0) AS min_bal,
    coalesce(CAST(max(balance_after) FILTER (WHERE {_in(w)}) AS DOUBLE), 0) AS max_bal,
    coalesce(CAST(sum(balance_after) FILTER (WHERE {_in(w)}) AS DOUBLE)
             / count(balance_after) FILTER (WHERE {_in(w)}), 0) AS avg_bal,
    coalesce(CAST(sum(balance_after) FILTER (WHERE {_in(w)}) AS DOUBLE), 0) AS total_bal
    FROM tx WHERE {_in(31)} GROUP BY account_id""" for w in WINDOW_DAYS) + ")"
BAL = _BAL


@query("rolling_channel", f"""WITH {TX}, a AS (
  SELECT account_id, channel, {', '.join(f'{e} AS {n}_{w}' for w in WINDOW_DAYS
                                          for n, e in list(_stats(w).items())[:6])}
  FROM tx WHERE {_in(31)} GROUP BY account_id, channel)
SELECT *, {', '.join(f'coalesce(round(total_amt_{a} / nullif(total_amt_{b}, 0), 6), 0) AS r_amt_{a}_{b}'
                     for a, b in RATIO_PAIRS)} FROM a""")
def rolling_channel(spark, sf):
    wide = R.channel_wide(transactions(spark, sf), as_of_col(), extended=False)
    return wide.select("*", *[
        F.round(R.ratio_or_zero(F.col(f"total_amt_{a}"), F.col(f"total_amt_{b}")), 6).alias(f"r_amt_{a}_{b}")
        for a, b in RATIO_PAIRS])


def _flat_sql():
    cols = []
    for c in CHANNELS:
        for w in WINDOW_DAYS:
            s = _stats(w, f" AND channel = '{c}'")
            cols += [f"{s[n]} AS {c}_L{w}D_{n.upper()}" for n in R.BASIC]
    ratios = [f"coalesce(round({c}_L{a}D_TOTAL_AMT / nullif({c}_L{b}D_TOTAL_AMT, 0), 6), 0) AS R_{c}_AMT_L{a}_{b}D"
              for c in CHANNELS for a, b in RATIO_PAIRS]
    return (f"WITH {TX}, a AS (SELECT account_id, {', '.join(cols)} FROM tx WHERE {_in(31)} "
            f"GROUP BY account_id) SELECT *, {', '.join(ratios)} FROM a")


@query("rolling_wide", _flat_sql())
def rolling_wide(spark, sf):
    df = R.flat_features(transactions(spark, sf), as_of_col())
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("R_") else F.col(c) for c in df.columns])


@query("rolling_extended", f"WITH {TX}, {EXT} SELECT * FROM ext")
def rolling_extended(spark, sf):
    return R.channel_windows(transactions(spark, sf), as_of_col(), extended=True)


_AMTS = [c for c in R.EXTENDED if c.endswith("amt")] + ["true_avg_amt"]


@query("rolling_combined", f"""WITH {TX}, {EXT}, {COMBINED}
SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in _AMTS)}) FROM comb""")
def rolling_combined(spark, sf):
    wide = R.channel_wide(transactions(spark, sf), as_of_col())
    return _round_amounts(R.combined_windows(wide), _AMTS)


@query("rolling_balance", f"WITH {TX}, {BAL} SELECT * FROM bal")
def rolling_balance(spark, sf):
    return R.balance_windows(transactions(spark, sf), as_of_col())


@query("window_bands", f"""WITH {TX}, t AS (
  SELECT account_id, {', '.join(f"{_stats(w)['total_amt']} AS a{w}, {_stats(w)['total_txns']} AS n{w}" for w in WINDOW_DAYS)}
  FROM tx WHERE {_in(31)} GROUP BY account_id)
SELECT account_id, 0 AS band_from, 7 AS band_to, round(a7, 9) AS total_amt, n7 AS total_txns FROM t
UNION ALL SELECT account_id, 7, 14, round(greatest(a14 - a7, 0), 9), greatest(n14 - n7, 0) FROM t
UNION ALL SELECT account_id, 14, 31, round(greatest(a31 - a14, 0), 9), greatest(n31 - n14, 0) FROM t""")
def window_bands(spark, sf):
    tx = transactions(spark, sf).withColumn("channel", F.lit("_ALL"))
    long = R.channel_windows(tx, as_of_col())
    return _round_amounts(R.window_bands(long, ["total_amt", "total_txns"]), ["total_amt"])


@query("event_rolling", f"""WITH {TX} SELECT event_id, account_id,
{', '.join(f'''CAST(sum(amount) OVER w{w} AS DOUBLE) AS amt_{w}, count(*) OVER w{w} AS n_{w}''' for w in WINDOW_DAYS)}
FROM tx WINDOW {', '.join(f'''w{w} AS (PARTITION BY account_id ORDER BY ts
RANGE BETWEEN INTERVAL {w} DAY PRECEDING AND CURRENT ROW)''' for w in WINDOW_DAYS)}""")
def event_rolling(spark, sf):
    return R.event_rolling(transactions(spark, sf))
