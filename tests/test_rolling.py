"""Rolling features on hand-made transactions, and their invariants."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillwatch.operators import rolling as R
from tillwatch.plans.views import as_of_col, transactions

AS_OF = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = ("event_id long, account_id string, ts timestamp, channel string, direction string, "
          "amount decimal(18,2), balance_after decimal(18,2), is_customer_induced boolean")


def make_tx(spark, rows):
    """rows of (account, days ago, channel, direction, amount[, balance])."""
    from decimal import Decimal
    data = [(i, r[0], AS_OF - timedelta(days=r[1]), r[2], r[3], Decimal(str(r[4])),
             Decimal(str(r[5])) if len(r) > 5 else None, True) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


MIXED = [("A1", 2, "CASH", "CREDIT", 1000), ("A1", 3, "CASH", "DEBIT", 400), ("A1", 10, "CASH", "CREDIT", 5000),
         ("A1", 1, "UPI", "CREDIT", 200), ("A1", 1, "NEFT", "CREDIT", 300), ("A1", 1, "IMPS", "CREDIT", 100)]


def at():
    return F.lit(AS_OF).cast("timestamp")


def test_hand_computed_channel_statistics(spark):
    rows = {(r.channel, r.window_days): r for r in
            R.channel_windows(make_tx(spark, MIXED), at(), extended=True).collect()}
    week = rows["CASH", 7]
    assert (week.total_amt, week.cr_amt, week.db_amt) == (1400, 1000, 400)
    assert (week.min_amt, week.max_amt, week.avg_amt) == (400, 1000, 700)
    assert rows["CASH", 31].total_amt == 6400


def test_combined_categories_sum_members(spark):
    wide = R.channel_wide(make_tx(spark, MIXED), at())
    rows = {(r.category, r.window_days): r for r in R.combined_windows(wide).collect()}
    assert rows["ELEC_XFER", 7].total_amt == 400
    assert rows["NON_CASH_CHQ", 7].total_amt == 600
    assert rows["_ALL", 7].total_amt == 2000
    # summed extremes are the contract; the real ones are separate
    assert rows["_ALL", 7].min_amt == 400 + 200 + 300 + 100
    assert rows["_ALL", 7].true_min_amt == 100


def test_windows_nest_and_accounts_do_not_mix(spark):
    tx = make_tx(spark, [("ACC1", 3, "CASH", "CREDIT", 1000), ("ACC1", 20, "CASH", "CREDIT", 5000),
                         ("ACC2", 0, "CASH", "CREDIT", 999999)])
    rows = {(r.account_id, r.window_days): r.total_amt for r in R.channel_windows(tx, at()).collect()}
    assert rows["ACC1", 7] == 1000 and rows["ACC1", 31] == 6000 and rows["ACC2", 7] == 999999


def test_window_ends_are_closed_and_future_is_ignored(spark):
    tx = make_tx(spark, [("A", 7, "UPI", "CREDIT", 1), ("A", 0, "UPI", "CREDIT", 2), ("A", -1, "UPI", "CREDIT", 4)])
    rows = {r.window_days: r.total_amt for r in R.channel_windows(tx, at()).collect()}
    assert rows == {7: 3, 14: 3, 31: 3}


def test_balances(spark):
    tx = make_tx(spark, [("A", 1, "UPI", "CREDIT", 1, 5000), ("A", 2, "UPI", "DEBIT", 1, 4900), ("A", 3, "UPI", "DEBIT", 1)])
    week = R.balance_windows(tx, at()).where("window_days = 7").first()
    assert (week.min_bal, week.max_bal, week.avg_bal, week.total_bal) == (4900, 5000, 4950, 9900)


def test_bands_add_up_and_null_windows_are_skipped(spark):
    long = spark.createDataFrame([("A", 7, 10.0), ("A", 14, 25.0), ("A", 31, 20.0), ("B", 7, 1.0), ("B", 14, None),
                                  ("B", 31, 9.0)], "account_id string, window_days int, amt double")
    got = {(r.account_id, r.band_to): r.amt for r in R.window_bands(long, ["amt"]).collect()}
    assert got == {("A", 7): 10, ("A", 14): 15, ("A", 31): 0, ("B", 7): 1, ("B", 31): 8}


def test_flat_schema_is_fixed(spark):
    df = R.flat_features(make_tx(spark, MIXED), at())
    assert len(df.columns) == 1 + 16 * (3 * 6 + 2)
    row = df.first()
    assert row["GST_L7D_TOTAL_AMT"] == 0 and row["R_CASH_AMT_L7_14D"] == pytest.approx(1400 / 6400)


@pytest.mark.parametrize("bucket_hours", [1, 6, 24 * 365])
def test_event_rolling_equals_brute_force_with_a_hot_account(spark, bucket_hours):
    rows = [("HOT", (i * 37 % 800) / 20, "UPI", "CREDIT", i % 13) for i in range(300)]
    rows += [("B", i * 1.5, "UPI", "CREDIT", i) for i in range(40)]
    tx = make_tx(spark, rows)
    got = {r.event_id: (r.amt_7, r.n_7, r.amt_31, r.n_31)
           for r in R.event_rolling(tx, bucket_hours=bucket_hours).collect()}
    for i, (acc, ago, *_r) in enumerate(rows):
        want = []
        for w in (7, 31):
            t = AS_OF - timedelta(days=ago)
            inside = [r[4] for r in rows if r[0] == acc and t - timedelta(days=w) <= AS_OF - timedelta(days=r[1]) <= t]
            want += [sum(inside), len(inside)]
        assert got[i] == tuple(want)


def test_features_at_equal_batch_features_as_of_each_event(spark):
    tx = make_tx(spark, MIXED)
    points = tx.where("event_id = 0").select("event_id", "account_id", "ts")
    at_event = R.features_at(points, tx, ["CASH", "UPI"]).first()
    batch = R.flat_features(tx, F.lit(AS_OF - timedelta(days=2)).cast("timestamp"), ["CASH", "UPI"]).first()
    for c in batch.asDict():
        if c != "account_id":
            assert at_event[c] == batch[c], c


def test_channels_add_up_to_all_on_given_data(spark, sf):
    tx = transactions(spark, sf)
    wide = R.channel_wide(tx, as_of_col())
    parts = wide.agg(F.sum("total_amt_31"), F.sum("total_txns_31")).first()
    whole = R.combined_wide(wide).where("category = '_ALL'").agg(F.sum("total_amt_31"), F.sum("total_txns_31")).first()
    assert parts[0] == pytest.approx(whole[0]) and parts[1] == whole[1]


def test_filter_reaches_the_scan(spark, sf):
    plan = R.channel_wide(transactions(spark, sf), as_of_col())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan
    assert plan.count("Exchange hashpartitioning") == 1
