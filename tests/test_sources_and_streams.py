"""Exports, stored tables and multi-batch streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillwatch.operators.rolling import features_at
from tillwatch.sources import kafka as K
from tillwatch.sources import tables as T
from tillwatch.sources import transactions as S
from tillwatch.streaming.transactions import TransactionJob, sweep_expired

HEAD = "ACCT_ID,TXN_DATE,TXN_TIME,CHANNEL,DR_CR,AMOUNT,BALANCE\n"


def test_exports_parse(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "A,2024-01-01,10:00:00,CASH,cr,10.50,\n")
    (tmp_path / "b.csv").write_text(HEAD + "B,2024-01-02,10:00:00,UPI,DR,3,99.5\n")
    rows = S.read_exports(spark, str(tmp_path)).orderBy("account_id").collect()
    assert [(r.account_id, r.direction, float(r.amount), r.balance_after) for r in rows][0] == ("A", "CREDIT", 10.5, None)
    assert rows[1].direction == "DEBIT" and float(rows[1].balance_after) == 99.5
    since = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert S.read_exports(spark, str(tmp_path), since).count() == 1


def test_export_without_a_required_column_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ACCT_ID,TXN_DATE\nA,2024-01-01\n")
    with pytest.raises(S.ExportFormatError):
        S.read_exports(spark, str(tmp_path))


def test_oof_store_replaces_one_model_only(spark, tmp_path):
    path = str(tmp_path / "oof")
    row = lambda m, s: spark.createDataFrame([(1, 0, s, m)], "account_id int, fold int, score double, model string")
    T.write_oof(row("a", 0.1), path)
    T.write_oof(row("b", 0.2), path)
    T.write_oof(row("a", 0.3), path)
    assert {r.model: r.score for r in T.read_oof(spark, path).collect()} == {"a": 0.3, "b": 0.2}


def test_batch_replay_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1)], "account_id string, x int")
    for b in (0, 1, 1):
        T.append_batch(df, path, b)
    assert spark.read.parquet(path).count() == 2


def test_predictions_are_unique_per_account_and_version(spark):
    old = spark.createDataFrame([(1, "v1")], "account_id int, model_version string")
    new = spark.createDataFrame([(1, "v1"), (1, "v2"), (1, "v2")], "account_id int, model_version string")
    assert [(r.account_id, r.model_version) for r in T.insert_predictions(new, old).collect()] == [(1, "v2")]


def cash_score(f):
    return f.withColumn("score", F.when(F.col("CASH_L7D_TOTAL_AMT") > 200000, 0.97).otherwise(0.1))


def switch(spark, on):
    return spark.createDataFrame([(1, "ACTIVATE" if on else "DEACTIVATE")], "id int, event string")


def run(spark, folder, root, on=False, cross=None):
    job = TransactionJob(root, cash_score, lambda s: switch(s, on), cross, channels=["CASH", "UPI"])
    job.start(K.read_json_files(spark, folder, 1), f"{root}/checkpoint").awaitTermination()
    return job


def write_messages(folder, messages, per_file):
    folder.mkdir(exist_ok=True)
    for i in range(0, len(messages), per_file):
        (folder / f"part-{i:05d}.json").write_text("\n".join(json.dumps(m) for m in messages[i:i + per_file]))


def message(i, acc, ts, channel, amount, direction="CREDIT"):
    return {"event_id": str(i), "account_id": acc, "timestamp": ts.isoformat(), "channel": channel,
            "direction": direction, "amount": amount}


def test_gate_hold_notice_and_suppression(spark, tmp_path):
    t = datetime(2024, 1, 1)
    write_messages(tmp_path / "in", [message(1, "A", t, "CASH", 500000.0), message(2, "B", t, "UPI", 500.0, "DEBIT")], 10)
    cross = lambda s: s.createDataFrame([("A", True, 2, 0.5)], "account_id string, flagged boolean, "  # noqa: E731
                                        "counterparty_flagged_count int, cross_bank_velocity_score double")
    job = run(spark, str(tmp_path / "in"), str(tmp_path / "off"), cross=cross)
    rows = {r.account_id: r for r in spark.read.parquet(job.path("results")).collect()}
    assert rows["A"].action == "AUTO-HOLD" and rows["A"].action_id in rows["A"].customer_notice
    assert rows["A"].cross_bank_flagged == 1 and rows["B"].action is None and rows["B"].customer_notice is None
    acts = T.read_actions(spark, job.path("actions"))
    assert acts.count() == 1
    later = F.lit("2024-02-01 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "action_id string")
    assert sweep_expired(acts, none, later, str(tmp_path / "overrides")).count() == 1
    on = run(spark, str(tmp_path / "in"), str(tmp_path / "on"), on=True)
    rows = {r.account_id: r for r in spark.read.parquet(on.path("results")).collect()}
    assert rows["A"].action == "SUPPRESSED_BY_KILL_SWITCH"
    assert T.read_actions(spark, on.path("actions")).count() == 0


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    msgs = [message(i, f"A{i % 3 if i % 2 else 0}", t0 + timedelta(hours=9 * i), ["CASH", "UPI"][i % 2], float(1000 * (i % 7) + 1))
            for i in range(60)]
    write_messages(tmp_path / "in", msgs + [msgs[-1]], 16)  # one duplicate at the end
    job = run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    res = spark.read.parquet(job.path("results"))
    assert res.count() == 60 and res.select("batch_id").distinct().count() >= 4
    rows = spark.read.text(str(tmp_path / "in"))
    tx = K.parse_messages(rows).dropDuplicates(["event_id"])
    feats = features_at(tx.select("event_id", "account_id", "ts"), tx, ["CASH", "UPI"])
    want = {r.event_id: r.score for r in cash_score(feats).collect()}
    assert {r.event_id: r.score for r in res.collect()} == want
    online = {r.account_id: r for r in T.online_features(spark, job.path("online")).collect()}
    last = {r.account_id: r for r in feats.join(tx.select("event_id", "ts"), "event_id").orderBy("ts").collect()}
    for acc, row in online.items():
        assert row["CASH_L31D_TOTAL_AMT"] == last[acc]["CASH_L31D_TOTAL_AMT"]


def test_bad_payloads_are_dropped(spark):
    df = spark.createDataFrame([("not json",), (json.dumps(message(1, "A", datetime(2024, 1, 1), "UPI", 1.0)),)], "value string")
    assert K.parse_messages(df).count() == 1
