"""Results do not depend on sizes, lateness or missing keys."""

import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.learn.anomaly import FrozenEcod, rank_ladder
from tillwatch.operators import ordering as O
from tillwatch.operators.clean import to_long
from tillwatch.operators.joins import counterparty_exposure
from tillwatch.operators.ledger import judge_overrides
from tillwatch.operators.profiles import ecod_raw
from tillwatch.session import Scratch, delete_folder, folder_exists, settle
from tillwatch.sources import kafka as K
from tillwatch.streaming.transactions import TransactionJob


def test_join_keeps_null_unknown_and_hot_keys_at_any_size(spark):
    df = spark.range(4000).select("id", F.expr(
        "CASE WHEN id < 1500 THEN 'hot' WHEN id < 2500 THEN NULL WHEN id < 2600 THEN 'unknown' ELSE concat('k', id) END AS k"))
    per = df.where("k <> 'unknown'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = [sorted(map(tuple, O.join_per_value(df, per, ["k"], rows).collect()), key=repr) for rows in (50_000, 0)]
    assert got[0] == got[1] and len(got[0]) == 4000
    assert sum(r[2] is None for r in got[0]) == 1100
    assert sum(r[0] == "hot" and r[2] == 0 for r in got[0]) == 1500


@pytest.fixture(params=[50_000, 0])
def broadcast_rows(request, monkeypatch):
    """Both sides of the size switch, for the operators that call the join."""
    join = O.join_per_value
    forced = lambda df, per, on: join(df, per, on, request.param)
    for module in ("tillwatch.operators.ordering", "tillwatch.operators.ledger", "tillwatch.operators.joins"):
        monkeypatch.setattr(f"{module}.join_per_value", forced)


def test_null_scores_keep_their_row_without_a_rank(spark, broadcast_rows):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "account_id int, score double")
    assert {r.account_id: r.avg_rank for r in O.average_ranks(df, [], "score").collect()} == {1: 2.0, 2: None, 3: 1.0}


def test_an_override_without_an_action_is_answered(spark, broadcast_rows):
    requests = spark.createDataFrame([(1, None, "i", "reason enough", 1), (2, "a", "i", "reason enough", 1)],
                                     "request_id int, action_id string, investigator_id string, reason string, ts int")
    actions = spark.createDataFrame([("a",)], "action_id string")
    got = {r.request_id: r.cause for r in judge_overrides(requests, actions, actions.limit(0)).collect()}
    assert got == {1: "no such action", 2: None}


def test_an_account_with_a_null_counterparty_stays(spark, broadcast_rows):
    edges = spark.createDataFrame([(1, None), (2, "x")], "account_id int, counterparty_id string")
    flagged = spark.createDataFrame([("x",)], "counterparty_id string")
    got = {r.account_id: r.counterparty_flagged_count for r in counterparty_exposure(edges, flagged).collect()}
    assert got == {1: 0, 2: 1}


def test_rank_ladder_is_exact_in_the_tails_and_short():
    ladder = rank_ladder(10**9, 1.005)
    assert ladder[:200] == list(range(1, 201)) and ladder[-200:] == list(range(10**9 - 199, 10**9 + 1))
    assert len(ladder) < 8000 and rank_ladder(5, 1.005) == [1, 2, 3, 4, 5] and rank_ladder(0, 1.005) == []


def test_frozen_ecod_equals_the_exact_one_beyond_its_landmarks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.lognormal(size=(20_000, 2)))]
    df = settle(spark.createDataFrame(rows, "account_id int, a double, b double"))
    exact = {r.account_id: r.ecod for r in ecod_raw(to_long(df, ["a", "b"])).collect()}
    frozen = {r.account_id: r.e for r in df.select("account_id", FrozenEcod.fit(df, ["a", "b"]).column().alias("e")).collect()}
    assert max(abs(exact[k] - frozen[k]) for k in exact) < 0.011  # two columns within the ladder's ratio
    top = sorted(exact, key=exact.get)[-20:]
    assert all(frozen[k] == pytest.approx(exact[k], abs=0.006) for k in top)


def score(f):
    return f.withColumn("score", F.col("CASH_L31D_TOTAL_AMT") / F.lit(1000.0))


def job(spark, tmp_path, lines_per_file):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, lines in enumerate(lines_per_file):
        path = folder / f"part-{i:03d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    off = lambda s: s.createDataFrame([(1, "DEACTIVATE")], "id int, event string")
    done = TransactionJob(str(tmp_path / "out"), score, off, channels=["CASH"])
    done.start(K.read_json_files(spark, str(folder), 1), str(tmp_path / "checkpoint")).awaitTermination()
    return done


def message(ts, amount, **more):
    return json.dumps({"account_id": "A", "timestamp": ts.isoformat(), "channel": "CASH", "direction": "CREDIT",
                       "amount": amount, **more})


def test_equal_messages_without_an_id_are_two_events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    done = job(spark, tmp_path, [[message(t, 10.0), message(t, 10.0)]])
    rows = spark.read.parquet(done.path("results")).collect()
    assert len(rows) == 2 and all(r.score == pytest.approx(0.02) for r in rows)


def test_late_events_are_kept_and_count_later(spark, tmp_path):
    t = datetime(2024, 1, 20)
    files = [[message(t, 1.0, event_id="a")], [message(t + timedelta(days=1), 2.0, event_id="b")],
             [message(t - timedelta(days=10), 4.0, event_id="late")], [message(t + timedelta(days=2), 8.0, event_id="c"),
                                                                       message(t, 1.0, event_id="a")]]
    done = job(spark, tmp_path, files)
    got = {r.event_id: round(r.score * 1000, 6) for r in spark.read.parquet(done.path("results")).collect()}
    assert got == {"a": 1.0, "b": 3.0, "late": 4.0, "c": 15.0}


def test_unreadable_payloads_are_put_aside(spark, tmp_path):
    t = datetime(2024, 1, 1)
    bad = ["not json", json.dumps({"timestamp": t.isoformat()}), message(t, 1.0).replace("2024-01-01T", "20x4-")]
    done = job(spark, tmp_path, [[message(t, 10.0), *bad]])
    assert spark.read.parquet(done.path("results")).count() == 1
    assert sorted(r.payload for r in spark.read.parquet(done.path("quarantine")).collect()) == sorted(bad)


def test_topic_positions_name_messages(spark):
    t = datetime(2024, 1, 1)
    raw = spark.createDataFrame([(message(t, 1.0), "t", 0, 1), (message(t, 1.0), "t", 0, 2)],
                                "value string, topic string, partition int, offset bigint")
    assert K.parse_messages(raw).select("event_id").distinct().count() == 2


def test_scratch_deletes_what_it_settled(spark):
    with Scratch(spark) as scratch:
        path = scratch.folder()
        spark.range(3).write.parquet(path)
        assert folder_exists(spark, path)
    assert not folder_exists(spark, path)
    delete_folder(spark, path)  # a second time does no harm
