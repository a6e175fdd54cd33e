"""Keyed stream state: what is read, what is kept, parts of active accounts, bucketed upserts, expiry timers."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tillwatch.operators.rolling import features_at
from tillwatch.sources import kafka as K
from tillwatch.sources import tables as T
from tillwatch.streaming.transactions import TransactionJob

T0 = datetime(2024, 1, 1)


def message(i, acc, ts, channel, amount, direction="CREDIT"):
    return json.dumps({"event_id": str(i), "account_id": acc, "timestamp": ts.isoformat(), "channel": channel,
                       "direction": direction, "amount": amount})


def write(folder, batches):
    folder.mkdir(exist_ok=True)
    done = len(list(folder.iterdir()))
    for n, lines in enumerate(batches, done):
        path = folder / f"part-{n:05d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age


def score(f):
    return f.withColumn("score", (F.col("CASH_L31D_TOTAL_AMT") + F.col("UPI_L7D_DB_AMT")) / F.lit(1e6))


def run(spark, tmp_path, **more):
    off = lambda s: s.createDataFrame([(1, "DEACTIVATE")], "id int, event string")
    job = TransactionJob(str(tmp_path / "out"), score, off, channels=["CASH", "UPI"], **more)
    job.start(K.read_json_files(spark, str(tmp_path / "in"), 1), str(tmp_path / "checkpoint")).awaitTermination()
    return job


def events(n, accounts=3):
    return [message(i, f"A{i * i % accounts}", T0 + timedelta(hours=7 * i, microseconds=i), ["CASH", "UPI", "ODD"][i % 3],
                    float(10 * i + 1), ["CREDIT", "DEBIT"][i % 2]) for i in range(n)]


def expected(spark, lines):
    tx = K.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string")).dropDuplicates(["event_id"])
    feats = features_at(tx.select("event_id", "account_id", "ts"), tx, ["CASH", "UPI"])
    return {r.event_id: r.score for r in score(feats).collect()}


def results(spark, job):
    return {r.event_id: r.score for r in spark.read.parquet(job.path("results")).collect()}


def test_state_answers_without_history(spark, tmp_path, monkeypatch):
    """Batches in order, over two runs, with repeats: no batch reads the history table."""
    lines = events(120)

    def refuse(*_):
        raise AssertionError("history was read")

    monkeypatch.setattr(TransactionJob, "refresh", refuse)
    write(tmp_path / "in", [lines[:40], lines[40:80] + lines[30:45]])
    run(spark, tmp_path)
    write(tmp_path / "in", [lines[80:] + [lines[85], lines[60]]])
    job = run(spark, tmp_path)
    rows = spark.read.parquet(job.path("results"))
    assert rows.count() == 120 and rows.select("batch_id").distinct().count() == 3
    assert results(spark, job) == expected(spark, lines)


@pytest.mark.parametrize("late_days", [0, 31])
def test_late_events_are_exact_from_state_or_history(spark, tmp_path, late_days):
    """Events 60 days behind come from the history table, others from state; repeats of both stay out."""
    first = [message(i, "A", T0 + timedelta(days=i), "CASH", 2.0 ** (i % 20)) for i in range(0, 90, 3)]
    late = [message(1000 + i, "A", T0 + timedelta(days=i, hours=1), "CASH", 3.0) for i in (80, 70, 30, 20, 5)]
    write(tmp_path / "in", [first[:10], first[10:], late[:2], late[2:], late])
    job = run(spark, tmp_path, late_days=late_days)
    got, want = results(spark, job), expected(spark, first)
    assert len(got) == len(first) + len(late)
    assert all(got[k] == want[k] for k in want)  # results already given are not revised
    by_batch = expected(spark, first + late[:2])
    assert all(got[k] == by_batch[k] for k in ("1080", "1070"))
    whole = expected(spark, first + late)
    assert all(got[k] == whole[k] for k in ("1030", "1020", "1005"))


def test_parts_of_an_active_account(spark, tmp_path):
    lines = events(90, accounts=2)
    write(tmp_path / "in", [lines[:50], lines[50:] + lines[40:55]])
    job = run(spark, tmp_path, parts=F.when(F.col("account_id") == "A0", 4).otherwise(1))
    assert results(spark, job) == expected(spark, lines)


def test_old_days_leave_the_state():
    """A processor on plain dictionaries: days out of every window's reach are removed."""
    import pandas as pd

    from tillwatch.streaming.state import DAY, AccountWindows

    class Map(dict):
        iterator, getValue, updateValue = dict.items, dict.__getitem__, dict.__setitem__
        removeKey = dict.pop

    p = AccountWindows(["event_id"], ["CASH"], [7, 31], 2, None)
    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    p.totals, p.events = Value(), Map()

    def give(*days):
        rows = pd.DataFrame({"event_id": days, "state_ts": [int(d * DAY) for d in days], "state_id": range(len(days)),
                             "state_channel": 0, "state_direction": 1, "state_cents": 100, "state_own": True})
        return pd.concat(p.handleInputRows(("A", 0), iter([rows]), None))

    assert [list(x) for x in give(0, 10.5, 20).sums] == [[100, 100, 0, 1, 1, 0] * 2, [100, 100, 0, 1, 1, 0, 200, 200, 0, 2, 2, 0],
                                                         [100, 100, 0, 1, 1, 0, 300, 300, 0, 3, 3, 0]]
    give(40)
    assert sorted(p._read()) == [10, 20, 40] and sorted(p.events) == [(10,), (20,), (40,)]
    late = give(39.5, 5).set_index("event_id").sums  # the second is too far behind
    assert late[5] is None and late[39.5] is not None and 5 not in p._read()


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "online")
    old = spark.range(200).selectExpr("CAST(id AS STRING) AS account_id", "0 AS x", "0 AS written_at")
    T.upsert_buckets(old, path, "account_id", "written_at", 16)
    files = lambda: {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    assert len(before) == 16
    T.upsert_buckets(spark.createDataFrame([("7", 5, 1), ("new", 6, 1)], "account_id string, x int, written_at int"),
                     path, "account_id", "written_at", 16)
    assert 14 <= len(before & files()) < 16 and len(files()) == 16
    rows = {r.account_id: r.x for r in T.online_features(spark, path).collect()}
    assert len(rows) == 201 and rows["7"] == 5 and rows["new"] == 6 and rows["8"] == 0
    stale = spark.createDataFrame([("7", 9, 0)], "account_id string, x int, written_at int")
    T.upsert_buckets(stale, path, "account_id", "written_at", 16)  # older than what is held
    assert {r.account_id: r.x for r in T.online_features(spark, path).collect()} == rows


def test_deadlines_expire_once(spark, tmp_path):
    """Over several runs of one checkpoint: overrides first or last, delayed and repeated rows, a restart."""
    from tillwatch.streaming.sweep import start_sweep

    hours = lambda h: T0 + timedelta(hours=h)
    schemas = {"actions": "action_id string, expires_at timestamp", "overrides": "action_id string", "clock": "now timestamp"}

    def sweep(**rows):
        for name, schema in schemas.items():
            spark.createDataFrame(rows.get(name, []), schema).write.mode("append").parquet(str(tmp_path / name))
        streams = {n: spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in schemas.items()}
        start_sweep(**streams, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt")).awaitTermination()
        if not (tmp_path / "out").exists():
            return []
        return sorted(r.action_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [(f"a{i}", hours(48)) for i in range(30)] + [("soon", hours(6)), ("past", hours(-1))]
    assert sweep(actions=first, overrides=[("a0",), ("a1",), ("early",)], clock=[(hours(0),)]) == ["past"]
    assert sweep(clock=[(hours(6),)]) == ["past"]  # due only after the deadline
    assert sweep(overrides=[("a2",)], clock=[(hours(7),)]) == ["past", "soon"]
    want = sorted(["past", "soon", *(f"a{i}" for i in range(3, 30))])
    assert sweep(actions=[("early", hours(1))], overrides=[("a2",)], clock=[(hours(49),)]) == want
    assert sweep(actions=[("a5", hours(48)), ("late", hours(3))], overrides=[("a6",)], clock=[(hours(90),)]) == sorted([*want, "late"])
    assert sweep() == sorted([*want, "late"])


def test_one_timer_serves_the_deadlines_of_a_slot():
    """A processor on plain objects: many actions under one key of state, one timer, each expires once."""
    import pandas as pd

    from tillwatch.streaming.sweep import Deadlines

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        timers = set()
        getValueState = staticmethod(lambda *_: Value())
        registerTimer, deleteTimer = timers.add, timers.remove

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    p = Deadlines()
    p.init(Handle)

    def give(kind, **deadlines):
        list(p.handleInputRows((3,), iter([pd.DataFrame({
            "action_id": list(deadlines), "kind": kind, "deadline": list(deadlines.values())})]), None))

    def fire(now):
        Handle.timers.remove(min(Handle.timers))
        return sorted(name for part in p.handleExpiredTimer((3,), Clock(now), None) for name in part["action_id"])

    give("override", a0=None, early=None)
    give("action", early=1.0, **{f"a{i}": 100.0 + i for i in range(50)})
    assert Handle.timers == {101}
    give("override", a1=None, a2=None)
    give("action", a3=50.0)  # a repeated action does nothing
    assert Handle.timers == {103}
    assert fire(120) == sorted(f"a{i}" for i in range(3, 21)) and Handle.timers == {121}
    assert fire(500) == sorted(f"a{i}" for i in range(21, 50)) and not Handle.timers


def test_days_share_entries_of_the_store():
    """A month of events takes an entry per block of days; a repeat after the oldest days have left stays out."""
    import pandas as pd

    from tillwatch.streaming.state import BLOCK, DAY, AccountWindows

    class Map(dict):
        getValue, removeKey, calls = dict.__getitem__, dict.pop, 0

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    p = AccountWindows(["event_id"], ["CASH"], [7], 2, None)
    p.totals, p.events = Value(), Map()

    def give(days):
        rows = pd.DataFrame({"event_id": days, "state_ts": [int(d * DAY) for d in days], "state_id": [int(d) for d in days],
                             "state_channel": 0, "state_direction": 1, "state_cents": 100, "state_own": True})
        return {i: None if s is None else s[0] for part in p.handleInputRows(("A", 0), iter([rows]), None)
                for i, s in zip(part["event_id"], part["sums"])}

    assert give(range(30)) == {d: 100 * min(d + 1, 8) for d in range(30)}
    assert p.events.calls == 30 // BLOCK
    assert sorted(p._read()) == list(range(20, 30)) and sorted(p.events) == [(20,), (25,)]
    assert give([31, 28]) == {31: 700} and sorted(p._read()) == [*range(22, 30), 31]
    assert sorted(p.events) == [(20,), (25,), (30,)]
