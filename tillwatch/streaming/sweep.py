"""The SLA sweep as a stream: event-time timers expire actions nobody has overridden.

Three streams meet: the actions, the overrides and a clock. Actions are dealt by
hash over ``SLOTS`` keys of state, since a key costs far more to visit than an action.
A slot's timer stands at the earliest deadline that is open in it; an override
closes its action, and when the clock has passed the timer, it emits the system's
override of every action due and moves to the next deadline. A batch reads and writes
the slots it touches. Timers and what has been emitted are part of the checkpoint,
so a restart emits nothing twice.

Only clock rows carry an event time: they alone move the watermark, and no action
or override, however delayed, is left out as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillwatch.operators.ledger import EXPIRY_ACTOR, EXPIRY_REASON
from tillwatch.sources.tables import append_batch
from tillwatch.streaming.state import STORE

_OUT = "action_id string, investigator_id string, reason string, timestamp timestamp, override_type string"


#: Keys of state the actions are dealt over; fixed for the life of a checkpoint.
SLOTS = 1 << 14

#: Deadline of each action (None until it is known), and whether it is overridden or expired.
Actions = dict[str, tuple[int | None, bool]]


def next_due(actions: Actions) -> int | None:
    """The earliest deadline still open."""
    return min((d for d, closed in actions.values() if d is not None and not closed), default=None)


class Deadlines(StatefulProcessor):
    """The actions of one slot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "actions", "ids array<string>, deadlines array<bigint>, closed array<boolean>")

    def _read(self) -> Actions:
        held = self.state.get()
        return {i: (d, c) for i, d, c in zip(*held)} if held else {}

    def _write(self, actions: Actions) -> None:
        self.state.update((list(actions), [d for d, _ in actions.values()], [c for _, c in actions.values()]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        actions = self._read()
        timer, changed = next_due(actions), False
        for name in rows.loc[rows["kind"] == "override", "action_id"]:
            deadline, closed = actions.get(name, (None, False))
            if not closed:
                actions[name], changed = (deadline, True), True
        asked = rows.loc[(rows["kind"] == "action") & rows["deadline"].notna()]
        for name, due in asked.groupby("action_id")["deadline"].min().items():
            deadline, closed = actions.get(name, (None, False))
            if deadline is None:
                actions[name], changed = (int(due), closed), True
        if changed:
            self._write(actions)
            due = next_due(actions)
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        actions, mark = self._read(), timerValues.getCurrentWatermarkInMs()
        due = [name for name, (d, closed) in actions.items() if d is not None and not closed and d <= mark]
        actions.update({name: (actions[name][0], True) for name in due})
        self._write(actions)
        later = next_due(actions)
        if later is not None:
            self.handle.registerTimer(later)
        yield pd.DataFrame({"action_id": due, "investigator_id": EXPIRY_ACTOR, "reason": EXPIRY_REASON,
                            "timestamp": pd.Timestamp(mark, unit="ms"), "override_type": "AUTO_EXPIRED"})

    def close(self) -> None:
        pass


def expiries(actions: DataFrame, overrides: DataFrame, clock: DataFrame) -> DataFrame:
    """System override rows of the actions whose ``expires_at`` the clock has passed without an override.

    ``actions`` (action_id, expires_at), ``overrides`` (action_id) and ``clock``
    (now) are streams. A deadline counts as passed from the millisecond after it.
    An override met before its action, or in the batch in which the deadline
    passes, still counts; repeated actions and overrides do nothing.
    """
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    name = F.col("action_id").cast("string").alias("action_id")
    none = F.lit(None).cast("timestamp").alias("now")
    due = (F.unix_millis(F.col("expires_at").cast("timestamp")) + 1).alias("deadline")
    rows = (
        actions.select(name, F.lit("action").alias("kind"), due, none)
        .unionByName(overrides.select(name, F.lit("override").alias("kind"),
                                      F.lit(None).cast("long").alias("deadline"), none))
        .where("action_id IS NOT NULL")
        .unionByName(clock.select(F.lit("").alias("action_id"), F.lit("clock").alias("kind"),
                                  F.lit(None).cast("long").alias("deadline"), F.col("now").cast("timestamp").alias("now"))))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("action_id"), F.lit(SLOTS)))
    out = rows.withWatermark("now", "0 seconds").groupBy("slot").transformWithStateInPandas(
        Deadlines(), _OUT, "Append", "EventTime")
    return out.withColumn("action_id", F.col("action_id").cast(actions.schema["action_id"].dataType))


def start_sweep(actions: DataFrame, overrides: DataFrame, clock: DataFrame, path: str, checkpoint: str,
                available_now: bool = True):
    """Write the expiries to ``path``, one set per batch; a replayed batch rewrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, path, batch_id)

    w = expiries(actions, overrides, clock).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
