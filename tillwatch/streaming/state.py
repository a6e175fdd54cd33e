"""Rolling sums of each account kept as keyed stream state.

An account's events of the last weeks live in the state store, cut into blocks of
``BLOCK`` days: an entry per block holds its events (each call to the store costs far
more than the bytes it carries), one more the sums per day and channel. An
arriving event reads the sums of the whole days inside its windows and the events
of the few days where a window begins or ends, so its sums are exact and no
history is scanned. Accounts that a batch does not touch cost nothing.

Days that no window can reach any more are dropped when the account's newest day
moves on; ``late_days`` says how far behind that newest event an event may come
and still be answered from state. Older ones are passed on without sums: the job
computes those from the history table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType

from tillwatch.model import CHANNELS, WINDOW_DAYS

DAY = 86_400_000_000
#: Days whose events share an entry of the store; fixed for the life of a checkpoint.
BLOCK = 5
#: Per channel: total, credit and debit cents, then how many.
STATS = ["total_amt", "cr_amt", "db_amt", "total_txns", "cr_txns", "db_txns"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Channel is the place in the job's list, or -1; direction 1 is credit, 2 debit, 0 neither.
_EVENT = np.dtype([("ts", "<i8"), ("id", "<i8"), ("channel", "<i1"), ("direction", "<i1"), ("cents", "<i8")])


def stats_of(events: np.ndarray) -> np.ndarray:
    """(events x 6): what each event adds to the statistics of its channel."""
    out = np.zeros((len(events), 6), np.int64)
    for k, here in enumerate((True, events["direction"] == 1, events["direction"] == 2)):
        out[:, k] = np.where(here, events["cents"], 0)
        out[:, 3 + k] = here
    return out


def block_of(day):
    """First day of the block that holds a day (a number or an array)."""
    return day - day % BLOCK


def window_sums(at: np.ndarray, ts: np.ndarray, channel: np.ndarray, stats: np.ndarray, channels: int,
                windows: list[int]) -> np.ndarray:
    """(points x windows x channels x 6) sums over ``at - window <= ts <= at``."""
    out = np.zeros((len(at), len(windows), channels, 6), np.int64)
    order = np.argsort(ts, kind="stable")
    for c in range(channels):
        own = order[channel[order] == c]
        if not len(own):
            continue
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(stats[own], 0)])
        stop = np.searchsorted(ts[own], at, "right")
        for w, days in enumerate(windows):
            out[:, w, c] = sums[stop] - sums[np.searchsorted(ts[own], at - days * DAY, "left")]
    return out


class AccountWindows(StatefulProcessor):
    """One account (or one part of a very active one); see the module's notes."""

    def __init__(self, columns: list[str], channels: list[str], windows: list[int], late_days: int, ttl_days: int | None):
        self.columns, self.channels, self.windows = columns, list(channels), list(windows)
        self.keep = max(windows) + late_days
        self.late = late_days
        self.ttl = ttl_days * 86_400_000 if ttl_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "days binary", self.ttl)
        self.events = handle.getMapState("events", "day int", "events binary", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows), ignore_index=True)
        if not key[0]:
            yield self._out(rows, np.arange(len(rows)), None)
            return
        new = np.zeros(len(rows), _EVENT)
        for name in _EVENT.names:
            new[name] = rows[f"state_{name}"].to_numpy()
        own = rows["state_own"].to_numpy(bool)
        totals = self._read()
        floor = max(totals, default=-(1 << 30)) - self.keep
        day = new["ts"] // DAY
        old = day < floor
        stored, held = set(map(block_of, totals)), {}

        def load(b: int) -> np.ndarray:
            if b not in held:
                held[b] = np.frombuffer(self.events.getValue((b,))[0], _EVENT) if b in stored else np.zeros(0, _EVENT)
            return held[b]

        fresh = old.copy()
        block = block_of(day)
        for b in np.unique(block[~old]).tolist():
            at = np.flatnonzero((block == b) & ~old)
            known = set(load(b)[["ts", "id"]].tolist())
            pairs = new[["ts", "id"]][at].tolist()
            add = [i for i, pair in zip(at.tolist(), pairs) if not (pair in known or known.add(pair))]
            fresh[add] = True
            mine = [i for i in add if own[i]]
            if mine:
                held[b] = np.concatenate([held[b], new[mine]])
                held_day = held[b]["ts"] // DAY
                for d in np.unique(day[mine]).tolist():
                    sums = np.zeros((len(self.channels), 6), np.int64)
                    counted = held[b][(held_day == d) & (held[b]["channel"] >= 0)]
                    np.add.at(sums, counted["channel"].astype(np.int64), stats_of(counted))
                    totals[d] = sums
                self.events.updateValue((b,), (held[b].tobytes(),))
        answered = np.flatnonzero(fresh & ~old & (day - max(self.windows) >= floor))
        passed = np.setdiff1d(np.flatnonzero(fresh), answered)
        if len(passed):
            yield self._out(rows, passed, None)
        if len(answered):
            yield self._out(rows, answered, self._sums(new["ts"][answered], totals, load))
        newest = max(totals, default=0)
        gone = [d for d in totals if d < newest - self.keep]
        for d in gone:
            del totals[d]
        for b in set(map(block_of, gone)) - set(map(block_of, totals)):
            self.events.removeKey((b,))
        if totals:
            self.totals.update((b"".join([np.int64(d).tobytes() + x.tobytes() for d, x in totals.items()]),))

    def _read(self) -> dict[int, np.ndarray]:
        """Sums per day (channels x 6)."""
        held = self.totals.get()
        size = 1 + 6 * len(self.channels)
        rows = np.frombuffer(held[0], np.int64).reshape(-1, size) if held else np.zeros((0, size), np.int64)
        return {int(r[0]): r[1:].reshape(-1, 6) for r in rows}

    def _sums(self, at: np.ndarray, totals: dict[int, np.ndarray], load) -> np.ndarray:
        edges = {int(d) for w in (0, *self.windows) for d in np.unique((at - w * DAY) // DAY)} & set(totals)
        parts = [load(b) for b in sorted(set(map(block_of, edges)))]
        whole = sorted(d for d in set(totals) - edges if any(((at // DAY) > d) & ((at - max(self.windows) * DAY) // DAY < d)))
        events = np.concatenate([np.zeros(0, _EVENT), *parts])
        events = events[np.isin(events["ts"] // DAY, sorted(edges))]
        n = len(self.channels)
        # A day that no window cuts counts as one entry per channel.
        ts = np.concatenate([events["ts"], np.repeat(np.array(whole, np.int64) * DAY, n)])
        channel = np.concatenate([events["channel"].astype(np.int64), np.tile(np.arange(n), len(whole))])
        stats = np.concatenate([stats_of(events), *(totals[d] for d in whole)])
        return window_sums(at, ts, channel, stats, n, self.windows)

    def _out(self, rows: pd.DataFrame, at: np.ndarray, sums: np.ndarray | None) -> pd.DataFrame:
        out = rows.iloc[at][[*self.columns, "state_own"]].reset_index(drop=True)
        out["sums"] = [None] * len(at) if sums is None else list(sums.reshape(len(at), -1))
        return out

    def close(self) -> None:
        pass


def with_sums(events: DataFrame, channels: list[str] = CHANNELS, windows: list[int] = WINDOW_DAYS,
              late_days: int = 31, ttl_days: int | None = 365, parts: Column | None = None) -> DataFrame:
    """A stream of events, each once, with ``sums``: its windows as of its own time.

    ``sums`` is null for events further behind than ``late_days`` and for rows
    without an account. A repeated event (same account, time and id) is left out.
    ``ttl_days`` after their last change (by the clock) entries leave the store,
    which only matters for accounts that fell silent; a stream that may stand
    still for longer needs a larger one, or None.

    ``parts`` gives the number of parts an account's state is spread over (a
    function of account_id that must not change while the checkpoint lives). All
    parts see all events of the account and give partial sums, which
    ``merged`` adds up; ``state_own`` marks the part that stores the event.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = events.columns
    decimals = {f.name: f.dataType.simpleString() for f in events.schema.fields if isinstance(f.dataType, DecimalType)}
    plain = [f"CAST(`{c}` AS STRING) AS `{c}`" if c in decimals else f"`{c}`" for c in names]
    place = " ".join(f"WHEN channel = '{c}' THEN {i}" for i, c in enumerate(channels))
    work = events.withColumn("state_parts", F.lit(1) if parts is None else F.greatest(parts.cast("int"), F.lit(1))).selectExpr(
        *plain, "account_id AS state_key", "unix_micros(CAST(ts AS TIMESTAMP)) AS state_ts",
        "xxhash64(CAST(event_id AS STRING)) AS state_id", f"CAST(CASE {place} ELSE -1 END AS TINYINT) AS state_channel",
        "CAST(CASE direction WHEN 'CREDIT' THEN 1 WHEN 'DEBIT' THEN 2 ELSE 0 END AS TINYINT) AS state_direction",
        "coalesce(CAST(amount * 100 AS BIGINT), 0L) AS state_cents", "state_parts").selectExpr(
        "*", "pmod(state_id, state_parts) AS state_home", "explode(sequence(0, state_parts - 1)) AS state_part").selectExpr(
        "*", "state_home = state_part AS state_own").drop("state_home", "state_parts")
    # Rows without account or time share a key of their own; null is no key for state.
    known = F.when(F.col("ts").isNotNull(), F.col("state_key").cast("string"))
    work = work.withColumn("state_ts", F.coalesce("state_ts", F.lit(0))).withColumn("state_key", F.coalesce(known, F.lit("")))
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "state_own boolean", "sums array<bigint>"])
    out = work.groupBy("state_key", "state_part").transformWithStateInPandas(
        AccountWindows(names, channels, windows, late_days, ttl_days), schema, "Append", "ProcessingTime")
    return out.selectExpr(*[f"CAST(`{c}` AS {decimals[c]}) AS `{c}`" if c in decimals else f"`{c}`" for c in names],
                          "state_own", "sums")


def merged(batch: DataFrame, size: int) -> DataFrame:
    """Partial sums of the parts added up: one row per event that some part stored."""
    rest = [c for c in batch.columns if c not in ("event_id", "state_own", "sums")]
    one = batch.where("event_id IS NOT NULL").groupBy("event_id").agg(
        F.bool_or("state_own").alias("state_own"), F.bool_or(F.col("sums").isNull()).alias("_gap"),
        *[F.first(c, ignorenulls=True).alias(c) for c in rest],
        *[F.expr(f"sum(sums[{i}]) AS _s{i}") for i in range(size)])
    sums = F.when(~F.col("_gap"), F.array(*[f"_s{i}" for i in range(size)]))
    one = one.where("state_own").withColumn("sums", sums).select(*[c for c in batch.columns])
    return one.unionByName(batch.where("event_id IS NULL AND state_own"))


def flat_of_sums(channels: list[str], windows: list[int]) -> list[str]:
    """SQL over ``sums``: the columns ``<channel>_L<w>D_<STAT>`` in units of money."""
    out, i = [], 0
    for w in windows:
        for c in channels:
            for stat in STATS:
                out.append(f"sums[{i}]{' / 100D' if stat.endswith('amt') else ''} AS `{c}_L{w}D_{stat.upper()}`")
                i += 1
    return out
