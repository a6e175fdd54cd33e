"""From arriving transactions to features, scores and automatic actions.

The features of each arriving event, as of its own time, come from keyed stream
state (``streaming.state``): a batch reads nothing of the accounts it does not
touch, and nothing of any history. Only events too late for the state are
computed from the history table, with the functions of the batch jobs. One
``foreachBatch`` callback then scores, gates and logs. Every output is partitioned
by batch id (the online table by bucket) and rewritten whole on replay, so
at-least-once delivery leaves each event's effects exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions import text as X
from tillwatch.model import AUTO_HOLD_SCORE, CHANNELS, DEFAULT_SLA_HOURS, WINDOW_DAYS
from tillwatch.operators import ledger as L
from tillwatch.operators.joins import merge_cross_bank
from tillwatch.operators.rolling import BASIC, days, features_at, flat_columns
from tillwatch.session import Scratch, broadcast_when_small, folder_exists, settle
from tillwatch.sources.tables import append_batch, upsert_buckets
from tillwatch.streaming.state import flat_of_sums, merged, with_sums

BATCH_ACCOUNTS = 500_000


@dataclass
class TransactionJob:
    """Tables under ``root``: history, online, results, actions, quarantine.

    Every event is kept, however late: it gets its own result and counts in the
    windows of all events handled after it. A repeated event (same account, time
    and id) is left out by the state, one that comes more than ``late_days`` behind
    its account's newest by the ids in the history. Unreadable payloads go to
    ``quarantine`` as they came.

    ``parts`` spreads the state of very active accounts, ``late_days`` and
    ``ttl_days`` bound it (see ``streaming.state.with_sums``); ``buckets`` is the
    number of files of the online table, of which a batch rewrites those it touches.

    ``scorer`` adds a ``score`` column on [0, 1] to the feature frame (a fitted
    model's transform or a Pandas UDF). ``switch_log`` and ``cross_bank`` are
    functions so that each batch sees the current tables.
    """

    root: str
    scorer: Callable[[DataFrame], DataFrame]
    switch_log: Callable[[SparkSession], DataFrame]
    cross_bank: Callable[[SparkSession], DataFrame] | None = None
    channels: list[str] = field(default_factory=lambda: list(CHANNELS))
    threshold: float = AUTO_HOLD_SCORE
    sla_hours: int = DEFAULT_SLA_HOURS
    model_version: str = "unspecified"
    institution: str = "your bank"
    late_days: int = 31
    ttl_days: int | None = 365
    parts: Column | None = None
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def answered(self, events: DataFrame) -> DataFrame:
        """Features of the events that the state has answered."""
        ids = ["event_id", "account_id", "ts", "channel"]
        base = events.selectExpr(*ids, *flat_of_sums(self.channels, WINDOW_DAYS))
        return base.selectExpr(*ids, *flat_columns(self.channels))

    def refresh(self, events: DataFrame, batch_id: int, settle=settle) -> DataFrame:
        """Features of events from the history table, which holds them already."""
        spark = events.sparkSession
        span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        oldest = F.lit(span["lo"]) - days(max(WINDOW_DAYS))
        history = spark.read.parquet(self.path("history")).where(
            (F.col("event_date") >= F.to_date(oldest)) & (F.col("ts") >= oldest)
            & (F.col("ts") <= F.lit(span["hi"])) & (F.col("batch_id") <= batch_id))
        # The batch bounds the accounts, so a hot account's history is filtered in
        # place instead of being shuffled to one task.
        touched = broadcast_when_small(settle(events.select("account_id").distinct()), BATCH_ACCOUNTS)
        recent = history.join(touched, "account_id", "left_semi")
        return features_at(events, recent, self.channels)

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch's events that no earlier batch brought, one per id.

        Only history of the dates the batch touches is read (ids alone).
        """
        spark = batch.sparkSession
        events = batch.dropDuplicates(["event_id"])
        if not folder_exists(spark, self.path("history")):
            return events
        dates = [r[0] for r in batch.select(F.to_date("ts")).distinct().collect()]  # calendar days
        known = spark.read.parquet(self.path("history")).where(
            F.col("event_date").isin(dates) & (F.col("batch_id") < batch_id)).select("event_id")
        return events.join(known, "event_id", "left_anti")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with Scratch(spark) as scratch:
            self._handle(scratch.settle(batch), batch_id, scratch)

    def _handle(self, batch: DataFrame, batch_id: int, scratch: Scratch) -> None:
        spark = batch.sparkSession
        settle = scratch.settle
        if "payload" in batch.columns:
            bad = batch.where("payload IS NOT NULL").select("payload")
            if not bad.isEmpty():
                append_batch(bad, self.path("quarantine"), batch_id)
            batch = batch.where("payload IS NULL").drop("payload")
        if self.parts is not None:
            batch = merged(batch, len(self.channels) * len(WINDOW_DAYS) * len(BASIC))
        held = batch.where("sums IS NOT NULL")
        late = settle(self.unseen(batch.where("sums IS NULL").drop("sums", "state_own"), batch_id))
        batch = settle(held.drop("sums", "state_own").unionByName(late))
        if batch.isEmpty():
            return
        append_batch(batch.withColumn("event_date", F.to_date("ts")), self.path("history"), batch_id, ("event_date",))
        # A projection of the settled batch: cheap enough to be read twice.
        feats = self.answered(held)
        if not late.isEmpty():
            old = self.refresh(late, batch_id, settle).join(late.select("event_id", "ts", "channel"), "event_id")
            feats = feats.unionByName(settle(old))
        newest = batch.groupBy("account_id").agg(F.max(F.struct("ts", "event_id")).alias("written_at"))
        newest = newest.select("written_at", F.col("written_at.event_id").alias("event_id"))
        if self.cross_bank is not None:
            touched = batch.select("account_id").distinct()
            signals = settle(self.cross_bank(spark).join(touched, "account_id", "left_semi"))
            feats = merge_cross_bank(feats, broadcast_when_small(signals, BATCH_ACCOUNTS))
        upsert_buckets(settle(feats.drop("channel").join(newest, "event_id")), self.path("online"), "account_id",
                       "written_at", self.buckets)
        scored = L.gate(self.scorer(feats), self.switch_log(spark), self.threshold)
        action_id = L.stable_id(F.col("account_id"), F.col("event_id"))
        held = F.col("action") == L.AUTO_HOLD
        ref = X.reference_id(F.col("account_id"), action_id)
        flag = F.col("cross_bank_flagged") if "cross_bank_flagged" in feats.columns else F.lit(None).cast("int")
        result = settle(scored.select(
            "event_id", "account_id", "ts", "channel", "score", "action", flag.alias("cross_bank_flagged"),
            F.when(held, action_id).alias("action_id"),
            F.when(held, X.notice(F.lit(L.AUTO_HOLD), ref, self.institution)).alias("customer_notice")))
        append_batch(result, self.path("results"), batch_id)
        holds = result.where(F.col("action") == L.AUTO_HOLD).select(
            "account_id", "event_id", F.lit(L.AUTO_HOLD).alias("action_type"),
            F.format_string("transaction score %.4f on %s", "score", "channel").alias("action_detail"),
            F.col("ts").alias("created_at"))
        append_batch(L.record_actions(holds, self.model_version, self.sla_hours), self.path("actions"), batch_id)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = True):
        rows = with_sums(events, self.channels, WINDOW_DAYS, self.late_days, self.ttl_days, self.parts)
        w = rows.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        # State that expires by the clock asks for another batch for ever; a run over what
        # is there now must end, and expiry can wait for the next batch with data.
        conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name, None)
        conf.set(name, "false")
        try:
            return (w.trigger(availableNow=True) if available_now else w).start()
        finally:
            conf.set(name, before) if before is not None else conf.unset(name)


def sweep_expired(actions: DataFrame, overrides: DataFrame, now, path: str) -> DataFrame:
    """Scheduled SLA sweep: append the system overrides that are due and return them."""
    due = settle(L.expired_overrides(actions, overrides, now))
    due.write.mode("append").parquet(path)
    return due
