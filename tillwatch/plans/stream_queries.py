"""Registered queries: ingestion and streams, run to completion on the given tables."""

import uuid

from pyspark.sql import functions as F

from tillwatch.model import CHANNELS
from tillwatch.plans.decision_queries import LEDGER, actions, overrides, switch_log
from tillwatch.plans.quality_queries import band_sql
from tillwatch.plans.registry import ORACLES, query
from tillwatch.plans.views import ACC, AS_OF, TX, accounts, as_transactions, table, transactions
from tillwatch.session import durable_folder
from tillwatch.sources import transactions as S
from tillwatch.sources.tables import online_features
from tillwatch.streaming.accounts import start_scoring
from tillwatch.streaming.sweep import start_sweep
from tillwatch.streaming.transactions import TransactionJob

_USED = list(CHANNELS)


def _scratch(spark, name):
    return f"{durable_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("batch_ingest", f"""WITH {TX} SELECT CAST(account_id AS VARCHAR) AS account_id, date_trunc('second', ts) AS ts, channel,
 direction, CAST(amount AS DOUBLE) AS amount, CAST(balance_after AS DOUBLE) AS balance_after
FROM tx WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00'""")
def batch_ingest(spark, sf):
    tx = transactions(spark, sf)
    folder = _scratch(spark, "exports")
    tx.select(
        F.col("account_id").cast("string").alias("ACCT_ID"), F.date_format("ts", "yyyy-MM-dd").alias("TXN_DATE"),
        F.date_format("ts", "HH:mm:ss").alias("TXN_TIME"), F.col("channel").alias("CHANNEL"),
        F.when(F.col("direction") == "CREDIT", "cr").otherwise("DR").alias("DR_CR"),
        F.col("amount").cast("string").alias("AMOUNT"), F.col("balance_after").cast("string").alias("BALANCE"),
    ).write.option("header", True).csv(folder)
    since = F.lit("2024-01-10 00:00:00").cast("timestamp")
    out = S.read_exports(spark, folder, since)
    return out.select("account_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "channel", "direction",
                      F.col("amount").cast("double").alias("amount"),
                      F.col("balance_after").cast("double").alias("balance_after"))


def event_stream(spark, sf):
    """The given events table as a file stream of transactions."""
    raw = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf.rstrip('/')}/events*.parquet")
    return as_transactions(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def _cash_score(feats):
    """Stand-in scorer: a week's cash turnover against 400."""
    return feats.withColumn("score", F.least(F.col("CASH_L7D_TOTAL_AMT") / F.lit(400.0), F.lit(1.0)))


def _run(spark, sf):
    root = _scratch(spark, "stream")
    registry = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("account_id"), (F.col("s_acctbal") < 0).alias("flagged"),
        F.col("s_nationkey").alias("counterparty_flagged_count"), F.lit(0.0).alias("cross_bank_velocity_score"))
    log = switch_log(spark, sf)
    job = TransactionJob(root, _cash_score, lambda s: log,
                         lambda s: registry, channels=_USED, model_version="v1")
    q = job.start(event_stream(spark, sf), f"{root}/checkpoint")
    q.awaitTermination()
    return job


_WIN = ", ".join(f"""sum(amount) FILTER (WHERE channel = '{c}') OVER w{w} AS {c}_{w},
 count(*) FILTER (WHERE channel = '{c}') OVER w{w} AS {c}_n{w}""" for c in _USED for w in (7, 31))
_EVT = f"""ev AS (SELECT event_id, account_id, ts, channel, {_WIN} FROM tx
 WINDOW w7 AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
 w31 AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 31 DAY PRECEDING AND CURRENT ROW))"""


@query("stream_features", f"""WITH {TX}, {_EVT} SELECT account_id, {', '.join(
 f"CAST(coalesce(arg_max_null({c}_{w}, {{'t': ts, 'i': event_id}}), 0) AS DOUBLE) AS {c}_L{w}D_TOTAL_AMT, "
 f"arg_max({c}_n{w}, {{'t': ts, 'i': event_id}}) AS {c}_L{w}D_TOTAL_TXNS" for c in _USED for w in (7, 31))}
FROM ev GROUP BY account_id""")
def stream_features(spark, sf):
    job = _run(spark, sf)
    cols = [f"{c}_L{w}D_{s}" for c in _USED for w in (7, 31) for s in ("TOTAL_AMT", "TOTAL_TXNS")]
    return online_features(spark, job.path("online")).select("account_id", *cols)


@query("stream_gate", f"""WITH {TX}, {_EVT}, {LEDGER},
s AS (SELECT arg_max(event = 'ACTIVATE', id) AS active FROM sw),
sc AS (SELECT event_id, account_id, least(CAST(coalesce(CASH_7, 0) AS DOUBLE) / 400.0::DOUBLE, 1.0) AS score FROM ev),
g AS (SELECT sc.*, CASE WHEN score >= 0.95 THEN CASE WHEN active THEN 'SUPPRESSED_BY_KILL_SWITCH' ELSE 'AUTO-HOLD' END END AS action FROM sc, s)
SELECT event_id, account_id, score, action, CAST(s_acctbal < 0 AS INTEGER) AS cross_bank_flagged,
 CASE WHEN action = 'AUTO-HOLD' THEN sha256(account_id || '|' || event_id) END AS action_id
FROM g LEFT JOIN supplier ON s_suppkey = account_id""")
def stream_gate(spark, sf):
    job = _run(spark, sf)
    return spark.read.parquet(job.path("results")).select(
        "event_id", "account_id", "score", "action", "cross_bank_flagged", "action_id")


@query("stream_score", f"""WITH {ACC}, s AS (SELECT account_id, least(coalesce(age, 0) / 100.0::DOUBLE
  + tenure / 2000.0::DOUBLE, 1.0) * 100.0::DOUBLE AS mule_score FROM acc)
SELECT account_id, mule_score, {band_sql('mule_score', "'LOW'", [(95.0, 'CRITICAL'), (85.0, 'HIGH'), (70.0, 'MEDIUM')])} AS severity FROM s""")
def stream_score(spark, sf):
    root = _scratch(spark, "arrivals")
    accounts(spark, sf).select("account_id", "age", "tenure").write.parquet(f"{root}/in")
    rows = spark.readStream.schema("account_id long, age int, tenure long").parquet(f"{root}/in")
    scorer = lambda d: d.withColumn("score", F.least(
        F.col("age") / F.lit(100.0) + F.col("tenure") / F.lit(2000.0) + F.col("absent"), F.lit(1.0)))
    q = start_scoring(rows, ["age", "tenure", "absent"], scorer, f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("sla_sweep", ORACLES["sla_expiry"])
def sla_sweep(spark, sf):
    """The expiries of ``sla_expiry``, emitted by the timers of a stream over the same ledgers."""
    root = _scratch(spark, "sweep")
    tables = {"actions": actions(spark, sf).select("action_id", "expires_at"), "overrides": overrides(spark, sf).select("action_id"),
              "clock": spark.sql(f"SELECT TIMESTAMP '{AS_OF}' AS now")}
    streams = {}
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}")
        streams[name] = spark.readStream.schema(spark.read.parquet(f"{root}/{name}").schema).parquet(f"{root}/{name}")
    start_sweep(**streams, path=f"{root}/out", checkpoint=f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("timestamp", "batch_id")
