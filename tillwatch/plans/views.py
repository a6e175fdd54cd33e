"""How the given star tables play the roles of the account-risk data model.

Every view exists twice: as a DataFrame and as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.model import CHANNELS, MONEY

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


def as_transactions(events: DataFrame) -> DataFrame:
    """``events`` rows, batch or stream, as money movements (see SURVEY 7.1).

    The balance is a stand-in value.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    amount = F.col("value").cast(MONEY)
    return events.select(
        "event_id",
        F.col("user_id").alias("account_id"),
        "ts",
        F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), k % 16 + 1).alias("channel"),
        F.when(kind.isin("purchase", "error"), "DEBIT").otherwise("CREDIT").alias("direction"),
        amount.alias("amount"),
        F.when(kind != "view", (amount * (k % 7 + 1)).cast(MONEY)).alias("balance_after"),
        (kind != "error").alias("is_customer_induced"),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return as_transactions(table(spark, sf, "events"))


_CH = "[" + ", ".join(f"'{c}'" for c in CHANNELS) + "]"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
TX = f"""tx AS (
  SELECT event_id, user_id AS account_id, ts,
         list_extract({_CH}, {_K} % 16 + 1) AS channel,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
         CAST(value AS DECIMAL(18,2)) AS amount,
         CASE WHEN event_type <> 'view'
              THEN CAST(CAST(value AS DECIMAL(18,2)) * ({_K} % 7 + 1) AS DECIMAL(18,2)) END AS balance_after,
         event_type <> 'error' AS is_customer_induced
  FROM events)"""


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` as the account dimension, with a stand-in score on [0, 100]."""
    key = F.col("c_custkey")
    buckets = F.array(*[F.lit(b) for b in ["L14D", "L31D", "L90D", "L180D", "L365D", "G365D", "?"]])
    return table(spark, sf, "customer").select(
        key.alias("account_id"),
        F.col("c_mktsegment").alias("occupation"),
        (18 + F.col("c_nationkey") * 2).alias("age"),
        (key % 1500).alias("tenure"),
        F.element_at(buckets, (key % 7 + 1).cast("int")).alias("open_bucket"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
        ((key * 7919 % 10001) / F.lit(100.0)).alias("mule_score"),
    )


ACC = """acc AS (
  SELECT c_custkey AS account_id, c_mktsegment AS occupation, 18 + c_nationkey * 2 AS age,
         c_custkey % 1500 AS tenure,
         list_extract(['L14D','L31D','L90D','L180D','L365D','G365D','?'],
                      CAST(c_custkey % 7 + 1 AS INTEGER)) AS open_bucket,
         CAST(c_acctbal < 0 AS INTEGER) AS label,
         (c_custkey * 7919 % 10001) / CAST(100.0 AS DOUBLE) AS mule_score
  FROM customer)"""


MATRIX_FEATURES = [
    "n_orders", "sum_price", "max_price", "n_urgent", "n_lines", "sum_qty", "sum_ext",
    "max_disc", "n_returned", "sum_qty_x2",
]


def account_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One numeric row per account from ``orders`` and ``lineitem``.

    ``lineitem`` is reduced per order before it meets ``orders``; both joins
    are on keys that are unique on at least one side.
    """
    dec = lambda c: F.col(c).cast(MONEY)
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(dec("l_quantity")).alias("sum_qty"),
        F.sum(dec("l_extendedprice")).alias("sum_ext"),
        F.max("l_discount").alias("max_disc"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", dec("o_totalprice").alias("price"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    per = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("price").alias("sum_price"),
        F.max("price").alias("max_price"),
        F.sum("urgent").alias("n_urgent"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("sum_qty").alias("sum_qty"),
        F.sum("sum_ext").alias("sum_ext"),
        F.max("max_disc").alias("max_disc"),
        F.sum("n_returned").alias("n_returned"))
    acc = accounts(spark, sf)
    out = acc.join(per, acc.account_id == per.o_custkey, "left")
    num = [F.col(c).cast("double").alias(c) for c in MATRIX_FEATURES[:-1]]
    return out.select("account_id", "label", "occupation", *num,
                      (F.col("sum_qty").cast("double") * 2.0).alias("sum_qty_x2"))


MAT = ACC + """,
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS sum_ext, max(l_discount) AS max_disc,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey),
per AS (
  SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS sum_price,
         max(CAST(o_totalprice AS DECIMAL(18,2))) AS max_price,
         sum(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS n_urgent,
         sum(n_lines) AS n_lines, sum(sum_qty) AS sum_qty, sum(sum_ext) AS sum_ext,
         max(max_disc) AS max_disc, sum(n_returned) AS n_returned
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_custkey),
mat AS (
  SELECT account_id, label, occupation, CAST(n_orders AS DOUBLE) AS n_orders,
         CAST(sum_price AS DOUBLE) AS sum_price, CAST(max_price AS DOUBLE) AS max_price,
         CAST(n_urgent AS DOUBLE) AS n_urgent, CAST(n_lines AS DOUBLE) AS n_lines,
         CAST(sum_qty AS DOUBLE) AS sum_qty, CAST(sum_ext AS DOUBLE) AS sum_ext,
         CAST(max_disc AS DOUBLE) AS max_disc, CAST(n_returned AS DOUBLE) AS n_returned,
         CAST(sum_qty AS DOUBLE) * 2.0 AS sum_qty_x2
  FROM acc LEFT JOIN per ON account_id = o_custkey)"""


def long_matrix(mat: DataFrame, features=None, ids=("account_id",)) -> DataFrame:
    return mat.unpivot(list(ids), list(features or MATRIX_FEATURES), "feature", "value")


LONG = "long AS (UNPIVOT (SELECT account_id, label, " + ", ".join(MATRIX_FEATURES) + \
    " FROM mat) ON " + ", ".join(MATRIX_FEATURES) + " INTO NAME feature VALUE value)"


def scored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """``labels`` with three stand-in scores on [0, 1) from the documents' sizes."""
    n = F.col("n_chars")
    return table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("account_id"), F.col("toxic").alias("label"),
        ((n % 997) / F.lit(997.0)).alias("score"),
        ((n * 31 % 499) / F.lit(499.0)).alias("score_b"),
        ((n * 17 % 251) / F.lit(251.0)).alias("score_c"),
        F.col("quality"))


SC = """sc AS (
  SELECT doc_id AS account_id, toxic AS label, (n_chars % 997) / CAST(997.0 AS DOUBLE) AS score,
         (n_chars * 31 % 499) / CAST(499.0 AS DOUBLE) AS score_b,
         (n_chars * 17 % 251) / CAST(251.0 AS DOUBLE) AS score_c, quality
  FROM labels JOIN documents USING (doc_id))"""


def vectors(spark: SparkSession, sf: str, positive: int = 3) -> DataFrame:
    """``embeddings`` as a labelled numeric matrix: one class is the positive one."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("account_id"),
        (F.col("label") == positive).cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
