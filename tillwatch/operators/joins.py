"""Account-level enrichment and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.ordering import hash_rank, join_per_value


def with_labels(features: DataFrame, labels: DataFrame, key: str = "account_id") -> DataFrame:
    """Both sides hold one row per account."""
    return features.join(labels, key)


def merge_cross_bank(features: DataFrame, signals: DataFrame | None) -> DataFrame:
    """Cross-bank signal as three flat features; without an adapter nothing is added."""
    if signals is None:
        return features
    flat = signals.select(
        "account_id", F.col("flagged").cast("int").alias("cross_bank_flagged"),
        F.col("counterparty_flagged_count").alias("cross_bank_counterparty_count"),
        F.col("cross_bank_velocity_score").alias("cross_bank_velocity"))
    # A hint on ``signals`` is kept by the projection above.
    return features.join(flat, "account_id", "left")


def counterparty_exposure(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Distinct flagged counterparties per account.

    Pairs are made distinct first (map-side), and a counterparty that very many
    accounts share joins as a hot value rather than in one task.
    """
    pairs = edges.select("account_id", "counterparty_id").distinct()
    mark = flagged.select("counterparty_id", F.lit(1).alias("hit")).distinct()
    per = pairs.groupBy("counterparty_id").agg(F.count(F.lit(1)).alias("n")).join(
        mark, "counterparty_id", "left")
    return join_per_value(pairs, per, ["counterparty_id"]).groupBy("account_id").agg(
        F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("counterparty_flagged_count"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Newest investigator label per account."""
    return feedback.groupBy("account_id").agg(F.max_by("true_label", "created_at").alias("feedback_label"))


def overlay_feedback(labels: DataFrame, feedback: DataFrame) -> DataFrame:
    """Investigator labels replace original ones; ``changed`` marks real differences."""
    fb = latest_feedback(feedback)
    y = F.coalesce(F.col("feedback_label"), F.col("label"))
    return labels.join(fb, "account_id", "left").select(
        *[c for c in labels.columns if c != "label"], y.alias("label"), (y != F.col("label")).alias("changed"))


def lookup(ids: DataFrame, table: DataFrame, key: str = "account_id") -> DataFrame:
    """Stored rows for the asked ids; an unknown id keeps a row of NULLs."""
    return ids.select(key).distinct().join(table, key, "left")


def in_scope(table: DataFrame, *id_sets: DataFrame, key: str = "account_id") -> DataFrame:
    """Rows whose id is in any of the given sets."""
    ids = id_sets[0].select(key)
    for other in id_sets[1:]:
        ids = ids.union(other.select(key))
    return table.join(ids.distinct(), key, "left_semi")


def keep_positives(df: DataFrame, max_rows: int, label: str = "label", key: str = "account_id",
                   seed: int = 42) -> DataFrame:
    """All positives plus exactly enough hash-chosen negatives to reach ``max_rows``, in key order."""
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    if sizes["n"] <= max_rows:
        return df.orderBy(key)
    want = max(max_rows - int(sizes["p"] or 0), 0)
    neg = df.where(F.col(label) == 0).withColumn(
        "_h", F.md5(F.concat_ws(":", F.col(key), F.lit(seed))))
    chosen = hash_rank(neg, [], "_h").where(F.col("row_rank") < want)
    return df.where(F.col(label) == 1).unionByName(chosen.select(*df.columns)).orderBy(key)


def lookalike_pool(scored: DataFrame, pool_size: int = 400, score: str = "score") -> DataFrame:
    """All positives and the ``pool_size`` best-scored negatives (a bounded top-k)."""
    near = scored.where(F.col("label") == 0).orderBy(F.desc(score), "account_id").limit(pool_size)
    return scored.where(F.col("label") == 1).unionByName(near)
