"""Exact nearest-neighbour distances and nearest-prototype scores.

k nearest neighbours of every account among a reference set would be all pairs
if done naively. Following the published pivot-partitioned join (Lu et al., VLDB
2012): references fall into the cell of their nearest pivot, each query gets an
upper bound on its k-th distance from per-cell summaries, and it visits only
cells that can still hold a neighbour. The answer is exact whatever the pivots.
A cell's references are cut into blocks and its queries into chunks, so one task
holds bounded rows even when one cell attracts a third of all rows; a block
emits k distances per query, never its pairs. Inside a block a matrix product
finds the few references that can be among the k nearest, whatever its rounding;
only their distances are computed, by differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.operators.profiles import batch_minmax
from tillwatch.session import settle

BLOCK_ROWS = 4096
#: Blocks of ``block_rows`` that one task holds of either side; it compares ``_REFS`` rows of both at a time.
BLOCKS_AT_ONCE = 32


def euclidean(vec: Column, center: list[float]) -> Column:
    """Distance of an ARRAY<DOUBLE> column to a constant point."""
    point = F.array(*[F.lit(float(x)) for x in center])
    return F.sqrt(F.aggregate(F.zip_with(vec, point, lambda a, b: (a - b) * (a - b)),
                              F.lit(0.0), lambda acc, x: acc + x))


def prototype_score(df: DataFrame, positive: list[list[float]], negative: list[list[float]],
                    vec: str = "vec") -> DataFrame:
    """``d_neg / (d_pos + d_neg + 1e-9)`` with the nearest centre of each kind; no join."""
    d_pos = F.array_min(F.array(*[euclidean(F.col(vec), c) for c in positive]))
    d_neg = F.array_min(F.array(*[euclidean(F.col(vec), c) for c in negative]))
    return df.withColumns({"_dp": d_pos, "_dn": d_neg}).withColumn(
        "proto", F.col("_dn") / (F.col("_dp") + F.col("_dn") + F.lit(1e-9))).drop("_dp", "_dn")


#: Differences held at once by ``_distances`` (8 bytes each), whatever the number of columns.
_CELLS = 2_000_000
_REFS = 512


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances, by slices of both sides that hold ``_CELLS`` differences (one row at least)."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CELLS // max(1, min(len(b), _REFS) * a.shape[1])) if len(a) else 1
    for s in range(0, len(a), step):
        for t in range(0, len(b), _REFS):
            out[s:s + step, t:t + _REFS] = np.sqrt(((a[s:s + step, None, :] - b[None, t:t + _REFS, :]) ** 2).sum(axis=2))
    return out


def nearest_distances(a: np.ndarray, b: np.ndarray, k: int, rows: int = _REFS) -> np.ndarray:
    """(rows of ``a`` x min(k, rows of ``b``)) least Euclidean distances, in no order; ``rows`` of either side at a time."""
    m = min(k, len(b))
    out = np.empty((len(a), m))
    for s in range(0, len(a), rows):
        x, best = a[s:s + rows], None
        for t in range(0, len(b), rows):
            d = _least(x, b[t:t + rows], m)
            best = d if best is None else np.concatenate([best, d], 1)
            if best.shape[1] > m:
                best = np.partition(best, m - 1, axis=1)[:, :m]
        out[s:s + rows] = best
    return out


def _least(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distances per row of ``a`` (all, if ``b`` has fewer rows)."""
    m = min(k, len(b))
    with np.errstate(over="ignore", invalid="ignore"):
        na, nb = (a * a).sum(1), (b * b).sum(1)
        # Rounding of a square found through the product: under (width + 4) ulp of both norms, with room to spare.
        slack = 16 * (a.shape[1] + 4) * np.finfo(float).eps * (na + nb.max())
    if m == len(b) or not np.isfinite(slack).all():
        d = _distances(a, b)
        return np.partition(d, m - 1, axis=1)[:, :m]
    square = a @ b.T
    square *= -2.0
    square += nb
    square += na[:, None]
    limit = np.partition(square, m - 1, axis=1)[:, m - 1] + slack
    # Row by row in order; every row has at least m references within its limit.
    i, j = np.nonzero(square <= limit[:, None])
    if len(i) > square.size // 4:
        return np.partition(_distances(a, b), m - 1, axis=1)[:, :m]
    d, step = np.empty(len(i)), max(1, _CELLS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        d[s:s + step] = np.sqrt(((a[i[s:s + step]] - b[j[s:s + step]]) ** 2).sum(axis=1))
    found = np.bincount(i, minlength=len(a))
    if (found == m).all():
        return d.reshape(-1, m)
    order = np.lexsort((d, i))
    starts = np.cumsum(found) - found
    return d[order][starts[:, None] + np.arange(m)]


def choose_pivots(refs: DataFrame, count: int, vec: str) -> np.ndarray:
    """A fixed number of reference rows in hash order."""
    rows = refs.select(vec).orderBy(F.md5(F.col(vec).cast("string"))).limit(count).collect()
    return np.unique(np.array([r[0] for r in rows], dtype=float), axis=0)


def mean_knn_distance(queries: DataFrame, refs: DataFrame, k: int = 10, vec: str = "vec",
                      key: str = "account_id", pivots: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean distance of every query to its k nearest references (fewer if there are fewer)."""
    spark = queries.sparkSession
    k_type = queries.schema[key].dataType.simpleString()
    refs = refs.select(F.col(vec).alias("v"))
    piv = choose_pivots(refs, pivots, "v")

    def assign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            d = _distances(np.array(pdf["v"].tolist(), dtype=float), piv)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"v": pdf["v"], "cell": cell.astype("int32"), "d": d[np.arange(len(d)), cell]})

    placed = settle(refs.mapInPandas(assign, "v array<double>, cell int, d double"))
    w = W.partitionBy("cell").orderBy("d")
    near = placed.select("cell", "d").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    near_d = {r["cell"]: sorted(r["ds"]) for r in
              near.groupBy("cell").agg(F.collect_list("d").alias("ds")).collect()}
    stats = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
    cells = sorted(stats)  # at most ``pivots`` entries: bounded driver data
    k_all = min(k, sum(s[0] for s in stats.values()))
    lo = np.array([stats[c][1] for c in cells])
    hi = np.array([stats[c][2] for c in cells])
    live = piv[cells]
    offsets = np.concatenate([near_d[c] for c in cells])
    owner = np.concatenate([np.full(len(near_d[c]), i) for i, c in enumerate(cells)])

    def visit(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            d = _distances(np.array(pdf["v"].tolist(), dtype=float), live)
            upper = np.partition(d[:, owner] + offsets[None, :], k_all - 1, axis=1)[:, k_all - 1]
            lower = np.maximum(d - hi[None, :], lo[None, :] - d)
            hit = lower <= upper[:, None] * (1 + 1e-9) + 1e-9
            yield pd.DataFrame({"k": pdf["k"], "v": pdf["v"],
                                "cells": [[cells[j] for j in np.flatnonzero(row)] for row in hit]})

    q = queries.select(F.col(key).alias("k"), F.col(vec).alias("v")).mapInPandas(
        visit, f"k {k_type}, v array<double>, cells array<int>")
    asked = settle(q)
    visits = asked.select("k", "v", F.explode("cells").alias("cell"))
    loads = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = block_rows * BLOCKS_AT_ONCE
    plan = spark.createDataFrame(
        [(c, -(-stats[c][0] // held), -(-loads[c] // held)) for c in cells if c in loads],
        "cell int, blocks int, chunks int")

    def slot(name: str, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.col(name)).cast("int")

    def spread(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    # ``plan`` has one row per cell, at most ``pivots``.
    left = visits.join(F.broadcast(plan), "cell").withColumn("chunk", slot("chunks", "k")).withColumn(
        "block", spread("blocks")).select("cell", "block", "chunk", "k", "v")
    right = placed.join(F.broadcast(plan), "cell").withColumn("block", slot("blocks", "v", "d")).withColumn(
        "chunk", spread("chunks")).select("cell", "block", "chunk", "v")

    def nearest(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"k": pd.Series([], dtype=lp["k"].dtype), "d": pd.Series([], dtype=float)})
        best = nearest_distances(np.array(lp["v"].tolist(), dtype=float), np.array(rp["v"].tolist(), dtype=float),
                                 k)
        return pd.DataFrame({"k": np.repeat(lp["k"].to_numpy(), best.shape[1]), "d": best.ravel()})

    by = ["cell", "block", "chunk"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, f"k {k_type}, d double")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("d"))).where(F.col("r") <= k)
    return top.groupBy(F.col("k").alias(key)).agg(F.avg("d").alias("peer_distance"))


def peer_anomaly(df: DataFrame, k: int = 10, score: str = "score", vec: str = "vec",
                 key: str = "account_id", **kw) -> DataFrame:
    """Mean distance to the k nearest accounts scored legitimate, min-max scaled.

    A legitimate account meets itself at distance 0, as its own nearest peer.
    """
    d = mean_knn_distance(df, df.where(F.col(score) < 0.5), k, vec, key, **kw)
    return batch_minmax(settle(d), "peer_distance").withColumnRenamed("peer_distance", "peer_anomaly")
