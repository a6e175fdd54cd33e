"""Anomaly models: isolation forest from bounded subsamples, and ECOD with a frozen reference."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.prep import as_array
from tillwatch.operators.wide import column_quantiles
from tillwatch.session import settle

_SPACE = 1_000_000_007


def subsamples(df: DataFrame, trees: int, size: int, key: str = "account_id", seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` hash-chosen rows per tree.

    A row is first offered only to the trees whose hash admits it (about twice
    ``size`` rows per tree in all), so the table is never multiplied by the
    number of trees; the offer widens until every tree is full.
    """
    n = df.count()
    want = min(size, n)
    ids = df.select(key)
    draw = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(_SPACE))
    share = 2.0
    while True:
        bound = int(min(_SPACE, _SPACE * share * want / max(n, 1)))
        offer = settle(ids.withColumn("tree", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < bound))))
        short = offer.groupBy("tree").count().where(F.col("count") >= want).count() < trees
        if not short or bound >= _SPACE:
            break
        share *= 2
    # At most a few times ``size`` rows share a tree here.
    picked = offer.groupBy("tree").agg(F.slice(F.sort_array(F.collect_list(
        F.struct(draw(F.col("tree")).alias("h"), F.col(key).alias("k")))), 1, want).alias("s"))
    # trees x size rows by construction: broadcast, so the wide table stays where it is.
    chosen = picked.select("tree", F.explode("s").alias("s")).select("tree", F.col("s.k").alias(key))
    return df.join(F.broadcast(chosen), key)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    if limit == 0 or len(x) <= 1:
        return {"n": len(x)}
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if len(spread) == 0:
        return {"n": len(x)}
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] <= cut
    return {"f": f, "t": cut, "l": _grow(x[low], rng, limit - 1), "r": _grow(x[~low], rng, limit - 1)}


def expected_path(n) -> np.ndarray:
    """Mean unsuccessful-search depth of a binary search tree with n rows."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depths(node: dict, x: np.ndarray, depth: int) -> np.ndarray:
    if "f" not in node:
        return np.full(len(x), depth + float(expected_path(node["n"])))
    out = np.empty(len(x))
    low = x[:, node["f"]] <= node["t"]
    out[low] = _depths(node["l"], x[low], depth + 1)
    out[~low] = _depths(node["r"], x[~low], depth + 1)
    return out


@dataclass(frozen=True)
class IsolationForest:
    cols: list[str]
    trees: list[str]
    size: int

    @staticmethod
    def fit(df: DataFrame, cols: list[str], trees: int = 100, size: int = 256, seed: int = 42) -> "IsolationForest":
        """Trees are grown in parallel, each from its own subsample of at most ``size`` rows."""
        base = df.select("account_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
        limit = int(np.ceil(np.log2(max(size, 2))))

        def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values("account_id")[cols].to_numpy(dtype=float)
            rng = np.random.default_rng(seed + int(key[0]))
            return pd.DataFrame({"tree": [int(key[0])], "body": [json.dumps(_grow(rows, rng, limit))],
                                 "n": [len(rows)]})

        grown = subsamples(base, trees, size, seed=seed).groupBy("tree").applyInPandas(
            build, "tree int, body string, n int").orderBy("tree").collect()  # trees x size nodes at most
        return IsolationForest(list(cols), [r["body"] for r in grown], max(r["n"] for r in grown))

    def column(self) -> Column:
        """``2 ** (-mean depth / c)`` of a row, vectorised per Arrow batch."""
        forest, norm = [json.loads(b) for b in self.trees], max(float(expected_path(self.size)), 1e-12)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if v.empty:
                return pd.Series([], dtype=float)
            x = np.array(v.tolist(), dtype=float)
            return pd.Series(np.power(2.0, -np.mean([_depths(t, x, 0) for t in forest], axis=0) / norm))

        return score(as_array(self.cols))

    def score(self, df: DataFrame, name: str = "iforest") -> DataFrame:
        return df.select("account_id", self.column().alias(name))


def rank_ladder(n: int, ratio: float) -> list[int]:
    """Ascending ranks of 1..n: all near both ends, then in steps growing by ``ratio``."""
    up, r = [], 1
    while r <= (n + 1) // 2:
        up.append(r)
        r = max(r + 1, int(r * ratio))
    up += [(n + 1) // 2] if n else []
    return sorted({*up, *(n + 1 - r for r in up)})


@dataclass(frozen=True)
class FrozenEcod:
    """ECOD of new rows against a frozen reference.

    Tail shares come from the reference's values at a ladder of exact ranks: every
    rank up to 1 / (ratio - 1) from either end, then ranks growing by ``ratio``.
    A share is so exact in the tails and within the ratio anywhere, whatever the
    number of rows, and the ladder grows with its logarithm only.
    """

    cols: list[str]
    landmarks: list[list[float]]
    ranks: list[list[float]]
    counts: list[int]
    left: list[bool]

    @staticmethod
    def fit(df: DataFrame, cols: list[str], ratio: float = 1.005) -> "FrozenEcod":
        facts = df.agg(*[F.expr(f"skewness(CAST(`{c}` AS DOUBLE)) AS s{i}") for i, c in enumerate(cols)],
                       F.count(F.lit(1)).alias("n")).first()
        ladder = rank_ladder(facts["n"], ratio)
        probs = [(r - 1) / max(facts["n"] - 1, 1) for r in ladder]
        found = {c: f for (_, c), f in column_quantiles(df, cols, probs).items()}  # a ladder per column
        counts = [found[c][1] if c in found else 0 for c in cols]
        return FrozenEcod(list(cols), [found[c][0] if c in found else [] for c in cols],
                          [[p * (n - 1) + 1 for p in probs] for n in counts], counts,
                          [bool((facts[i] or 0) < 0) for i in range(len(cols))])

    def column(self) -> Column:
        marks = [np.asarray(m, dtype=float) for m in self.landmarks]
        ranks = [np.asarray(r, dtype=float) for r in self.ranks]
        counts, left = self.counts, np.array(self.left)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=float).reshape(len(v), len(marks))
            low, high = np.empty_like(x), np.empty_like(x)
            for j, m in enumerate(marks):
                n = max(counts[j], 1)
                upto = np.concatenate([[0.0], ranks[j][:len(m)]])[np.searchsorted(m, x[:, j], side="right")]
                above = np.concatenate([n - ranks[j][:len(m)] + 1, [0.0]])[np.searchsorted(m, x[:, j], side="left")]
                low[:, j] = -np.log(np.maximum(upto, 1) / n)
                high[:, j] = -np.log(np.maximum(above, 1) / n)
            auto = np.where(left[None, :], low, high)
            return pd.Series(np.maximum.reduce([low.sum(axis=1), high.sum(axis=1), auto.sum(axis=1)]))

        return score(as_array(self.cols))
