"""Helpers the corpus operators share: Arrow batches, linking, even cuts of an id column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillwatch.session import Scratch, settle

#: Texts one step of a Python task holds at once; Arrow batches are cut to it.
STEP_CHARS = 6_000_000


def steps(batches: Iterator[pa.RecordBatch], column: str = "text",
          limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
        part = np.cumsum(sizes) // limit
        at = 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            yield batch.slice(at, stop - at)
            at = stop


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a DDL schema; call it on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def in_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text",
             done: Callable[[], None] | None = None) -> DataFrame:
    """Run ``make`` over bounded slices; it returns the columns of ``schema`` in order.

    ``done`` is called when a task ends: a Python worker lives on and serves other
    stages, so what a task has remembered must go with it.
    """
    arrow = arrow_schema(schema)

    def run(batches):
        try:
            for batch in steps(batches, text):
                cols = make(batch)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in zip(cols.values(), arrow, strict=True)], schema=arrow)
        finally:
            if done:
                done()
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """XXH64 of byte words, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and fold, three times)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * _ODD + words[i:i + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Positions holding the minimum of some window of w values (ties all count).

    Fewer than w values count as one window.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    w = min(w, len(x))
    least = sliding_min(x, w)
    # A position is chosen when the largest of its windows' minima is its own value.
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(~sliding_min(~padded, w) == x)


def compress(root: np.ndarray) -> np.ndarray:
    while True:
        nxt = root[root]
        if np.array_equal(nxt, root):
            return root
        root = nxt


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of the index pairs; each class is named by its smallest member."""
    while True:
        ra, rb = root[a], root[b]
        off = ra != rb
        if not off.any():
            return root
        a, b, ra, rb = a[off], b[off], ra[off], rb[off]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        root = compress(root)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): one row (node, root) per node.

    ``root`` is the smallest node reachable. Alternates the large-star and
    small-star steps: every round keeps at most as many edges as before, no
    neighbour list is gathered anywhere, and minima are combined before the
    shuffle. Each round is a written table, so a lost executor costs a re-read.
    """
    spark = edges.sparkSession
    rounds = []
    scratch = Scratch(spark)
    rounds.append(scratch)
    now = scratch.settle(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    mark = None
    while True:
        both = now.union(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).selectExpr("u", "least(u, low) AS low")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "low AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").selectExpr("explode(array(named_struct('u', v, 'v', low), "
                                                  "named_struct('u', u, 'v', low))) AS e").select("e.*")
        scratch = Scratch(spark)
        nxt = scratch.settle(small.where("u <> v").distinct())
        rounds.append(scratch)
        rounds.pop(0).close()
        got = tuple(nxt.selectExpr("count(*)", "bit_xor(xxhash64(u, v))", "sum(xxhash64(u, v) % 1000003)").first())
        if got == mark:
            break
        now, mark = nxt, got
    out = settle(nxt.selectExpr("u AS node", "v AS root")
                 .union(nxt.selectExpr("v AS node", "v AS root").distinct()))
    rounds.pop().close()
    return out


def cut_points(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Ascending distinct values that split a whole-number column into even pieces.

    They only balance the work: at most ``pieces`` numbers reach the driver.
    """
    probs = [i / pieces for i in range(1, pieces)]
    got = df.select(F.percentile_approx(F.col(column), probs, 10_000).alias("c")).first()["c"] if probs else []
    return sorted({int(c) for c in got or []})


def piece_of(column: str, cuts: list[int]) -> str:
    """SQL for the number of cut points below a value; null counts as below all."""
    def nest(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({column} <= {cuts[mid]}L, {nest(lo, mid)}, {nest(mid + 1, hi)})"

    return f"IF({column} IS NULL, 0, {nest(0, len(cuts))})"


def even_parts(df: DataFrame, bytes_each: int) -> int:
    """Partitions for a shuffle of ``df``: the session's number, more where its files are large.

    Spark's own size estimate serves (no job); where it knows none, the session's
    number stands.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(parts, -(-size // bytes_each)) if size < 1 << 50 else parts
