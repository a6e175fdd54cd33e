"""Exact quantiles and label counts of many columns at once, without a long form.

The long form of a matrix has a row per cell, and every pass over it hashes a name
and moves a row for each. Here the tasks take the matrix as it is and work column by
column; only tables by (group, column, piece) and the values near a wanted rank leave
them:

1. every ``STRIDE``-th value of each sorted batch goes to one approximate-percentile
   pass, which cuts each column into pieces. Cut points only balance the work;
2. rows per (group, column, piece) are counted, so it is known which piece holds a rank;
3. the distinct values of those pieces, counted in their task, meet by (group, column,
   piece) and are ranked there.

The driver sees columns x pieces counts and the wanted values, never a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIDE = 32
#: Pieces of a column when few ranks are wanted, and rows one piece should hold when many are.
FINE_PIECES = 512
RANKED_ROWS = 20_000
PIECE_ROWS = 1_000_000
_KEY = "g bigint, c int"


def as_matrix(df: DataFrame, cols: list[str], by: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The group (0 without ``by``), ``extra`` SQL columns and the columns as doubles, by position."""
    return df.selectExpr(f"CAST(`{by}` AS BIGINT) AS g" if by else "0L AS g", *extra,
                         *[f"CAST(`{c}` AS DOUBLE) AS `c{i}`" for i, c in enumerate(cols)])


def _groups(batch: pa.RecordBatch):
    group = np.asarray(batch.column(0))
    for g in np.unique(group):
        own = group == g
        yield int(g), batch if own.all() else batch.filter(pa.array(own))


def _columns(batch: pa.RecordBatch, first: int = 1):
    """((group, column number), values without nulls) of a batch; -0.0 becomes 0.0."""
    for g, part in _groups(batch):
        for i in range(first, part.num_columns):
            yield (g, i - first), part.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0


def _table(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One batch of ((group, column), array, ...) items, the key repeated along the arrays."""
    sizes = [len(f[1]) for f in found]
    keys = [np.repeat(np.array([f[0][k] for f in found], t), sizes) for k, t in ((0, np.int64), (1, np.int32))]
    rest = [np.concatenate([f[k] for f in found]) for k in range(1, len(found[0]))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *rest)], ["g", "c", *names])


def _cuts(matrix: DataFrame, pieces: int) -> dict[tuple[int, int], np.ndarray]:
    """Ascending cut points per (group, column)."""
    def picks(batches):
        for batch in batches:
            found = []
            for key, x in _columns(batch):
                if len(x):
                    found.append((key, np.sort(x)[min(STRIDE, len(x)) // 2::STRIDE]))
            if found:
                yield _table(found, ["v"])

    even = ", ".join(repr(i / pieces) for i in range(1, pieces))
    rows = matrix.mapInArrow(picks, f"{_KEY}, v double").groupBy("g", "c").agg(F.expr(
        f"percentile_approx(v, array({even}), {10 * pieces})").alias("cuts")).collect()
    return {(r["g"], r["c"]): np.unique([x for x in r["cuts"] if x == x]) for r in rows}


def _piece_sizes(matrix: DataFrame, shared) -> dict[tuple[int, int], np.ndarray]:
    def run(batches):
        held = {}
        for batch in batches:
            for key, x in _columns(batch):
                if len(x):
                    cuts = shared.value[key]
                    n = np.bincount(np.searchsorted(cuts, x), minlength=len(cuts) + 1)
                    held[key] = held[key] + n if key in held else n
        found = [(key, np.flatnonzero(n).astype(np.int32), n[n > 0]) for key, n in held.items()]
        if found:
            yield _table(found, ["p", "n"])

    rows = matrix.mapInArrow(run, f"{_KEY}, p int, n bigint").groupBy("g", "c", "p").agg(F.sum("n").alias("n")).toArrow()
    out = {key: np.zeros(len(cuts) + 1, np.int64) for key, cuts in shared.value.items()}
    for g, c, p, n in zip(*(rows[x].to_pylist() for x in ("g", "c", "p", "n"))):
        out[g, c][p] = n
    return out


def _wanted(probs: list[float], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper 0-based rank and the fraction between them.

    A rank within rounding error of a whole number is that number, as in ``exact_quantiles``.
    """
    r = np.asarray(probs, float) * (n - 1)
    near = np.round(r)
    r = np.where(np.abs(r - near) < 1e-9 + 1e-12 * n, near, r)
    lo = np.floor(r)
    return lo.astype(np.int64), np.ceil(r).astype(np.int64), r - lo


def interpolated(ordered: np.ndarray, probs: list[float]) -> list[float]:
    """``column_quantiles`` of one ascending array."""
    lo, hi, share = _wanted(probs, len(ordered))
    below, above = ordered[lo], ordered[hi]
    with np.errstate(invalid="ignore"):
        return (below + (above - below) * share).tolist()


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     by: str | None = None) -> dict[tuple[int, str], tuple[list[float], int]]:
    """Exact linear-interpolated quantiles of columns: (group, column) to values in ``probs`` order and rows.

    Nulls are left out and a column without values has no entry; NaN is the largest
    value. The group is 0 without ``by``, a whole-number column without nulls and with
    few values. ``df`` is read four times; settle what is costly. The driver gets
    one number per group, column and probability.
    """
    spark = df.sparkSession
    matrix = as_matrix(df, cols, by)
    rows = df.count()
    fine = FINE_PIECES if 4 * len(probs) < FINE_PIECES else min(FINE_PIECES, -(-rows // RANKED_ROWS))
    shared = spark.sparkContext.broadcast(_cuts(matrix, max(2, fine, -(-rows // PIECE_ROWS))))
    sizes = _piece_sizes(matrix, shared)
    wanted = {key: _wanted(probs, int(n.sum())) for key, n in sizes.items()}
    ranks = {key: np.unique(np.concatenate(w[:2])) for key, w in wanted.items()}
    starts = {key: np.cumsum(n) - n for key, n in sizes.items()}
    held = {}
    for key, n in sizes.items():
        held[key] = np.zeros(len(n), bool)
        held[key][np.searchsorted(np.cumsum(n), ranks[key], side="right")] = True
    plan = spark.sparkContext.broadcast((held, starts, ranks))

    def near(batches):
        for batch in batches:
            found = []
            for key, x in _columns(batch):
                if len(x):
                    v, n = np.unique(x, return_counts=True)
                    piece = np.searchsorted(shared.value[key], v)
                    keep = plan.value[0][key][piece]
                    found.append((key, piece[keep].astype(np.int32), v[keep], n[keep]))
            if found:
                yield _table(found, ["p", "v", "n"])

    def pick(key, t):
        g, c, p = (k.as_py() for k in key)
        start, want = int(plan.value[1][g, c][p]), plan.value[2][g, c]
        v, n = np.asarray(t["v"]), np.asarray(t["n"])
        order = np.argsort(v, kind="stable")
        stop = start + np.cumsum(n[order])
        r = want[np.searchsorted(want, start):np.searchsorted(want, stop[-1])]
        found = v[order][np.searchsorted(stop, r, side="right")]
        return pa.table({"g": np.full(len(r), g, np.int64), "c": np.full(len(r), c, np.int32), "r": r, "v": found})

    got = matrix.mapInArrow(near, f"{_KEY}, p int, v double, n bigint").groupBy("g", "c", "p").applyInArrow(
        pick, f"{_KEY}, r bigint, v double").toArrow()
    g, c, r, v = (np.asarray(got[x]) for x in ("g", "c", "r", "v"))
    order = np.lexsort((r, c, g))
    at = 0
    out = {}
    for key in sorted(ranks):
        of = v[order[at:at + len(ranks[key])]]
        at += len(of)
        lo, hi, share = wanted[key]
        below, above = (of[np.searchsorted(ranks[key], x)] for x in (lo, hi))
        with np.errstate(invalid="ignore"):
            out[key[0], cols[key[1]]] = ((below + (above - below) * share).tolist(), int(sizes[key].sum()))
    shared.unpersist()
    plan.unpersist()
    return out


def label_cells(df: DataFrame, cols: list[str], edges: dict[tuple[int, str], list[float]], label: str = "label",
                by: str | None = None) -> DataFrame:
    """(g, feature, bin, label, n): rows by bin of each column and label, bins as in ``drift.bin_of``.

    ``edges`` are the distinct quantiles of the same rows, from the least to the largest
    value, so that every value lies in a bin; a single edge is bin 0. The label is its text.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        {(g, i): np.unique(edges[g, c]) for i, c in enumerate(cols) for g in {k[0] for k in edges} if (g, c) in edges})

    def run(batches):
        held = {}
        for batch in batches:
            for g, part in _groups(batch):
                coded = part.column(1).dictionary_encode(null_encoding="encode")
                names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
                for i in range(2, part.num_columns):
                    e = shared.value[g, i - 2]
                    x = part.column(i).to_numpy(zero_copy_only=False) + 0.0
                    cell = np.minimum(np.searchsorted(e, x, side="right"), len(e) - 1) * len(names) + code
                    n = np.bincount(cell, minlength=len(e) * len(names)).reshape(len(e), len(names))
                    for k, name in enumerate(names):
                        key = g, i - 2, name
                        held[key] = held[key] + n[:, k] if key in held else n[:, k]
        rows = [(g, cols[i], b, name, int(k)) for (g, i, name), n in held.items() for b, k in enumerate(n) if k]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()))],
                ["g", "feature", "bin", "label", "n"])

    return (as_matrix(df, cols, by, (f"CAST(`{label}` AS STRING) AS label",))
            .mapInArrow(run, "g bigint, feature string, bin int, label string, n bigint")
            .groupBy("g", "feature", "bin", "label").agg(F.sum("n").alias("n")))
