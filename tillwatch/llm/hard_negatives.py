"""Hard-negative mining with angular triangle filtering, exact.

Every row stores its angles to a few reference directions. For two rows the
triangle inequality on the sphere bounds the angle between them from both sides,

    max |t(a) - t(x)|  <=  angle(a, x)  <=  min(t(a) + t(x), 2 pi - t(a) - t(x)),

so the norms times the cosines bound their inner product. The bounds are widened
by more than any rounding can amount to. Only rows whose bounds overlap a window
of wanted scores are scored, in exact integer arithmetic. The windows are: for
positives, from an anchor's fifth best score so far upwards; for negatives, from
80 % of a positive's score to that score, narrowed as better rows are met.

The index packs rows, ordered by nearest reference and angle, into blocks that
carry the range of each angle, of the norms and of the labels' rows, so whole
blocks fall to the same test. The references are picked from ``SAMPLE`` rows of
smallest hash; they only steer what is skipped, every row is in the index.

Anchors meet all rows in a grid: groups of anchors times groups of blocks, both
of bounded size; each cell is one unit of work and gives back at most five rows
per anchor and window. Groups are drawn by row, so a label, vector or direction
that a third of all rows share does not change the size of any cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import arrow_schema
from tillwatch.session import Scratch, settle

REFERENCES = 16
SAMPLE = 1024
#: Rows of an index block, rows and anchors of a grid cell, anchors compared at once.
BLOCK = 1024
CELL_ROWS = 65_536
CELL_ANCHORS = 32_768
AT_ONCE = 256
#: More than the rounding of any stored angle, cosine or norm.
SLACK = 5e-6


# --- vectors ----------------------------------------------------------------------

def scaled(batch: pa.RecordBatch, width: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that take part, and their vectors as whole numbers, zeros behind shorter ones.

    Columns: vec_id, label, embedding. Without a part: a null id, label, vector or
    component, a component that is not finite, or so large (about 2**28 times 64
    components, scaled) that scores leave 64 bits.
    """
    vectors = batch.column(2)
    sizes = np.asarray(pc.list_value_length(vectors).fill_null(0), np.int64)
    flat = pc.list_flatten(vectors)
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(factor * values)
    fine = np.isfinite(values) & (np.abs(whole) < min(2.0 ** 31, np.sqrt(2.0 ** 62 / width)))
    part = np.ones(batch.num_rows, bool)
    for c in range(3):
        part &= np.asarray(batch.column(c).is_valid())
    part[row[~fine]] = False
    out = np.zeros((batch.num_rows, width), np.int64)
    keep = part[row]
    out[row[keep], place[keep]] = whole[keep].astype(np.int64)
    at = np.flatnonzero(part)
    return at, out[at]


def angles_to(q: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles (rows x references) in radians; a zero vector is at a right angle to all."""
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    cosine = np.divide(x @ refs.T, norm[:, None], out=np.zeros((len(x), len(refs))), where=norm[:, None] > 0)
    return norm, np.arccos(np.clip(cosine, -1, 1))


def pick_references(q: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` directions of the sample, each far from those before; an axis if there is none."""
    x = q.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    x = x[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return np.eye(1, max(q.shape[1], 1))
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    return x[chosen]


# --- index ------------------------------------------------------------------------

_ROW = "near int, angle float, vec_id bigint, label bigint, vector binary, norm double, angles binary"
_BLOCK = "n int, ids binary, labels binary, vectors binary, norms binary, angles binary"
_ANCHOR = "vec_id bigint, label bigint, vector binary, norm double, angles binary"


def _joined(column: pa.Array, kind) -> np.ndarray:
    """One array from the bytes of every row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


class Rows:
    """Unpacked rows inside a task: ids, labels, whole-number vectors ``q``, norms and angles ``t``."""

    def __init__(self, ids, labels, q, norms, t):
        self.ids, self.labels, self.norms = ids, labels, norms
        self.q, self.t = q, t

    @classmethod
    def of_block(cls, b: dict) -> Rows:
        n = b["n"]
        return cls(*(np.frombuffer(b[c], np.int64) for c in ("ids", "labels")),
                   np.frombuffer(b["vectors"], np.int32).reshape(n, -1), np.frombuffer(b["norms"], np.float64),
                   np.frombuffer(b["angles"], np.float32).reshape(n, -1))

    @classmethod
    def of_table(cls, t: pa.Table) -> Rows:
        shape = (t.num_rows, -1 if t.num_rows else 0)
        return cls(*(np.asarray(t[c], np.int64) for c in ("vec_id", "label")),
                   _joined(t["vector"], np.int32).reshape(shape), np.asarray(t["norm"], np.float64),
                   _joined(t["angles"], np.float32).reshape(shape))

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.q[at], self.norms[at], self.t[at])

    def __len__(self) -> int:
        return len(self.ids)


class VectorIndex:
    """The packed rows of ``rows`` (vec_id, label, embedding) in the tables of ``scratch``."""

    def __init__(self, rows: DataFrame, scratch: Scratch, factor: int = 256, references: int = REFERENCES,
                 block: int = BLOCK):
        self.scratch, self.factor, self.block = scratch, factor, block
        rows = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
        stats = rows.agg(F.max(F.size("embedding")).alias("d"), F.count(F.lit(1)).alias("n")).first()
        self.width, self.rows = max(stats["d"] or 0, 1), stats["n"]
        sample = (rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
                  .orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE).toArrow())
        some = [scaled(b, self.width, factor)[1] for b in sample.to_batches()]
        self.refs = pick_references(np.concatenate([np.zeros((0, self.width), np.int64), *some]), references)
        self.tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = scratch.settle(self._packed(rows))

    def _packed(self, rows: DataFrame) -> DataFrame:
        refs, width, factor, size = self.refs, self.width, self.factor, self.block
        plain, packed = arrow_schema(_ROW), arrow_schema(_BLOCK)

        def place(batches):
            for batch in batches:
                at, q = scaled(batch, width, factor)
                norm, t = angles_to(q, refs)
                t, near = t.astype(np.float32), t.argmin(1).astype(np.int32)
                ids = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    pa.array(near), pa.array(t[np.arange(len(at)), near]), ids.column(0), ids.column(1),
                    _binary(q.astype(np.int32)), pa.array(norm), _binary(t)], schema=plain)

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    values = (np.asarray(part.column(2), np.int64), np.asarray(part.column(3), np.int64),
                              _joined(part.column(4), np.int32), np.asarray(part.column(5), np.float64),
                              _joined(part.column(6), np.float32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                        schema=packed)

        parts = max(self.tasks, -(-self.rows // CELL_ROWS))
        return (rows.mapInArrow(place, _ROW).repartitionByRange(parts, "near", "angle", "vec_id")
                .sortWithinPartitions("near", "angle", "vec_id").mapInArrow(pack, _BLOCK))

    def anchors(self, every: int) -> DataFrame:
        """(no, vec_id, label, vector, norm, angles): the distinct rows whose vec_id ``every`` divides, numbered."""
        arrow = arrow_schema(_ANCHOR)

        def unpack(batches):
            for batch in batches:
                for b in batch.to_pylist():
                    rows = Rows.of_block(b)
                    rows = rows.take(np.flatnonzero(rows.ids % every == 0))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows.ids), pa.array(rows.labels), _binary(rows.q), pa.array(rows.norms),
                        _binary(rows.t)], schema=arrow)

        distinct = self.blocks.mapInArrow(unpack, _ANCHOR).dropDuplicates(["vec_id", "label", "vector"])
        return self.scratch.settle(distinct.withColumn("no", F.monotonically_increasing_id()))

    def grid(self, anchors: DataFrame, work, schema: str) -> DataFrame:
        """``work(blocks, anchors)`` of every cell of the grid."""
        down = max(-(-self.rows // CELL_ROWS), min(self.tasks, self.blocks.count()), 1)
        across = max(-(-anchors.count() // CELL_ANCHORS), 1)
        left = self.blocks.withColumn("g", F.expr(f"pmod(xxhash64(ids, angles), {down})")).withColumn(
            "h", F.expr(f"explode(sequence(0L, {across - 1}L))"))
        right = anchors.withColumn("h", F.expr(f"pmod(xxhash64(no), {across})")).withColumn(
            "g", F.expr(f"explode(sequence(0L, {down - 1}L))"))
        return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(work, schema)


# --- bounds and scores ------------------------------------------------------------

def score_bounds(a: Rows, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score (anchors x rows) that the angles leave possible."""
    least = np.zeros((len(a), len(x)), np.float32)
    most = np.full((len(a), len(x)), np.pi, np.float32)
    for k in range(a.t.shape[1]):
        u, v = a.t[:, k, None], x.t[None, :, k]
        np.maximum(least, np.abs(u - v), out=least)
        np.minimum(most, np.float32(np.pi) - np.abs(np.float32(np.pi) - (u + v)), out=most)
    both = a.norms[:, None] * x.norms
    return both * (np.cos(most) - SLACK) - 1, both * (np.cos(least) + SLACK) + 1


class Frame:
    """Ranges of the angles and norms of each block: bounds for all its rows at once."""

    def __init__(self, blocks: list[Rows]):
        self.low = np.stack([b.t.min(0) for b in blocks])
        self.high = np.stack([b.t.max(0) for b in blocks])
        self.norms = np.array([(b.norms.min(), b.norms.max()) for b in blocks])

    def bounds(self, a: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score (anchors x blocks) possible with any row of a block."""
        least = np.zeros((len(a), len(self.low)), np.float32)
        most = np.full((len(a), len(self.low)), np.pi, np.float32)
        pi = np.float32(np.pi)
        for k in range(a.t.shape[1]):
            u, low, high = a.t[:, k, None], self.low[None, :, k], self.high[None, :, k]
            np.maximum(least, np.maximum(low - u, u - high), out=least)
            far = np.where((u + low <= pi) & (u + high >= pi), pi,
                           pi - np.minimum(np.abs(pi - (u + low)), np.abs(pi - (u + high))))
            np.minimum(most, far, out=most)
        cos_low, cos_high = np.cos(most) - SLACK, np.cos(least) + SLACK
        own, n = a.norms[:, None], self.norms.T
        return (own * np.minimum(cos_low * n[0], cos_low * n[1]) - 1,
                own * np.maximum(cos_high * n[0], cos_high * n[1]) + 1)


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact: every sum of products is within the type used."""
    top = float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(x, dtype=np.float64).max(initial=0))
    if top * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


_NONE = np.iinfo(np.int64).min


class Best:
    """The ``k`` best (score descending, id ascending) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.last = np.full(slots, _NONE)

    def offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """``score`` and ``fits``: one row per slot of ``slots``, one column per id."""
        if not fits.any():
            return
        if score.shape[1] > self.k:
            shown = np.where(fits, score, _NONE)
            at = shown.shape[1] - self.k
            fits = fits & (score >= np.partition(shown, at, axis=1)[:, at, None])
        row, column = np.nonzero(fits)
        slot = np.concatenate([self.slot, slots[row]])
        got = np.concatenate([self.score, score[row, column]])
        own = np.concatenate([self.id, ids[column]])
        order = np.lexsort((own, -got, slot))
        slot, got, own = slot[order], got[order], own[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        nth = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        keep = nth < self.k
        full = nth == self.k - 1
        self.last[slot[full]] = got[full]
        self.slot, self.score, self.id = slot[keep], got[keep], own[keep]


def _cell(left: pa.Table, right: pa.Table):
    return [Rows.of_block(b) for b in left.to_pylist()], Rows.of_table(right)


def positives_in(left: pa.Table, right: pa.Table, k: int):
    """(anchor row, score, id) of the ``k`` best rows of an anchor's label among the blocks of a cell."""
    blocks, anchors = _cell(left, right)
    of_label = [{x: b.take(np.flatnonzero(b.labels == x)) for x in np.intersect1d(b.labels, anchors.labels).tolist()}
                for b in blocks]
    for label in np.unique(anchors.labels).tolist():
        parts = [f[label] for f in of_label if label in f]
        mine = np.flatnonzero(anchors.labels == label)
        for at in range(0, len(mine) if parts else 0, AT_ONCE):
            own = mine[at:at + AT_ONCE]
            a = anchors.take(own)
            best = Best(len(a), k)
            high = Frame(parts).bounds(a)[1]
            for j in np.argsort(-high.max(0)).tolist():
                go = np.flatnonzero(high[:, j] >= best.last)
                if not len(go):
                    continue
                few, rows = a.take(go), parts[j]
                wanted = score_bounds(few, rows)[1] >= best.last[go, None]
                some = np.flatnonzero(wanted.any(0))
                rows = rows.take(some)
                best.offer(go, scores(few.q, rows.q), rows.ids, wanted[:, some] & (few.ids[:, None] != rows.ids))
            yield own[best.slot], best.score, best.id


def negatives_in(left: pa.Table, right: pa.Table, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor row, window, score, id): of other labels, the ``k`` best with low <= score <= high, per window.

    ``low`` and ``high`` have a row per anchor and a column per window; low > high is an empty window.
    """
    blocks, anchors = _cell(left, right)
    windows = low.shape[1]
    frame = Frame(blocks) if blocks else None
    for at in range(0, len(anchors) if blocks else 0, AT_ONCE):
        own = np.arange(at, min(at + AT_ONCE, len(anchors)))
        a, lo, hi = anchors.take(own), low[own], high[own]
        best = Best(len(a) * windows, k)
        cap = np.where(lo <= hi, hi, _NONE).max(1)
        floor_, roof = frame.bounds(a)
        for j in np.argsort(-roof.max(0)).tolist():
            now = np.maximum(lo, best.last.reshape(-1, windows))
            need = np.where(now <= hi, now, np.iinfo(np.int64).max).min(1)
            go = np.flatnonzero((roof[:, j] >= need) & (floor_[:, j] <= cap) & (need <= cap))
            if not len(go):
                continue
            few, rows = a.take(go), blocks[j]
            least, most = score_bounds(few, rows)
            wanted = (most >= need[go, None]) & (least <= cap[go, None]) & (few.labels[:, None] != rows.labels)
            some = np.flatnonzero(wanted.any(0))
            rows, wanted = rows.take(some), wanted[:, some]
            got = scores(few.q, rows.q)
            for w in range(windows):
                fits = wanted & (got >= now[go, w, None]) & (got <= hi[go, w, None])
                best.offer(go * windows + w, got, rows.ids, fits)
        yield own[best.slot // windows], best.slot % windows, best.score, best.id


# --- mining -----------------------------------------------------------------------

def _first(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` best of each key over all cells, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80,
         factor: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows``.

    Anchors are the rows whose vec_id ``every`` divides. Positives are the best
    other rows of the anchor's label; negatives of a positive are the best rows of
    other labels that score ``percent`` to 100 % of it. Scores are inner products
    of the components times ``factor``, rounded down; ties go by vec_id.

    Rows with a null id, label, vector or component, or a component that is not
    finite or too large, take no part. Other rows are those of another vec_id. A
    repeated row counts as often as it occurs, but is one anchor. A shorter vector
    has zeros behind it. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        index = VectorIndex(rows, scratch, factor)
        anchors = index.anchors(every)
        schema = "no bigint, score bigint, vec_id bigint"
        arrow = arrow_schema(schema)

        def near(left, right):
            no = np.asarray(right["no"], np.int64)
            found = [(no[a], s, i) for a, s, i in positives_in(left, right, positives)]
            return pa.concat_tables([arrow.empty_table(), *(
                pa.Table.from_arrays([pa.array(c) for c in f], schema=arrow) for f in found)])

        best = scratch.settle(_first(index.grid(anchors, near, schema), ["no"], positives, "nth"))
        windows = best.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("w"))
        wanted = scratch.settle(anchors.join(windows, "no").withColumn("w", F.col("w.score")))
        schema = "no bigint, nth int, score bigint, vec_id bigint"
        more = arrow_schema(schema)

        def hard(left, right):
            no = np.asarray(right["no"], np.int64)
            high = np.zeros((len(no), positives), np.int64)
            low = np.ones((len(no), positives), np.int64)
            for i, w in enumerate(right["w"].to_pylist()):
                high[i, :len(w)] = w
                low[i, :len(w)] = [-(-percent * s // 100) for s in w]
            found = [(no[a], w + 1, s, i) for a, w, s, i in negatives_in(left, right, low, high, negatives)]
            return pa.concat_tables([more.empty_table(), *(
                pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, more)], schema=more)
                for cols in found)])

        hits = _first(index.grid(wanted, hard, schema), ["no", "nth"], negatives, "rank").selectExpr(
            "no", "nth", "rank", "vec_id AS negative_id", "score AS negative_score")
        return settle(
            hits.join(best.selectExpr("no", "nth", "vec_id AS positive_id", "score AS positive_score"), ["no", "nth"])
            .join(anchors.selectExpr("no", "vec_id AS anchor_id"), "no")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
