"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are compared within ``MAX_DIFF`` differing bits, exactly.

1. Equal fingerprints collapse to one row (combined before the shuffle).
2. Candidates meet by the pigeonhole rule: with the free bits cut into
   MAX_DIFF + 1 groups, two close fingerprints agree in one whole group. Rows
   are keyed by (mask, masked bits). A bucket over ``BUCKET`` rows is keyed
   again by groups of the bits that are still free, as often as needed; after
   ``DEPTH`` rounds so few bits are free that a bucket is small by itself. No
   bucket is ever cut or dropped.
3. A task takes whole buckets sorted by Gray rank and builds an index over them:
   neighbours in Gray order share most bits, so nodes of ``FAN`` neighbours hold
   the bits all of them share, less what their parent already holds. A query
   walks down, adds the differences in each node's bits and drops a whole group
   once the sum exceeds the limit - or once the group is already linked to it,
   so a dense group of copies is not compared pair by pair.
4. A task returns a spanning forest of its links, at most one link per
   fingerprint, and components are found over those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import components, compress, in_arrow, unite
from tillwatch.session import Scratch, settle

WORDS = 4
MAX_DIFF = 4
BUCKET = 32_768
DEPTH = 4
FAN = 8
#: Rows of buckets a task indexes at once, and pairs it looks at in one step.
_INDEXED = 1 << 17
_FRONTIER = 1 << 20
_BITS = np.array([[(b >> k) & 1 for k in range(8)] for b in range(256)], np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """SimHash of a text's shingles; 0 without a word.

    A bit is set if it is set in over half of the shingles' XXH64. Words are
    split at ASCII white space after lower-casing A-Z, repeats count.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(len(parts) - words + 1, 1)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    last = ends[words - 1:] if len(parts) >= words else ends[-1:]
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([one(joined[a:b], seed) for a, b in zip(starts[at:min(at + (1 << 16), n)].tolist(),
                                                             last[at:at + (1 << 16)].tolist())], "<u8")
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k:8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return sum(1 << k for k in range(64) if 2 * counts[k] > n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one narrow pass over whole texts; ``fp`` is a signed bigint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch):
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "fp": pa.array(fps.view(np.int64))}

    base = docs.selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    return in_arrow(base, make, f"doc_id {kind}, text_hash bigint, fp bigint")


def with_gray_rank(df: DataFrame, code: str, name: str) -> DataFrame:
    """Position of a 64-bit code in the Gray sequence: the running parity of its bits from the top."""
    df = df.withColumn(name, F.col(code))
    for k in (1, 2, 4, 8, 16, 32):
        df = df.withColumn(name, F.expr(f"{name} ^ shiftrightunsigned({name}, {k})"))
    return df


def refine(mask: int, groups: int) -> list[int]:
    """The mask with each of ``groups`` even parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), groups) if len(part)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels(codes: np.ndarray, starts: np.ndarray):
    """Index levels, leaves' parents first: (first child, end child, pattern, bits it adds, shared bits).

    ``starts``: first row of each bucket. Nodes never cross a bucket; the last
    level has one root per bucket.
    """
    levels = []
    both, one = codes, codes  # bits set in all, bits set in any
    shared_below = np.full(len(codes), ~np.uint64(0))
    while True:
        sizes = np.diff(np.append(starts, len(both)))
        nodes = -(-sizes // FAN)
        first = np.repeat(starts, nodes) + FAN * (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes))
        both, one = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(one, first)
        shared = both | ~one
        ends = np.append(first[1:], len(shared_below))
        if levels:
            levels[-1]["adds"] = levels[-1]["shared"] & ~np.repeat(shared, ends - first)
        levels.append({"first": first, "end": ends, "pattern": both, "shared": shared, "adds": shared})
        starts = np.cumsum(nodes) - nodes
        shared_below = shared
        if (nodes == 1).all():
            return levels


def link(codes: np.ndarray, buckets: np.ndarray, limit: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and for each the index of the smallest one linked to it.

    ``buckets`` holds the first row of each bucket; rows are in Gray order inside.
    Links are all pairs of one bucket within ``limit`` bits, closed transitively.
    """
    fps, at = np.unique(codes, return_inverse=True)
    root = np.arange(len(fps))
    levels = _levels(codes, buckets)
    top = len(levels) - 1
    leaf_adds = ~np.repeat(levels[0]["shared"], levels[0]["end"] - levels[0]["first"])
    roots = np.repeat(np.arange(len(buckets)), np.diff(np.append(buckets, len(codes))))
    last = [None] * len(levels)  # last row under each node, to look at later rows only
    below = np.arange(1, len(codes) + 1)
    for i, level in enumerate(levels):
        last[i] = below = below[level["end"] - 1]
    begin, step = 0, 64
    while begin < len(codes):
        # Label of a node: that of all its rows, or -1.
        labels = [root[at]]
        for level in levels:
            low = np.minimum.reduceat(labels[-1], level["first"])
            high = np.maximum.reduceat(labels[-1], level["first"])
            labels.append(np.where(low == high, low, -1))
        stop = min(begin + step, len(codes))
        q = np.arange(begin, stop)
        stack = [(top, q, roots[q], np.zeros(len(q), np.int64))]
        a, b = [], []
        while stack:
            k, q, node, apart = stack.pop()
            # Groups already linked to the query, and rows before it, need no visit.
            keep = (labels[k + 1][node] != root[at[q]]) & (last[k][node] > q + 1)
            q, node, apart = q[keep], node[keep], apart[keep]
            if not len(q):
                continue
            first, count = levels[k]["first"][node], levels[k]["end"][node] - levels[k]["first"][node]
            if count.sum() > _FRONTIER and len(q) > 1:
                half = len(q) // 2
                stack += [(k, q[half:], node[half:], apart[half:]), (k, q[:half], node[:half], apart[:half])]
                continue
            child = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            q, apart = np.repeat(q, count), np.repeat(apart, count)
            pattern, adds = (codes, leaf_adds) if k == 0 else (levels[k - 1]["pattern"], levels[k - 1]["adds"])
            apart = apart + np.bitwise_count((codes[q] ^ pattern[child]) & adds[child])
            near = apart <= limit
            q, child, apart = q[near], child[near], apart[near]
            if k:
                stack.append((k - 1, q, child, apart))
            else:
                new = at[q] != at[child]
                a.append(at[q[new]])
                b.append(at[child[new]])
        if a:
            root = unite(root, np.concatenate(a), np.concatenate(b))
        begin, step = stop, min(step * 2, 1 << 14)
    return fps, compress(root)


def _link_buckets(batches):
    """Spanning links of the rows (mask, bits, fp), sorted by bucket and Gray rank."""
    held: list[np.ndarray] = []
    size = 0

    def out(rows):
        key = rows[:, :2]
        new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        starts = np.concatenate([[0], new])
        counts = np.diff(np.append(starts, len(rows)))
        rows = rows[np.repeat(counts > 1, counts)]
        if not len(rows):
            return None
        counts = counts[counts > 1]
        fps, root = link(rows[:, 2].astype(np.int64).view(np.uint64), np.cumsum(counts) - counts)
        own = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_pydict({"a": pa.array(fps[own].view(np.int64)),
                                           "b": pa.array(fps[root[own]].view(np.int64))})

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns], 1))
        size += batch.num_rows
        if size < _INDEXED:
            continue
        rows = np.concatenate(held)
        changes = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut and (made := out(rows[:cut])) is not None:
            yield made
        held, size = [rows[cut:]], len(rows) - cut
    if held and (made := out(np.concatenate(held))) is not None:
        yield made


def links(fps: DataFrame, limit: int = MAX_DIFF, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(a, b): links that connect all fingerprints ``fp`` within ``limit`` bits of each other.

    Input rows are distinct fingerprints. The links span the components; they are
    not all pairs.
    """
    spark = fps.sparkSession
    groups = limit + 1
    masks = refine(0, groups)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    for level in range(depth + 1):
        keyed = keyed.selectExpr("mask", "fp & mask AS bits", "fp")
        if level < depth:
            big = keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
            big = settle(big.select("mask", "bits", F.lit(True).alias("big")))
            if big.isEmpty():
                big = None
        else:
            big = None
        here = keyed
        if big is not None:
            tagged = keyed.join(big, ["mask", "bits"], "left")
            here = tagged.where("big IS NULL").drop("big")
        spread = (with_gray_rank(here, "fp", "g").repartition("mask", "bits")
                  .sortWithinPartitions("mask", "bits", "g").select("mask", "bits", "fp")
                  .mapInArrow(_link_buckets, "a bigint, b bigint"))
        found = spread if found is None else found.union(spread)
        if big is None:
            return found
        # Every mask of this level leads to ``groups`` finer ones: a table of fixed size.
        finer = [(_signed(m), [_signed(x) for x in refine(m, groups)]) for m in masks]
        masks = [x for m in masks for x in refine(m, groups)]
        table = spark.createDataFrame(finer, "mask bigint, finer array<bigint>")
        keyed = (tagged.where("big").join(F.broadcast(table), "mask")
                 .select("fp", F.explode("finer").alias("mask")).distinct())
    return found


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, first_text): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, null only if no
    row of the component has an id. (component_id, first_text) names the row
    to keep: the smallest pair of doc_id (nulls last) and text hash.
    """
    scratch = Scratch(docs.sparkSession)
    prints = settle(fingerprints(docs))
    # Null ids come last: (no id, id, text hash) compares as a whole.
    order = "min(named_struct('n', doc_id IS NULL, 'd', doc_id, 't', text_hash))"
    distinct = scratch.settle(prints.groupBy("fp").agg(F.expr(order).alias("low")))
    roots = components(links(distinct.select("fp")))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").selectExpr(
        "fp", "coalesce(root, fp) AS root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("first"))
    per_print = settle(linked.select("fp", "root").join(lowest, "root").selectExpr(
        "fp", "first.d AS component_id", "first.t AS first_text"))
    scratch.close()
    return prints.join(per_print, "fp").select("doc_id", "text_hash", "fp", "component_id", "first_text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    A null or empty text has fingerprint zero and links like any other; repeated
    rows share a class; other columns are not read; an empty table gives no rows.
    """
    return classes(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest doc_id, then text hash.

    Rows equal in doc_id and text are one row here. All columns are kept.
    """
    kept = classes(docs).where("doc_id <=> component_id AND text_hash <=> first_text").selectExpr(
        "doc_id AS _doc", "text_hash AS _hash").distinct()
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                       F.xxhash64("text").alias("_hash"))
    same = rows["_doc"].eqNullSafe(kept["_doc"]) & rows["_hash"].eqNullSafe(kept["_hash"])
    met = rows.join(kept, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy(F.lit(0)))
    return met.withColumn("_nth", first).where("_nth = 1").select("_row.*")
