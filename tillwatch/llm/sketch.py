"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

A sketch keeps the hashes under the threshold, whatever the text's length, so
its size grows with the text and a short text's sketch is comparable with a long
one's: shared hashes over the smaller sketch estimate containment, over the
union resemblance. The smallest hash is always kept, so no text with a shingle
has an empty sketch. That hash alone, if over the threshold, can not be in a
longer text's sketch: containment is then null. Resemblance is coarse for texts
of few kept hashes. Sketches merge: the union of two, less any hash over the
threshold but the smallest, is the sketch of the union.

Shingles are 8 consecutive code points (a shorter text is one shingle, an empty
text has none).
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import arrow_schema, cut_points, even_parts, mix, steps

SHINGLE = 8
SCALE = 32
#: Input bytes per range beyond which more ranges than shuffle partitions are made.
RANGE_BYTES = 64 << 20
_M = 0x9E3779B97F4A7C15
#: Code points hashed at once.
_SEGMENT = 1 << 20


def _hashes(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        if len(x) < SHINGLE:
            h = np.uint64(len(x))
            for c in x:
                h = h * np.uint64(_M) + c
            return mix(np.array([h], np.uint64))
        step = 1
        while step < SHINGLE:
            x = x[:len(x) - step] * np.uint64(pow(_M, step, 1 << 64)) + x[step:]
            step *= 2
    return mix(x)


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """Ascending distinct hashes below 2**64 / scale, and the smallest hash in any case."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    limit = np.uint64((1 << 64) // scale)
    kept, least = [], None
    for at in range(0, max(len(codes) - SHINGLE + 1, min(len(codes), 1)), _SEGMENT):
        h = _hashes(codes[at:at + _SEGMENT + SHINGLE - 1])
        kept.append(h[h < limit])
        low = h.min()
        least = low if least is None else min(least, low)
    if least is None:
        return np.zeros(0, np.uint64)
    out = np.unique(np.concatenate(kept))
    return out if len(out) else np.array([least], np.uint64)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of the texts' shingles together."""
    out = np.union1d(a, b)
    below = out[out < np.uint64((1 << 64) // scale)]
    return below if len(below) else out[:1]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, one empty is like nothing."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """Estimated share of the smaller text's shingles that the other has; None if a sketch
    holds only a hash over the threshold, which says nothing about it."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    limit = np.uint64((1 << 64) // scale)
    if a[0] >= limit or b[0] >= limit:
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def to_text(a: np.ndarray) -> str:
    """16 hexadecimal digits per hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def edit(text: str, following: str) -> str:
    """The last third replaced by as many code points of the following text (or all it has)."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint each text and its edit with the next document, descending doc_id.

    The table is dealt by ranges of doc_id in one shuffle. Each range also gets
    the first document after it (at most one id per range, and for the last
    range the first document of all), so every document finds its successor in
    its own sorted stream; nothing is gathered.

    Repeated ids follow each other by text (nulls last). A row without an id has
    no place in the order: nothing replaces its last third and ``near_next`` is
    null. A null text is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    pieces = even_parts(base, RANGE_BYTES)
    cuts = sorted({float(c) for c in cut_points(ids, "doc_id", pieces)})

    def ranged(df):
        df = df.withColumn("_v", F.col("doc_id").cast("double"))
        if not cuts:
            return df.withColumn("_range", F.when(F.col("_v").isNotNull(), F.lit(0.0))).drop("_v")
        return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_v", outputCol="_range",
                          handleInvalid="keep").transform(df).drop("_v")

    heads = sorted((int(r["_range"]), r["head"]) for r in
                   ranged(ids).groupBy("_range").agg(F.max("doc_id").alias("head")).collect())
    # The head of a range is also needed at the end of the range above it; the top
    # one follows the very last document.
    needed = {}
    for (_, head), (above, _) in zip(heads, [*heads[1:], *heads[:1]]):
        needed[head] = above
    own = ranged(base.where("doc_id IS NOT NULL")).selectExpr(
        "CAST(_range AS INT) AS place", "doc_id", "text", "0 AS borrowed")
    if needed:
        lookup = spark.createDataFrame(list(needed.items()), "doc_id bigint, above int")  # one row per range
        also = own.join(F.broadcast(lookup), "doc_id").selectExpr(
            "above AS place", "doc_id", "text", "1 AS borrowed")
        dealt = own.where(F.lit(True)).union(also)
    else:
        dealt = own
    dealt = dealt.union(base.where("doc_id IS NULL").selectExpr(
        "-1 - CAST(pmod(xxhash64(text), 4096) AS INT) AS place", "doc_id", "text", "0 AS borrowed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, contained_edited double, contained_next double")

    arrow = arrow_schema(schema)

    def run(batches):
        held = None

        def row(key, text, mine, following, other):
            changed = edit(text, following)
            theirs = sketch(changed, scale)
            return (key, len(text), sha256(changed.encode("utf-8")).hexdigest(), to_text(mine), to_text(theirs),
                    resemblance(mine, theirs), None if other is None else resemblance(mine, other),
                    containment(mine, theirs, scale), None if other is None else containment(mine, other, scale))

        for batch in steps(batches):
            out = []
            for place, key, text, borrowed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place < 0:
                    out.append(row(key, text, sketch(text, scale), "", None))
                    continue
                if held and held[0] != place:
                    held = None  # that range ended with its borrowed document
                mine = None if held is None and borrowed else sketch(text, scale)
                if held:
                    out.append(row(*held[1:], text, mine))
                held = None if borrowed else (place, key, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return (dealt.repartition(pieces, "place")
            .sortWithinPartitions("place", "borrowed", F.desc("doc_id"), F.asc("text"))
            .select("place", "doc_id", "text", "borrowed").mapInArrow(run, schema))
