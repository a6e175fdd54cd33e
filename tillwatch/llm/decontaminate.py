"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words of a benchmark item (a shorter item is one
window). Of the GRAM-word hashes inside a window the smallest is its
fingerprint; documents select fingerprints the same way, so a document that
holds the window has selected the same fingerprint at the same place.

1. Benchmark items give one row per selected fingerprint, with the item's words
   around it.
2. A narrow pass over the documents selects fingerprints and keeps those that a
   bit map of the benchmark's fingerprints lets through. The map has a fixed
   size; a larger benchmark only lets more rows through, none is lost.
3. The rows left meet the benchmark's by fingerprint (one shuffle of few rows)
   and are extended both ways word by word. Runs of SPAN words are hits, so the
   result is exact.

Items shorter than SPAN words have their own window length; documents are
winnowed once for every length that occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import WordHash, grams, steps, window_minima
from tillwatch.session import broadcast_when_small, settle

SPAN = 13
GRAM = 5
#: Bits of the map of benchmark fingerprints (2 ** 24 bits are 2 MB).
MAP_BITS = 24
SMALL_ROWS = 50_000

#: A-Z to a-z, and every ASCII byte that is no letter or digit to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
              for b in range(256))
_HASH = WordHash(seed=7)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def picks(hashes: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints selected for windows of ``span`` words."""
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = min(gram, span)
    g = grams(hashes, k) ^ np.uint64(span * 0x9E3779B1)  # every window length has its own fingerprints
    at = window_minima(g, span - k + 1)
    return at, g[at]


def benchmark_fingerprints(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(mark, span, item_id, before, gram_words, after) per selected fingerprint of an item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in steps(batches):
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                w = words_of(text)
                if not w:
                    continue
                n = min(span, len(w))
                k = min(gram, n)
                for p, mark in zip(*(x.tolist() for x in picks(_HASH.of(w), n, gram))):
                    rows.append((i, mark, n, w[max(p - (n - k), 0):p][::-1], w[p:p + k], w[p + k:p + n]))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(cols[1], np.uint64).view(np.int64)), pa.array(cols[2], pa.int32()),
                 batch.column(0).take(pa.array(cols[0], pa.int64())),
                 *[pa.array([[x.decode("utf-8", "replace") for x in c] for c in col], pa.list_(pa.string()))
                   for col in cols[3:]]],
                ["mark", "span", "item_id", "before", "gram_words", "after"])

    return items.select("item_id", "text").where("text IS NOT NULL").mapInArrow(
        run, f"mark bigint, span int, item_id {kind}, before array<string>, gram_words array<string>, after array<string>")


def candidates(docs: DataFrame, spans: list[int], let_through: np.ndarray, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, found): found lists selected fingerprints the map lets through.

    Each entry carries its position and the words around it, as far as a window
    reaches. ``let_through`` is a packed bit map of fixed size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("mark", pa.int64()), ("p", pa.int64()), ("span", pa.int32()),
                       ("before", pa.list_(pa.string())), ("gram_words", pa.list_(pa.string())),
                       ("after", pa.list_(pa.string()))])

    def run(batches):
        for batch in steps(batches):
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                w = words_of(text)
                counts.append(len(w))
                hashes = _HASH.of(w)
                rows = []
                for n in spans:
                    at, marks = picks(hashes, n, gram)
                    bit = marks & np.uint64((1 << MAP_BITS) - 1)
                    ok = (let_through[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                    k = min(gram, n)
                    for p, mark in zip(at[ok == 1].tolist(), marks[ok == 1].view(np.int64).tolist()):
                        around = ([x.decode("utf-8", "replace") for x in c]
                                  for c in (w[max(p - (n - k), 0):p][::-1], w[p:p + k], w[p + k:p + n]))
                        rows.append(dict(zip(("mark", "p", "span", "before", "gram_words", "after"),
                                             (mark, p, n, *around))))
                found.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(found, pa.list_(entry))],
                ["doc_id", "text_hash", "n_words", "found"])

    return docs.selectExpr("doc_id", "text", "xxhash64(text) AS text_hash").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, n_words bigint, found array<struct<mark: bigint, p: bigint, span: int, "
             "before: array<string>, gram_words: array<string>, after: array<string>>>")


def _agree(mine: str, theirs: str) -> str:
    """SQL: how many leading words two arrays have in common."""
    n = f"least(size({mine}), size({theirs}))"
    same = f"zip_with(slice({mine}, 1, {n}), slice({theirs}, 1, {n}), (x, y) -> x = y)"
    return f"coalesce(nullif(array_position({same}, false), 0) - 1, {n})"


def judge(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    Null and empty texts have no words. Rows with the same doc_id and text have
    the same result; null ids are documents like any other. A benchmark without
    words hits nothing; items without an id mark words but are not listed.
    """
    spark = docs.sparkSession
    marks = settle(benchmark_fingerprints(items, span, gram))
    spans = sorted(r["span"] for r in marks.select("span").distinct().collect())  # at most SPAN values
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    whole = (1 << MAP_BITS) - 1
    for r in marks.selectExpr(f"mark & {whole} AS bit").distinct().toLocalIterator():  # at most 2 ** MAP_BITS rows
        bits[r["bit"] >> 3] |= 1 << (r["bit"] & 7)
    shared = spark.sparkContext.broadcast(bits)
    seen = settle(candidates(docs, spans, _Lazy(shared), gram))
    rows = seen.selectExpr("doc_id", "text_hash", "explode(found) AS f").selectExpr(
        "doc_id", "text_hash", "f.mark AS mark", "f.span AS span", "f.p AS p", "f.before AS b", "f.gram_words AS g",
        "f.after AS a").distinct()
    met = rows.join(broadcast_when_small(marks, SMALL_ROWS), ["mark", "span"]).where("g = gram_words")
    runs = met.selectExpr("doc_id", "text_hash", "item_id", "span", "p", f"{_agree('b', 'before')} AS lead",
                          f"size(g) + {_agree('a', 'after')} AS rest").where("lead + rest >= span").selectExpr(
        "doc_id", "text_hash", "item_id", "p - lead AS start", "p + rest AS stop")
    # Same-text documents and repeated windows collapse before words are listed.
    words = runs.select("doc_id", "text_hash", "start", "stop").distinct().select(
        "doc_id", "text_hash", F.explode(F.expr("sequence(start, stop - 1)")).alias("w")).distinct().groupBy(
        "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    held = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hits = words.join(held, words["doc_id"].eqNullSafe(held["doc_id"]) & (words["text_hash"] == held["text_hash"])).select(
        words["doc_id"].alias("_d"), words["text_hash"].alias("_t"), "n_hit", "ids")
    base = seen.select("doc_id", "text_hash", "n_words")
    out = base.join(hits, base["doc_id"].eqNullSafe(hits["_d"]) & (base["text_hash"] == hits["_t"]), "left")
    return out.selectExpr(
        "doc_id", "text_hash", "n_words", "coalesce(n_hit, 0L) AS n_hit", "CAST(coalesce(size(ids), 0) AS BIGINT) AS n_items",
        "sha2(coalesce(array_join(array_sort(ids), ','), ''), 256) AS items_sha256",
        "coalesce(n_hit, 0L) > 0 AND 20 * coalesce(n_hit, 0L) >= n_words AS contaminated")


class _Lazy:
    """A broadcast array that tasks index like the array itself."""

    def __init__(self, shared):
        self._shared = shared

    def __getitem__(self, at):
        return self._shared.value[at]


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return judge(docs, items).drop("text_hash")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = judge(docs, items).where("contaminated").selectExpr("doc_id AS _bd", "text_hash AS _bt").distinct()
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                       F.xxhash64("text").alias("_hash"))
    return rows.join(bad, rows["_doc"].eqNullSafe(bad["_bd"]) & (rows["_hash"] == bad["_bt"]), "left_anti").select("_row.*")
