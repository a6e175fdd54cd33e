"""Exact deduplication over a cuckoo-filter index of live text digests.

Texts are equal when identical after deleting blanks, tabs, line feeds, vertical
tabs, form feeds and carriage returns; their digest is the SHA-256 of what is
left in UTF-8. The index is sharded by the leading digest bits. A shard holds

    stored keys   digest, byte length, number of live rows, the row that stays
    filter        buckets of four 16-bit fingerprints; a key lies in one of two
                  buckets, the second reached from the first by the fingerprint

A digest that misses the filter is new and goes in without a look at the stored
keys. A hit is verified against the content of its two buckets: the stored keys
filed there are compared by full digest and byte length. When an insertion finds
no place after ``MAX_KICKS`` moves, the shard's filter is made anew with twice
the buckets from the stored keys. A digest whose last live row is deleted leaves
filter and keys. When shards have grown too large on average, all keys are dealt
to more shards and filters are rebuilt in the next step.

Texts never move: only digests do, and each task first adds up equal digests, so
a text that a third of all rows share sends one record per task (two if it sees
more than ``COMBINED`` digests). Every state is a written table.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import arrow_schema, steps
from tillwatch.session import Scratch, delete_folder, new_folder, settle

#: What normalisation deletes.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4
MAX_KICKS = 300
#: Stored keys a shard is planned for, and the smallest number of shards.
SHARD_KEYS = 32_768
LEAST_SHARDS = 64
#: Digests a task adds up before it sends them on.
COMBINED = 200_000
_FIRST_BUCKETS = 64


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; ``buckets`` is a power of two.

    >>> f = CuckooFilter(64)
    >>> f.insert(12345), f.has(12345), f.delete(12345), f.has(12345)
    (True, True, True, False)
    """

    def __init__(self, buckets: int = _FIRST_BUCKETS, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = array("H", cells if cells is not None else bytes(2 * SLOTS * buckets))

    def places(self, h: int) -> tuple[int, int, int]:
        """Fingerprint (never zero) and both buckets of a 64-bit hash, the smaller bucket first."""
        mark = (h >> 48) or 1
        one = h & (self.buckets - 1)
        two = self.other(one, mark)
        return (mark, one, two) if one <= two else (mark, two, one)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 4) & (self.buckets - 1)

    def _slot(self, bucket: int, mark: int) -> int:
        at = bucket * SLOTS
        part = self.cells[at:at + SLOTS]
        return at + part.index(mark) if mark in part else -1

    def has(self, h: int) -> bool:
        mark, one, two = self.places(h)
        return self._slot(one, mark) >= 0 or self._slot(two, mark) >= 0

    def insert(self, h: int) -> bool:
        """False if no place was found; the filter must then be rebuilt, as it lost one fingerprint."""
        mark, one, two = self.places(h)
        for bucket in (one, two):
            if (at := self._slot(bucket, 0)) >= 0:
                self.cells[at] = mark
                return True
        bucket = two
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.cells[at] = self.cells[at], mark
            bucket = self.other(bucket, mark)
            if (at := self._slot(bucket, 0)) >= 0:
                self.cells[at] = mark
                return True
        return False

    def delete(self, h: int) -> bool:
        """Take out one fingerprint of ``h``, which must have been inserted."""
        mark, one, two = self.places(h)
        for bucket in (one, two):
            if (at := self._slot(bucket, mark)) >= 0:
                self.cells[at] = 0
                return True
        return False


def _hash_of(digest: bytes) -> int:
    """The filter's 64 bits; shards use other bytes of the digest."""
    return int.from_bytes(digest[8:16], "little")


class Shard:
    """Stored keys of one shard and the filter over them; runs inside a task."""

    def __init__(self, keys: list[list], filter_row: tuple[int, bytes] | None):
        #: digest, n_bytes, live, then the row that stays: n_chars, doc_id, batch, place
        self.keys: dict[int, list] = dict(enumerate(keys))
        self.next = len(keys)
        self.false_hits = self.resizes = 0
        self.filter = CuckooFilter(*filter_row) if filter_row else None
        if self.filter is None:
            self._rebuild(_FIRST_BUCKETS)
        else:
            self._file_all()

    def _file_all(self) -> None:
        self.filed = defaultdict(list)
        for number, key in self.keys.items():
            self.filed[self.filter.places(_hash_of(key[0]))].append(number)

    def _rebuild(self, buckets: int) -> None:
        """A filter of at least ``buckets`` buckets from the stored keys."""
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(_hash_of(key[0])) for key in self.keys.values()):
                return self._file_all()
            buckets *= 2

    def find(self, digest: bytes, n_bytes: int) -> int | None:
        """Number of the stored key with this digest; the filter answers for most that are absent."""
        h = _hash_of(digest)
        if not self.filter.has(h):
            return None
        for number in self.filed.get(self.filter.places(h), ()):
            if self.keys[number][0] == digest and self.keys[number][1] == n_bytes:
                return number
        self.false_hits += 1
        return None

    def add(self, key: list) -> None:
        number = self.find(key[0], key[1])
        if number is not None:
            stored = self.keys[number]
            stored[2] += key[2]
            if _order(key) < _order(stored):
                stored[3:] = key[3:]
            return
        self.keys[self.next] = key
        h = _hash_of(key[0])
        if self.filter.insert(h):
            self.filed[self.filter.places(h)].append(self.next)
        else:
            self.resizes += 1
            self._rebuild(2 * self.filter.buckets)
        self.next += 1

    def take(self, key: list) -> None:
        """Lower a key's live rows and set the row that stays now; without live rows the key goes."""
        number = self.find(key[0], key[1])
        if number is None:
            return
        stored = self.keys[number]
        stored[2] += key[2]
        stored[3:] = key[3:]
        if stored[2] <= 0:
            h = _hash_of(key[0])
            self.filter.delete(h)
            self.filed[self.filter.places(h)].remove(number)
            del self.keys[number]


def _order(key: list) -> tuple:
    """Most code points first, then the smallest id (null last), then the first row."""
    n_chars, doc_id, batch, place = key[3:]
    return -n_chars, doc_id is None, doc_id if doc_id is not None else 0, batch, place


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes, n_chars) of every row of ``docs``; a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, n_bytes bigint, n_chars bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in steps(batches):
            texts = pc.fill_null(batch.column(1), "")
            bare = [t.translate(None, BLANKS) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([sha256(t).digest() for t in bare], pa.binary()),
                pa.array(map(len, bare), pa.int64()), pc.utf8_length(texts).cast(pa.int64())], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class ExactIndex:
    """Live rows and their digests under ``folder``, which all executors share.

    ``insert`` and ``delete`` write a new state and then drop the one before;
    a job that fails leaves the old state as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", shard_keys: int = SHARD_KEYS,
                 least_shards: int = LEAST_SHARDS):
        self.spark, self.folder, self.shard_keys = spark, folder.rstrip("/"), shard_keys
        self.shards, self.version, self.batch = least_shards, 0, 0
        self.rows_schema = (f"doc_id {id_type}, digest binary, n_bytes bigint, n_chars bigint, batch int, "
                            "place bigint")
        self.key_schema = ("digest binary, n_bytes bigint, live bigint, n_chars bigint, "
                           f"doc_id {id_type}, batch int, place bigint")
        self.state_schema = (f"shard int, {self.key_schema}, buckets int, cells binary, false_hits bigint, "
                             "resizes bigint")

    # --- tables ------------------------------------------------------------------

    def _paths(self, kind: str, batches: range) -> list[str]:
        return [f"{self.folder}/{kind}-{b}" for b in batches]

    def rows(self) -> DataFrame:
        """Every live row: doc_id, digest, n_bytes, n_chars, and its place (batch, place)."""
        if not self.batch:
            return self.spark.createDataFrame([], self.rows_schema)
        rows = self.spark.read.schema(self.rows_schema).parquet(*self._paths("rows", range(self.batch)))
        if not self.version - self.batch:
            return rows
        gone = self.spark.read.schema("batch int, place bigint").parquet(
            *self._paths("gone", range(self.version - self.batch)))
        return rows.join(gone, ["batch", "place"], "left_anti")

    def state(self) -> DataFrame:
        """Stored keys (``cells`` null) and one filter row per shard."""
        if not self.version:
            return self.spark.createDataFrame([], self.state_schema)
        return self.spark.read.schema(self.state_schema).parquet(f"{self.folder}/state-{self.version}")

    def keys(self) -> DataFrame:
        return self.state().where("cells IS NULL").select("digest", "n_bytes", "live", "n_chars", "doc_id", "batch",
                                                          "place")

    # --- changes -----------------------------------------------------------------

    def _combined(self, rows: DataFrame) -> DataFrame:
        """One record per digest and task with the number of rows and the best of them."""
        schema = f"shard int, {self.key_schema}"
        arrow, shards = arrow_schema(schema), self.shards

        def flush(held):
            keys = list(held.values())
            shard = np.array([int.from_bytes(k[0][:4], "big") % shards for k in keys], np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard), *(pa.array(c, f.type) for c, f in zip(zip(*keys), list(arrow)[1:]))], schema=arrow)

        def run(batches):
            held: dict[tuple, list] = {}
            for batch in batches:
                for doc_id, digest, n_bytes, n_chars, number, place in zip(*(c.to_pylist() for c in batch.columns)):
                    key = [digest, n_bytes, 1, n_chars, doc_id, number, place]
                    old = held.setdefault((digest, n_bytes), key)
                    if old is not key:
                        old[2] += 1
                        if _order(key) < _order(old):
                            old[3:] = key[3:]
                if len(held) > COMBINED:
                    yield flush(held)
                    held.clear()
            if held:
                yield flush(held)

        return rows.select("doc_id", "digest", "n_bytes", "n_chars", "batch", "place").mapInArrow(run, schema)

    def _step(self, records: DataFrame, change: str) -> None:
        """Deal the records to their shards, run ``Shard.add`` or ``Shard.take`` and write the state."""
        schema = arrow_schema(self.state_schema)
        n = len(self.key_schema.split(", "))

        def run(key, left, right):
            kept = right.filter(pc.is_null(right["cells"]))
            made = right.filter(pc.is_valid(right["cells"]))
            row = (made["buckets"][0].as_py(), made["cells"][0].as_py()) if made.num_rows else None
            shard = Shard([list(k) for k in zip(*(kept.column(i).to_pylist() for i in range(1, n + 1)))], row)
            act = getattr(shard, change)
            for k in zip(*(left.column(i).to_pylist() for i in range(1, n + 1))):
                act(list(k))
            keys = list(shard.keys.values())
            cols = [list(c) for c in zip(*keys)] if keys else [[] for _ in range(n)]
            return pa.Table.from_arrays(
                [pa.array([key[0].as_py()] * (len(keys) + 1), pa.int32())]
                + [pa.array([*c, None], f.type) for c, f in zip(cols, list(schema)[1:])]
                + [pa.array([None] * len(keys) + [x], f.type) for x, f in zip(
                    (shard.filter.buckets, shard.filter.cells.tobytes(), shard.false_hits, shard.resizes),
                    list(schema)[n + 1:])], schema=schema)

        out = (records.groupBy("shard").cogroup(self.state_for_shards().groupBy("shard"))
               .applyInArrow(run, self.state_schema))
        out.write.mode("error").parquet(f"{self.folder}/state-{self.version + 1}")
        old, self.version = self.version, self.version + 1
        self._dealt = self.shards
        if old:
            delete_folder(self.spark, f"{self.folder}/state-{old}")

    def state_for_shards(self) -> DataFrame:
        """The state; after the number of shards has grown, its keys dealt anew without filters."""
        state = self.state()
        if not self.version or self._dealt == self.shards:
            return state
        dealt = F.expr(f"CAST(conv(substring(hex(digest), 1, 8), 16, 10) AS BIGINT) % {self.shards}").cast("int")
        return state.where("cells IS NULL").withColumn("shard", dealt)

    def insert(self, docs: DataFrame) -> None:
        """Add every row of ``docs`` (doc_id, text); other columns are not read."""
        path = f"{self.folder}/rows-{self.batch}"
        digests(docs).withColumn("batch", F.lit(self.batch)).withColumn(
            "place", F.monotonically_increasing_id()).write.mode("error").parquet(path)
        rows = self.spark.read.schema(self.rows_schema).parquet(path)
        held = self.state().where("cells IS NULL").count() if self.version else 0
        while held + rows.count() > 2 * self.shards * self.shard_keys:
            self.shards *= 2
        self._step(self._combined(rows), "add")
        self.batch += 1

    def delete(self, ids: DataFrame) -> None:
        """Take out every live row whose doc_id occurs in ``ids`` (a null id is never met)."""
        with Scratch(self.spark) as scratch:
            live = scratch.settle(self.rows())
            gone = scratch.settle(live.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
            gone.select("batch", "place").write.mode("error").parquet(
                f"{self.folder}/gone-{self.version - self.batch}")
            lost = gone.groupBy("digest", "n_bytes").agg((-F.count(F.lit(1))).alias("live"))
            left = live.join(gone, ["batch", "place"], "left_anti").join(lost, ["digest", "n_bytes"], "left_semi")
            best = left.groupBy("digest", "n_bytes").agg(F.expr(
                "min(named_struct('c', -n_chars, 'n', doc_id IS NULL, 'doc_id', doc_id, 'batch', batch, 'place', place))"
            ).alias("b"))
            shard = F.expr(f"CAST(conv(substring(hex(digest), 1, 8), 16, 10) AS BIGINT) % {self.shards}").cast("int")
            records = lost.join(best, ["digest", "n_bytes"], "left").select(
                shard.alias("shard"), "digest", "n_bytes", "live", (-F.col("b.c")).alias("n_chars"), "b.doc_id",
                "b.batch", "b.place")
            self._step(records, "take")

    # --- answers -----------------------------------------------------------------

    def report(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256), one row per live row.

        Of equal texts the row with the most code points stays, then the smallest
        doc_id (null last); of rows equal in all of that exactly one is kept.
        """
        several = self.keys().where("live > 1").selectExpr(
            "digest", "live", "doc_id AS keep_id", "named_struct('b', batch, 'p', place) AS keep")
        return self.rows().join(several, "digest", "left").selectExpr(
            "doc_id", "IF(keep IS NULL, doc_id, keep_id) AS keep_id", "coalesce(live, 1L) AS group_size",
            "keep IS NULL OR (keep.b = batch AND keep.p = place) AS kept", "lower(hex(digest)) AS text_sha256")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """(doc_id, present, keep_id) of every row of ``docs`` against the live digests; nothing is changed."""
        schema = "digest binary, doc_id " + docs.schema["doc_id"].dataType.simpleString()
        arrow = arrow_schema(schema)
        n = len(self.key_schema.split(", "))

        def run(left, right):
            kept = right.filter(pc.is_null(right["cells"]))
            made = right.filter(pc.is_valid(right["cells"]))
            row = (made["buckets"][0].as_py(), made["cells"][0].as_py()) if made.num_rows else None
            shard = Shard([list(k) for k in zip(*(kept.column(i).to_pylist() for i in range(1, n + 1)))], row)
            found = {d: shard.find(d, b) for d, b in zip(left["digest"].to_pylist(), left["n_bytes"].to_pylist())}
            met = [(d, shard.keys[i][4]) for d, i in found.items() if i is not None]
            return pa.Table.from_arrays([pa.array([m[k] for m in met], arrow[k].type) for k in (0, 1)], schema=arrow)

        rows = digests(docs).withColumn("batch", F.lit(0)).withColumn("place", F.lit(0).cast("long"))
        met = (self._combined(rows).groupBy("shard").cogroup(self.state_for_shards().groupBy("shard"))
               .applyInArrow(run, schema).selectExpr("digest", "doc_id AS keep_id", "true AS met").dropDuplicates(["digest"]))
        return rows.join(met, "digest", "left").selectExpr("doc_id", "met IS NOT NULL AS present", "keep_id")


def duplicates(docs: DataFrame) -> DataFrame:
    """The report of an index over all rows of ``docs``.

    Null and empty texts are equal to each other and to texts of blanks alone;
    a text may be as long as Spark's largest value; rows with equal text and
    repeated rows count one by one; a row without id can only stay if no row with
    an id has as many code points; other columns are not read; an empty table
    gives no rows.
    """
    index = ExactIndex(docs.sparkSession, new_folder(docs.sparkSession, "exact"),
                       docs.schema["doc_id"].dataType.simpleString())
    index.insert(docs)
    return index.report()


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the rows that stay, all columns kept; of rows equal in doc_id and text one stays."""
    scratch = Scratch(docs.sparkSession)
    keep = scratch.settle(duplicates(docs).where("kept").select(
        F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_digest"), F.lit(True).alias("_kept")))
    bare = F.expr(r"sha2(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', ''), 256)")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
                       bare.alias("_digest"), F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    same = rows["_doc"].eqNullSafe(keep["_doc"]) & (rows["_digest"] == keep["_digest"])
    first = F.row_number().over(Window.partitionBy("_doc", "_digest").orderBy(F.desc("_n")))
    out = settle(rows.join(keep, same, "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row.*"))
    scratch.close()
    return out
