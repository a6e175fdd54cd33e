"""How far the sources of a language differ in their words: an exact audit.

Kept terms are found by iceberg prefix refinement. Each level cuts the terms of
a document to byte prefixes of ``FIRST``, 2 ``FIRST``, 4 ``FIRST``, ... bytes and
counts the documents that hold each (language, prefix). A prefix in too few
documents is discarded with all that begins with it; a term no longer than the
level is complete and, if frequent enough, kept; longer terms under a frequent
prefix go to the next level, until none is open. So rare long strings never
become keys of the exact count.

Between levels a bit map of fixed size tells the tasks which prefixes go on. A
bit set by another prefix only lets a rare one pass, and its own count drops it
at the next level: nothing is lost or wrongly kept.

Every text is read once; its distinct terms go to a packed table that the levels
read. Tasks add up their counts before they move, so a language or source with
a third of all rows sends about one record per task and term. Pairs of
sources are compared in blocks of sources and chunks of terms; a chunk holds its
frequent and its absent terms, so the work per task is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import arrow_schema, mix, steps
from tillwatch.session import Scratch, settle

FIRST = 4
MAP_BITS = 1 << 24
#: Terms a task compares at once, and sources on each side of a block pair.
CHUNK_TERMS = 4096
BLOCK_SOURCES = 64
#: Bytes of text in a pack, which a Python task unpacks whole, and terms it hashes at once.
PACK_CHARS = 1_000_000
_HASHED_TERMS = 16_384
#: Rows a task adds up before it sends them on, and rows it hands over at once.
HELD_ROWS = 500_000
_ROWS_OUT = 10_000
#: A-Z to lower case, every other ASCII character that is not a letter to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SCALE = 1_000_000_000


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that stand back to back in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of binary values without nulls."""
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset) if len(values) else np.zeros(1, int)
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, np.diff(ends).astype(np.int64)


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts in order, and how many each text has.

    Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased.
    """
    x = np.frombuffer(b" ".join([*texts, b""]).translate(_FOLD), np.uint8)
    inside = x != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    text_stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return _binary(x[inside], stops - starts), np.diff(np.searchsorted(starts, text_stops), prepend=0)


_PACK = ("langs array<string>, sources array<string>, sizes binary, lengths binary, vocabulary binary, codes binary, "
         "counts binary, widths array<int>")


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def term_packs(docs: DataFrame) -> DataFrame:
    """The distinct terms of every row and how often each occurs in it, packed.

    A pack holds some rows: their languages, sources and numbers of terms, the
    pack's terms in byte order, and per row the numbers of its terms, ascending,
    with their counts, as unsigned integers of the widths needed.
    """
    arrow = arrow_schema(_PACK)

    def pack(batches):
        for batch in steps(batches, limit=PACK_CHARS):
            terms, n = terms_of(pc.fill_null(batch.column(0), "").cast(pa.binary()).to_pylist())
            coded = terms.dictionary_encode()
            order = np.asarray(pc.array_sort_indices(coded.dictionary), np.int64)
            place = np.zeros(len(order), np.int64)
            place[order] = np.arange(len(order))
            wide = max(len(order), 1)
            pairs, counts = np.unique(np.repeat(np.arange(batch.num_rows), n) * wide + place[np.asarray(coded.indices)],
                                      return_counts=True)
            words, lengths = _parts(coded.dictionary.take(pa.array(order)))
            parts = [_narrow(x) for x in (
                np.bincount(pairs // wide, minlength=batch.num_rows), lengths, pairs % wide, counts)]
            yield pa.RecordBatch.from_pylist([{
                "langs": batch.column(1).to_pylist(), "sources": batch.column(2).to_pylist(),
                "vocabulary": words.tobytes(), "widths": [x.itemsize for x in parts],
                **dict(zip(("sizes", "lengths", "codes", "counts"), (x.tobytes() for x in parts)))}], schema=arrow)

    def run(batches):
        yield from pack(batches)
        pa.default_memory_pool().release_unused()

    return docs.select("text", *_groups_of()).mapInArrow(run, _PACK)


def _groups_of() -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


# --- bit maps ---------------------------------------------------------------------

def _hashes(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term, over all its bytes; a bounded number of terms at once."""
    return np.concatenate([np.zeros(0, np.uint64), *(
        _hashes_of(terms.slice(at, _HASHED_TERMS)) for at in range(0, len(terms), _HASHED_TERMS))])


def _hashes_of(terms: pa.Array) -> np.ndarray:
    data, lengths = _parts(terms)
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
               ^ lengths.astype(np.uint64))


def _bits_of(langs: list[str], which: np.ndarray, terms: pa.Array, bits: int) -> np.ndarray:
    """Bit number of each (language, term)."""
    seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)
    return (mix(_hashes(terms) ^ seeds[which]) & np.uint64(bits - 1)).astype(np.int64)


def _bit_map(keys: DataFrame, term: str, bits: int = MAP_BITS) -> np.ndarray:
    """Bits of (lang, term) set; at most ``bits`` / 64 numbers reach the driver."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names = batch.column(0).dictionary_encode()
                bit = _bits_of(names.dictionary.to_pylist(), np.asarray(names.indices), batch.column(1), bits)
                own = np.zeros(bits // 64, np.uint64)
                np.bitwise_or.at(own, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["w", "v"])

    words = (keys.select("lang", term).mapInArrow(run, "w bigint, v bigint")
             .groupBy("w").agg(F.bit_or("v").alias("v")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words["w"], np.int64)] = np.asarray(words["v"], np.int64)
    return out.view(np.uint64)


class _Pack:
    """An unpacked pack: parallel arrays ``doc``, ``code`` and ``count`` over (row, term)."""

    def __init__(self, row: dict):
        names = {x: i for i, x in enumerate(dict.fromkeys(row["langs"]))}
        self.langs, self.sources = list(names), row["sources"]
        self.lang_of = np.array([names[x] for x in row["langs"]], np.int64)
        sizes, self.length, self.code, self.count = (
            np.frombuffer(row[c], f"<u{w}").astype(t)
            for c, w, t in zip(("sizes", "lengths", "codes", "counts"), row["widths"], (np.int64, np.int64, np.int32, np.int32)))
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.terms = _binary(np.frombuffer(row["vocabulary"], np.uint8), self.length)

    def take(self, mask: np.ndarray) -> None:
        self.doc, self.code, self.count = self.doc[mask], self.code[mask], self.count[mask]

    def prefixes(self, cut: int | None) -> tuple[np.ndarray, pa.Array]:
        """Number of the prefix of each term, ascending as the terms are, and the prefixes."""
        cuts = pc.binary_slice(self.terms, 0, cut) if cut else self.terms
        new = np.ones(len(cuts), bool)
        if len(cuts) > 1:
            new[1:] = np.asarray(pc.not_equal(cuts[1:], cuts[:-1]))
        return np.cumsum(new) - 1, cuts.filter(pa.array(new))

    def keys(self, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(language, prefix number) of each pair as one key, and the keys that occur, ascending."""
        key = self.lang_of[self.doc] * n + number[self.code]
        seen = np.zeros(len(self.langs) * n, bool)
        seen[key] = True
        return key, np.flatnonzero(seen)

    def filter(self, cut: int | None, bits: np.ndarray) -> None:
        """Only pairs whose (language, prefix) has its bit set."""
        number, prefixes = self.prefixes(cut)
        n = len(prefixes)
        key, seen = self.keys(number, n)
        if not len(seen):
            return
        bit = _bits_of(self.langs, seen // n, prefixes.take(pa.array(seen % n)), 64 * len(bits))
        met = np.zeros(len(self.langs) * n, bool)
        met[seen] = (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
        self.take(met[key])


def _summed(table: DataFrame, make, keys: str, values: str) -> DataFrame:
    """Rows of ``make(pack)`` with the ``values`` columns summed over equal ``keys``.

    A task adds up its packs before the rows leave it, as far as ``HELD_ROWS`` go.
    """
    arrow = arrow_schema(f"{keys}, {values}")
    names = [f.split()[0] for f in keys.split(", ")]
    sums = [f.split()[0] for f in values.split(", ")]

    def run(batches):
        held, n = [], 0

        def total():
            t = pa.concat_tables(held)
            if len(held) > 1:
                t = t.group_by(names, use_threads=False).aggregate([(x, "sum") for x in sums])
                t = t.select([*names, *(f"{x}_sum" for x in sums)])
            return t.rename_columns(arrow.names).cast(arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                made = make(_Pack(batch.slice(i, 1).to_pylist()[0]))
                if made is None:
                    continue
                held.append(pa.Table.from_arrays(made, schema=arrow))
                n += held[-1].num_rows
                if n > HELD_ROWS:
                    held = [total()]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=_ROWS_OUT)
                        held = []
                    n = sum(t.num_rows for t in held)
        if held:
            yield from total().to_batches(max_chunksize=_ROWS_OUT)
        # The Python worker lives on; what this task took goes back to the executor.
        held.clear()
        pa.default_memory_pool().release_unused()

    return (table.mapInArrow(run, f"{keys}, {values}").groupBy(*names)
            .agg(*[F.sum(x).alias(x) for x in sums]))


def _named(names: list[str], which: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(which))


# --- kept terms -------------------------------------------------------------------

def _level(table: DataFrame, before: int, level: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, prefix, open, docs) of the terms longer than ``before`` under the prefixes of ``bits``.

    ``open`` rows count the documents with a term longer than ``level`` under the
    prefix; the others count the documents of a complete term.
    """
    shared = None if bits is None else table.sparkSession.sparkContext.broadcast(bits)

    def make(pack):
        if shared is not None:
            pack.take(pack.length[pack.code] > before)
            pack.filter(before, shared.value)
        if not len(pack.doc):
            return None
        is_open = pack.length[pack.code] > level
        number, prefixes = pack.prefixes(level)
        n = len(prefixes)
        key, seen = pack.keys(number, n)
        # A complete term occurs once per document. Open terms of a document that
        # share a prefix stand side by side, as terms are in byte order.
        done = np.bincount(key[~is_open], minlength=len(pack.langs) * n)[seen]
        doc, more = pack.doc[is_open], key[is_open]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (more[1:] != more[:-1])
        opened = np.bincount(more[new], minlength=len(pack.langs) * n)[seen]
        at = np.concatenate([seen[done > 0], seen[opened > 0]])
        docs = np.concatenate([done[done > 0], opened[opened > 0]])
        return [_named(pack.langs, at // n), prefixes.take(pa.array(at % n)),
                pa.array(np.arange(len(at)) >= np.count_nonzero(done)), pa.array(docs)]

    return _summed(table, make, "lang string, prefix binary, open boolean", "docs bigint")


def kept_terms(table: DataFrame, min_docs: int, scratch: Scratch, first: int = FIRST) -> DataFrame:
    """(lang, term): terms in at least ``min_docs`` rows of a language, found level by level."""
    kept, before, level, bits = [], 0, first, None
    while True:
        frequent = scratch.settle(_level(table, before, level, bits).where(F.col("docs") >= min_docs))
        kept.append(frequent.where("NOT open").select("lang", F.col("prefix").alias("term")))
        ongoing = frequent.where("open")
        if ongoing.isEmpty():
            break
        bits, before, level = _bit_map(ongoing, "prefix"), level, 2 * level
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def term_counts(table: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in every group that has any."""
    shared = table.sparkSession.sparkContext.broadcast(_bit_map(kept, "term"))

    def make(pack):
        pack.filter(None, shared.value)
        if not len(pack.doc):
            return None
        names = {x: i for i, x in enumerate(dict.fromkeys(zip(pack.lang_of.tolist(), pack.sources)))}
        own = np.array([names[x] for x in zip(pack.lang_of.tolist(), pack.sources)], np.int64)
        pairs = own[pack.doc] * len(pack.terms) + pack.code
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        group, code = np.divmod(pairs[first], len(pack.terms))
        return [_named([pack.langs[x] for x, _ in names], group), _named([x for _, x in names], group),
                pack.terms.take(pa.array(code)), pa.array(np.add.reduceat(pack.count[order], first, dtype=np.int64))]

    return (_summed(table, make, "lang string, source string, term binary", "n bigint")
            .join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))


# --- divergence -------------------------------------------------------------------

def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / total), digit by digit in base 1000 so that 64 bits hold every step."""
    rest, out = n + 2, 0
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + part
    return out + 1


def share_sql(n: str, total: str) -> str:
    """``share`` as SQL; null where ``total`` is 0."""
    one = f"(({n} + 2) * 1000L)"
    two, three = f"({one} % {total} * 1000L)", f"({one} % {total} * 1000L % {total} * 1000L)"
    return f"(1L + {one} DIV {total} * 1000000L + {two} DIV {total} * 1000L + {three} DIV {total})"


def gap_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value, seen): summed gaps of the source pairs a < b over terms that a block pair holds.

    Terms absent from both blocks are not in ``value``; ``seen`` counts the others.
    """
    rows = counts.join(groups, ["lang", "source"]).selectExpr(
        "lang", "pmod(xxhash64(term), chunks) AS chunk", "no", "total", "blocks", "term", "n")
    # Every source is present in every chunk, whether or not it has a term there.
    every = groups.where("terms > 0").selectExpr(
        "lang", "explode(sequence(0L, chunks - 1)) AS chunk", "no", "total", "blocks", "CAST(NULL AS BINARY) AS term",
        "0L AS n")
    mine = f"no DIV {BLOCK_SOURCES}"
    dealt = rows.unionByName(every).withColumn("other", F.expr("explode(sequence(0L, blocks - 1))")).selectExpr(
        "lang", "chunk", f"least({mine}, other) AS i", f"greatest({mine}, other) AS j", "no", "total", "term", "n")
    schema = "lang string, a bigint, b bigint, value bigint, seen bigint"
    arrow = arrow_schema(schema)

    def run(key, t):
        lang, _, i, j = (k.as_py() for k in key)
        no, at = np.unique(np.asarray(t["no"], np.int64), return_inverse=True)
        total = np.zeros(len(no), np.int64)
        total[at] = np.asarray(t["total"], np.int64)
        has = np.asarray(t["term"].is_valid())
        coded = t["term"].filter(pa.array(has)).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        n = np.zeros((len(no), len(coded.dictionary)), np.int64)
        n[at[has], np.asarray(coded.indices, np.int64)] = np.asarray(t["n"], np.int64)[has]
        p = share(n, total[:, None])
        left = np.flatnonzero(no // BLOCK_SOURCES == i)
        right = np.flatnonzero(no // BLOCK_SOURCES == j)
        a, b, value = [], [], []
        for x in left:
            ys = right[right > x]
            if len(ys):
                d = p[ys] - p[x]
                value.append((d * d // (p[ys] + p[x])).sum(1))
                a.append(np.full(len(ys), no[x]))
                b.append(no[ys])
        a, b, value = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b, value))
        return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value),
                                     pa.array(np.full(len(a), n.shape[1], np.int64))], schema=arrow)

    return (dealt.groupBy("lang", "chunk", "i", "j").applyInArrow(run, schema)
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of every language, in exact arithmetic.

    Part ``pair``: the summed gap between a source's term shares and each other
    source's. Part ``term``: the ``top`` kept terms by which a source exceeds its
    language. Null text, lang and source count as ''. Every row is a document, also
    one that repeats another; terms of any length are read whole; ties rank by
    item in UTF-8 order; other columns are not read; an empty table gives no rows
    and a language without kept terms gives pairs of value 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.settle(term_packs(docs))
    kept = scratch.settle(kept_terms(table, min_docs, scratch))
    counts = scratch.settle(term_counts(table, kept))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = scratch.settle(
        docs.select(*_groups_of()).distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        .selectExpr("lang", "source", "coalesce(terms, 0L) AS terms", "coalesce(n, 0L) AS own",
                    "coalesce(n, 0L) + 2 * coalesce(terms, 0L) AS total",
                    f"1 + (coalesce(terms, 0L) DIV {CHUNK_TERMS}) AS chunks",
                    "CAST(row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS BIGINT) AS no",
                    f"1 + (count(1) OVER (PARTITION BY lang) - 1) DIV {BLOCK_SOURCES} AS blocks"))
    sums = scratch.settle(_pair_sums(counts, groups))
    p = groups.selectExpr("lang", "source", "no", "terms", f"{share_sql('0L', 'nullif(total, 0)')} AS p")
    q = p.selectExpr("lang", "source AS item", "no AS other", "p AS q")
    pairs = p.join(q, "lang").where("no <> other").selectExpr(
        "lang", "source", "item", "terms", "p", "q", "least(no, other) AS a", "greatest(no, other) AS b").join(
        sums, ["lang", "a", "b"], "left").selectExpr(
        "lang", "source", "'pair' AS part", "item",
        f"coalesce(value + (terms - seen) * ({gap_sql('p', 'q')}), 0L) AS value")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    langs = groups.groupBy("lang").agg((F.sum("own") + 2 * F.max("terms")).alias("lang_total"))
    terms = (counts.join(whole, ["lang", "term"]).join(groups.select("lang", "source", "total"), ["lang", "source"])
             .join(langs, "lang").selectExpr("lang", "source", "CAST(term AS STRING) AS item",
                                             f"{share_sql('n', 'total')} AS p", f"{share_sql('all', 'lang_total')} AS q")
             .where("p > q").selectExpr("lang", "source", "'term' AS part", "item", f"{gap_sql('p', 'q')} AS value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    out = settle(pairs.withColumn("rank", rank).unionByName(
        terms.withColumn("rank", rank).where(F.col("rank") <= top)))
    scratch.close()
    return out
