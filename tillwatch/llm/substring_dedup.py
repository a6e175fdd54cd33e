"""Substring deduplication: MinHash banding over paragraphs.

Two kinds of paragraph, both of ``LENGTH`` words or more:

    line   a line of the text.
    cut    ``LENGTH`` words inside running text, cut where the content says so: of
           every ``REACH`` consecutive three-word hashes the smallest starts one.
           The cut depends on the words alone, so a passage of REACH + LENGTH - 1
           (50) or more words holds at least one whole cut, the same in every
           document, wherever it stands.

Paragraphs of both kinds are compared with each other by MinHash banding and exact
Jaccard similarity of five-word shingles, ``SIMILAR`` or more.

1. One pass gives every paragraph a content hash of its shingles and ``BANDS`` band
   keys of ``ROWS`` MinHashes each: at similarity 0.8 a pair meets with probability
   1 - (1 - 0.8^ROWS)^BANDS = 0.972, equal paragraphs always.
2. Equal paragraphs collapse by content hash. Sums over a content's places (its
   documents' hashes, a weight of each, weighted starts) tell whether two contents
   always occur together, overlapping at the same distance: such cuts of one text
   and its copies are alike by nature, no repeats, and would fill the bands. All
   others are compared, whichever of their places lie apart. (Contents of exactly
   the same documents whose weighted distances happen to average below a cut's
   length also count as together.) Band keys move in packed arrays.
3. Candidates' shingles are collected by a second pass that a bit map of fixed
   size thins out. Inside a band the exact Jaccard similarity decides. Contents
   already linked are not compared again, and a band of many shingles is cut into
   blocks whose pairs are separate tasks; a task returns a spanning forest.
4. Components over the links are the passage classes. A class found at two places
   that do not overlap, in two documents or in one, is a repeat: its first place
   (document, position) stays, the others can be removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import WordHash, components, compress, even_parts, grams, mix, steps, unite, window_minima
from tillwatch.session import Scratch, broadcast_when_small, settle

LENGTH = 24
REACH = 27
SHINGLE = 5
ROWS, BANDS = 3, 5
SIMILAR = 0.8
MAP_BITS = 24
#: Paragraphs whose keys are packed together, and bytes of paragraphs per partition that meets them.
PACK_ROWS = 100_000
EXCHANGE_BYTES = 16 << 20
#: A key's target task stands beside the array, so half a key is enough. ``docs``, ``weight`` and ``starts`` are
#: sums over a content's places: hash of the document, its weight (1 to 8), weight times first word.
PACKED = np.dtype([("key", "<u4"), ("content", "<u8"), ("docs", "<u8"), ("weight", "<u4"), ("starts", "<i8")])
#: Contents of a band up to which all pairs are counted through shared shingles at once.
_FEW = 12
#: Shingles of a band that one task compares with each other.
BLOCK = 200_000
_HASH = WordHash(seed=11)
_SEEDS = np.array([mix(np.array([i + 1], np.uint64))[0] for i in range(ROWS * BANDS)], np.uint64)


class Paragraphs:
    """Paragraphs of one text: first words, word counts and contents of lines, then of cuts."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """Hashes of the text's words, and how many of them each line has."""
        self.shingles = grams(words, SHINGLE)
        starts = np.cumsum(sizes) - sizes
        long = sizes >= LENGTH
        cuts = window_minima(grams(words, 3)[:max(len(words) - LENGTH + 1, 0)], REACH)
        self.start = np.concatenate([starts[long], cuts]).astype(np.int64)
        self.words = np.concatenate([sizes[long], np.full(len(cuts), LENGTH)]).astype(np.int64)
        sums = np.zeros(len(self.shingles) + 1, np.uint64)
        np.cumsum(mix(self.shingles ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        with np.errstate(over="ignore"):
            self.content = mix(sums[self.start + self.words - SHINGLE + 1] - sums[self.start] + self.words.astype(np.uint64))

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of some paragraphs back to back, and how many each has."""
        sizes = self.words[which] - SHINGLE + 1
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.shingles[np.repeat(self.start[which], sizes) + place], sizes


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def paragraphs(texts: list[bytes]) -> list[Paragraphs]:
    """The paragraphs of each text; words are cut and hashed for all texts at once, each distinct word once."""
    x = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    inside = ~_BLANK[x]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(x[inside])]).dictionary_encode()
    words = _HASH.of(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
    # Lines end at line feeds; every text ends with the one that joins it to the next.
    breaks = np.flatnonzero(x == 10)
    line_stops = np.searchsorted(starts, breaks)
    sizes = np.diff(line_stops, prepend=0)
    text_stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    lines = np.searchsorted(breaks, text_stops) + 1
    out, line, word = [], 0, 0
    for stop in lines.tolist():
        n = int(line_stops[stop - 1])
        out.append(Paragraphs(words[word:n], sizes[line:stop]))
        line, word = stop, n
    return out


def bands(texts: list[Paragraphs]) -> np.ndarray:
    """Band keys of all paragraphs of some texts, paragraphs x BANDS."""
    sizes = [len(t.shingles) for t in texts]
    spans = np.concatenate([np.stack([t.start, t.start + t.words - SHINGLE + 1], 1).ravel() + at
                            for t, at in zip(texts, np.cumsum([0, *sizes[:-1]]))])
    padded = np.concatenate([*(t.shingles for t in texts), np.zeros(1, np.uint64)])
    out = np.zeros((len(spans) // 2, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j, seed in enumerate(_SEEDS):
            # Odd multiples of the hashes, folded once: a cheap family of permutations.
            h = (padded ^ seed) * (seed | np.uint64(1))
            h ^= h >> np.uint64(31)
            out[:, j // ROWS] = out[:, j // ROWS] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, spans)[::2]
        return mix(out ^ np.arange(1, BANDS + 1, dtype=np.uint64))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, start, words, content, keys): every paragraph of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in steps(batches):
            take, starts, words, contents, texts = [], [], [], [], []
            for i, found in enumerate(paragraphs(batch.column(1).cast(pa.binary()).to_pylist())):
                if not len(found.start):
                    continue
                take.append(np.full(len(found.start), i))
                starts.append(found.start)
                words.append(found.words)
                contents.append(found.content)
                texts.append(found)
            if not take:
                continue
            keys = bands(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.concatenate(take))), pa.array(np.concatenate(starts).astype(np.int32)),
                 pa.array(np.concatenate(words).astype(np.int32)), pa.array(np.concatenate(contents).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()),
                                          pa.array(keys.ravel().view(np.int64)))],
                ["doc_id", "start", "words", "content", "keys"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        run, f"doc_id {kind}, start int, words int, content bigint, keys array<bigint>")


def joined(batches, least: int):
    """The batches put together to ``least`` rows or more each (fewer at the end)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _runs(new: np.ndarray) -> np.ndarray:
    """Where each run begins, given what differs from the row before."""
    return np.flatnonzero(np.append(True, new))


def collapsed(rows: np.ndarray) -> np.ndarray:
    """One row of each key and content, ordered by both, with the sums over its places."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["content"], rows["key"]))]
    begin = _runs((rows["key"][1:] != rows["key"][:-1]) | (rows["content"][1:] != rows["content"][:-1]))
    out = rows[begin]
    for name in ("docs", "weight", "starts"):
        out[name] = np.add.reduceat(rows[name], begin)
    return out


def apart(rows: np.ndarray) -> np.ndarray:
    """Those of :func:`collapsed` whose band has two contents that do not always occur together."""
    if not len(rows):
        return rows
    begin = _runs(rows["key"][1:] != rows["key"][:-1])
    sizes = np.diff(np.append(begin, len(rows)))
    least, most = np.minimum.reduceat, np.maximum.reduceat
    far = most(rows["starts"], begin) - least(rows["starts"], begin) >= LENGTH * rows["weight"][begin].astype(np.int64)
    ok = (sizes > 1) & (far | (least(rows["docs"], begin) != most(rows["docs"], begin)))
    return rows[np.repeat(ok, sizes)]


def members(found: DataFrame) -> DataFrame:
    """(key, content, docs, weight, starts): contents of the bands with candidates, and sums over their places.

    One packed array per batch and target moves, 32 bytes for a key of a paragraph.
    """
    parts = even_parts(found, EXCHANGE_BYTES)
    targets = 4 * parts

    def pack(batches):
        for batch in joined(batches, PACK_ROWS):
            doc, start, content = (batch.column(i).to_numpy() for i in range(3))
            keys = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, BANDS)
            rows = np.zeros((len(doc), BANDS), PACKED)
            rows["key"] = keys >> np.uint64(32)
            weight = (doc.view(np.uint64) >> np.uint64(61)).astype(np.int64) + 1
            rows["content"], rows["docs"] = content.view(np.uint64)[:, None], doc.view(np.uint64)[:, None]
            rows["weight"], rows["starts"] = weight[:, None], (weight * start)[:, None]
            rows, target = rows.ravel(), (keys % np.uint64(targets)).astype(np.int32).ravel()
            order = np.argsort(target, kind="stable")
            rows, target = rows[order], target[order]
            names, at = np.unique(target, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([collapsed(x).tobytes() for x in np.split(rows, at[1:])], pa.binary())],
                ["target", "rows"])

    def meet(batches):
        def out(target, parts):
            rows = apart(collapsed(np.frombuffer(b"".join(parts), PACKED)))
            return pa.RecordBatch.from_arrays(
                [pa.array((target << 32) + rows["key"].astype(np.int64)), pa.array(rows["content"].view(np.int64)),
                 pa.array(rows["docs"].astype(np.uint64).view(np.int64)), pa.array(rows["weight"].astype(np.int64)),
                 pa.array(rows["starts"].astype(np.int64))], ["key", "content", "docs", "weight", "starts"])

        held, at = [], None
        for batch in batches:
            for target, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if target != at and held:
                    yield out(at, held)
                    held = []
                at = target
                held.append(part)
        if held:
            yield out(at, held)

    packed = found.selectExpr("xxhash64(doc_id) AS doc", "start", "content", "keys").mapInArrow(
        pack, "target int, rows binary")
    return packed.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(
        meet, "key bigint, content bigint, docs bigint, weight bigint, starts bigint")


def bit_map(numbers: DataFrame) -> np.ndarray:
    """``MAP_BITS`` low bits of the numbers (one column), as a bit map; at most 2 ** (MAP_BITS - 6) words move."""
    low = numbers.toDF("x").selectExpr(f"x & {(1 << MAP_BITS) - 1} AS b")
    words = low.selectExpr("b DIV 64 AS w", "shiftleft(1L, CAST(b % 64 AS INT)) AS v").groupBy("w").agg(
        F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), "<i8")
    bits[np.asarray(words["w"], np.int64)] = np.asarray(words["v"], np.int64)
    return bits.view(np.uint8)


def let_in(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    low = numbers & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1


def shingle_sets(docs: DataFrame, let_through, sources) -> DataFrame:
    """(content, shingles) of the paragraphs a bit map of content hashes lets through.

    Only texts whose id a second bit map lets through are read: the first places
    of the contents.
    """
    def run(batches):
        for batch in steps(batches):
            bits = let_through.value
            wanted = let_in(sources.value, batch.column(0).to_numpy().view(np.uint64)) == 1
            batch = batch.filter(pa.array(wanted))
            names, flat, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for found in paragraphs(batch.column(1).cast(pa.binary()).to_pylist()):
                which = np.flatnonzero(let_in(bits, found.content))
                if len(which):
                    x, n = found.sets(which)
                    names.append(found.content[which])
                    flat.append(x)
                    sizes.append(n)
            names, flat, sizes = (np.concatenate(c) for c in (names, flat, sizes))
            # Each content once, each of its shingles once, ascending.
            once = np.zeros(len(names), bool)
            once[np.unique(names, return_index=True)[1]] = True
            flat, names, sizes = flat[np.repeat(once, sizes)], names[once], sizes[once]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, owner))
            flat = flat[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.bincount(owner[new], minlength=len(sizes)), out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[new].view(np.int64)))],
                ["content", "shingles"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("xxhash64(doc_id) AS doc", "text").mapInArrow(
        run, "content bigint, shingles array<bigint>")


def comparable(places: np.ndarray, i, j) -> np.ndarray:
    """Whether contents i and j do not always occur together; ``places`` is (docs, weight, starts)."""
    docs, weight, starts = places.T
    return (docs[i] != docs[j]) | (weight[i] != weight[j]) | (np.abs(starts[i] - starts[j]) >= LENGTH * weight[i])


def similar(sets: list[np.ndarray], least: float = SIMILAR, places: np.ndarray | None = None) -> np.ndarray:
    """For each content the index of the smallest one it is linked to, by exact Jaccard.

    An index from each shingle to the contents that hold it counts what a content
    shares with every other one. Contents already linked are not linked again,
    those that always occur together by their ``places`` never.
    """
    n = len(sets)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(root, sizes)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    held_by, first = owner[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    at = np.cumsum(sizes) - sizes
    for i in range(n):
        if (root == root[i]).all():
            break
        mine = number[at[i]:at[i] + sizes[i]]
        lists = [held_by[first[k]:first[k + 1]] for k in mine]
        both = np.bincount(np.concatenate(lists) if lists else np.zeros(0, int), minlength=n)
        near = np.flatnonzero((both >= least * (sizes + sizes[i] - both)) & (root != root[i]))
        if places is not None:
            near = near[comparable(places, near, i)]
        if len(near):
            root = compress(unite(root, np.full(len(near), i), near))
    return root


def small_links(group: np.ndarray, sizes: np.ndarray, flat: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of contents within their groups, for many groups of few contents at once.

    Content i holds the next ``sizes[i]`` shingles of ``flat`` and lies in ``group[i]``.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, flat, group[owner]))
    own, val, grp = owner[order], flat[order], group[owner[order]]
    left, right = [], []
    for gap in range(1, _FEW):  # the same shingle, held by contents of one group
        same = (val[gap:] == val[:-gap]) & (grp[gap:] == grp[:-gap])
        if not same.any():
            break
        left.append(own[:-gap][same])
        right.append(own[gap:][same])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, both = np.unique(np.concatenate(left) * len(sizes) + np.concatenate(right), return_counts=True)
    i, j = np.divmod(pairs, len(sizes))
    ok = (both >= SIMILAR * (sizes[i] + sizes[j] - both)) & comparable(places, i, j)
    return i[ok], j[ok]


def _verify(batches):
    """Spanning links of rows (key, block, content, shingles, docs, weight, starts), sorted by the first three."""
    held = []

    def table(batch, at, stop):
        part = batch.slice(at, stop - at)
        lists = part.column(3)
        offsets = np.asarray(lists.offsets, np.int64)
        return (np.asarray(part.column(2), np.int64), np.diff(offsets),
                lists.values.to_numpy()[offsets[0]:offsets[-1]],
                np.stack([np.asarray(part.column(k), np.int64) for k in (4, 5, 6)], 1))

    def out(parts):
        """Links among rows of whole groups; ``parts`` holds (group, content, sizes, flat, places)."""
        group, names, sizes, flat, places = (np.concatenate(x) for x in zip(*parts))
        starts = np.cumsum(sizes) - sizes
        begin = _runs(group[1:] != group[:-1])
        counts = np.diff(np.append(begin, len(group)))
        few = np.repeat(counts <= _FEW, counts)
        some = np.flatnonzero(few)
        root = unite(np.arange(len(some)), *small_links(group[some], sizes[some], flat[np.repeat(few, sizes)], places[some]))
        own = np.flatnonzero(root != np.arange(len(some)))
        a, b = [names[some[own]]], [names[some[root[own]]]]
        for g in np.flatnonzero(counts > _FEW).tolist():
            at = np.arange(begin[g], begin[g] + counts[g])
            root = similar([flat[starts[x]:starts[x] + sizes[x]] for x in at.tolist()], places=places[at])
            own = np.flatnonzero(root != np.arange(len(at)))
            a.append(names[at[own]])
            b.append(names[at[root[own]]])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    last, number = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(k), np.int64) for k in (0, 1)], 1)
        new = np.append(last is None or tuple(keys[0]) != last, (keys[1:] != keys[:-1]).any(1))
        group = number + np.cumsum(new)
        number, last = int(group[-1]), tuple(keys[-1])
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if held and new.any():
            # Everything before the last group that begins here is whole.
            held.append((group[:cut], *table(batch, 0, cut)))
            yield out(held)
            held = []
        elif cut:
            yield out([(group[:cut], *table(batch, 0, cut))])
        held.append((group[cut:], *table(batch, cut, batch.num_rows)))
    if held:
        yield out(held)


def links(docs: DataFrame, found: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different paragraphs of similarity ``SIMILAR`` or more."""
    share = docs.sparkSession.sparkContext.broadcast
    met = scratch.settle(members(found))
    # One document of each wanted content is read again.
    wanted = share(bit_map(met.select("content")))

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(let_in(wanted.value, batch.column(0).to_numpy().view(np.uint64)) == 1))

    first = found.selectExpr("content", "xxhash64(doc_id) AS doc").mapInArrow(kept, "content bigint, doc bigint").groupBy(
        "content").agg(F.min("doc").alias("doc"))
    sources = share(bit_map(first.select("doc")))
    sets = shingle_sets(docs, wanted, sources).groupBy(
        "content").agg(F.first("shingles").alias("shingles"))
    counted = met.groupBy("key").agg((F.count(F.lit(1)) * LENGTH).alias("n"))
    large = counted.where(F.col("n") > block).selectExpr("key", f"CAST(ceil(n / {block}) AS INT) AS cut")
    dealt = met.join(broadcast_when_small(scratch.settle(large), 100_000), "key", "left").selectExpr(
        "key", "content", "docs", "weight", "starts", "CAST(pmod(xxhash64(content), coalesce(cut, 1)) AS INT) AS own",
        "coalesce(cut, 1) AS cut")
    # Every pair of blocks of a large band is a group of its own.
    dealt = dealt.selectExpr(
        "key", "content", "docs", "weight", "starts",
        "explode(transform(sequence(0, cut - 1), i -> least(i, own) * cut + greatest(i, own))) AS block")
    return (dealt.join(sets, "content").select("key", "block", "content", "shingles", "docs", "weight", "starts")
            .repartition("key", "block").sortWithinPartitions("key", "block", "content")
            .mapInArrow(_verify, "a bigint, b bigint"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, class_id, first_doc_id, removable) per repeated passage.

    One row per paragraph whose class occurs at two places or more that do not
    overlap, in several documents or in one.
    ``first_doc_id`` is the smallest doc_id of the class, ``removable`` is false
    for the first place of the class, and for places of its document that overlap it
    in a row, as they are mostly the same words. Rows with a null text or id hold no
    paragraph; repeated rows (same id and text) are one document; texts under
    ``LENGTH`` words have no paragraph; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.settle(units(docs))
        roots = components(links(docs, found, scratch))
        named = found.select("doc_id", "start", "words", "content")
        # Most contents are met in one document only; they leave on numbers alone.
        linked = roots.selectExpr("node AS content", "root")
        lows = named.groupBy("content").agg(
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.expr("min(start + words) AS stop"),
            F.max("start").alias("start")).join(
            linked, "content", "left").where("lo <> hi OR stop <= start OR root IS NOT NULL").selectExpr(
            "content", "coalesce(root, content) AS class", "lo", "hi", "stop", "start")
        # Written first: a plain table lets Spark split a hot class on the other side of the join.
        classes = scratch.settle(
            lows.groupBy("class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("stop").alias("stop"),
                                      F.max("start").alias("start")).where("lo <> hi OR stop <= start"))
        of_content = lows.select("content", "class").join(classes.select("class", "lo"), "class")
        flagged = scratch.settle(named.join(of_content, "content").dropDuplicates(["doc_id", "start", "class"]))
        # Word after the first run of overlapping places; the list is bounded by one document.
        first = scratch.settle(flagged.where("doc_id = lo").groupBy("class").agg(
            F.expr("sort_array(collect_list(named_struct('s', start, 'e', start + words)))").alias("places")).selectExpr(
            "class", "aggregate(places, places[0].e, (e, x) -> IF(x.s < e, greatest(e, x.e), e)) AS stop"))
        return settle(flagged.join(first, "class").selectExpr(
            "doc_id", "start AS start_word", "start + words AS end_word", "lower(lpad(hex(class), 16, '0')) AS class_id",
            "lo AS first_doc_id", "doc_id <> lo OR start >= stop AS removable"))
