"""Corpus operators against brute force on small tables with nulls, ties and hostile texts."""

import base64
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from compare import canon
from tillwatch.llm import (
    bpe, common, decontaminate, langid, line_dedup, queries, simhash, sketch, substring_dedup, token_counts, token_files,
    warc)
from tillwatch.session import new_folder

VOCABULARY = queries.VOCABULARY
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, place int, p string"
HOSTILE = ["", None, " ", "\n\n\n", "<|endoftext|>x<|startoftext|>", "É é ΑΣ Σ İ ﬁ １ ٣", "a\x1cb\x85c d", "x" * 5000,
           "ab " * 3000, "日本語のテキスト", "don't I'LL we've", "\t\r\n mixed \r\n lines\r\n", "😀 😀", "0 1 2 .", "!?!"]


def frame(spark, texts, langs=None, ids=None):
    """Documents with extra columns whose names the operators use inside; the last two rows repeat one, without and with id."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), "extra", 1, "q")
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(sf):
    con = duckdb.connect()
    got = [r[0] for r in con.execute(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    return got + HOSTILE + got[:3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = [*range(len(texts)), None, None, 0]
    return frame(spark, [*texts, texts[0], None, texts[0]], ids=ids).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return repr(tuple(row))


# --- tokens ---------------------------------------------------------------------

def library(text):
    tok = Tokenizer.from_file(VOCABULARY)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(docs, empty):
    want = []
    for r in docs.collect():
        ids, back = library(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.round_trip(docs, VOCABULARY).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert bpe.round_trip(empty, VOCABULARY).count() == 0


def test_bpe_random_strings():
    rng = random.Random(3)
    parts = ["a", "b", "th", "e", "'s", "'re", " ", "\n", "é", "é", "Σ", "ß", "1", "!", "#", "<|endoftext|>", "日", "​"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(800)]
    tok = Tokenizer.from_file(VOCABULARY)
    for encoder in (bpe.WordBpe(VOCABULARY), token_files.LibraryBpe(VOCABULARY)):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)]
        assert got == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    monkeypatch.setattr(bpe, "WORDS", 3)
    encoder = bpe.WordBpe(VOCABULARY)
    for t in ["one two three four", "five six one two", "seven"]:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library(t)[0]


def test_token_files_round_trip(spark, docs, empty):
    folder = new_folder(spark, "tokens")
    token_files.write(docs, folder, VOCABULARY, 2)
    got = token_files.read(spark, folder, VOCABULARY).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = [*library(r.text)[0], 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(key, got)) == sorted(map(key, want))
    # The files by themselves: flat integers, documents in order.
    path = re.sub("^file:(//)?", "", folder)
    flat = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        shard = token_files.Shard(f, 2)
        flat += shard.tokens.tolist()
    assert flat == [i for r in rows for i in [*library(r.text)[0], 2]]
    nothing = new_folder(spark, "tokens")
    token_files.write(empty, nothing, VOCABULARY, 2)
    assert token_files.read(spark, nothing, VOCABULARY).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_line(docs, empty, rule):
    tok = Tokenizer.from_file(queries.RANKS_TWIN)
    tok.encode_special_tokens = True
    args = (queries.RANKS, public_tokenizers.PATTERN, queries.RANKS_TWIN, rule)
    got = token_counts.by_line(docs, *args).collect()
    want = []
    for r in docs.collect():
        text = r.text or ""
        ends = [m.end() for m in re.finditer("\n", text)]
        if not ends or ends[-1] != len(text):
            ends.append(len(text))
        starts = [0, *ends[:-1]]
        raw = [len(text[:e].encode()) for e in ends]
        spans, at = [], 0
        for t in tok.encode(text, add_special_tokens=False).tokens:
            spans.append((at, at + len(t)))  # a byte-level token has a character per byte
            at += len(t)
        for n, (a, b) in enumerate(zip(starts, ends)):
            lo, hi = ([0, *raw][n], raw[n])
            crossing = sum(lo <= s < hi < e for s, e in spans)
            if rule == "first":
                count = sum(lo <= s < hi for s, _ in spans)
            elif rule == "share":
                count = sum(max(min(e, hi) - max(s, lo), 0) / (e - s) for s, e in spans)
            else:
                count = 0
                for s, e in spans:
                    held = [max(min(e, h) - max(s, low), 0) for low, h in zip([0, *raw], raw)]
                    count += held.index(max(held)) == n
            want.append((r.doc_id, n, a, b, count, crossing))
    assert [x[:4] + x[5:] for x in sorted(map(tuple, got), key=repr)] == [x[:4] + x[5:] for x in sorted(want, key=repr)]
    assert sum(x.n_tokens for x in got) == pytest.approx(sum(x[4] for x in want))
    place = lambda x: (x[0] is None, x[0] or 0, *x[1:4], round(float(x[4]), 6))
    assert sorted(map(place, got)) == sorted(map(place, want))
    assert token_counts.by_line(empty, *args).count() == 0


def test_long_white_space_is_encoded():
    encoder = token_counts.ByteTokens(queries.RANKS, public_tokenizers.PATTERN, queries.RANKS_TWIN)
    text = "a" + " " * 300_000 + "b\n"
    assert encoder.lengths[encoder.encode(text)].sum() == len(text)


# --- near duplicates ---------------------------------------------------------------

def brute_classes(fps, limit=4):
    values = np.array(sorted(set(fps)), np.uint64)
    root = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= limit
    while True:
        low = np.where(near, root[None, :], len(values)).min(1)
        if (low == root).all():
            return dict(zip(values.tolist(), root.tolist()))
        root = low


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(docs, empty):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    classes = brute_classes(fps)
    low = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            low[classes[f]] = min(low.get(classes[f], r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{f:016x}", low.get(classes[f])) for r, f in zip(rows, fps)]
    assert sorted(map(key, simhash.near_duplicates(docs).collect())) == sorted(map(key, want))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each_class(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    classes = brute_classes([brute_fingerprint(r.text) for r in docs.collect()])
    got = [classes[brute_fingerprint(r.text)] for r in rows]
    assert len(got) == len(set(got)) == len(set(classes.values()))
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("bucket", [4, 60, 10_000])
def test_links_span_dense_groups_at_any_bucket_size(spark, bucket):
    rng = np.random.default_rng(bucket)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    codes = base[rng.integers(0, 4, 400)]
    for _ in range(6):
        codes ^= (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * (rng.random(400) < 0.5).astype(np.uint64)
    codes = np.unique(np.append(codes, [np.uint64(0), np.uint64(15), ~np.uint64(0)]))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint")
    edges = simhash.links(df, bucket=bucket)
    roots = {r.node: r.root for r in common.components(edges).collect()}
    want = brute_classes(codes.tolist())
    got = {}
    for c in codes.tolist():
        signed = simhash._signed(c)
        got.setdefault(roots.get(signed, signed), set()).add(want[c])
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want.values()))


def test_components_of_paths_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (-5, 200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), -5: -5, 200: -5}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_repeated_passages_are_found(spark, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    text = lambda n: [word() for _ in range(n)]
    passage, other = text(50), text(60)
    rows = [text(80) for _ in range(12)]
    for k, at in ((1, 0), (4, 33), (7, 80)):
        rows[k][at:at] = passage
    for k, at in ((2, 10), (5, 71)):
        rows[k][at:at] = other
    near = rows[9].copy()
    near[23] = word()  # its last shingle alone differs in the first paragraphs
    texts = [" ".join(r) for r in rows] + [" ".join(near), "", None, "short text", " ".join(passage)]
    docs = frame(spark, texts, ids=[*range(len(texts) - 1), None])
    got = substring_dedup.repeats(docs).collect()
    assert {r.doc_id for r in got} == {1, 4, 7, 2, 5, 9, 12}
    for r in got:
        assert r.first_doc_id == {1: 1, 4: 1, 7: 1, 2: 2, 5: 2, 9: 9, 12: 9}[r.doc_id]
        assert r.removable == (r.doc_id != r.first_doc_id)
        assert r.end_word - r.start_word >= substring_dedup.LENGTH
    assert substring_dedup.repeats(empty).count() == 0


def test_similar_paragraphs_link_in_blocks(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(24)]
    texts = []
    for k in range(30):  # one word at an end differs: Jaccard 19/21
        w = base.copy()
        w[23] = f"other{k}"
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    with substring_dedup.Scratch(spark) as scratch:
        found = scratch.settle(substring_dedup.units(docs))
        for block in (80, 100_000):
            edges = substring_dedup.links(docs, found, scratch, block)
            assert edges.count() < 30 * 40
            roots = common.components(edges)
            assert roots.select("root").distinct().count() == 1 and roots.count() == 30


def test_near_copies_inside_running_text_link(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(400)]
    edited = passage.copy()
    for at in range(11, 400, 23):  # no 24 words in a row are left
        edited[at] = word()
    run = lambda w: " ".join([word() for _ in range(30)] + w + [word() for _ in range(30)])
    wrapped = "\n".join(" ".join(edited[k:k + 10]) for k in range(0, 400, 10))
    for other in (run(edited), wrapped):
        got = substring_dedup.repeats(frame(spark, [run(passage), other])).collect()
        assert {r.doc_id for r in got} == {0, 1}
        assert all(r.removable == (r.doc_id == 1) for r in got)


def test_overlapping_cuts_of_one_text_do_not_link(spark):
    rng = random.Random(17)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    with substring_dedup.Scratch(spark) as scratch:
        for texts in ([text], [text, text]):
            docs = frame(spark, texts)
            found = scratch.settle(substring_dedup.units(docs))
            assert found.count() > 100 and substring_dedup.links(docs, found, scratch).count() == 0
    assert not any(r.removable for r in substring_dedup.repeats(frame(spark, [text, text])).collect() if r.doc_id == 0)


# --- lines and benchmark -----------------------------------------------------------

def test_queries_match_their_sql(spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall()), name


def brute_lines(rows):
    """Kept text by (id, text)."""
    def order(r):
        return (r[0] is not None, r[0] or 0, r[2])

    seen, out = {}, {}
    for r in sorted({(r.doc_id, r.text, r.th) for r in rows if r.text is not None}, key=order):
        lines = r[1].split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        n = [len(re.findall("[^\t-\r ]+", lines[i])) for i in at]
        for p in range(len(at)):
            for size in (1, 2, 3):
                part = n[p:p + size]
                if len(part) < size or size < 3 and (sum(part) < 50 or size == 2 and max(part) >= 50):
                    continue
                w = tuple(lines[i] for i in at[p:p + size])
                if w in seen:
                    gone.update(at[p:p + size])
                seen.setdefault(w, True)
        out[r[0], r[1]] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_runs_against_brute_force(spark, empty):
    rng = random.Random(8)
    lines = [f"line {i}" for i in range(12)] + ["", " \t"]
    lines += [f"{i} " + sep.join("w" * 49) for i, sep in enumerate([" ", " \t ", "   "])]  # 50 words each
    lines += [f"{i} " + " ".join("v" * k) for i, k in enumerate([24, 24, 25, 48])]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 25))) for _ in range(60)] + [None, "", "line 1", "\n" * 9]
    texts += [lines[14], lines[14], lines[17] + "\n\n" + lines[18], lines[17] + "\n" + lines[18]]
    docs = frame(spark, texts, ids=[None, None, *range(len(texts) - 4), 3, 3])
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS th").collect()
    brute = brute_lines(rows)
    want = []
    for r in rows:
        n, gone, kept = brute.get((r.doc_id, r.text), (0, 0, None))
        want.append((r.doc_id, n, gone, None if kept is None else hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(key, line_dedup.report(docs).collect())) == sorted(map(key, want))
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    kept = sorted((key((r.doc_id, r.text)) for r in cleaned.collect()))
    left = [(r.doc_id, brute[r.doc_id, r.text][2] if r.text is not None else None) for r in rows
            if r.text is None or not brute[r.doc_id, r.text][1] or brute[r.doc_id, r.text][2].strip(" \t\r\n")]
    assert kept == sorted(map(key, left))
    assert line_dedup.report(empty).count() == 0


def test_long_paragraphs_repeat_by_themselves(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), " ".join(f"s{i}" for i in range(49))
    docs = frame(spark, [f"a\n{long}\nb", f"c\n{long}\nd", f"e\n{short}\nf", f"g\n{short}\nh"])
    got = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    first, second, third, fourth = (got[i] for i in sorted(got))
    assert (first, second) == (f"a\n{long}\nb", "c\nd")
    assert (third, fourth) == (f"e\n{short}\nf", f"g\n{short}\nh")


def test_selected_positions_thin_out_windows_and_miss_none(spark):
    rng = random.Random(11)
    rows = [[f"x{rng.randint(0, 400)}" for _ in range(size)] for size in (0, 1, 2, 3, 4, 500, 3000)]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, lines array<string>").selectExpr(
        "id", "transform(lines, x -> xxhash64(x)) AS h", "transform(lines, x -> 1) AS n")
    for run, gram in ((3, 2), (3, 1), (6, 2)):
        got = docs.selectExpr("id", "h", f"{line_dedup.selected(run, gram)} AS s").collect()
        grams = {r.id: [tuple(r.h[j:j + gram]) for j in range(len(r.h) - gram + 1)] for r in got}
        held = {}
        for r in got:
            windows = len(r.h) - run + 1
            covered = [p for s in r.s for p in range(s.lo, s.hi + 1)]
            assert covered == list(range(1, windows + 1))  # every window chose one position
            for s in r.s:
                assert s.hi <= s.m <= s.lo + run - gram  # inside all windows that chose it
                assert held.setdefault(grams[r.id][s.m - 1], s.mark) == s.mark
            if windows > 400:  # of random lines about two in (grams of a window + 1) positions are chosen
                assert len(r.s) < windows * (2 / (run - gram + 2) + 0.08)


def test_line_dedup_has_no_python(docs):
    plan = line_dedup.report(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_against_brute_force(spark, docs, empty, sf):
    rng = random.Random(9)
    base = docs.collect()
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(6).collect()]
    items = spark.createDataFrame(
        [*enumerate(bench), (6, None), (7, "..."), (8, "one two three"), (9, "x y z w v u t"), (10, bench[0]), (11, "日本 é"),
         (None, "one two three")], "item_id bigint, text string")
    odd = ["One, TWO three! one two three", "x y z w v u t s", "z w v " + bench[0].upper() + " tail", "日本 é. 日本", "one two"]
    odd += [" ".join(rng.choices(["one", "two", "three", "x", "y"], k=40)) for _ in range(10)]
    odd += [" ".join(fold(bench[1])[3:16]), " ".join(fold(bench[1])[3:15]), " ".join(fold(bench[2]) * 3)]
    more = frame(spark, odd, ids=[1000 + i for i in range(len(odd) - 1)] + [None])
    table = docs.union(more)
    windows = {}
    for r in items.collect():
        w = fold(r.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(r.item_id)
    lengths = {len(w) for w in windows}
    want = []
    for r in table.collect():
        w = fold(r.text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    ids |= found
        ids = sorted(str(i) for i in ids - {None})
        want.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                     bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.report(table, items).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    clean = decontaminate.clean(table, items)
    assert clean.columns == table.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.report(empty, items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert len(base) == decontaminate.report(docs, items.limit(0)).count()


# --- sketches ------------------------------------------------------------------------

def test_sketches_with_next_document(docs, empty):
    rows = docs.collect()
    known = sorted((r for r in rows if r.doc_id is not None), key=lambda r: (-r.doc_id, r.text or ""))
    want = []
    for k, r in enumerate(known):
        text, after = r.text or "", known[(k + 1) % len(known)].text or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        want.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.to_text(sketch.sketch(text)),
                     sketch.to_text(sketch.sketch(edited)), sketch.resemblance(sketch.sketch(text), sketch.sketch(edited)),
                     sketch.resemblance(sketch.sketch(text), sketch.sketch(after))))
    got = [tuple(r)[:7] for r in sketch.compare_with_next(docs).collect()]
    assert sorted(map(key, [g for g in got if g[0] is not None])) == sorted(map(key, want))
    alone = [g for g in got if g[0] is None]
    assert len(alone) == len(rows) - len(known) and all(g[6] is None for g in alone)
    assert sketch.compare_with_next(empty).count() == 0
    assert sketch.compare_with_next(docs.where("doc_id = 5")).first().near_next == 1.0


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdefghij ", k=40_000)) for _ in range(2))
    both = sketch.merge(sketch.sketch(a), sketch.sketch(b))
    joined = sketch.sketch(a + b)
    assert len(np.setxor1d(both, joined)) <= 3  # shingles over the seam
    assert sketch.containment(sketch.sketch(a[:10_000]), sketch.sketch(a)) > 0.99
    assert sketch.resemblance(sketch.sketch(a[:20_000]), sketch.sketch(a)) == pytest.approx(0.5, abs=0.05)
    assert sketch.from_text(sketch.to_text(both)).tolist() == both.tolist()
    assert len(sketch.sketch("")) == 0 and len(sketch.sketch("ab")) == 1


def test_containment_is_null_for_a_fallback_hash(spark):
    rng = random.Random(2)
    some = ("".join(rng.choices("abcdefgh ", k=20)) for _ in range(1000))
    short = next(t for t in some if sketch.sketch(t)[0] >= (1 << 64) // sketch.SCALE)
    long = short + "".join(rng.choices("abcdefgh ", k=20_000))
    assert sketch.containment(sketch.sketch(short), sketch.sketch(long)) is None
    got = {r.doc_id: r for r in sketch.compare_with_next(frame(spark, [long, short])).collect()}
    assert got[1].contained_next is None and got[0].contained_edited is not None


# --- archives --------------------------------------------------------------------------

def test_archives_round_trip(spark):
    pages = [(1, "http://a/x y", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://c", ""),
             (5, "http://d", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "http://e", "é\n\nX-Page-Id: 9\r\n"),
             (None, "http://f", "<p>same</p>"), (7, "http://g", "z" * 300_000), (2, "http://b", "<p>same</p>")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id bigint, url string, html string, block string").repartition(2)
    arc, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc.write_arc(df, arc)
    warc.convert(spark, arc, out)
    top = {}
    for p, _, html in pages:
        raw = (html or "").encode()
        top[raw] = max(top.get(raw, -1), -1 if p is None else p)
    want = []
    for p, _, html in pages:
        raw = (html or "").encode()
        visit = p != top[raw]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if visit else "response",
                     top[raw] if visit else None))
    assert sorted(map(key, warc.page_report(spark, out).collect())) == sorted(map(key, want))
    nothing, converted = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc.write_arc(df.limit(0), nothing)
    warc.convert(spark, nothing, converted)
    assert warc.page_report(spark, converted).count() == 0


def test_arc_versions_and_members():
    import gzip
    v1 = b"filedesc://x 0.0.0.0 20010101000000 text/plain 75\n1 0 org\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    body = b"1 0 org\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    v1 = b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n" % len(body) + body + b"\n"
    r1 = b"http://a b 1.2.3.4 20020202020202 text/html 11\nhello\nworld\n"
    records = list(warc.arc_records(warc.Stream(gzip.compress(v1) + gzip.compress(r1))))
    assert records[0][0]["URL"] == "http://a%20b" and records[0][1] == b"hello\nworld"
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(warc.Stream(v1 + b"http://a 1.2.3.4 20020202020202 text/html 99\nshort")))


# --- language ----------------------------------------------------------------------------

def test_language_accuracy_and_null_cases(spark, sf, docs, empty):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(whole).join(whole.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = {r.doc_id: r for r in langid.identify(whole.select("doc_id", "text", "lang").union(
        spark.createDataFrame([(-1, None, "en"), (-2, "12 .. !", "en"), (-3, "", None), (-4, "the and of with", None)],
                              "doc_id bigint, text string, lang string"))).where("doc_id < 0").collect()}
    assert [odd[-k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and odd[-4].lang_pred == "en"
    assert langid.identify(empty).count() == 0
    assert langid.identify(docs).count() == docs.count()
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang = ''").union(
        docs.limit(0))).collect()} <= {"", "und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, sf):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "simhash_near_dedup"
    docs = whole
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < 4:
            assert made.columns == whole.columns, name
            folder = new_folder(spark, "stage")
            made.write.parquet(folder)
            docs = spark.read.parquet(folder)
    rows = whole.selectExpr("doc_id", "text", "xxhash64(text) AS th").collect()  # no text lacks letters here
    left = {i: kept for (i, _), (_, gone, kept) in brute_lines(rows).items() if not gone or kept.strip(" \t\r\n")}
    prints = {i: brute_fingerprint(t) for i, t in left.items()}
    classes = brute_classes(list(prints.values()))
    first = {}
    for i in sorted(left):
        first.setdefault(classes[prints[i]], i)
    bench = [fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + min(13, len(w))]) for w in bench for i in range(len(w) - min(13, len(w)) + 1)}
    want = []
    for i in first.values():
        w = fold(left[i])
        hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows
               for p in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            continue
        ids, back = library(left[i])
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("step", [common.STEP_CHARS, 1])
def test_steps_cover_all_rows(step):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"k": list(range(5)), "text": ["a" * 10, None, "", "b" * 3, "c"]})
    got = [r for b in common.steps([batch], limit=step) for r in b.to_pylist()]
    assert got == batch.to_pylist()


# --- inner bounds and hot groups -------------------------------------------------------------

def test_language_features_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab É1 .\n日😀ßİ", k=rng.randrange(0, 40))) for _ in range(200)]
    whole = [sorted(np.concatenate([np.zeros(0, np.int64), *langid.features(t)]).tolist()) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_SEGMENT", size)
        assert [sorted(np.concatenate([np.zeros(0, np.int64), *langid.features(t)]).tolist()) for t in texts] == whole


def test_a_hot_payload_is_split(spark):
    """Two thirds of the pages are one error page: both joins split it."""
    pages = spark.range(6000).selectExpr(
        "id AS page_id", "concat('http://h/', id) AS url",
        "IF(id % 3 = 0, concat('<p>', sha2(CAST(id AS STRING), 512), '</p>'), repeat('not found ', 40)) AS html").repartition(8)
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        arc, out = new_folder(spark, "arc"), new_folder(spark, "warc")
        warc.write_arc(pages, arc)
        records = warc.arc_facts(spark, arc, blocks=True)
        groups = warc.settle(records.groupBy("payload").agg({"id": "max"}).selectExpr(
            "payload", "`max(id)` AS first_id", "'u' AS first_url", "'d' AS first_date"))
        met = warc.with_first(records, groups, 0)
        met.collect()
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
        warc.convert(spark, arc, out)
        report = warc.page_report(spark, out)
        rows = report.collect()
        assert "skew=true" in report._jdf.queryExecution().executedPlan().toString()
        assert sum(r.record_type == "revisit" for r in rows) == 3999 and len(rows) == 6000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_unknown_scripts_leave_at_the_language_stage(spark, sf):
    """Texts in scripts no learnt language has score like a guess among all languages and go; known ones stay."""
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    junk = [(90_000, "Это совсем другой язык и другие буквы"), (90_001, "ελληνικά γράμματα μόνο"), (90_002, "12 .. 77"),
            (90_003, None)]
    planted = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in junk],
                                    "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_id(spark, whole.unionByName(planted.select(*whole.columns)), sf)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {i for i, _ in junk} and len(ids) >= 0.99 * whole.count()
