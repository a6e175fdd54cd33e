"""The cuckoo index against grouping by text, with deletions, overflow, nulls and repeated rows."""

import hashlib
import random
import re

import pytest

from tillwatch.llm import exact_dedup as X
from tillwatch.session import new_folder

SCHEMA = "doc_id bigint, text string, digest string, live int, place string"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1, "q") for i, t in rows], SCHEMA).repartition(3)


def want(rows):
    """Expected report rows; equal rows are kept once."""
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, got in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for nth, (_, _, _, i) in enumerate(sorted(got, key=lambda r: r[:3])):
            out.append((i, min(got, key=lambda r: r[:3])[3], len(got), nth == 0, sha))
    return sorted(map(repr, out))


def rows_of(report):
    return sorted(repr(tuple(r)) for r in report.collect())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = ["a b", "ab", " a\tb\n", "", None, " \x0b\x0c\r ", "é É", "éÉ", "x" * 200_000, "x " * 200_000, "\x1ca", "a",
            " a", "日本 語", "日本語"]
    return base + ["w%d %s" % (rnd.randrange(40), " " * rnd.randrange(3)) for _ in range(300)]


def test_report_equals_grouping(spark, texts):
    rows = [*enumerate(texts), (None, "ab"), (None, "only null id"), (3, ""), (7, "éÉ"), (7, "éÉ")]
    got = X.duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got) == want(rows)
    assert X.duplicates(frame(spark, [])).count() == 0


def test_hot_text(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    assert rows_of(X.duplicates(frame(spark, rows))) == want(rows)


def test_insert_delete_lookup_and_more_shards(spark, texts):
    rnd = random.Random(5)
    # Few keys a shard: the second insertion deals the keys to more shards.
    index = X.ExactIndex(spark, new_folder(spark, "exact"), shard_keys=20, least_shards=2)
    live = []
    for start in (0, 1000):
        rows = [(start + i, t) for i, t in enumerate(texts)]
        index.insert(frame(spark, rows))
        live += rows
    assert index.shards > 2
    assert rows_of(index.report()) == want(live)
    out = {i for i, _ in live if rnd.random() < 0.6} | {2, 1002, 0}
    index.delete(spark.createDataFrame([(i,) for i in out] + [(None,), (99_999,)], "doc_id bigint"))
    live = [r for r in live if r[0] not in out]
    assert rows_of(index.report()) == want(live)
    there = {bare(t) for _, t in live}
    asked = [(i, t) for i, t in enumerate([*texts, "never seen", "nor this"])]
    for r in index.lookup(frame(spark, asked)).collect():
        assert r.present == (bare(asked[r.doc_id][1]) in there)
        assert (r.keep_id is not None) == r.present
    index.insert(frame(spark, [(5000, "a b"), (5001, "never seen")]))
    assert rows_of(index.report()) == want([*live, (5000, "a b"), (5001, "never seen")])
    index.delete(index.rows().select("doc_id"))
    assert index.report().count() == 0 and index.keys().count() == 0


def test_deduplicate_keeps_columns(spark, texts):
    docs = frame(spark, [*enumerate(texts), (0, "a b")])
    got = X.deduplicate(docs)
    assert got.schema == docs.schema
    kept = [eval(r)[0] for r in want([*enumerate(texts), (0, "a b")]) if eval(r)[3]]
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_filter_overflow_and_deletion():
    rnd = random.Random(1)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    shard = X.Shard([], None)
    for i, d in enumerate(digests):
        shard.add([d, 5, 1, 5, i, 0, i])
    assert shard.resizes > 0 and shard.filter.buckets >= 1024
    assert all(shard.find(d, 5) is not None for d in digests)
    assert all(shard.find(d, 6) is None for d in digests)
    gone = set(rnd.sample(range(4000), 3000))
    for i in gone:
        shard.take([digests[i], 5, -1, None, None, None, None])
    assert len(shard.keys) == 1000
    assert all((shard.find(d, 5) is None) == (i in gone) for i, d in enumerate(digests))
    assert sum(1 for c in shard.filter.cells if c) == 1000


def test_false_hits_are_verified():
    """Digests that agree in every bit the filter sees are still told apart by the stored keys."""
    same = hashlib.sha256(b"x").digest()
    twins = [bytes([i]) + same[1:] for i in range(5)]
    shard = X.Shard([], None)
    for i, d in enumerate(twins):
        shard.add([d, 1, 1, 1, i, 0, i])
        shard.add([d, 1, 1, 1, 9, 0, 9])
    assert sorted((k[0], k[2], k[4]) for k in shard.keys.values()) == sorted((d, 2, i) for i, d in enumerate(twins))
    assert shard.false_hits > 0
    shard.take([twins[2], 1, -2, None, None, None, None])
    assert shard.find(twins[2], 1) is None and shard.find(twins[3], 1) is not None
