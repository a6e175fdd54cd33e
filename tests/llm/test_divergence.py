"""The source audit against a plain-Python version, over many levels, sources and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tillwatch.llm import divergence as D
from tillwatch.session import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, total string, value int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, a, s, "extra", 1, "q", 2) for k, (t, a, s) in enumerate(rows)], SCHEMA)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w)
            for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, min_docs, top=10):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        groups[lang or "", source or ""].update(words(text))
        docs[lang or ""].update(set(words(text)))
    kept = {a: {t for t, n in c.items() if n >= min_docs} for a, c in docs.items()}
    out = []

    def shares(lang, count):
        total = sum(count[t] for t in kept[lang]) + 2 * len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept[lang]}

    def gap(p, q):
        return (p - q) ** 2 // (p + q)

    for lang in kept:
        whole = Counter()
        for (a, _), c in groups.items():
            if a == lang:
                whole.update(c)
        q = shares(lang, whole)
        per = {s: shares(lang, c) for (a, s), c in groups.items() if a == lang}
        for s, p in per.items():
            pairs = [(-sum(gap(p[t], other[t]) for t in kept[lang]), o.encode()) for o, other in per.items() if o != s]
            terms = [(-gap(p[t], q[t]), t.encode()) for t in kept[lang] if groups[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(map(repr, out))


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    stems = ["a", "ab", "abc", "abcd", "abcdefgh", "abcdefghijkl", "Ñandú", "ñandu", "ÉCOLE", "école", "x" * 300,
             "x" * 300 + "y", "日本語", "日本", "z z", "it's"]
    out = []
    for _ in range(160):
        lang = rnd.choice(["en", "de", None])
        pick = [rnd.choice(stems) + rnd.choice(["", "", "s", "S", "tail", "%d" % rnd.randrange(30)])
                for _ in range(rnd.randrange(0, 25))]
        out.append((rnd.choice([" ", ", ", "\n", "\x00"]).join(pick), lang, rnd.choice(["s1", "s2", "é", None, "s10"])))
    return out + [(None, "en", "s1"), ("", "fr", "only"), ("alone alone", "fr", "two"), ("...", "en", "empty"),
                  out[0], out[0], ("long " * 50_000, "de", "s1")]


def test_audit_equals_brute_force(spark, rows):
    for min_docs in (1, 4, 10):
        assert rows_of(D.audit(frame(spark, rows).repartition(3), min_docs)) == brute(rows, min_docs)


def test_blocks_and_chunks(spark, rows, monkeypatch):
    """Many blocks of sources and chunks of terms, steps that cut batches, a bit map that is full."""
    monkeypatch.setattr(D, "CHUNK_TERMS", 3)
    monkeypatch.setattr(D, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(D, "HELD_ROWS", 40)
    monkeypatch.setattr(D, "_ROWS_OUT", 7)
    monkeypatch.setattr(D, "FIRST", 2)
    assert rows_of(D.audit(frame(spark, rows).repartition(2), 5)) == brute(rows, 5)
    full = D._bit_map
    monkeypatch.setattr(D, "_bit_map", lambda keys, term, bits=64: full(keys, term, 64))
    assert rows_of(D.audit(frame(spark, rows).repartition(2), 5)) == brute(rows, 5)


def test_empty_table(spark):
    assert D.audit(frame(spark, [])).count() == 0


def test_rare_prefixes_are_dropped_early(spark):
    """Terms under a rare prefix never reach the second level."""
    rows = [(f"common {chr(97 + i % 26)}{chr(97 + i // 26)}qunique", "en", "s") for i in range(200)]
    with Scratch(spark) as scratch:
        table = scratch.settle(D.term_packs(frame(spark, rows)))
        first = D._level(table, 0, 3, None).where("docs >= 10")
        assert [bytes(r.prefix) for r in first.where("open").collect()] == [b"com"]
        second = D._level(table, 3, 6, D._bit_map(first.where("open"), "prefix")).collect()
        assert {bytes(r.prefix) for r in second} == {b"common"}
        assert [bytes(r.term) for r in D.kept_terms(table, 10, scratch).collect()] == [b"common"]


def test_shares_are_exact_beyond_64_bits():
    import numpy as np
    rnd = random.Random(4)
    for _ in range(200):
        total = rnd.randrange(3, 9 * 10**15)
        n = rnd.randrange(0, total - 2)
        assert int(D.share(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 2) // total


def test_a_pack_is_small_whatever_a_task_gets(spark):
    text = "some words that repeat " * 1000
    docs = frame(spark, [(text, "en", f"s{k % 3}") for k in range(200)] + [(text * 60, "en", "s1"), (None, "en", "s2")])
    packs = D.term_packs(docs.coalesce(1)).collect()
    assert sum(len(r["langs"]) for r in packs) == 202
    assert max(len(r["langs"]) for r in packs) * len(text) <= 1_200_000
    terms = D.terms_of([" ".join(f"t{'x' * (k % 9)}{chr(97 + k % 26)}" for k in range(40_000)).encode()])[0]
    assert D._hashes(terms)[20_000:].tolist() == D._hashes(terms.slice(20_000)).tolist()
