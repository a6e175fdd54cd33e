"""Paragraph classes against all pairs of paragraphs, and the places rule."""

import random

import numpy as np
import pytest

from tillwatch.llm import substring_dedup as S
from tillwatch.llm.common import components

SCHEMA = "doc_id bigint, text string, content string, start int, class int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def brute(texts):
    """(links, classes): content pairs of Jaccard 0.8 where one occurs without the other, and repeated classes."""
    places, sets = {}, {}
    for i, text in enumerate(texts):
        p = S.paragraphs([(text or "").encode()])[0]
        for start, words, content in zip(p.start.tolist(), p.words.tolist(), p.content.tolist()):
            places.setdefault(content, set()).add((i, start, start + words))
            sets[content] = set(p.shingles[start:start + words - S.SHINGLE + 1].tolist())
    names = sorted(places)
    root = {c: c for c in names}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    def apart(p, q):
        return p[0] != q[0] or p[2] <= q[1] or q[2] <= p[1]

    links = set()
    for k, a in enumerate(names):
        for b in names[k + 1:]:
            both = len(sets[a] & sets[b])
            alone = any(all(apart(p, q) for q in places[y]) for x, y in ((a, b), (b, a)) for p in places[x])
            if both >= 0.8 * len(sets[a] | sets[b]) and alone:
                links.add((a, b))
                root[find(b)] = find(a)
    classes = {}
    for c in names:
        classes.setdefault(find(c), []).extend(places[c])
    kept = [sorted(p) for p in classes.values() if any(apart(x, y) for x in p for y in p)]
    return links, sorted(kept)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    pool = [[word() for _ in range(rnd.choice([24, 30, 60]))] for _ in range(8)]
    out = []
    for _ in range(110):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            w = list(rnd.choice(pool)) if rnd.random() < 0.6 else [word() for _ in range(rnd.randrange(3, 50))]
            if rnd.random() < 0.5:
                w[rnd.choice([0, -1])] = word()
            parts.append(" ".join(w))
        out.append(rnd.choice(["\n", " "]).join(parts))
    return out + ["", None, out[0], " ".join(out[1].split() * 3)]


def test_classes_against_all_pairs(spark, texts):
    """Recall of links is at least 0.9; classes that miss no link are equal; nothing else is linked."""
    links, kept = brute(texts)
    docs = frame(spark, texts)
    with S.Scratch(spark) as scratch:
        found = scratch.settle(S.units(docs))
        edges = S.links(docs, found, scratch)
        roots = {r.node: r.root for r in components(edges).collect()}
        near = {(a, b) for a, b in ((int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in links)}
        met = sum(roots.get(a, a) == roots.get(b, b) for a, b in near)
        assert len(near) > 100 and met >= 0.9 * len(near)
    got = {}
    for r in S.repeats(docs).collect():
        got.setdefault(r.class_id, set()).add((r.doc_id, r.start_word, r.end_word))
    want = {tuple(k) for k in kept}
    same = sum(tuple(sorted(g)) in want for g in got.values())
    assert same >= 0.9 * len(want) and len(got) <= 1.1 * len(want)


def test_every_place_of_a_content_counts(spark):
    """Contents whose first places overlap are linked through their other places."""
    rnd = random.Random(3)
    w = [f"{rnd.random():.9f}" for _ in range(25)]
    a, b = " ".join(w[:24]), " ".join(w[1:25])  # 19 of 21 shingles shared
    texts = [" ".join(w[:24]) + "\n" + "x", a + "\nz", b + "\ny"]
    got = S.repeats(frame(spark, texts)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and len({r.class_id for r in got}) == 1


def test_a_repeat_inside_one_document(spark):
    rnd = random.Random(4)
    w = " ".join(f"{rnd.random():.9f}" for _ in range(30))
    other = " ".join(f"{rnd.random():.9f}" for _ in range(80))
    got = S.repeats(frame(spark, [f"{w}\n{other}\n{w}", other[:300].replace(".", "x")])).collect()
    lines = sorted((r.start_word, r.removable) for r in got if r.end_word - r.start_word == 30)
    assert lines == [(0, False), (110, True)] and {r.doc_id for r in got} == {0}


def test_places_add_up():
    rows = np.zeros(5, S.PACKED)
    rows["content"] = [5, 5, 6, 6, 7]
    rows["docs"], rows["weight"], rows["starts"] = [10, 30, 10, 30, 10], [1, 3, 1, 3, 1], [100, 0, 110, 30, 100]
    got = S.collapsed(rows)
    assert got[["docs", "weight", "starts"]].tolist() == [(40, 4, 100), (40, 4, 140), (10, 1, 100)]
    places = np.stack([got[n].astype(np.int64) for n in ("docs", "weight", "starts")], 1)
    assert not S.comparable(places, 0, 1) and S.comparable(places, 0, 2)  # ten words apart in both documents
    assert len(S.apart(got)) == 3 and len(S.apart(got[:2])) == 0 and len(S.apart(got[:1])) == 0


def test_words_and_lines_of_many_texts():
    """All texts at once give what each gives alone; lines and words are those of str.split."""
    rnd = random.Random(8)
    texts = ["", "\n", "a\n\nb c", "  lead", "tail\n", "x\u00c9 Y\tz\x0b\x0cq\r\n1", *(
        "".join(rnd.choices("ab \n\t", k=400)) for _ in range(20)), " ".join(map(str, range(500)))]
    raw = [t.encode() for t in texts]
    for one, text in zip(S.paragraphs(raw), raw):
        alone = S.paragraphs([text])[0]
        words = [w for w in text.lower().split()]
        assert len(one.shingles) == max(len(words) - S.SHINGLE + 1, 0)
        assert one.content.tolist() == alone.content.tolist() and one.start.tolist() == alone.start.tolist()
        sizes = [len(x.split()) for x in text.lower().split(b"\n")]
        assert [int(n) for n in one.words if n != S.LENGTH] == [n for n in sizes if n > S.LENGTH]
