"""Hard negatives against all pairs, with ties, copies, odd vectors and small grid cells."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tillwatch.llm import hard_negatives as H
from tillwatch.session import Scratch

SCHEMA = "vec_id bigint, label int, embedding array<float>, no int, score string, norm double, h int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, v, 1, "s", 2.0, 3) for i, x, v in rows], SCHEMA).repartition(3)


def brute(rows, every=100, k=5, top=5):
    fine = [(i, x, [math.floor(256 * float(np.float32(c))) for c in v]) for i, x, v in rows
            if i is not None and x is not None and v is not None
            and all(c is not None and math.isfinite(c) for c in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, x, v in {(i, x, tuple(v)) for i, x, v in fine if i % every == 0}:
        met = sorted((-score(v, w), j, y == x) for j, y, w in fine if j != i)
        for s, j, _ in [m for m in met if m[2]][:k]:
            hard = [(t, n) for t, n, same in met if not same and 80 * -s <= 100 * -t <= 100 * -s][:top]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(hard)]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(n, width, seed, clusters=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    x = centres[rnd.integers(0, clusters, n)] + 0.3 * rnd.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [(i, rnd.randrange(4), v) for i, v in enumerate(vectors(900, 12, 1))]
    same = out[5][2]
    out += [(1000 + i, i % 3, same) for i in range(400)]  # a third of the rows share a vector
    nan, inf = float("nan"), float("inf")
    out += [(2000, 1, None), (2001, None, same), (None, 1, same), (2002, 1, [0.1, None]), (2100, 1, [nan] * 12),
            (2200, 1, [inf] * 12), (2300, 1, []), (2400, 2, [0.0] * 12), (2500, 3, [0.5]), (2600, 0, [-1.0] * 12),
            (2700, 77, same), (2800, 1, [300.0, -2.5] * 6), (100, 2, same), (1100, out[100][1], same)]
    return out + [out[0], out[0], out[200], out[7]]


def test_equals_all_pairs(spark, rows):
    assert found(H.mine(frame(spark, rows))) == brute(rows)


def test_many_cells(spark, rows, monkeypatch):
    for name, value in (("BLOCK", 16), ("CELL_ROWS", 100), ("CELL_ANCHORS", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(H, name, value)
    assert found(H.mine(frame(spark, rows), every=50, positives=2, negatives=3)) == brute(rows, 50, 2, 3)


def test_empty_and_hopeless_tables(spark):
    assert found(H.mine(frame(spark, []))) == []
    assert found(H.mine(frame(spark, [(0, 1, None), (None, None, None)]))) == []
    assert found(H.mine(frame(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]))) == [(0, 1, 1, 2, 0, 0)]


def test_large_components_are_scored_exactly(spark):
    rows = [(i, i % 2, [float(2 ** 18 + 3 * i), float(i), -1.0]) for i in range(40)]
    assert found(H.mine(frame(spark, rows), every=10)) == brute(rows, 10)


def packed(vectors_, labels):
    q = np.floor(256 * np.array(vectors_, np.float64)).astype(np.int64)
    refs = H.pick_references(q, 8)
    norm, t = H.angles_to(q, refs)
    return H.Rows(np.arange(len(q)), np.array(labels), q.astype(np.int32), norm, t.astype(np.float32))


def test_bounds_hold_for_rows_and_blocks():
    for width, seed in ((2, 1), (12, 2), (64, 3)):
        v = vectors(300, width, seed)
        rows = packed(v + [v[0]] * 3 + [[0.0] * width, [-c for c in v[0]], [40 * c for c in v[1]]], [0] * 306)
        real = H.scores(rows.q, rows.q)
        low, high = H.score_bounds(rows, rows)
        assert (low <= real).all() and (real <= high).all()
        parts = [rows.take(np.arange(k, min(k + 30, len(rows)))) for k in range(0, len(rows), 30)]
        low, high = H.Frame(parts).bounds(rows)
        for j, p in enumerate(parts):
            real = H.scores(rows.q, p.q)
            assert (low[:, j] <= real.min(1)).all() and (real.max(1) <= high[:, j]).all()


def test_most_rows_are_never_scored(spark, monkeypatch):
    """In clustered vectors of few dimensions the angles leave a small part of the pairs."""
    v = vectors(4000, 4, 9, clusters=40)
    data = [(i, i % 5, x) for i, x in enumerate(v)]
    with Scratch(spark) as scratch:
        index = H.VectorIndex(frame(spark, data), scratch, block=64)
        blocks, anchors = index.blocks.toArrow(), index.anchors(100).toArrow()
    asked, plain = [], H.scores
    monkeypatch.setattr(H, "scores", lambda a, x: asked.append(len(a) * len(x)) or plain(a, x))
    monkeypatch.setattr(H, "AT_ONCE", 1)
    got = list(H.positives_in(blocks, anchors, 5))
    assert sum(len(s) for _, s, _ in got) == 5 * 40
    assert sum(asked) < 0.1 * 40 * 4000 / 5
