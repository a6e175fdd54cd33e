"""Exact order statistics against numpy, with heavy ties and hot keys."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwatch.operators import ordering as O


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.integers(0, 3))
def test_quantiles_match_numpy(spark, values, hot):
    data = [("hot", float(v)) for v in values for _ in range(1 + hot)] + [("b", 1.5)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.q, r.n) for r in O.exact_quantiles(df, ["k"], "v", probs).collect()}
    want = np.quantile([v for k, v in data if k == "hot"], probs)
    assert got["hot"][0] == pytest.approx(list(want))
    assert got["hot"][1] == len(data) - 1 and got["b"][0] == [1.5] * 6


def test_quantiles_without_keys_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert O.exact_quantiles(df, [], "v", [0.5]).first().q == [2.0]


@pytest.mark.parametrize("cuts", [[], [0.5], [1.0, 2.0, 3.0, 7.5]])
def test_running_totals_do_not_depend_on_the_pieces(spark, cuts):
    rows = [("a", float(i % 9), i) for i in range(50)] + [("b", 4.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, x int")
    got = sorted((r.k, r.v, r.x, r.c) for r in
                 O.running(df, ["k"], "v", {"c": "x"}, O.piece_of("v", cuts)).collect())
    want = sorted((k, v, x, sum(y for k2, u, y in rows if k2 == k and u <= v)) for k, v, x in rows)
    assert got == want


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_hot_join_keeps_every_row(spark, broadcast_rows):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id"))).alias("k"))
    per = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = O.join_per_value(df, per, ["k"], broadcast_rows)
    assert out.columns == ["k", "id", "first"]
    assert out.count() == 3000
    assert out.where("k = 'hot' AND first = 0").count() == 1000
    assert out.where("k <> 'hot' AND first = id").count() == 2000


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "account_id int, score double")
    got = {r.account_id: (r.avg_rank, r.group_n) for r in O.average_ranks(df, [], "score").collect()}
    assert got == {1: (2.5, 4), 2: (2.5, 4), 3: (1.0, 4), 4: (4.0, 4)}


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 2).alias("y"))
    out = O.hash_rank(df, ["y"], "h")
    for y in (0, 1):
        assert sorted(r.row_rank for r in out.where(F.col("y") == y).collect()) == list(range(250))


def test_brackets_move_few_rows_and_stay_exact(spark):
    # Two features of very different scale, one with a third of its rows equal, both beyond one bracket.
    df = spark.range(60_000).selectExpr(
        "IF(id % 2 = 0, 'wide', 'narrow') AS k",
        "IF(id % 2 = 0, IF(id % 3 = 0, 7e6, (id * 7919 % 60013) * 1e6), (id * 104729 % 60013) * 1e-6) AS v")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    counts = O._bracketed(df, ["k"], "v", probs)
    assert counts.where("v IS NOT NULL").agg(F.sum("n")).first()[0] < 60_000 // 2
    assert counts.count() < 1_000
    assert counts.agg(F.sum("n")).first()[0] == 60_000
    want = {k: np.quantile(g["v"], probs) for k, g in df.toPandas().groupby("k")}
    for r in O.exact_quantiles(df, ["k"], "v", probs).collect():
        assert r.q == pytest.approx(list(want[r.k]), rel=1e-12) and r.n == 30_000
    alone = df.where("k = 'narrow'")
    assert O.exact_quantiles(alone, [], "v", probs).first().q == pytest.approx(list(want["narrow"]), rel=1e-12)


def test_a_bracket_that_misses_counts_all_values(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS v")
    wrong = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).selectExpr("k", "0 AS _piece", "CAST(NULL AS DOUBLE) AS v", "n")
    monkeypatch.setattr(O, "_bracketed", lambda *_: wrong)
    assert O.exact_quantiles(df, ["k"], "v", [0.5]).first().q == [9999.5]


def test_every_key_is_cut_by_its_own_values(spark):
    df = spark.range(20_000).selectExpr(
        "concat('f', id % 20) AS k", "(id * 7919 % 20011) * pow(10.0, id % 20) AS v", "1L AS n")
    pieces = O.with_piece(df, ["k"], "v").groupBy("k").agg(
        F.count_distinct("_piece").alias("pieces"), F.max("_piece").alias("top")).collect()
    assert len(pieces) == 20 and all(r.pieces >= 3 for r in pieces)


def test_many_cuts_search_like_the_nest(spark):
    cuts = [float(i) for i in range(0, 400, 2)]
    df = spark.range(-3, 410).selectExpr("CAST(id AS DOUBLE) AS v")
    got = {r.v: r.p for r in df.select("v", O.piece_of("v", cuts).alias("p")).collect()}
    assert got == {v: sum(c < v for c in cuts) for v in got}
