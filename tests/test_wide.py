"""Column-wise quantiles and label counts against the long form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.operators import clean as C
from tillwatch.operators import prep as P
from tillwatch.operators import wide
from tillwatch.operators.ordering import exact_quantiles

COLS = ["smooth", "ties", "gaps", "none", "odd", "one"]


@pytest.fixture(scope="module")
def matrix(spark):
    h = F.xxhash64("account_id")
    return spark.range(3000).withColumnRenamed("id", "account_id").select(
        "account_id", (F.pmod(h, F.lit(100_003)) / 7.0 - 5000.0).alias("smooth"),
        F.pmod(h, F.lit(5)).cast("int").alias("ties"),
        F.when(F.pmod(h, F.lit(3)) > 0, F.pmod(h, F.lit(1009)) * 0.1).alias("gaps"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("account_id") < 9, float("nan")).when(F.col("account_id") < 200, -0.0).otherwise(
            F.pmod(h, F.lit(11)) - 4.0).alias("odd"), F.lit(2.5).alias("one"),
        F.when(F.col("account_id") % 100 > 0, (F.pmod(h, F.lit(7)) == 0).cast("int")).alias("label"),
        (F.col("account_id") % 2 + 1).alias("b")).repartition(5)


def same(a, b):
    return len(a) == len(b) and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


@pytest.mark.parametrize("count", [3, 11, 700])
def test_columns_have_the_quantiles_of_the_long_form(spark, matrix, count):
    probs = [i / (count - 1) for i in range(count)]
    long = {r["feature"]: r for r in exact_quantiles(C.to_long(matrix, COLS), ["feature"], "value", probs).collect()}
    found = wide.column_quantiles(matrix, COLS, probs)
    assert {c for _, c in found} == set(long) == set(COLS) - {"none"}
    for (_, c), (q, n) in found.items():
        assert n == long[c]["n"]
        assert same(q, long[c]["q"]), c


def test_pieces_of_any_size_give_the_same(spark, matrix, monkeypatch):
    probs = [i / 400 for i in range(401)]
    want = wide.column_quantiles(matrix, ["smooth", "gaps"], probs, "b")
    assert set(want) == {(g, c) for g in (1, 2) for c in ("smooth", "gaps")}
    for rows in (50, 10**9):
        monkeypatch.setattr(wide, "RANKED_ROWS", rows)
        assert wide.column_quantiles(matrix, ["smooth", "gaps"], probs, "b") == want
    x = np.array([r[0] for r in matrix.where("b = 1").select("smooth").collect()])
    assert want[1, "smooth"][0] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)


def test_a_wide_matrix_makes_no_row_per_cell(spark, matrix, monkeypatch):
    monkeypatch.setattr(P, "stack_columns", None)
    monkeypatch.setattr(C, "stack_columns", None)
    assert P.RobustScale.fit(matrix, ["smooth", "one"]).scale["one"] == 1.0
    assert P.top_features(matrix, ["smooth", "ties"], 1) in (["smooth"], ["ties"])
    assert len(P.QuantileMap.fit(matrix, ["smooth"]).landmarks[0]) == 1000
    assert C.column_medians(matrix, ["one", "none"]) == {"one": 2.5}


def test_information_equals_the_long_form_per_group(spark, matrix):
    cols = ["smooth", "ties", "gaps", "none", "odd"]
    want = P.mutual_information(P.labelled_long(matrix, cols, "label", ("b",)), ["b"]).collect()
    got = {(r["b"], r["feature"]): r["mi"] for r in P.column_information(matrix, cols, by="b").collect()}
    assert len(got) == 10
    assert got == pytest.approx({(r["b"], r["feature"]): r["mi"] for r in want}, rel=1e-9, abs=1e-12)


def test_no_rows_give_no_entries(spark, matrix):
    none = matrix.where("account_id < 0")
    assert wide.column_quantiles(none, COLS, [0.5]) == {}
    assert P.top_features(none, COLS, 3) == []
