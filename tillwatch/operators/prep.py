"""Label-aware preparation as fit/transform pairs; fits see training rows only."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.operators.clean import stack_columns
from tillwatch.operators.drift import bin_of
from tillwatch.operators.ordering import exact_quantiles, hash_rank, join_per_value, join_totals, ranked_values
from tillwatch.operators.wide import column_quantiles, interpolated, label_cells
from tillwatch.session import broadcast_when_small, settle

MI_BINS = 10
EDGE_BROADCAST_ROWS = 50_000
#: Values (8 bytes each) up to which one task holds a training matrix to select its columns.
TASK_VALUES = 64_000_000


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", key: str = "account_id",
                     seed: int = 42) -> DataFrame:
    """Add ``fold``: each class dealt evenly over k folds in hash order."""
    h = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key), F.lit(seed))))
    return hash_rank(h, [label], "_h").withColumn(
        "fold", (F.col("row_rank") % k).cast("int")).drop("_h", "row_rank")


def half_samples(df: DataFrame, runs: int, label: str = "label", key: str = "account_id",
                 seed: int = 42) -> DataFrame:
    """(b, key, label) of ``runs`` class-stratified halves without replacement.

    Positives keep at least five rows where there are that many.
    """
    base = settle(df.select(key, label))
    sizes = base.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    take = F.when(F.col(label) == 1, F.greatest(F.floor(F.col("n") / 2), F.lit(5))) \
            .otherwise(F.floor(F.col("n") / 2))
    tagged = base.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn(
        "_h", F.md5(F.concat_ws(":", F.col(key), F.col("b"), F.lit(seed))))
    ranked = hash_rank(tagged, ["b", label], "_h")
    # Two label classes: the size table has as many rows as there are classes.
    sizes = broadcast_when_small(sizes.select(label, take.alias("_take")), 1000)
    return ranked.join(sizes, label).where(F.col("row_rank") < F.col("_take")).select("b", key, label)


def mutual_information(long: DataFrame, keys: list[str] | None = None, bins: int = MI_BINS) -> DataFrame:
    """Binned mutual information of each feature with the label, per key.

    ``long`` has keys, feature, value, label. Bins hold equal counts of the rows
    given, NULL counts as 0. Only (key, feature, bin, label) counts are shuffled.
    """
    group = [*(keys or []), "feature"]
    data = settle(long.select(*group, F.coalesce("value", F.lit(0.0)).alias("value"), "label"))
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(data, group, "value", probs).select(*group, F.array_distinct("q").alias("edges"))
    edges = broadcast_when_small(settle(edges), EDGE_BROADCAST_ROWS)
    b = F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(0))
    return _information(
        data.join(edges, group).groupBy(*group, b.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")), group)


def column_information(df: DataFrame, cols: list[str], label: str = "label", by: str | None = None,
                       bins: int = MI_BINS) -> DataFrame:
    """``mutual_information`` of the columns of a matrix, per whole-number ``by``, without its long form."""
    data = settle(df.selectExpr(*[f"`{c}`" for c in ([by] if by else [])], f"`{label}` AS label",
                                *[f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `{c}`" for c in cols]))
    found = column_quantiles(data, cols, [i / bins for i in range(bins + 1)], by)
    cells = label_cells(data, cols, {k: q for k, (q, _) in found.items()}, "label", by)
    return _information(cells.withColumnRenamed("g", by) if by else cells.drop("g"), [*([by] if by else []), "feature"])


def _information(cells: DataFrame, group: list[str]) -> DataFrame:
    # At most bins x classes rows per feature remain from here on.
    g = W.partitionBy(*group)
    t = cells.select(
        *group, "n", F.sum("n").over(g).alias("all"),
        F.sum("n").over(W.partitionBy(*group, "bin")).alias("nx"),
        F.sum("n").over(W.partitionBy(*group, "label")).alias("ny"))
    mi = F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return t.groupBy(*group).agg(F.sum(mi).alias("mi"))


def run_information(df: DataFrame, cols: list[str], rows: int, label: str = "label", runs: int = 0,
                    bins: int = MI_BINS) -> list[dict[str, float]]:
    """``column_information`` of a matrix of ``rows`` rows that one task holds, per run; without ``runs`` of all rows.

    With ``runs`` the column ``_runs`` lists the runs a row takes part in, from 1 on. A column is
    sorted once for all runs, whose rows are then picked in order.
    """
    probs = [i / bins for i in range(bins + 1)]

    def measure(batches):
        x, labels, member, at = np.empty((rows, len(cols)), order="F"), [], np.zeros((rows, runs), np.uint8, order="F"), 0
        for batch in batches:
            part = slice(at, at + batch.num_rows)
            labels += batch.column(0).to_pylist()
            if runs:
                own = batch.column(1)
                np.add.at(member[part], (np.asarray(own.value_parent_indices()), np.asarray(own.flatten()) - 1), 1)
            for i in range(len(cols)):
                x[part, i] = batch.column(i + 2).to_numpy(zero_copy_only=False)
            at += batch.num_rows
        names, code = np.unique([str(v) for v in labels], return_inverse=True)
        out = []
        for i in range(len(cols)):
            order = np.argsort(x[:, i], kind="stable")
            ordered, coded = x[order, i] + 0.0, code[order]
            for run in range(max(runs, 1)):
                often = member[order, run] if runs else None
                if often is None:
                    v, c = ordered, coded
                elif often.max(initial=0) > 1:
                    v, c = np.repeat(ordered, often), np.repeat(coded, often)
                else:
                    v, c = ordered[often > 0], coded[often > 0]
                if len(v):
                    out.append((run, cols[i], _task_information(v, c, len(names), np.unique(interpolated(v, probs)))))
        yield pa.RecordBatch.from_pylist([dict(zip(("run", "feature", "mi"), r)) for r in out], schema=pa.schema(
            [("run", pa.int32()), ("feature", pa.string()), ("mi", pa.float64())]))

    matrix = df.selectExpr(f"CAST(`{label}` AS STRING) AS label", "_runs" if runs else "array(1) AS _runs",
                           *[f"coalesce(CAST(`{c}` AS DOUBLE), 0D) AS `c{i}`" for i, c in enumerate(cols)])
    got = [{} for _ in range(max(runs, 1))]
    for r in matrix.coalesce(1).mapInArrow(measure, "run int, feature string, mi double").collect():  # runs x columns
        got[r["run"]][r["feature"]] = r["mi"]
    return got


def _task_information(ordered: np.ndarray, code: np.ndarray, classes: int, edges: np.ndarray) -> float:
    """Mutual information of an ascending column, cut at ``edges`` as in ``label_cells``, with the labels' codes."""
    starts = np.searchsorted(ordered, edges[1:-1], side="left") if len(edges) > 1 else np.zeros(0, np.int64)
    ends = np.concatenate([[0], starts, [len(ordered)]])
    cells = np.stack([np.diff(np.concatenate([[0], np.cumsum(code == k)])[ends]) for k in range(classes)], 1).astype(float)
    n = cells.sum()
    expected = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True)
    full = cells > 0
    return float((cells[full] / n * np.log(cells[full] * n / expected[full])).sum())


def ranked_features(information: dict[str, float], n: int) -> list[str]:
    """The n most informative columns, best first (ties by name)."""
    return sorted(information, key=lambda c: (-round(information[c], 12), c))[:n]


def top_features(df: DataFrame, cols: list[str], n: int, label: str = "label", bins: int = MI_BINS) -> list[str]:
    """Names of the n most informative columns, best first (ties by name). ``df`` is read twice; settle what is costly."""
    rows = df.count()
    if 0 < rows * len(cols) <= TASK_VALUES:
        return ranked_features(run_information(df, cols, rows, label, bins=bins)[0], n)
    rows = column_information(df, cols, label, bins=bins).orderBy(F.desc(F.round("mi", 12)), "feature").limit(n).collect()
    return [r["feature"] for r in rows]


def labelled_long(df: DataFrame, cols: list[str], label: str = "label", extra=()) -> DataFrame:
    return stack_columns(df, [*extra, label], cols).withColumnRenamed(label, "label")


def stability_counts(df: DataFrame, cols: list[str], n_features: int, runs: int, seed: int = 42,
                     key: str = "account_id", label: str = "label") -> DataFrame:
    """How often each feature ranks in the top ``n_features`` over half-samples; freq against the maximum."""
    picks = half_samples(df, runs, label, key, seed)
    mi = column_information(df.drop(label).join(picks, key), cols, label, "b")
    w = W.partitionBy("b").orderBy(F.desc(F.round("mi", 12)), "feature")  # columns per run
    chosen = settle(mi.where(F.col("mi").isNotNull()).withColumn("r", F.row_number().over(w)).where(
        F.col("r") <= n_features).groupBy("feature").agg(F.count(F.lit(1)).alias("times")))
    best = chosen.agg(F.max("times")).scalar()
    return chosen.withColumn("freq", F.col("times") / best)


def stable_features(df: DataFrame, cols: list[str], n_features: int = 150, runs: int = 30,
                    threshold: float = 0.6, seed: int = 42, minimum: int = 20) -> list[str]:
    """Features chosen in enough runs; when fewer than ``minimum`` qualify, the most frequent ones."""
    if 0 < df.count() * len(cols) <= TASK_VALUES:
        # A row once, with its runs, where ``stability_counts`` repeats it in each.
        picks = half_samples(df, runs, seed=seed).groupBy("account_id", "label").agg(F.collect_list("b").alias("_runs"))
        drawn = settle(df.drop("label").join(picks, "account_id").select("label", "_runs", *[f"`{c}`" for c in cols]))
        times = Counter(c for mi in run_information(drawn, cols, drawn.count(), runs=runs) for c in ranked_features(mi, n_features))
        often = [c for c in times if times[c] / max(times.values()) >= threshold]
        return sorted(times if len(often) < minimum else often, key=lambda c: (-times[c], c))[:n_features]
    counts = settle(stability_counts(df, cols, n_features, runs, seed))
    order = [F.desc("times"), F.asc("feature")]
    keep = counts.where(F.col("freq") >= threshold)
    if keep.count() < minimum:
        keep = counts
    return [r["feature"] for r in keep.orderBy(*order).limit(n_features).collect()]


@dataclass(frozen=True)
class Engineered:
    """Derived columns for a fixed feature list; decided on fit rows, applied anywhere."""

    top: list[str]
    log_cols: list[str]

    @staticmethod
    def fit(train: DataFrame, top: list[str], logs: int = 30) -> "Engineered":
        """Log columns are those among the leading features whose training minimum is positive."""
        lead = top[:logs]
        mins = train.agg(*[F.min(f"`{c}`").alias(f"m{i}") for i, c in enumerate(lead)]).first()
        return Engineered(list(top), [c for i, c in enumerate(lead) if (mins[f"m{i}"] or 0) > 0])

    def columns(self) -> dict[str, str]:
        """Name to SQL expression over the selected columns."""
        out = {f"{n}_log": f"log1p(greatest(`{n}`, 0D))" for n in self.log_cols}
        out |= {f"{n}_sq": f"`{n}` * `{n}`" for n in self.top[:20]}
        lead = self.top[:10]
        out |= {f"{a}_x_{b}": f"`{a}` * `{b}`" for i, a in enumerate(lead) for b in lead[i + 1:]}
        for k in (10, 20, 50):
            out[f"top_{k}_mean"] = "(" + " + ".join(f"`{n}`" for n in self.top[:k]) + f") / {len(self.top[:k])}D"
        return out

    def deviations(self) -> dict[str, str]:
        """Row deviations read the stored row means; inlined, the sums would repeat per term."""
        out = {}
        for k in (10, 20):
            part = self.top[:k]
            terms = " + ".join(f"(`{n}` - top_{k}_mean) * (`{n}` - top_{k}_mean)" for n in part)
            out[f"top_{k}_std"] = f"sqrt(({terms}) / {len(part) - 1}D)" if len(part) > 1 else "CAST(NULL AS DOUBLE)"
        return out

    @property
    def names(self) -> list[str]:
        return [*self.top, *self.columns(), *self.deviations()]

    def arrays(self, x: np.ndarray, valid: dict[int, np.ndarray]):
        """(values, which are not null; None: all) of every column in ``names``, by the same arithmetic as the SQL.

        ``x`` has the selected columns, ``valid`` the rows not null of those that have nulls.
        """
        width, place = x.shape[1], {c: i for i, c in enumerate(self.top)}

        def known(which):
            masks = [valid[i] for i in which if i in valid]
            return np.logical_and.reduce(masks) if masks else None

        for i in range(width):
            yield x[:, i], valid.get(i)
        for i in (place[c] for c in self.log_cols):
            v = x[:, i] if i not in valid else np.where(valid[i], x[:, i], 0.0)  # greatest() skips nulls
            yield np.log1p(np.maximum(v, 0.0)), None
        for i in range(min(20, width)):
            yield x[:, i] * x[:, i], valid.get(i)
        for i in range(min(10, width)):
            for j in range(i + 1, min(10, width)):
                yield x[:, i] * x[:, j], known((i, j))
        means = {}
        for k in (min(10, width), min(20, width), min(50, width)):
            total = x[:, 0].copy()
            for i in range(1, k):
                total += x[:, i]
            means[k] = total / k
            yield means[k], known(range(k))
        for k in (min(10, width), min(20, width)):
            if k == 1:
                yield np.zeros(len(x)), np.zeros(len(x), bool)
                continue
            total = (x[:, 0] - means[k]) ** 2
            for i in range(1, k):
                total += (x[:, i] - means[k]) ** 2
            yield np.sqrt(total / (k - 1)), known(range(k))

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ("account_id",)) -> DataFrame:
        first = df.selectExpr(*[f"`{c}`" for c in (*keep, *self.top)],
                              *[f"{e} AS `{n}`" for n, e in self.columns().items()])
        return first.selectExpr("*", *[f"{e} AS `{n}`" for n, e in self.deviations().items()])


@dataclass(frozen=True)
class RobustScale:
    """(x - median) / IQR with exact quartiles; a zero IQR divides by 1."""

    center: dict[str, float]
    scale: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, cols: list[str]) -> "RobustScale":
        found = column_quantiles(train, cols, [0.25, 0.5, 0.75])
        mid = {c: q[1] for (_, c), (q, _) in found.items()}
        iqr = {c: (q[2] - q[0]) or 1.0 for (_, c), (q, _) in found.items()}
        return RobustScale(mid, iqr)

    def sql(self, c: str) -> str:
        mid, iqr = float(self.center.get(c, 0.0)), float(self.scale.get(c, 1.0))
        return f"(CAST(`{c}` AS DOUBLE) - {mid!r}D) / {iqr!r}D"

    def transform(self, df: DataFrame, cols: list[str]) -> DataFrame:
        scaled = set(cols)
        return df.selectExpr(*[f"{self.sql(c)} AS `{c}`" if c in scaled else f"`{c}`" for c in df.columns])


def rank_transform(long: DataFrame) -> DataFrame:
    """Uniform [0, 1] rank of each value within its feature: (average rank - 1) / (n - 1)."""
    ranks = ranked_values(long, ["feature"], "value")
    ranks = join_totals(ranks, ranks.groupBy("feature").agg(F.sum("n").alias("total")), ["feature"])
    u = (F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0) - 1) / F.greatest(F.col("total") - 1, F.lit(1))
    return join_per_value(long, ranks.select("feature", "value", "n", u.alias("u")), ["feature", "value"])


@dataclass(frozen=True)
class QuantileMap:
    """Frozen uniform quantile transform: landmarks per column, linear in between.

    New values only ever go through ``column``; outside the fitted range they
    clip to 0 or 1, and inside a run of equal landmarks they take its middle.
    """

    cols: list[str]
    landmarks: list[list[float]]

    @staticmethod
    def fit(train: DataFrame, cols: list[str], count: int = 1000) -> "QuantileMap":
        n = min(count, max(train.count(), 2))
        found = column_quantiles(train, cols, [i / (n - 1) for i in range(n)])  # one array per column
        return QuantileMap(list(cols), [found[0, c][0] for c in cols])

    def column(self, vec: Column) -> Column:
        """Ranks of an ARRAY<DOUBLE> in column order, vectorised per Arrow batch."""
        marks = [np.asarray(m, dtype=float) for m in self.landmarks]

        @F.pandas_udf("array<double>")
        def ranks(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), dtype=float).reshape(len(v), len(marks))
            out = np.empty_like(x)
            for j, q in enumerate(marks):
                ref = np.linspace(0.0, 1.0, len(q))
                up = np.interp(x[:, j], q, ref)
                down = -np.interp(-x[:, j], -q[::-1], -ref[::-1])
                out[:, j] = 0.5 * (up + down)
            return pd.Series(list(out))

        return ranks(vec)


def as_array(cols: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in cols) + ")")
