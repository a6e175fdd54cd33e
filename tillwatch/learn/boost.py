"""Boosted learners: weighted trees, and Newton boosting for custom losses.

Data-parallel throughout: a round is one distributed tree fit. Only tree
structures and one-row aggregates reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions.safe import clip, sigmoid
from tillwatch.operators.metrics import class_balance
from tillwatch.session import settle

SETTLE_EVERY = 5


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Positive rows weigh n_neg / n_pos, negatives 1."""
    w = class_balance(df, label).first()["pos_weight"]
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


def probability(model, df: DataFrame) -> DataFrame:
    """Add ``score``: the model's probability of the positive class."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.drop("probability", "rawPrediction", "prediction")


def fit_weighted_gbt(train: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 42,
                     validation: str | None = None):
    """Cost-sensitive gradient boosting; ``validation`` names a boolean early-stopping column."""
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds,
                        maxDepth=depth, stepSize=0.1, seed=seed, subsamplingRate=0.8)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(with_class_weight(train))


def fit_weighted_forest(train: DataFrame, trees: int = 50, depth: int = 6, seed: int = 42):
    """A second learner with a different bias than boosting."""
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                                numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return rf.fit(with_class_weight(train))


# An objective looks at the scored training rows once per round (a one-row
# aggregate at most) and returns gradient and Hessian as columns of m and label.
Objective = Callable[[DataFrame], tuple[Column, Column]]


def focal_objective(alpha: float, gamma: float = 2.0, step: float = 1e-4) -> Objective:
    """Binary focal loss; derivatives by central differences, Hessian at least 1e-6."""
    pos = F.col("label") == 1

    def loss(m: Column) -> Column:
        p = clip(sigmoid(m), 1e-7, 1 - 1e-7)
        pt = F.when(pos, p).otherwise(F.lit(1.0) - p)
        at = F.when(pos, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
        return -at * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.ln(pt)

    def derive(_: DataFrame) -> tuple[Column, Column]:
        m, h = F.col("m"), F.lit(step)
        up, mid, down = loss(m + h), loss(m), loss(m - h)
        grad = (up - down) / F.lit(2 * step)
        hess = F.greatest((up - F.lit(2.0) * mid + down) / F.lit(step * step), F.lit(1e-6))
        return grad, hess

    return derive


def nnpu_objective(prior: float = 0.01) -> Objective:
    """Non-negative positive-unlabeled risk (Kiryo et al., 2017).

    The unlabeled gradients vanish together whenever the estimated negative risk
    of the unlabeled rows, less the positives' share, is not positive.
    """
    pos = F.col("label") == 1

    def derive(scored: DataFrame) -> tuple[Column, Column]:
        p = clip(sigmoid(F.col("m")), 1e-7, 1 - 1e-7)
        s = scored.agg(
            F.count_if(pos).alias("np"), F.count_if(~pos).alias("nu"),
            F.coalesce(F.sum(F.when(pos, p)), F.lit(0.0)).alias("sp"),
            F.coalesce(F.sum(F.when(~pos, p)), F.lit(0.0)).alias("su")).first()
        n_pos, n_unl = max(s["np"], 1), max(s["nu"], 1)
        active = s["su"] / n_unl - prior * s["sp"] / n_pos > 0
        q = F.lit(1.0) - p
        grad_u = p / F.lit(float(n_unl)) if active else F.lit(0.0)
        hess_u = p * q / F.lit(float(n_unl)) if active else F.lit(1e-6)
        grad = F.when(pos, -F.lit(prior) * q / F.lit(float(n_pos))).otherwise(grad_u)
        hess = F.when(pos, F.lit(prior) * p * q / F.lit(float(n_pos))).otherwise(hess_u)
        return grad, hess

    return derive


@dataclass
class NewtonModel:
    """Sum of regression trees on the margin scale."""

    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)

    def margin(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("m", F.lit(0.0))
        for t in self.trees:
            out = _step(t, out, self.rate)
        return out

    def score(self, df: DataFrame) -> DataFrame:
        return self.margin(df).withColumn("score", sigmoid(F.col("m"))).drop("m")


def _step(tree: DecisionTreeRegressionModel, df: DataFrame, rate: float) -> DataFrame:
    keep = [c for c in df.columns if c != "m"]
    return tree.transform(df).select(*keep, (F.col("m") + F.lit(rate) * F.col("prediction")).alias("m"))


def fit_newton(train: DataFrame, objective: Objective, rounds: int = 20, rate: float = 0.3,
               depth: int = 4, min_rows: int = 5, seed: int = 42) -> NewtonModel:
    """Second-order boosting: each tree fits ``-g / h`` weighted by ``h``.

    A weighted leaf mean is then ``-sum(g) / sum(h)``, the exact Newton step. The
    margins are written out every few rounds so that neither lineage nor plan
    grows with the number of rounds.
    """
    model = NewtonModel(rate)
    state = settle(train.select("features", "label").withColumn("m", F.lit(0.0)))
    for r in range(rounds):
        grad, hess = objective(state)
        work = state.withColumns({"g": grad, "w": hess}).withColumn("target", -F.col("g") / F.col("w"))
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="target", weightCol="w", maxDepth=depth,
            minInstancesPerNode=min_rows, seed=seed + r, maxMemoryInMB=512).fit(work)
        model.trees.append(tree)
        state = _step(tree, state, rate)
        if (r + 1) % SETTLE_EVERY == 0:
            state = settle(state)
    return model
