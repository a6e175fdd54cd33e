"""The whole ensemble as one frozen artifact: fit once, score any new table.

Scoring is transform-only. Every model adds a column to the same row, so a
scoring run has no shuffle at all, whatever the number of models.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions.severity import band_score, percent, recommended_action
from tillwatch.learn import boost, hist
from tillwatch.learn.anomaly import FrozenEcod, IsolationForest
from tillwatch.learn.clusters import RankSpace
from tillwatch.learn.data import Prepared, assemble
from tillwatch.learn.prototype import Prototypes
from tillwatch.learn.score import load_upload, persist_upload
from tillwatch.learn.stack import fit_meta
from tillwatch.learn.treeshap import contributions_column
from tillwatch.operators.clean import align_schema, clean_matrix, column_medians
from tillwatch.operators.joins import lookalike_pool
from tillwatch.operators.metrics import class_balance
from tillwatch.operators.prep import (
    Engineered, QuantileMap, RobustScale, as_array, top_features)
from tillwatch.operators.profiles import frozen_minmax, score_range
from tillwatch.session import settle

STACKED = ["nnpu", "gbt", "forest", "focal", "proto"]
ANOMALY = ["ecod", "iforest"]
BOOSTED = ["gbt", "nnpu", "focal", "cascade"]


@dataclass
class Bundle:
    columns: list[str]
    medians: dict[str, float]
    prep: Prepared
    focal_prep: Prepared
    gbt: hist.HistModel
    forest: RandomForestClassificationModel
    nnpu: hist.HistModel
    focal: hist.HistModel
    proto: Prototypes
    ecod: FrozenEcod
    iforest: IsolationForest
    ranges: dict[str, list[float]]
    meta: LogisticRegressionModel
    cascade: hist.HistModel
    cascade_cols: list[str]
    space: RankSpace

    @staticmethod
    def fit(raw: DataFrame, cols: list[str], oof: DataFrame, n_select: int = 150, stability_runs: int = 10,
            pool_size: int = 400, n_cascade: int = 80, trees: int = 50, prior: float = 0.01, seed: int = 42,
            gbt_rounds: int = 1000, nnpu_rounds: int = 200, focal_rounds: int = 300,
            cascade_rounds: int = 200) -> "Bundle":
        """``raw`` has account_id, label and columns; ``oof`` one out-of-fold column per stacked model.

        The boosted models have the depths and rates of their out-of-fold learners and are fitted side by side.
        """
        clean, final = clean_matrix(raw, cols)
        data = settle(clean.join(raw.select("account_id", "label"), "account_id"))
        alpha = float(class_balance(data).first()["alpha"])
        plain = Prepared.chosen(data, final, n_select, seed=seed)

        def focal():
            eng = Prepared.chosen(data, final, n_select, stability_runs, seed)
            return hist.fit_engineered(data, eng, hist.Focal(alpha), focal_rounds, 0.05, 4, seed=seed)

        def cascade():
            ranked = oof.select("account_id", "label", F.greatest(*[F.col(c) for c in STACKED]).alias("score"))
            pool = settle(lookalike_pool(ranked, pool_size).select("account_id", "label").join(
                data.drop("label"), "account_id"))
            chosen = top_features(pool, final, n_cascade)
            rows = settle(assemble(pool, chosen, ("account_id", "label")))
            return chosen, hist.fit(rows, hist.WeightedLogistic(), cascade_rounds, 0.05, 5, seed=seed)

        side = inheritable_thread_target(raw.sparkSession)
        with ThreadPoolExecutor(max_workers=4) as pool:
            gbt = pool.submit(side(lambda: hist.fit_engineered(
                data, plain, hist.WeightedLogistic(), gbt_rounds, 0.1, 5, patience=50, seed=seed)))
            nnpu = pool.submit(side(lambda: hist.fit_engineered(
                data, plain, hist.NonNegativePU(prior), nnpu_rounds, 0.05, 4, seed=seed)))
            others = pool.submit(side(focal)), pool.submit(side(cascade))
            meta = fit_meta(settle(assemble(oof, STACKED, ("account_id", "label"))))
            ecod, iforest = FrozenEcod.fit(data, final), IsolationForest.fit(data, final, seed=seed)
            space = RankSpace.fit(data, final, seed=seed)
            prep, nnpu = nnpu.result()
            ready = settle(prep.transform(data))
            forest, proto = boost.fit_weighted_forest(ready, trees, seed=seed), Prototypes.fit(ready, seed=seed)
            (focal_prep, focal_model), (cascade_cols, cascade_model) = (f.result() for f in others)
            out = Bundle(
                columns=final, medians=column_medians(data, final), prep=prep, focal_prep=focal_prep,
                gbt=gbt.result()[1], forest=forest, nnpu=nnpu, focal=focal_model, proto=proto, ecod=ecod,
                iforest=iforest, ranges={}, meta=meta, cascade=cascade_model, cascade_cols=cascade_cols, space=space)
        anomalies = settle(data.select(out.ecod.column().alias("ecod"), out.iforest.column().alias("iforest")))
        out.ranges = {a: list(score_range(anomalies, a)) for a in ANOMALY}
        return out

    @staticmethod
    def _with(df: DataFrame, vec: str, name: str, apply) -> DataFrame:
        """Run a model that reads ``features`` and writes ``score`` on its own vector column."""
        out = apply(df.withColumnRenamed(vec, "features"))
        return out.withColumnRenamed("features", vec).withColumnRenamed("score", name)

    def score(self, new: DataFrame, explain: int = 10, strict: bool = True) -> tuple[DataFrame, DataFrame]:
        """(scored records, one-row schema report). Nothing is fitted on the new data."""
        labelled = "label" in new.columns
        carry = ("label",) if labelled else ()
        aligned, report = align_schema(new, self.columns, self.medians, strict=strict, carry=carry)
        df = self.focal_prep.add(self.prep.add(aligned, "_a"), "_f")
        df = self._with(df, "_a", "gbt", self.gbt.score)
        df = self._with(df, "_a", "forest", lambda d: boost.probability(self.forest, d))
        df = self._with(df, "_a", "nnpu", self.nnpu.score)
        df = self._with(df, "_f", "focal", self.focal.score)
        df = self._with(df, "_a", "proto", self.proto.score)
        df = df.withColumns({"ecod": self.ecod.column(), "iforest": self.iforest.column()})
        for a in ANOMALY:
            df = frozen_minmax(df, a, *self.ranges[a])
        df = df.withColumn("_m", array_to_vector(as_array(STACKED)))
        df = self._with(df, "_m", "main", lambda d: boost.probability(self.meta, d))
        df = df.withColumn("_c", array_to_vector(as_array(self.cascade_cols)))
        df = self._with(df, "_c", "cascade", self.cascade.score)
        df = self.space.add(df)
        if explain:
            df = df.withColumn("shap", contributions_column(
                self.gbt.leaves(), [self.gbt.rate] * len(self.gbt.trees), self.prep.engineered.names, explain, "_a"))
        else:
            df = df.withColumn("shap", F.lit(None))
        main = F.col("main") * F.lit(100.0)
        records = df.withColumn("severity", band_score(main)).select(
            "account_id",
            F.struct(*[percent(F.col(c)).alias(c) for c in ["gbt", "nnpu", "forest", "focal"]]).alias("base"),
            F.struct(*[percent(F.col(c)).alias(c) for c in ANOMALY]).alias("anomaly"),
            percent(F.col("proto")).alias("proto"), percent(F.col("main")).alias("main"),
            percent(F.col("cascade")).alias("cascade"), "cluster", "severity",
            recommended_action(F.col("severity")).alias("action"), "x", "y", "z",
            F.round("main", 4).alias("risk_score"), "shap", *(["label"] if labelled else []))
        return records, report

    # ---- persistence -------------------------------------------------------
    def save(self, spark: SparkSession, root: str) -> None:
        """Models in their ML format, everything else as one JSON line; the path must be new."""
        models = {"forest": self.forest, "meta": self.meta, "kmeans": self.space.kmeans,
                  "center": self.space.center, "pca": self.space.pca}
        for name, m in models.items():
            m.save(f"{root}/{name}")
        params = {
            "columns": self.columns, "medians": self.medians, "ranges": self.ranges,
            "prep": _prep_out(self.prep), "focal_prep": _prep_out(self.focal_prep),
            **{name: getattr(self, name).state() for name in BOOSTED},
            "proto": [self.proto.positive, self.proto.negative],
            "ecod": [self.ecod.landmarks, self.ecod.ranks, self.ecod.counts, self.ecod.left], "iforest": [self.iforest.trees, self.iforest.size],
            "cascade_cols": self.cascade_cols, "ranks": self.space.ranks.landmarks,
        }
        spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.text(f"{root}/params")

    @staticmethod
    def load(spark: SparkSession, root: str) -> "Bundle":
        p = json.loads(spark.read.text(f"{root}/params", wholetext=True).first()[0])
        cols = p["columns"]
        return Bundle(
            columns=cols, medians=p["medians"], prep=_prep_in(p["prep"]), focal_prep=_prep_in(p["focal_prep"]),
            **{name: hist.HistModel.of(p[name]) for name in BOOSTED},
            forest=RandomForestClassificationModel.load(f"{root}/forest"),
            proto=Prototypes(*p["proto"]), ecod=FrozenEcod(cols, *p["ecod"]), iforest=IsolationForest(cols, *p["iforest"]),
            ranges=p["ranges"], meta=LogisticRegressionModel.load(f"{root}/meta"),
            cascade_cols=p["cascade_cols"],
            space=RankSpace(cols, QuantileMap(cols, p["ranks"]), KMeansModel.load(f"{root}/kmeans"),
                            StandardScalerModel.load(f"{root}/center"), PCAModel.load(f"{root}/pca")))


def _prep_out(p: Prepared) -> dict:
    return {"top": p.engineered.top, "logs": p.engineered.log_cols, "center": p.scale.center, "scale": p.scale.scale}


def _prep_in(d: dict) -> Prepared:
    return Prepared(Engineered(d["top"], d["logs"]), RobustScale(d["center"], d["scale"]))


def score_and_persist(bundle: Bundle, new: DataFrame, root: str, upload_id: str) -> DataFrame:
    """Score an upload, write it under its own id and return the stored rows."""
    records, _ = bundle.score(new)
    persist_upload(records, root, upload_id)
    return load_upload(new.sparkSession, root, upload_id)
