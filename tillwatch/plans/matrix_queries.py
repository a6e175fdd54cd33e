"""Registered queries on the account matrix and the embeddings."""

from pyspark.sql import functions as F

from tillwatch.learn.explain import behaviour_texts, linear_contributions
from tillwatch.operators import clean as C
from tillwatch.operators import neighbours as N
from tillwatch.operators import prep as P
from tillwatch.operators import profiles as O
from tillwatch.plans.feature_queries import _FILL
from tillwatch.plans.quality_queries import auc_sql, band_sql, rounded
from tillwatch.plans.registry import query
from tillwatch.plans.views import (
    ACC, MAT, MATRIX_FEATURES, SC, account_matrix, accounts, scored_labels, table, vectors)
from tillwatch.session import settle

_F = MATRIX_FEATURES
_FL = "fl AS (UNPIVOT (SELECT account_id, label, " + ", ".join(_F) + " FROM fm) ON " + ", ".join(_F) + \
    " INTO NAME feature VALUE value)"
_BASE = f"{MAT}, {_FILL}, {_FL}"


def filled_matrix(spark, sf):
    raw = settle(account_matrix(spark, sf))
    return C.impute(raw, _F, C.median_table(C.to_long(raw, _F)))


def filled_long(spark, sf):
    return P.labelled_long(filled_matrix(spark, sf), _F, "label", ("account_id",))


@query("stratified_folds", f"""WITH {SC} SELECT account_id, label, CAST((row_number() OVER (PARTITION BY label
 ORDER BY md5(account_id || ':42')) - 1) % 5 AS INTEGER) AS fold FROM sc""")
def stratified_folds(spark, sf):
    return P.stratified_folds(scored_labels(spark, sf).select("account_id", "label"))


def mi_sql(source, keys=""):
    k = keys
    on = f"{k}feature"
    return f"""ed AS (SELECT {on}, list_sort(list_distinct(quantile_cont(value,
  [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM {source} GROUP BY {on}),
bn AS (SELECT {on}, label, CASE WHEN value = edges[-1] THEN len(edges) - 1
  WHEN len(list_filter(edges, lambda e: e <= value)) BETWEEN 1 AND len(edges) - 1
  THEN len(list_filter(edges, lambda e: e <= value)) ELSE 0 END AS bin FROM {source} JOIN ed USING ({on})),
cl AS (SELECT {on}, bin, label, count(*) AS n FROM bn GROUP BY ALL),
tt AS (SELECT *, sum(n) OVER (PARTITION BY {on}) AS a, sum(n) OVER (PARTITION BY {on}, bin) AS nx,
  sum(n) OVER (PARTITION BY {on}, label) AS ny FROM cl),
mi AS (SELECT {on}, sum(n::DOUBLE / a * ln(n::DOUBLE * a / (nx * ny))) AS mi FROM tt GROUP BY {on})"""


@query("mi_rank", f"WITH {_BASE}, {mi_sql('fl')} SELECT feature, round(mi, 9) AS mi FROM mi")
def mi_rank(spark, sf):
    return rounded(P.mutual_information(filled_long(spark, sf)), "mi")


@query("stability_select", f"""WITH {_BASE},
h AS (SELECT b, account_id, label, row_number() OVER (PARTITION BY b, label
  ORDER BY md5(account_id || ':' || b || ':42')) - 1 AS r FROM fm, (SELECT unnest([1, 2, 3]) AS b)),
sz AS (SELECT label, CASE WHEN label = 1 THEN greatest(count(*) // 2, 5) ELSE count(*) // 2 END AS take FROM fm GROUP BY label),
hs AS (SELECT b, account_id, h.label FROM h JOIN sz ON h.label = sz.label WHERE r < take),
sl AS (SELECT b, hs.label, feature, value FROM hs JOIN fl ON fl.account_id = hs.account_id),
{mi_sql('sl', 'b, ')},
t AS (SELECT feature, count(*) AS times FROM (SELECT *, row_number() OVER (PARTITION BY b
  ORDER BY round(mi, 12) DESC, feature) AS r FROM mi) WHERE r <= 4 GROUP BY feature)
SELECT feature, times, times::DOUBLE / (SELECT max(times) FROM t) AS freq FROM t""")
def stability_select(spark, sf):
    return P.stability_counts(settle(filled_matrix(spark, sf).drop("occupation")), _F, 4, 3)


_TOP = ["n_orders", "n_lines", "sum_qty", "n_returned"]


@query("engineer_features", f"""WITH {MAT}, {_FILL} SELECT account_id, {', '.join(_TOP)},
{', '.join(f'round(ln(1 + greatest({c}, 0)), 9) AS {c}_log' for c in ['n_orders', 'n_lines', 'sum_qty'])},
{', '.join(f'{c} * {c} AS {c}_sq' for c in _TOP)},
{', '.join(f'{a} * {b} AS {a}_x_{b}' for i, a in enumerate(_TOP) for b in _TOP[i + 1:])},
round(list_avg([{', '.join(_TOP)}]), 9) AS top_10_mean, round(list_stddev_samp([{', '.join(_TOP)}]), 6) AS top_10_std,
round(list_avg([{', '.join(_TOP)}]), 9) AS top_20_mean, round(list_stddev_samp([{', '.join(_TOP)}]), 6) AS top_20_std,
round(list_avg([{', '.join(_TOP)}]), 9) AS top_50_mean FROM fm""")
def engineer_features(spark, sf):
    m = filled_matrix(spark, sf)
    # Which columns get a log is decided by the fit (tested on its own); SQL needs fixed names.
    eng = P.Engineered(_TOP, ["n_orders", "n_lines", "sum_qty"])
    logs = [f"{c}_log" for c in eng.log_cols]
    out = rounded(eng.transform(m), *logs, "top_10_mean", "top_20_mean", "top_50_mean")
    return rounded(out, "top_10_std", "top_20_std", digits=6)


@query("robust_scale", f"""WITH {MAT}, {_FILL} SELECT account_id, {', '.join(
    f'''round(({c} - (SELECT quantile_cont({c}, 0.5) FROM fm))
    / (SELECT CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1
       ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM fm), 9) AS {c}''' for c in _F)} FROM fm""")
def robust_scale(spark, sf):
    m = settle(filled_matrix(spark, sf))
    out = P.RobustScale.fit(m, _F).transform(m, _F).select("account_id", *_F)
    return rounded(out, *_F)


@query("quantile_transform", f"""WITH {_BASE} SELECT account_id, feature, round((rank() OVER (PARTITION BY feature ORDER BY value)
 + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE - 1)
 / greatest(count(*) OVER (PARTITION BY feature) - 1, 1), 9) AS u FROM fl""")
def quantile_transform(spark, sf):
    long = settle(filled_long(spark, sf).select("account_id", "feature", "value"))
    return rounded(P.rank_transform(long), "u").drop("value")


@query("ecod", f"""WITH {_BASE}, sk AS (SELECT feature, skewness(value) AS g, count(*) AS n FROM fl GROUP BY feature),
t AS (SELECT account_id, -ln(cume_dist() OVER (PARTITION BY feature ORDER BY value)) AS l,
  -ln(cume_dist() OVER (PARTITION BY feature ORDER BY value DESC)) AS r, g FROM fl JOIN sk USING (feature)),
s AS (SELECT account_id, greatest(sum(l), sum(r), sum(CASE WHEN g < 0 THEN l ELSE r END)) AS e FROM t GROUP BY account_id)
SELECT account_id, round((e - (SELECT min(e) FROM s)) / ((SELECT max(e) - min(e) FROM s) + 1e-10), 9) AS ecod FROM s""")
def ecod(spark, sf):
    long = settle(filled_long(spark, sf).select("account_id", "feature", "value"))
    return rounded(O.batch_minmax(settle(O.ecod_raw(long)), "ecod"), "ecod")


_CL = "CASE occupation WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END"


def _cluster():
    return F.when(F.col("occupation") == "BUILDING", 0).when(F.col("occupation") == "MACHINERY", 1).otherwise(2)


@query("cluster_profile", f"""WITH {MAT}, {_FILL}, fc AS (SELECT fm.*, {_CL} AS cluster FROM fm JOIN acc USING (account_id)),
cu AS (UNPIVOT (SELECT account_id, cluster, {', '.join(_F)} FROM fc) ON {', '.join(_F)} INTO NAME feature VALUE value),
a AS (SELECT cluster, feature, avg(value) AS m FROM cu GROUP BY ALL)
SELECT cluster, feature, round(m, 6) AS mean_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster
 ORDER BY abs(m) DESC, feature) AS rank FROM a) WHERE rank <= 5""")
def cluster_profile(spark, sf):
    m = filled_matrix(spark, sf).withColumn("cluster", _cluster())
    long = m.unpivot(["account_id", "cluster"], _F, "feature", "value")
    return rounded(O.cluster_top_features(long), "mean_value", digits=6)


@query("flag_profile", f"""WITH {_BASE}, fg AS (SELECT fl.feature, fl.value, mule_score > 50 AS flagged FROM fl JOIN acc USING (account_id)),
a AS (SELECT flagged, feature, avg(value) AS m, stddev_samp(value) AS s FROM fg GROUP BY ALL)
SELECT flagged, round(avg(m), 4) AS mean_of_means, round(avg(s), 4) AS mean_of_stds FROM a GROUP BY flagged""")
def flag_profile(spark, sf):
    acc = accounts(spark, sf).select("account_id", (F.col("mule_score") > 50).alias("flagged"))
    long = filled_matrix(spark, sf).join(acc, "account_id").unpivot(
        ["account_id", "flagged"], _F, "feature", "value")
    return rounded(O.flag_profile(long), "mean_of_means", "mean_of_stds", digits=4)


@query("cluster_triage", """WITH e AS (SELECT label AS cluster, CAST(vec_id % 7 = 0 AND label < 6 OR label = 4 AS INTEGER) AS y FROM embeddings),
c AS (SELECT cluster, count(*) AS accounts, sum(y)::BIGINT AS mules FROM e GROUP BY cluster),
t AS (SELECT sum(y)::DOUBLE AS m, count(*) AS n FROM e)
SELECT cluster, accounts, mules, mules::DOUBLE / accounts AS rate, round((mules::DOUBLE / accounts) / (m / n), 9) AS lift_vs_population,
 mules / m AS coverage, row_number() OVER (ORDER BY mules::DOUBLE / accounts DESC, cluster) = 1 AS densest FROM c, t""")
def cluster_triage(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"),
        (((F.col("vec_id") % 7 == 0) & (F.col("label") < 6)) | (F.col("label") == 4)).cast("int").alias("label"))
    return rounded(O.cluster_triage(e), "lift_vs_population")


_S3 = ["score", "score_b", "score_c"]


@query("agreement_ensemble", f"""WITH {SC} SELECT account_id, round((score + score_b + score_c) / 3, 9) AS ensemble,
 (score > 0.5)::INTEGER + (score_b > 0.5)::INTEGER + (score_c > 0.5)::INTEGER AS agreement FROM sc""")
def agreement_ensemble(spark, sf):
    return rounded(O.agreement(scored_labels(spark, sf), _S3), "ensemble").select("account_id", "ensemble", "agreement")


@query("batch_minmax", f"""WITH {SC} SELECT account_id, round((score - (SELECT min(score) FROM sc))
 / ((SELECT max(score) - min(score) FROM sc) + 1e-10), 9) AS score FROM sc""")
def batch_minmax(spark, sf):
    return rounded(O.batch_minmax(scored_labels(spark, sf).select("account_id", "score"), "score"), "score")


@query("frozen_minmax", f"""WITH {SC}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM sc WHERE quality = 1)
SELECT account_id, round(least(greatest((score - lo) / (hi - lo + 1e-10), 0), 1), 9) AS score FROM sc, r WHERE quality = 0""")
def frozen_minmax(spark, sf):
    sc = scored_labels(spark, sf)
    lo, hi = O.score_range(sc.where("quality = 1"), "score")
    new = sc.where("quality = 0").select("account_id", "score")
    return rounded(O.frozen_minmax(new, "score", lo, hi), "score")


_W = {"n_orders": 0.5, "sum_price": -1e-6, "n_lines": 0.25, "sum_qty": -0.01, "n_returned": 0.125}


@query("linear_contributions", f"""WITH {MAT}, {_FILL},
mu AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in _W)} FROM fm),
p AS ({' UNION ALL '.join(f"SELECT account_id, '{c}' AS feature, {w}::DOUBLE * (fm.{c} - mu.{c}) AS v FROM fm, mu" for c, w in _W.items())})
SELECT account_id, rank, feature, round(v, 6) AS shap_value, CASE WHEN v > 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(v) DESC, feature) AS rank FROM p) WHERE rank <= 3""")
def linear(spark, sf):
    m = settle(filled_matrix(spark, sf))
    mu = m.agg(*[F.avg(c).alias(c) for c in _W]).first().asDict()
    top = linear_contributions(m, _W, mu, 3)
    return rounded(top.select("account_id", F.posexplode("contributions").alias("p", "c")).select(
        "account_id", (F.col("p") + 1).alias("rank"), "c.feature", "c.shap_value", "c.direction"), "shap_value", digits=6)


_TX = ["n_orders", "sum_price", "max_price", "n_lines", "n_returned"]


@query("account_explanations", f"""WITH {MAT}, {_FILL},
p AS ({' UNION ALL '.join(f"SELECT account_id, '{c}' AS feature, {c} AS v FROM fm" for c in _TX)}),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(v) DESC, feature) AS r FROM p),
t AS (SELECT account_id, string_agg(r || '. ' || feature || ': ' || printf('%.4f', v), chr(10) ORDER BY r) AS body
      FROM r WHERE r <= 3 GROUP BY account_id)
SELECT account_id, 'ACCOUNT BEHAVIORAL ANALYSIS - ACCOUNT ' || account_id || chr(10)
 || 'RISK SCORE: ' || printf('%.1f', round(mule_score, 0)) || '%' || chr(10) || 'CLASSIFICATION: '
 || CASE WHEN round(mule_score, 0) / 100.0::DOUBLE > 0.5 THEN 'MULE (High Risk)' ELSE 'LEGITIMATE (Low Risk)' END || chr(10) || body
 || CASE WHEN account_id % 4 = 0 THEN chr(10) || 'BEHAVIOR TYPE: Mule Type ' || account_id % 3 + 1 ELSE '' END AS explanation
FROM acc JOIN t USING (account_id)""")
def account_explanations(spark, sf):
    acc = accounts(spark, sf)
    scores = acc.select("account_id", (F.round("mule_score", 0) / F.lit(100.0)).alias("score"))
    types = acc.where("account_id % 4 = 0").select("account_id", (F.col("account_id") % 3).alias("cluster"))
    return behaviour_texts(settle(filled_matrix(spark, sf)), _TX, scores, types, 3)


# ---- vectors ----------------------------------------------------------------
def _class_means(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    rows = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return {r["label"]: list(r["c"]) for r in rows.collect()}


@query("prototype_score", """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
d AS (SELECT vec_id, min(list_distance(embedding::DOUBLE[], c)) FILTER (WHERE c.label = 3) AS dp,
  min(list_distance(embedding::DOUBLE[], c)) FILTER (WHERE c.label <> 3) AS dn FROM embeddings, c GROUP BY vec_id)
SELECT vec_id AS account_id, round(dn / (dp + dn + 1e-9), 6) AS proto FROM d""")
def prototype_score(spark, sf):
    means = _class_means(spark, sf)
    df = N.prototype_score(vectors(spark, sf), [means[3]], [v for k, v in sorted(means.items()) if k != 3])
    return rounded(df, "proto", digits=6).select("account_id", "proto")


@query("peer_distance", """WITH p AS (SELECT q.vec_id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d
 FROM embeddings q, embeddings r WHERE r.label <> 3),
k AS (SELECT vec_id, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM p) WHERE r <= 10 GROUP BY vec_id)
SELECT vec_id AS account_id, round((m - (SELECT min(m) FROM k)) / ((SELECT max(m) - min(m) FROM k) + 1e-10), 6) AS peer_anomaly FROM k""")
def peer_distance(spark, sf):
    df = vectors(spark, sf).withColumn("score", F.col("label").cast("double"))
    return rounded(N.peer_anomaly(df, 10, block_rows=512), "peer_anomaly", digits=6)


# ---- scored uploads ---------------------------------------------------------
@query("upload_summary", f"""WITH {ACC}, up AS (SELECT *, account_id % 3 AS upload_id,
  {band_sql('mule_score', "'NONE'")} AS severity FROM acc), {auc_sql('up', 'mule_score', 'label', 'upload_id, ')}
SELECT u.upload_id, count(*) AS n_accounts, true AS has_labels,
 {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE'])},
 round(any_value(auc_pr), 9) AS auc_pr, round(any_value(auc_roc), 9) AS auc_roc
FROM up u JOIN auc USING (upload_id) GROUP BY u.upload_id""")
def upload_summary(spark, sf):
    from tillwatch.learn.score import summarize_uploads
    scored = accounts(spark, sf).withColumn("upload_id", F.col("account_id") % 3)
    return rounded(summarize_uploads(scored), "auc_pr", "auc_roc")


@query("upload_lookup", f"""WITH {ACC} SELECT account_id, mule_score FROM acc WHERE account_id % 3 = 1""")
def upload_lookup(spark, sf):
    from tillwatch.learn.score import load_upload, persist_upload
    from tillwatch.session import durable_folder
    import uuid
    root = f"{durable_folder(spark)}/uploads-{uuid.uuid4().hex}"
    scored = accounts(spark, sf)
    for i in range(3):
        persist_upload(scored.where(F.col("account_id") % 3 == i), root, f"upload_{i}")
    return load_upload(spark, root, "upload_1").select("account_id", "mule_score")
