"""Registered queries: ranking quality, alerts and drift."""

from pyspark.sql import functions as F

from tillwatch.functions import severity as S
from tillwatch.functions import text as X
from tillwatch.model import RECOMMENDED_ACTION, SEVERITY_CUTS
from tillwatch.operators import alerts as A
from tillwatch.operators import drift as D
from tillwatch.operators import metrics as Q
from tillwatch.plans.registry import query
from tillwatch.plans.views import ACC, SC, accounts, scored_labels, table


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def auc_sql(source, score, label, keys=""):
    """CTE chain ending in ``auc``; ``keys`` is a column list prefix such as 'fold,'."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""g AS (SELECT {keys} {score} AS s, count(*) AS n, sum({label}) AS pos FROM {source} GROUP BY {keys} {score}),
c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM g
      WINDOW w AS ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT {keys} sum(n)::BIGINT AS n_rows, sum(pos)::BIGINT AS n_pos,
  sum(pos * (cp::DOUBLE / cn + CASE WHEN cn = n THEN 1.0 ELSE (cp - pos)::DOUBLE / (cn - n) END) / 2)
    / nullif(sum(pos), 0) AS auc_pr,
  1 - sum(pos * ((cn - cp) - (n - pos) / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * (sum(n) - sum(pos)), 0) AS auc_roc
  FROM c {group})"""


_AUC = auc_sql("sc", "score", "label")


@query("pr_auc", f"WITH {SC}, {_AUC} SELECT n_rows, n_pos, round(auc_pr, 9) AS auc_pr FROM auc")
def pr_auc(spark, sf):
    return rounded(Q.ranking_quality(scored_labels(spark, sf)), "auc_pr").drop("auc_roc")


@query("roc_auc", f"WITH {SC}, {_AUC} SELECT n_rows, n_pos, round(auc_roc, 9) AS auc_roc FROM auc")
def roc_auc(spark, sf):
    return rounded(Q.ranking_quality(scored_labels(spark, sf)), "auc_roc").drop("auc_pr")


_TOP = "SELECT label, row_number() OVER (ORDER BY score DESC, account_id) AS r FROM sc"


@query("precision_at_k", f"""WITH {SC}, t AS ({_TOP}), h AS (SELECT sum(label)::BIGINT AS caught FROM t WHERE r <= 100)
SELECT caught, caught / 100.0::DOUBLE AS precision_at_k,
       caught::DOUBLE / (SELECT sum(label) FROM sc) AS recall_at_k FROM h""")
def precision_at_k(spark, sf):
    return Q.precision_at_k(scored_labels(spark, sf), 100)


@query("threshold_f1", f"""WITH {SC}, k AS (SELECT quantile_cont(score, 0.9) AS threshold FROM sc),
m AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
 count(*) FILTER (WHERE score >= threshold AND label <> 1) AS fp,
 count(*) FILTER (WHERE score < threshold AND label = 1) AS fn,
 count(*) FILTER (WHERE score < threshold AND label <> 1) AS tn FROM sc, k GROUP BY threshold)
SELECT round(threshold, 9) AS threshold, tp, fp, fn, tn,
 coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
 coalesce(tp * 2::DOUBLE / nullif(tp * 2 + fp + fn, 0), 0) AS f1 FROM m""")
def threshold_f1(spark, sf):
    return rounded(Q.threshold_metrics(scored_labels(spark, sf)), "threshold")


_DEPTHS = [10, 70, 80, 90, 130, 180]


@query("depth_curve", f"""WITH {SC}, t AS ({_TOP}), d AS (SELECT unnest([10, 70, 80, 90, 130, 180])::INTEGER AS depth),
h AS (SELECT depth, coalesce(sum(label), 0)::BIGINT AS caught FROM d, t WHERE r <= depth GROUP BY depth)
SELECT depth, caught, caught::DOUBLE / depth AS precision,
       caught::DOUBLE / (SELECT sum(label) FROM sc) AS recall FROM h""")
def depth_curve(spark, sf):
    return Q.depth_curve(scored_labels(spark, sf), _DEPTHS)


_SEEDED = """sd AS (SELECT account_id, 1 AS seed, score FROM sc UNION ALL SELECT account_id, 2, score_b FROM sc
UNION ALL SELECT account_id, 3, score_c FROM sc)"""


@query("rank_average", f"""WITH {SC}, {_SEEDED},
r AS (SELECT account_id, (rank() OVER (PARTITION BY seed ORDER BY score)
        + (count(*) OVER (PARTITION BY seed, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY seed) AS v FROM sd)
SELECT account_id, round(avg(v), 9) AS rank_score FROM r GROUP BY account_id""")
def rank_average(spark, sf):
    sc = scored_labels(spark, sf)
    runs = sc.select("account_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("seed"), F.col(c).alias("score"))
        for i, c in enumerate(["score", "score_b", "score_c"], 1)])))
    return rounded(Q.rank_average(runs), "rank_score")


@query("score_summary", f"""WITH {ACC} SELECT count(*) AS n_accounts,
avg(CASE WHEN mule_score >= 50 THEN 1.0::DOUBLE ELSE 0 END) AS detection_rate,
count(*) FILTER (WHERE mule_score >= 90) AS n_flagged, round(avg(mule_score), 9) AS mean_score,
min(mule_score) AS min_score, max(mule_score) AS max_score FROM acc""")
def score_summary(spark, sf):
    return rounded(Q.score_summary(accounts(spark, sf)), "mean_score")


@query("monitor_status", f"""WITH {ACC}, {auc_sql("acc", "mule_score / 100.0::DOUBLE", "label")}
SELECT round(auc_pr, 9) AS auc_pr, round(auc_roc, 9) AS auc_roc,
 (SELECT avg(CASE WHEN mule_score >= 50 THEN 1.0::DOUBLE ELSE 0 END) FROM acc) AS mule_detection_rate,
 CASE WHEN auc_pr > 0.95 THEN 'STABLE' ELSE 'DRIFT_DETECTED' END AS model_status FROM auc""")
def monitor_status(spark, sf):
    return rounded(Q.monitor_status(accounts(spark, sf)), "auc_pr", "auc_roc")


_FOLDED = "fo AS (SELECT *, account_id % 5 AS fold FROM sc)"


@query("fold_stats", f"""WITH {SC}, {_FOLDED}, {auc_sql("fo", "score", "label", "fold, ")}
SELECT count(*) AS n_folds, round(avg(auc_pr), 9) AS mean_auc_pr, round(stddev_pop(auc_pr), 9) AS std_auc_pr FROM auc""")
def fold_stats(spark, sf):
    df = scored_labels(spark, sf).withColumn("fold", F.col("account_id") % 5)
    return rounded(Q.fold_stats(df), "mean_auc_pr", "std_auc_pr")


@query("normal_interval", f"""WITH {SC}, m AS (SELECT *, 1.96::DOUBLE * sqrt(score * (1 - score)
 / (SELECT count(*)::DOUBLE FROM sc)) AS mg FROM sc)
SELECT account_id, round(greatest(score - mg, 0), 9) AS lower, round(least(score + mg, 1), 9) AS upper FROM m""")
def normal_interval(spark, sf):
    df = Q.normal_interval(scored_labels(spark, sf)).select("account_id", "lower", "upper")
    return rounded(df, "lower", "upper")


@query("imbalance_alpha", f"""WITH {SC}, k AS (SELECT count(*) FILTER (WHERE label = 1) AS n_pos,
 count(*) FILTER (WHERE label = 0) AS n_neg FROM sc),
w AS (SELECT *, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n_pos)) AS wp,
 (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n_neg)) AS wn FROM k)
SELECT n_pos, n_neg, n_neg::DOUBLE / n_pos AS pos_weight,
 round(least(greatest(wp / (wp + wn), 0.5), 0.99), 9) AS alpha FROM w""")
def imbalance_alpha(spark, sf):
    return rounded(Q.class_balance(scored_labels(spark, sf)), "alpha")


# ---- alerts -----------------------------------------------------------------
def band_sql(score, low="NULL", cuts=SEVERITY_CUTS):
    return "CASE " + " ".join(f"WHEN {score} >= {c} THEN '{n}'" for c, n in cuts) + f" ELSE {low} END"


_ACTION = "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RECOMMENDED_ACTION.items()) + " END"


@query("severity_alerts", f"""WITH {ACC}, a AS (SELECT account_id, mule_score, {band_sql('mule_score')} AS severity FROM acc)
SELECT account_id, mule_score, severity, {_ACTION} AS recommended_action, 'OPEN' AS status, '' AS notes
FROM a WHERE severity IS NOT NULL""")
def severity_alerts(spark, sf):
    return A.make_alerts(accounts(spark, sf), F.lit("2024-01-31").cast("date")).drop("timestamp", "investigator_id")


@query("severity_forms", f"""WITH {ACC} SELECT account_id, {band_sql('mule_score', "'NONE'")} AS score_form,
{band_sql('mule_score', "'LOW'", SEVERITY_CUTS[:-1])} AS stream_form, round(mule_score / 100.0 * 100, 4) AS pct FROM acc""")
def severity_forms(spark, sf):
    s = F.col("mule_score")
    return accounts(spark, sf).select(
        "account_id", S.band_score(s).alias("score_form"), S.band_stream(s).alias("stream_form"),
        S.percent(s / F.lit(100.0)).alias("pct"))


@query("severity_counts", f"""WITH {ACC} SELECT {band_sql('mule_score', "'NONE'")} AS severity, count(*) AS n_accounts
FROM acc GROUP BY 1""")
def severity_counts(spark, sf):
    return A.severity_counts(accounts(spark, sf))


@query("uncertain_queue", f"""WITH {ACC}, u AS (SELECT account_id, mule_score,
 abs(mule_score / 100.0::DOUBLE - 0.5::DOUBLE) AS uncertainty FROM acc)
SELECT *, 'HIGH' AS priority FROM u WHERE uncertainty < 0.1::DOUBLE""")
def uncertain_queue(spark, sf):
    return A.uncertain_queue(accounts(spark, sf))


_ISSUED = "2024-01-31"


@query("str_summary", f"""WITH {ACC} SELECT account_id, mule_score / 100.0::DOUBLE AS risk_score,
 'PENDING_FILING' AS status FROM acc WHERE mule_score / 100.0::DOUBLE > 0.95::DOUBLE""")
def str_summary(spark, sf):
    return A.str_summary(accounts(spark, sf), F.lit(_ISSUED)).select("account_id", "risk_score", "status")


@query("report_text", f"""WITH {ACC} SELECT account_id, concat_ws(chr(10),
 'SUSPICIOUS TRANSACTION REPORT (STR)', 'Report Date: {_ISSUED}', 'Account ID: ' || account_id,
 'Risk Score: ' || printf('%.1f', mule_score) || '%', 'Classification: HIGH-RISK MULE ACCOUNT',
 'Indicators: the ensemble agrees and the score exceeds the filing threshold.',
 'Next steps: hold pending investigation, enhanced due diligence, file with the financial intelligence unit, notify compliance, preserve records.',
 'Attachments: features, transactions, model confidence, peer comparison.') AS report_text
 FROM (SELECT account_id, round(mule_score / 100.0::DOUBLE * 100.0::DOUBLE, 1) AS mule_score FROM acc
       WHERE mule_score / 100.0::DOUBLE > 0.95::DOUBLE)""")
def report_text(spark, sf):
    return A.str_summary(accounts(spark, sf), F.lit(_ISSUED)).select("account_id", "report_text")


def _notice_sql():
    out = []
    for kind, text in X.NOTICES.items():
        head, tail = text.replace("{institution}", "your bank").replace("'", "''").split("{reference}")
        out.append(f"WHEN '{kind}' THEN '{head}' || reference_id || '{tail}'")
    return "CASE action_type " + " ".join(out) + " END"


@query("notices", f"""WITH {ACC}, a AS (SELECT account_id, CASE WHEN mule_score >= 95 THEN 'AUTO-HOLD'
 WHEN mule_score >= 85 THEN 'PRIORITY_REVIEW' ELSE 'STANDARD_QUEUE' END AS action_type,
 'CASE-' || account_id || '-' || account_id * 10 AS reference_id FROM acc WHERE mule_score >= 70)
SELECT account_id, action_type, reference_id, {_notice_sql()} AS message FROM a""")
def notices(spark, sf):
    s = F.col("mule_score")
    acts = accounts(spark, sf).where(s >= 70).select(
        "account_id", F.when(s >= 95, "AUTO-HOLD").when(s >= 85, "PRIORITY_REVIEW")
        .otherwise("STANDARD_QUEUE").alias("action_type"), (F.col("account_id") * 10).alias("action_id"))
    return A.notices(acts)


# ---- drift ------------------------------------------------------------------
_HALF = "2024-01-16 00:00:00"


def halves(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", "ts")
    cut = F.lit(_HALF).cast("timestamp_ntz")
    return e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")


PSI = """ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])))
  AS edges FROM bc WHERE side = 0 AND value IS NOT NULL GROUP BY feature),
bn AS (SELECT bc.feature, side, value, edges, CASE WHEN value = edges[-1] THEN len(edges) - 1
  WHEN len(list_filter(edges, lambda e: e <= value)) BETWEEN 1 AND len(edges) - 1
  THEN len(list_filter(edges, lambda e: e <= value)) END AS bin FROM bc JOIN ed USING (feature)),
tot AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS nb, count(*) FILTER (WHERE side = 1) AS nc FROM bc GROUP BY feature),
cnt AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS b, count(*) FILTER (WHERE side = 1) AS c
  FROM bn WHERE bin IS NOT NULL GROUP BY feature, bin),
psi AS (SELECT feature, sum((greatest(c::DOUBLE / nc, 1e-6) - greatest(b::DOUBLE / nb, 1e-6))
  * ln(greatest(c::DOUBLE / nc, 1e-6) / greatest(b::DOUBLE / nb, 1e-6))) AS psi FROM cnt JOIN tot USING (feature) GROUP BY feature)"""
_SEV = "CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE_SHIFT' ELSE 'SIGNIFICANT_SHIFT' END"


@query("psi_features", f"""WITH bc AS (SELECT event_type AS feature, value,
  CASE WHEN ts < TIMESTAMP '{_HALF}' THEN 0 ELSE 1 END AS side FROM events), {PSI},
s AS (SELECT feature, psi, {_SEV} AS severity FROM psi),
t AS (SELECT count(*) FILTER (WHERE severity = 'SIGNIFICANT_SHIFT') AS k FROM s)
SELECT feature, round(psi, 9) AS psi, severity, k AS n_significant_shift,
 CASE WHEN k > 0 THEN 'RETRAIN_REVIEW_RECOMMENDED' ELSE 'NO_ACTION_NEEDED' END AS overall_recommendation FROM s, t""")
def psi_features(spark, sf):
    base, cur = halves(spark, sf)
    return rounded(D.drift_report(base, cur), "psi")


@query("psi_scores", f"""WITH bc AS (SELECT 'score' AS feature, (o_totalprice % 997) AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS side FROM orders), {PSI}
SELECT round(psi, 9) AS psi, {_SEV} AS severity FROM psi""")
def psi_scores(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") % 997).alias("score"))
    return rounded(D.score_drift(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0")), "psi")
