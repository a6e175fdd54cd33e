"""Registered queries: dictionary mapping, typology, encoding, cleaning."""

from pyspark.sql import functions as F

from tillwatch.functions import specs as S
from tillwatch.model import DICTIONARY, OPEN_BUCKET_ORDINAL, WINDOW_DAYS
from tillwatch.operators import clean as C
from tillwatch.operators import encode as E
from tillwatch.operators import mapping as M
from tillwatch.operators import rolling as R
from tillwatch.operators.typology import typology
from tillwatch.plans.registry import query
from tillwatch.plans.rolling_queries import BAL, COMBINED, EXT, _in, _stats
from tillwatch.plans.views import (
    ACC, LONG, MAT, MATRIX_FEATURES, TX, account_matrix, accounts, as_of_col, table, transactions)
from tillwatch.session import settle

# A dictionary in the documented phrase grammar; feature names are row numbers.
_PHRASES = ["Cash", "Cheque", "UPI", "Online Transfer (IMPS+NEFT+RTGS)", "ATM",
            "Non Cash Non Cheque", "GST", "Loan"]
DICTIONARY_TEXT = [
    ("R_CASH_TXN_L7_14D", "Ratio of Cash Total txns - last 7 to 14D"),
    ("R_CASH_AMT_CR_L14_31D", "Ratio of Cash Credit Amount - last 14 to 31D"),
    ("RA_STDNG_INSTR_AMT_L7_14D", "Ratio of avgs: of Standing Instruction Total Amount - last 7 to 14D"),
    ("MIN_APB_AMT_DB_L7D", "Min Aadhar Payment Bridge Debit Amount - last 7D"),
    ("MM_GST_TXNS_DB_L7D", "Difference of Max and Min: GST Debit Txns - last 7D"),
    ("MM_CASH_AMT_L31D", "Difference of Max and Min: Cash Amount - last 31D"),
    ("CI_AMT_CR_L7D", "Customer Induced Credit Amount - last 7D"),
    ("R_CI_NON_CASH_CHQ_TXN_L7_14D", "Ratio of Customer Induced Non Cash Non Cheque Total txns - last 7 to 14D"),
    ("TOT_CI_AMT_CR_L31D", "Total Customer Induced Credit Amount - last 31D"),
    ("TOT_CI_AMT_L31D", "Total Customer Induced Amount - last 31D"),
    ("D_LOAN_AMT_L14_31D", "Deviation of Loan Total Amount - last 14 to 31D"),
    ("DA_LOAN_TXN_L7_31D", "Deviation of avgs: of Loan Total txns - last 7 to 31D"),
    ("D_TA_CASH_AMT_L7_14D", "Deviation of total from avg: Cash Amount - last 7 to 14D"),
    ("D_CASH_TXN_7D_OCC", "Deviation of Cash Total txns - last 7D"),
    ("DA_CASH_TXN_7D_OC", "Deviation of avgs: of Cash Total txns - last 7D"),
    ("TOT_BAL_7DAYS", "Total  account balance in last 7 days"),
    ("MIN_BAL_14DAYS", "Min account balance in last 14 days"),
    ("AVG_BAL_14DAYS", "Average account balance in last 14 days"),
    ("D_BAL_7_14", "Deviation of account balance - last 7 to 14D"),
    ("MM_BAL_7D", "Difference of Max and Min: account balance - last 7D"),
    ("TOT_AMT_L7D", "Total Transaction Amount - last 7D"),
    ("TOT_TXNS_CR_L31D", "Total Credit Txns - last 31D"),
    ("TOT_TXNS_L7_14D", "Total txns - last 7 to 14D"),
    ("AVG_UPI_TXN_L14D", "Average UPI txns - last 14D"),
    ("SOME_UNKNOWN_XYZ", "Something entirely unrecognized happened here"),
    ("MAX_UPI_NO_WINDOW", "Max UPI Amount"),
] + [(f"{st}_{ph.split()[0].upper()}_{d}_L{w}D", f"{word} {ph} {side} - last {w}D")
     for ph in _PHRASES for st, word in [("MAX", "Max"), ("AVG", "Average")]
     for d, side, w in [("CR", "Credit Amount", 7), ("DB", "Debit Txns", 31)]]


def dictionary(spark):
    rows = [(i, f"V{i}", n, d) for i, (n, d) in enumerate(DICTIONARY_TEXT)]
    return spark.createDataFrame(rows, DICTIONARY)


_DICT = "dict(row_no, feature, variable_name, description) AS (VALUES " + ", ".join(
    f"({i}, 'V{i}', '{n}', '{d}')" for i, (n, d) in enumerate(DICTIONARY_TEXT)) + ")"

_LOW = "lower(trim(description))"
_PARSE = f"""spec0 AS (SELECT *, {_LOW} AS low FROM dict),
spec1 AS (SELECT row_no, feature, variable_name, contains(low, 'customer induced') AS ci_filter,
  CASE {' '.join(f"WHEN starts_with(low, '{p}') THEN '{s}'" for p, s in S.STATISTIC_PREFIXES)} END AS stat,
  CASE {' '.join(f"WHEN contains(low, '{p}') THEN '{c}'" for p, c in S.CATEGORY_PHRASES)} END AS named,
  CASE WHEN contains(low, 'credit') THEN 'CR' WHEN contains(low, 'debit') THEN 'DB' ELSE 'TOTAL' END AS cr_db,
  CASE WHEN contains(low, 'amount') OR contains(low, 'balance') THEN 'AMT' ELSE 'TXNS' END AS metric,
  try_cast(regexp_extract(low, '{S.WINDOW_PATTERN}', 1) AS INTEGER) AS wa,
  try_cast(regexp_extract(low, '{S.WINDOW_PATTERN}', 2) AS INTEGER) AS wb,
  regexp_matches(variable_name, '_OCC?$') AS occ FROM spec0),
spec AS (SELECT *, coalesce(named, CASE WHEN ci_filter OR stat = 'TOT' THEN '_ALL' END) AS category FROM spec1)"""

# A dictionary as large as the part table, for the parser on its own.
_HEADS = ["Ratio of", "Ratio of avgs: of", "Deviation of", "Deviation of avgs: of", "Min", "Max",
          "Average", "Total", "Difference of Max and Min:", "Weird", "Total Customer Induced"]
_BODIES = ["Cash", "Cheque", "UPI", "Online Transfer (IMPS+NEFT+RTGS)", "ATM", "Merchant Payment",
           "Standing Instruction", "Mobile Banking", "Net Banking", "GST", "Loan", "account balance",
           "Non Cash Non Cheque", "", "", "Aadhaar Payment Bridge"]
_SIDES = ["Credit Amount", "Debit Amount", "Total txns", "Debit Txns", "Amount"]
_SPANS = ["last 7D", "last 14D", "last 31 days", "last 7 to 14D", "last 14 to 31D", "ever"]


def part_dictionary(spark, sf):
    k = F.col("p_partkey")

    def nth(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    return table(spark, sf, "part").select(
        k.alias("row_no"), F.concat(F.lit("P"), k).alias("feature"),
        F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))),
                 nth(["_OCC", "_OC", "", "_X"], k)).alias("variable_name"),
        F.concat_ws(" ", nth(_HEADS, k), nth(_BODIES, F.floor(k / 11)), nth(_SIDES, F.floor(k / 7)),
                    F.lit("-"), nth(_SPANS, F.floor(k / 3))).alias("description"))


def _nth_sql(values, by):
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({by}) % {len(values)} + 1 AS INTEGER))"


_PART_DICT = f"""dict AS (SELECT p_partkey AS row_no, 'P' || p_partkey AS feature,
  upper(replace(p_name, ' ', '_')) || {_nth_sql(['_OCC', '_OC', '', '_X'], 'p_partkey')} AS variable_name,
  concat_ws(' ', {_nth_sql(_HEADS, 'p_partkey')}, {_nth_sql(_BODIES, 'p_partkey // 11')},
            {_nth_sql(_SIDES, 'p_partkey // 7')}, '-', {_nth_sql(_SPANS, 'p_partkey // 3')}) AS description
  FROM part)"""


@query("spec_parse", f"""WITH {_PART_DICT}, {_PARSE}
SELECT row_no, feature, category, stat, cr_db, metric, wa AS window_a, wb AS window_b, occ, ci_filter FROM spec""")
def spec_parse(spark, sf):
    return S.parse_specs(part_dictionary(spark, sf)).select(
        "row_no", "feature", "category", "stat", "cr_db", "metric",
        F.col("windows")[0].alias("window_a"), F.get("windows", F.lit(1)).alias("window_b"), "occ", "ci_filter")


@query("reverse_index", f"""WITH {_PART_DICT}, {_PARSE}
SELECT wa AS window_days, metric, cr_db, arg_min(feature, row_no) AS feature FROM spec
WHERE stat = 'TOT' AND wa IS NOT NULL AND wb IS NULL AND NOT ci_filter AND category = '_ALL'
GROUP BY ALL""")
def reverse_index(spark, sf):
    return S.reverse_index(S.parse_specs(part_dictionary(spark, sf)))


def _value_sql():
    amt = "metric = 'AMT'"
    one, two = "wb IS NULL", "wb IS NOT NULL"
    rows = [
        ("category IS NULL OR stat IS NULL OR wa IS NULL", "0.0", "'UNRESOLVED'"),
        (f"category = '_BAL' AND {one} AND stat IN ('MIN','MAX','AVG','TOT')", "ba", "'OK'"),
        (f"category = '_BAL' AND {two} AND stat = 'TOT'", "ba + bb", "'NEEDS_CONFIRMATION'"),
        (f"category = '_BAL' AND {two}", "ba - bb", "'NEEDS_CONFIRMATION'"),
        ("category = '_BAL'", "0.0", "'UNRESOLVED'"),
        (f"{one} AND stat = 'TOT'", "va", "okst"),
        (f"{one} AND stat = 'MIN' AND {amt}", "mina", "okst"),
        (f"{one} AND stat = 'MAX' AND {amt}", "maxa", "okst"),
        (f"{one} AND stat IN ('MIN','MAX')", "va", "'NEEDS_CONFIRMATION'"),
        (f"{one} AND stat = 'AVG' AND {amt}", "avga", "okst"),
        (f"{one} AND stat = 'AVG'", "va / wa", "okst"),
        (f"{one} AND stat = 'MM' AND {amt}", "maxa - mina", "okst"),
        (f"{one} AND stat = 'MM'", "0.0", "'NEEDS_CONFIRMATION'"),
        (f"{one} AND occ AND stat = 'D'", "va", "'OCC_NOT_ADJUSTED'"),
        (f"{one} AND occ AND stat = 'DA'", "va / wa", "'OCC_NOT_ADJUSTED'"),
        (f"{two} AND stat = 'R'", "CASE WHEN vb = 0 THEN 0 ELSE va / vb END", "okst"),
        (f"{two} AND stat = 'RA'", "CASE WHEN vb = 0 THEN 0 ELSE (va / wa) / (vb / wb) END", "okst"),
        (f"{two} AND stat = 'D'", "va - vb", "'NEEDS_CONFIRMATION'"),
        (f"{two} AND stat = 'DA'", "va / wa - vb / wb", "'NEEDS_CONFIRMATION'"),
        (f"{two} AND stat = 'D_TA'", "va - v31 / 31", "'NEEDS_CONFIRMATION'"),
        (f"{two} AND stat = 'TOT'", "va + vb", "'NEEDS_CONFIRMATION'"),
    ]
    val = " ".join(f"WHEN {c} THEN {v}" for c, v, _ in rows)
    st = " ".join(f"WHEN {c} THEN {s}" for c, _, s in rows)
    return f"CASE {val} ELSE 0.0 END AS value, CASE {st} ELSE 'UNRESOLVED' END AS status"


def _key_sql(alias):
    out = []
    for s in R.EXTENDED[:6] + ["ci_total_amt", "ci_total_txns"]:
        out.append(f"WHEN key = '{s}' THEN CAST({alias}.{s} AS DOUBLE)")
    return f"coalesce(CASE {' '.join(out)} END, 0.0)"


def _bal_key(alias):
    return (f"coalesce(CASE WHEN stat = 'MIN' THEN {alias}.min_bal WHEN stat = 'MAX' THEN {alias}.max_bal "
            f"WHEN stat = 'AVG' THEN {alias}.avg_bal ELSE {alias}.total_bal END, 0.0)")


_cols = ", ".join(R.EXTENDED)
MAPPED = f"""{TX}, {EXT}, {COMBINED}, {BAL}, {_DICT}, {_PARSE},
raw AS (SELECT account_id, channel AS category, window_days, {_cols} FROM ext
        UNION ALL SELECT account_id, category, window_days, {_cols} FROM comb),
who AS (SELECT DISTINCT account_id FROM raw),
keyed AS (SELECT *, CASE WHEN ci_filter AND cr_db = 'TOTAL' THEN 'ci_' ELSE '' END
   || CASE cr_db WHEN 'TOTAL' THEN 'total' WHEN 'CR' THEN 'cr' ELSE 'db' END
   || CASE WHEN metric = 'AMT' THEN '_amt' ELSE '_txns' END AS key,
   CASE WHEN ci_filter AND cr_db <> 'TOTAL' THEN 'CI_SPLIT_NOT_AVAILABLE' ELSE 'OK' END AS okst FROM spec),
joined AS (SELECT who.account_id, k.*, {_key_sql('x')} AS va, {_key_sql('y')} AS vb, {_key_sql('z')} AS v31,
   coalesce(x.min_amt, 0) AS mina, coalesce(x.max_amt, 0) AS maxa, coalesce(x.avg_amt, 0) AS avga,
   {_bal_key('p')} AS ba, {_bal_key('q')} AS bb
   FROM who CROSS JOIN keyed k
   LEFT JOIN raw x ON x.account_id = who.account_id AND x.category = k.category AND x.window_days = k.wa
   LEFT JOIN raw y ON y.account_id = who.account_id AND y.category = k.category AND y.window_days = k.wb
   LEFT JOIN raw z ON z.account_id = who.account_id AND z.category = k.category AND z.window_days = 31
   LEFT JOIN bal p ON p.account_id = who.account_id AND p.window_days = k.wa
   LEFT JOIN bal q ON q.account_id = who.account_id AND q.window_days = k.wb),
mapped AS (SELECT account_id, row_no, feature, {_value_sql()} FROM joined)"""


def mapped(spark, sf):
    return M.map_features(transactions(spark, sf), S.parse_specs(dictionary(spark)), as_of_col())


@query("mapped_features", f"WITH {MAPPED} SELECT account_id, feature, round(value, 6) AS value, status FROM mapped")
def mapped_features(spark, sf):
    return mapped(spark, sf).select("account_id", "feature", F.round("value", 6).alias("value"), "status")


@query("mapping_coverage", f"""WITH {MAPPED} SELECT account_id, count(*) AS total_features,
{', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}" for s in
           ['OK', 'UNRESOLVED', 'NEEDS_CONFIRMATION', 'OCC_NOT_ADJUSTED', 'CI_SPLIT_NOT_AVAILABLE'])},
(count(*) - count(*) FILTER (WHERE status = 'UNRESOLVED')) / CAST(count(*) AS DOUBLE) AS resolved_fraction,
count(*) FILTER (WHERE status = 'OK') / CAST(count(*) AS DOUBLE) AS exact_fraction,
array_to_string(list_slice(list(feature ORDER BY row_no) FILTER (WHERE status = 'UNRESOLVED'), 1, 10), ',')
  AS unresolved_examples
FROM mapped GROUP BY account_id""")
def mapping_coverage(spark, sf):
    return M.coverage(mapped(spark, sf))


@query("occupation_benchmark", f"""WITH {MAPPED}, {ACC}
SELECT m.feature, occupation, round(avg(value), 6) AS mean_value
FROM mapped m JOIN spec s ON s.feature = m.feature JOIN acc ON acc.account_id = m.account_id
WHERE stat IN ('TOT','MIN','MAX','AVG') AND wa IS NOT NULL AND wb IS NULL GROUP BY ALL""")
def occupation_benchmark(spark, sf):
    specs = S.parse_specs(dictionary(spark))
    out = M.occupation_benchmark(mapped(spark, sf), specs, accounts(spark, sf))
    return out.withColumn("mean_value", F.round("mean_value", 6))


# ---- typology ---------------------------------------------------------------
_TYP_SRC = {
    "amt_total_31": f"coalesce({_stats(31)['total_amt']}, 0)", "amt_cr_31": _stats(31)["cr_amt"],
    "amt_db_31": _stats(31)["db_amt"], "amt_cr_7": _stats(7)["cr_amt"], "amt_db_7": _stats(7)["db_amt"],
    "txn_cr_31": _stats(31)["cr_txns"], "txn_db_31": _stats(31)["db_txns"],
}


def typology_input(spark, sf):
    tx = transactions(spark, sf)
    flows = R.channel_wide(tx.withColumn("channel", F.lit("_ALL")), as_of_col(), extended=False)
    bal = R.balance_windows(tx, as_of_col()).where("window_days = 14").select("account_id", "avg_bal")
    acc = accounts(spark, sf).join(flows, "account_id", "left").join(bal, "account_id", "left")
    return acc.select(
        "account_id", "occupation", "age", "tenure", "open_bucket",
        F.col("total_amt_31").alias("amt_total_31"), F.col("cr_amt_31").alias("amt_cr_31"),
        F.col("db_amt_31").alias("amt_db_31"), F.col("cr_amt_7").alias("amt_cr_7"),
        F.col("db_amt_7").alias("amt_db_7"), F.col("cr_txns_31").alias("txn_cr_31"),
        F.col("db_txns_31").alias("txn_db_31"), F.col("avg_bal").alias("avg_bal_14"),
        F.col("total_txns_31").alias("alerts_total"), F.col("total_txns_7").alias("alerts_night"))


_BUCKET = "CASE lower(open_bucket) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in [("l14d", 14), ("l31d", 31), ("l90d", 90), ("l180d", 180),
                                        ("l365d", 365), ("g365d", 730)]) + " ELSE 365 END"
_TYP = {
    "turnover_mult": "amt_total_31 / (abs(bal) + 1)",
    "cr_db_symmetry_31": "least(amt_cr_31, amt_db_31) / (greatest(amt_cr_31, amt_db_31) + 1)",
    "cr_db_symmetry_7": "least(amt_cr_7, amt_db_7) / (greatest(amt_cr_7, amt_db_7) + 1)",
    "velocity_cr": "(amt_cr_7 / 7.0::DOUBLE) / (amt_cr_31 / 31.0::DOUBLE + 1)",
    "velocity_db": "(amt_db_7 / 7.0::DOUBLE) / (amt_db_31 / 31.0::DOUBLE + 1)",
    "new_acct_thruput": f"amt_cr_31 / ({_BUCKET} + 1)",
    "thruput_per_tenure": "amt_cr_31 / (abs(tenure) + 1)",
    "dormant_wake": "CASE WHEN amt_cr_7 > 0 AND greatest(amt_cr_31 - amt_cr_7, 0) < amt_cr_7 * 0.1::DOUBLE "
                    "THEN round(ln(1 + abs(tenure)), 9) ELSE 0 END",
    "fanout_ratio": "CAST(txn_db_31 AS DOUBLE) / (txn_cr_31 + 1)",
    "smurf_index": "txn_cr_31 / (amt_cr_31 / (txn_cr_31 + 1) + 1)",
    "avg_credit_size": "amt_cr_31 / (txn_cr_31 + 1)",
    "night_share": "CAST(n7 AS DOUBLE) / (n31 + 1)",
    "occp_mismatch": "amt_cr_31 / (abs(med_occ) + 1)",
    "age_mismatch": "amt_cr_31 / (abs(med_age) + 1)",
    "retention": "abs(bal) / (amt_cr_31 + 1)",
}


@query("typology", f"""WITH {TX}, {ACC}, {BAL},
f AS (SELECT account_id, {', '.join(f'{e} AS {n}' for n, e in _TYP_SRC.items())},
      count(*) FILTER (WHERE {_in(7)}) AS n7, count(*) FILTER (WHERE {_in(31)}) AS n31
      FROM tx WHERE {_in(31)} GROUP BY account_id),
w AS (SELECT acc.account_id, occupation, age, tenure, open_bucket,
      {', '.join(f'coalesce({n}, 0) AS {n}' for n in list(_TYP_SRC) + ['n7', 'n31'])},
      coalesce(avg_bal, 0) AS bal
      FROM acc LEFT JOIN f ON f.account_id = acc.account_id
      LEFT JOIN bal ON bal.account_id = acc.account_id AND window_days = 14),
m AS (SELECT *, quantile_cont(amt_cr_31, 0.5) OVER (PARTITION BY occupation) AS med_occ,
      quantile_cont(amt_cr_31, 0.5) OVER (PARTITION BY age // 10) AS med_age FROM w)
SELECT account_id, {', '.join(f'{e} AS TYP_{n}' for n, e in _TYP.items())} FROM m""")
def typology_features(spark, sf):
    src = {c: c for c in [
        "amt_total_31", "amt_cr_31", "amt_db_31", "amt_cr_7", "amt_db_7", "txn_cr_31", "txn_db_31",
        "tenure", "open_bucket", "occupation", "age", "alerts_total", "alerts_night"]}
    df = typology(typology_input(spark, sf), {**src, "avg_bal_14": "avg_bal_14"})
    return df.withColumn("TYP_dormant_wake", F.round("TYP_dormant_wake", 9))


# ---- encodings and cleaning -------------------------------------------------
@query("encode_ordinal", f"""WITH {ACC} SELECT account_id, CAST(CASE open_bucket
{' '.join(f"WHEN '{k}' THEN {v}" for k, v in OPEN_BUCKET_ORDINAL.items())} ELSE -1 END AS DOUBLE) AS open_bucket_ord
FROM acc""")
def encode_ordinal(spark, sf):
    return accounts(spark, sf).select(
        "account_id", E.ordinal(F.col("open_bucket"), OPEN_BUCKET_ORDINAL).alias("open_bucket_ord"))


@query("encode_onehot", """WITH lv AS (SELECT c_custkey AS account_id, lower(trim(n_name)) AS level
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
top AS (SELECT level FROM lv GROUP BY level ORDER BY count(*) DESC, level LIMIT 10),
capped AS (SELECT account_id, CASE WHEN level IN (FROM top) THEN level ELSE 'other' END AS level FROM lv),
names AS (SELECT DISTINCT level FROM capped)
SELECT account_id, 'nation_' || left(regexp_replace(n.level, '[^0-9A-Za-z]', '_', 'g'), 20) AS feature,
CAST(capped.level = n.level AS DOUBLE) AS value FROM capped CROSS JOIN names n""")
def encode_onehot(spark, sf):
    cust = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("account_id"), F.col("n_name").alias("nation"))
    wide = E.one_hot(cust, "nation")
    return C.to_long(wide, wide.columns[1:])


def _raw(spark, sf):
    return account_matrix(spark, sf).withColumn("const_one", F.lit(1.0))


@query("clean_constant_median", f"""WITH {MAT}, {LONG.replace('FROM mat', 'FROM mat').replace('long AS', 'l0 AS')},
l1 AS (FROM (SELECT account_id, feature, value FROM l0) UNION ALL SELECT account_id, 'const_one', 1.0 FROM mat),
allr AS (SELECT m.account_id, f.feature, l1.value FROM mat m
  CROSS JOIN (SELECT DISTINCT feature FROM l1) f
  LEFT JOIN l1 ON l1.account_id = m.account_id AND l1.feature = f.feature),
st AS (SELECT feature, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS med FROM allr GROUP BY feature)
SELECT account_id, feature, round(coalesce(value, med), 6) AS value FROM allr JOIN st USING (feature) WHERE sd > 0""")
def clean_constant_median(spark, sf):
    raw = settle(_raw(spark, sf))
    cols = MATRIX_FEATURES + ["const_one"]
    long = C.to_long(raw, cols)
    keep = set(C.varying_features(long))
    kept = [c for c in cols if c in keep]
    filled = C.impute(raw, kept, C.median_table(long))
    return C.to_long(filled, kept).withColumn("value", F.round("value", 6))


@query("null_profile", f"""WITH {MAT} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_null, round(stddev_samp({c}), 4) AS std, "
    f"min({c}) AS min_value FROM mat" for c in MATRIX_FEATURES)}""")
def null_profile(spark, sf):
    return C.profile(C.to_long(account_matrix(spark, sf), MATRIX_FEATURES)).withColumn("std", F.round("std", 4))


_FILL = "fm AS (SELECT account_id, label, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM mat)) AS {c}" for c in MATRIX_FEATURES) + " FROM mat)"


@query("corr_prune", f"""WITH {MAT}, {_FILL} {' UNION ALL '.join(
    f"SELECT '{c}' AS feature, coalesce("
    + (' OR '.join(f"abs(corr({p}, {c})) > 0.95" for p in MATRIX_FEATURES[:j]) or 'bool_and(false)')
    + ", false) AS pruned FROM fm" for j, c in enumerate(MATRIX_FEATURES))}""")
def corr_prune(spark, sf):
    raw = settle(account_matrix(spark, sf))
    filled = C.impute(raw, MATRIX_FEATURES, C.median_table(C.to_long(raw, MATRIX_FEATURES)))
    gone = set(C.correlated_columns(filled, MATRIX_FEATURES))
    return spark.createDataFrame([(c, c in gone) for c in MATRIX_FEATURES], "feature string, pruned boolean")


_EXPECT = ["n_orders", "sum_price", "max_price", "n_urgent", "sum_qty"]


def _aligned(spark, sf):
    matrix = settle(account_matrix(spark, sf))
    ref = C.median_table(C.to_long(matrix, _EXPECT))
    new = matrix.select(
        "account_id", "n_orders", "sum_price", F.col("max_price").cast("string").alias("max_price"),
        "n_urgent", "sum_ext")
    return C.align_schema(new, _EXPECT, ref)


@query("schema_align", f"""WITH {MAT} SELECT account_id, {', '.join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM mat)) AS {c}" for c in _EXPECT[:4])},
(SELECT quantile_cont(sum_qty, 0.5) FROM mat) AS sum_qty FROM mat""")
def schema_align(spark, sf):
    return _aligned(spark, sf)[0]
