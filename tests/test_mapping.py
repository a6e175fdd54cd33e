"""Dictionary grammar and mapped values."""

import pytest

from tests.test_rolling import MIXED, at, make_tx
from tillwatch.functions.specs import parse_specs
from tillwatch.model import DICTIONARY
from tillwatch.operators import mapping as M

ROWS = [
    ("R_CASH_TXN_L7_14D", "Ratio of Cash Total txns - last 7 to 14D", "CASH", "R", "TOTAL", "TXNS", [7, 14], False, False),
    ("R_CASH_AMT_CR_L14_31D", "Ratio of Cash Credit Amount - last 14 to 31D", "CASH", "R", "CR", "AMT", [14, 31], False, False),
    ("RA_STDNG_INSTR_AMT_L7_14D", "Ratio of avgs: of Standing Instruction Total Amount - last 7 to 14D", "STDNG_INSTR", "RA", "TOTAL", "AMT", [7, 14], False, False),
    ("MIN_APB_AMT_DB_L7D", "Min Aadhar Payment Bridge Debit Amount - last 7D", "APB", "MIN", "DB", "AMT", [7], False, False),
    ("MAX_ELEC_XFER_AMT_CR_L31D", "Max Online Transfer (IMPS+NEFT+RTGS) Credit Amount - last 31D", "ELEC_XFER", "MAX", "CR", "AMT", [31], False, False),
    ("MM_GST_TXNS_DB_L7D", "Difference of Max and Min: GST Debit Txns - last 7D", "GST", "MM", "DB", "TXNS", [7], False, False),
    ("CI_AMT_CR_L7D", "Customer Induced Credit Amount - last 7D", "_ALL", None, "CR", "AMT", [7], False, True),
    ("R_CI_NON_CASH_CHQ_TXN_L7_14D", "Ratio of Customer Induced Non Cash Non Cheque Total txns - last 7 to 14D", "NON_CASH_CHQ", "R", "TOTAL", "TXNS", [7, 14], False, True),
    ("D_LOAN_AMT_L14_31D", "Deviation of Loan Total Amount - last 14 to 31D", "LOAN", "D", "TOTAL", "AMT", [14, 31], False, False),
    ("D_CASH_TXN_7D_OCC", "Deviation of Cash Total txns - last 7D", "CASH", "D", "TOTAL", "TXNS", [7], True, False),
    ("TOT_BAL_7DAYS", "Total  account balance in last 7 days", "_BAL", "TOT", "TOTAL", "AMT", [7], False, False),
    ("SOME_UNKNOWN_XYZ", "Something entirely unrecognized happened here", None, None, "TOTAL", "TXNS", None, False, False),
]


def dictionary(spark, rows):
    return parse_specs(spark.createDataFrame(
        [(i, f"F{i}", n, d) for i, (n, d, *_r) in enumerate(rows)], DICTIONARY))


def test_documented_rows(spark):
    for r in dictionary(spark, ROWS).collect():
        assert (r.category, r.stat, r.cr_db, r.metric, r.windows, r.occ, r.ci_filter) == tuple(ROWS[r.row_no][2:])


def test_values_and_statuses(spark):
    cases = [
        ("R", "Ratio of Cash Total Amount - last 7 to 31D", 1400 / 6400, "OK"),
        ("R2", "Ratio of GST Total Amount - last 7 to 31D", 0.0, "OK"),
        ("MM", "Difference of Max and Min: Cash Amount - last 7D", 600.0, "OK"),
        ("MX", "Max account balance in last 7 days", 0.0, "OK"),
        ("OC_OCC", "Deviation of Cash Total txns - last 7D", 2.0, "OCC_NOT_ADJUSTED"),
        ("CI", "Total Customer Induced Credit Amount - last 31D", 6600.0, "CI_SPLIT_NOT_AVAILABLE"),
        ("DD", "Deviation of Cash Total Amount - last 7 to 31D", -5000.0, "NEEDS_CONFIRMATION"),
        ("W", "Total Cash Amount - last 9D", 0.0, "OK"),
        ("X", "Something entirely unrecognized happened here", 0.0, "UNRESOLVED"),
    ]
    specs = dictionary(spark, [(n, d) for n, d, *_r in cases])
    got = {r.row_no: (r.value, r.status) for r in M.map_features(make_tx(spark, MIXED), specs, at()).collect()}
    for i, (_n, _d, value, status) in enumerate(cases):
        assert got[i] == (pytest.approx(value), status)


def test_benchmark_needs_an_occupation(spark):
    with pytest.raises(ValueError):
        M.occupation_benchmark(None, None, spark.createDataFrame([(1,)], "account_id int"))
