"""Checks of parsed pages and runs side by side, on literal tables."""

from datetime import datetime

from pyspark.sql import functions as F

from quirekit.functions import text as T
from quirekit.operators import quality, runs


def test_what_looks_tabular(spark):
    rows = ["| a | b |\nxx  yy  zz\n| c |", "a  b\nc  d\ne  f", "Revision Description\nIssue page\n1/2020 2/2020 3/2020", "revision issue page\n1\n2\n 3 \n4", "revision issue\n1/2020 2/2020 3/2020", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.looks_tabular(F.col("t"))).collect()]
    assert got == [True, False, True, True, False, False, False]


def test_expected_headings(spark):
    rows = ["SCOPE OF WORK\nscope\nABC\nÉTÉ À PARIS\nMIXEd CASE\n" + "A" * 101, "", None, "  PADDED LINE  \n1234"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.expected_headings(F.col("t"))).collect()]
    assert got == [3, 0, 0, 1]


def test_page_quality(spark):
    rows = [(1, "FIRST PART\nSECOND PART\nbody", "# FIRST PART\nbody"), (2, " ", "x"), (3, "aa  bb  cc\n| d |\n| e |", "none"), (4, None, None), (5, "plain <b>text</b>", "plain text")]
    got = {r["page_no"]: r for r in quality.page_quality(spark.createDataFrame(rows, "page_no int, t string, m string"), ["page_no"], "t", "m").collect()}
    assert (got[1]["recall"], got[1]["extra"], got[1]["heading_score"], got[1]["table_score"]) == (0.6, 0.0, 0.5, None)
    assert got[2]["recall"] is None and got[4]["recall"] is None and got[3]["table_score"] == 0.0 and got[5]["recall"] == 1.0


def test_runs_side_by_side(spark):
    asked = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", True), (1, "e", None), (1, "a", True)], "doc_id int, profile string, available boolean")
    results = spark.createDataFrame([(1, "a", 1, 0.5, None), (1, "a", 2, None, None), (1, "b", 1, 0.9, None), (1, "b", 2, 0.1, "broken"), (1, "x", 1, 1.0, None)], "doc_id int, profile string, page_no int, recall double, error string")
    got = {r["profile"]: (r["status"], r["reason"], r["pages"], r["avg_recall"], r["place"]) for r in runs.run_compare(asked, results).collect()}
    assert got == {"a": ("ok", None, 2, 0.5, 1), "b": ("error", "broken", None, None, None), "c": ("skipped", "parser is not available", None, None, None), "d": ("error", "no pages", None, None, None), "e": ("skipped", "parser is not available", None, None, None)}


def test_a_page_in_all_runs(spark):
    scores = spark.createDataFrame([(1, "r1", 1, 0.5), (1, "r2", 1, 0.5), (1, "r3", 1, 0.25), (1, "r1", 2, None), (1, "zz", 1, 1.0)], "doc_id int, run_id string, page_no int, recall double")
    started = spark.createDataFrame([("r1", datetime(2024, 1, 1)), ("r2", datetime(2024, 1, 3)), ("r3", datetime(2024, 1, 2))], "run_id string, started_at timestamp")
    got = {r["page_no"]: r for r in runs.page_compare(scores, started).collect()}
    assert [x["run_id"] for x in got[1]["runs"]] == ["r2", "r3", "r1"] and (got[1]["best_run"], got[1]["spread"], got[1]["n_runs"]) == ("r1", 0.25, 3)
    assert got[2]["n_runs"] == 1 and got[2]["spread"] is None
