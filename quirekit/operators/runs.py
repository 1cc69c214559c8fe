"""Several runs of parsers over the same documents, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_compare(requested: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, profile, status, reason, pages, avg_recall, min_recall, place): what became of every run that was asked for.

    ``requested``: doc_id, profile, available. ``results``: doc_id, profile, page_no, recall, error, one row a page; an
    error on any page is the run's. status: 'skipped' where the parser is not there, 'error', or 'ok'; a run without
    pages is an error. place ranks the ok runs of a document by mean recall to six places (null recalls don't count), then profile.
    Any number of runs goes in one pass: pages are added up by run, and a document's few runs meet in one window.
    """
    keys = ["doc_id", "profile"]
    sums = results.groupBy(*keys).agg(F.count("*").alias("pages"), F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"), F.min("error").alias("error"))
    met = requested.select(*keys, "available").dropDuplicates(keys).join(sums, keys, "left")
    status = F.when(~F.coalesce("available", F.lit(False)), "skipped").when(F.col("pages").isNull() | F.col("error").isNotNull(), "error").otherwise("ok")
    reason = F.when(F.col("status") == "skipped", F.lit("parser is not available")).when(F.col("status") == "error", F.coalesce("error", F.lit("no pages")))
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    order = Window.partitionBy("doc_id", "status").orderBy(F.round("avg_recall", 6).desc_nulls_last(), "profile")
    told = met.withColumn("status", status).select(*keys, "status", reason.alias("reason"), ok("pages"), ok("avg_recall"), ok("min_recall"))
    return told.withColumn("place", F.when(F.col("status") == "ok", F.row_number().over(order)))


def page_compare(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_runs, runs, best_run, spread): every page with all runs that have it, the latest run first.

    ``scores``: doc_id, run_id, page_no, recall; ``runs``: run_id, started_at (few: sent to all tasks if Spark finds
    them small). runs is an array of (run_id, recall); best_run has the highest recall, the first by id of equal ones.
    """
    met = scores.join(runs.select("run_id", "started_at"), "run_id")
    one = F.struct((-F.unix_micros("started_at")).alias("o"), "run_id", "recall")
    grouped = met.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(one)).alias("all"), F.min_by("run_id", F.struct((-F.col("recall")).alias("r"), "run_id")).alias("best_run"), (F.max("recall") - F.min("recall")).alias("spread"))
    return grouped.select("doc_id", "page_no", F.size("all").alias("n_runs"), F.transform("all", lambda r: F.struct(r["run_id"].alias("run_id"), r["recall"].alias("recall"))).alias("runs"), "best_run", "spread")
