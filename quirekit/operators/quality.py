"""How well a page's markdown keeps the text of its source: multiset token metrics, page scores, verdicts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators import layout

# Weights of a text page and a visual page, thresholds, what parsers leave behind.
WEIGHTS = {"recall": 0.40, "kept": 0.15, "table_score": 0.15, "judge": 0.30}
VISUAL_WEIGHTS = {"judge": 0.85, "table_score": 0.15}
PASS, ESCALATE = 0.90, 0.70
LOW_RECALL, HIGH_EXTRA, FAULT_FACTOR = 0.85, 0.25, 0.7
#: Texts that a worker holds as Python values at once.
ROWS = 64
LEFTOVERS = {"picture omitted": r"intentionally omitted", "picture-text wrapper": r"-+\s*Start of picture text", "empty table cells": r"(?m)^\s*\|(\s*\|){2,}\s*$"}


def token_overlap(pages: DataFrame, keys: list[str], truth: str, markdown: str, tags: bool = False) -> DataFrame:
    """keys, n_truth, n_md, common: tokens on either side and in common, as multisets.

    A page may have its texts in several rows. They shuffle once, by their keys, and tokens are counted
    where the page is, so a task holds the tokens of one page; pages without any token, or with a null key, have zeros.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    whole = lambda c: F.regexp_replace(F.lower(c), r"<[^>]+>", " ") if tags else F.col(c)
    texts = lambda c: F.array_join(F.collect_list(F.when(known, whole(c))), "\n").alias(c)
    return pages.groupBy(*keys).agg(texts(truth), texts(markdown)).select(*keys, counts_in_row(F.col(truth), F.col(markdown)).alias("_n")).select(*keys, "_n.*")


def recall(common: Column, n_truth: Column) -> Column:
    return F.when(n_truth == 0, F.lit(1.0)).otherwise(common / n_truth)


def extra(common: Column, n_md: Column) -> Column:
    return F.when(n_md == 0, F.lit(0.0)).otherwise((n_md - common) / n_md)


def content_overlap(lines: DataFrame, markdown: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_truth, n_md, common): the overlap with source lines other than running headers and footers.

    lines: doc_id, page_no, line_no, line; markdown: doc_id, page_no, markdown. Pages without a text have zeros.
    """
    keys = ["doc_id", "page_no"]
    body = lines.withColumn("normal", T.running_line(F.col("line"))).join(layout.furniture(lines).select("doc_id", "normal"), ["doc_id", "normal"], "left_anti")
    pages, none = lines.select(*keys).distinct(), F.lit(None).cast("string")
    own = markdown.select(*keys, "markdown").join(pages, keys, "left_semi")
    sides = body.select(*keys, F.col("line").alias("truth"), none.alias("markdown")).unionByName(own.withColumn("truth", none)).unionByName(pages.withColumn("truth", none).withColumn("markdown", none))
    return token_overlap(sides, keys, "truth", "markdown")


def table_score(truth: Column, markdown: Column) -> Column:
    """Null without a table in the source, else 1 if the markdown has table cells, 0 if not."""
    return F.when(~T.has_columns(truth), F.lit(None).cast("double")).when(T.table_cells(markdown) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def weighted(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the terms that are there, by their weights; 0 if none is."""
    over = sum((F.when(v.isNotNull(), F.lit(weights[k]) * v).otherwise(0.0) for k, v in terms.items()), F.lit(0.0))
    under = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in terms.items()), F.lit(0.0))
    return F.when(under == 0, F.lit(0.0)).otherwise(over / under)


def leftovers(markdown: Column) -> Column:
    """The names of what a parser left behind in a text."""
    found = [F.when(markdown.rlike(p), F.lit(n)) for n, p in LEFTOVERS.items()]
    breaks = (F.length(markdown) - F.length(F.replace(markdown, F.lit("<br>"), F.lit("")))) / 4
    return F.array_compact(F.array(*found, F.when(breaks > 15, F.lit("flattened <br> blob"))))


def verdict(composite: Column, passing: float = PASS, escalating: float = ESCALATE) -> Column:
    return F.when(composite >= passing, "pass").when(composite >= escalating, "escalate").otherwise("review")


def score_pages(pages: DataFrame, keys: list[str], truth: str, markdown: str, kind: str | None = None, judge: str | None = None, faults: str | None = None) -> DataFrame:
    """keys, recall, extra, table_score, composite, verdict, notes for every page.

    ``kind`` 'visual' leaves recall and extra out, as such pages have little text. A null judge or
    table score is no term. ``faults`` may name an array column of further structural faults.
    """
    overlap = token_overlap(pages, keys, truth, markdown)
    none = F.lit(None).cast("double")
    faulty = F.concat(leftovers(F.coalesce(markdown, F.lit(""))), F.coalesce(F.col(faults), F.array().cast("array<string>"))) if faults else leftovers(F.coalesce(markdown, F.lit("")))
    own = pages.select(*keys, table_score(F.col(truth), F.col(markdown)).alias("table_score"), (F.col(kind) if kind else F.lit("text")).alias("kind"), (F.col(judge).cast("double") if judge else none).alias("judge"), faulty.alias("faults"))
    both = own.join(overlap, keys).withColumn("recall", recall(F.col("common"), F.col("n_truth"))).withColumn("extra", extra(F.col("common"), F.col("n_md")))
    text = weighted({"recall": F.col("recall"), "kept": 1.0 - F.col("extra"), "table_score": F.col("table_score"), "judge": F.col("judge")}, WEIGHTS)
    visual = weighted({"judge": F.col("judge"), "table_score": F.col("table_score")}, VISUAL_WEIGHTS)
    marred = (F.col("kind") != "visual") & (F.size("faults") > 0)
    composite = F.when(F.col("kind") == "visual", visual).when(marred, text * FAULT_FACTOR).otherwise(text)
    plain = F.col("kind") != "visual"
    notes = F.array_compact(
        F.array(
            F.when(~plain & F.col("judge").isNull(), F.lit("visual page but no judge score")),
            F.when(plain & (F.col("recall") < LOW_RECALL), F.lit("low text recall")),
            F.when(plain & (F.col("extra") > HIGH_EXTRA), F.lit("high extra ratio")),
            F.when(plain & (F.col("table_score") == 0), F.lit("table present but not reproduced")),
            F.when(marred, F.concat(F.lit("parser artifacts: "), F.array_join("faults", ", "))),
        )
    )
    scored = both.withColumn("composite", T.thousandths(composite))
    return scored.select(*keys, "recall", "extra", "table_score", "judge", "composite", verdict(F.col("composite")).alias("verdict"), notes.alias("notes"))


def page_kind(n_chars: Column, images: Column, drawings: Column, min_chars: int = 250, min_drawings: int = 40) -> Column:
    return F.when((n_chars < min_chars) & ((images > 0) | (drawings >= min_drawings)), "visual").otherwise("text")


def escalation_reasons(recall_: Column, extra_: Column, table: Column, low: float = 0.95, high: float = 0.15) -> Column:
    """Why a page goes on to a better parser: an array of reasons, empty if none."""
    return F.array_compact(F.array(F.when(recall_ < low, F.lit("text_recall")), F.when(extra_ > high, F.lit("extra_text_ratio")), F.when(table < 1.0, F.lit("table_score"))))


def cloud_is_better(local: dict[str, Column], cloud: dict[str, Column], low: float = 0.95, high: float = 0.15) -> Column:
    """Whether the second parse of a page replaces the first. Terms recall, extra, table; missing ones count as the first's best and the second's worst, tables as 1."""
    lr, le, lt = (F.coalesce(local[k], F.lit(d)) for k, d in (("recall", 1.0), ("extra", 0.0), ("table", 1.0)))
    cr, ce, ct = (F.coalesce(cloud[k], F.lit(d)) for k, d in (("recall", 0.0), ("extra", 1.0), ("table", 1.0)))
    gained = (cr > lr) & (ce <= F.greatest(le, F.lit(high)))
    return (cr >= F.least(F.lit(low), lr)) & (ct >= lt) & (gained | ((ce < le) & (cr >= low)))


def adopt(candidates: DataFrame, keys: list[str], tolerance: float = 0.12) -> DataFrame:
    """One row per page: method adopted ('vlm', 'cleanup' or 'baseline'), its composite, and the method on record.

    ``candidates``: keys, base, vlm, cleanup (composites; null where there is none), base_content,
    cleanup_content (recall of content). A vlm text must beat the baseline; a cleaned text must not
    lose content beyond the tolerance; of both, vlm wins ties.
    """
    vlm_ok = F.coalesce(F.col("vlm") > F.col("base"), F.lit(False))
    clean_ok = F.col("cleanup").isNotNull() & F.coalesce(F.col("cleanup_content") >= F.col("base_content") - tolerance, F.lit(False))
    method = F.when(vlm_ok & (~clean_ok | (F.col("vlm") >= F.col("cleanup"))), "vlm").when(clean_ok, "cleanup").otherwise("baseline")
    record = F.when(F.col("method") != "baseline", F.col("method")).when(F.col("vlm").isNotNull(), "vlm").when(F.col("cleanup").isNotNull(), "cleanup").otherwise("vlm")
    composite = F.when(F.col("method") == "vlm", F.col("vlm")).when(F.col("method") == "cleanup", F.col("cleanup")).otherwise(F.col("base"))
    return candidates.withColumn("method", method).select(*keys, "method", composite.alias("composite"), record.alias("recorded"))


def card(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Averages and least values over pages that have them, and shares of pages, where nothing of nothing is 1."""
    share = lambda good, all_: F.when(F.count_if(all_) == 0, F.lit(1.0)).otherwise(F.count_if(good) / F.count_if(all_))
    has_table = F.col("table_score").isNotNull()
    return scores.groupBy(*keys).agg(F.count("*").alias("pages"), F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"), F.avg("extra").alias("avg_extra"), share(F.col("table_score") == 1.0, has_table).alias("table_coverage"), share(F.col("verdict") == "pass", F.lit(True)).alias("pass_share"))


_TAG = re.compile(r"<[^>]+>")


def counts_in_row(truth: Column, markdown: Column, tags: bool = False) -> Column:
    """struct<n_truth, n_md, common> of two texts of one row: the figures of :func:`token_overlap` without a shuffle."""

    def tokens(text: str | None) -> Counter:
        low = (text or "").lower()
        return Counter(folds.tokens(_TAG.sub(" ", low) if tags else low))

    def figures(a: str | None, b: str | None) -> tuple[int, int, int]:
        x, y = tokens(a), tokens(b)
        return x.total(), y.total(), folds.in_common(x, y)

    @F.arrow_udf("n_truth long, n_md long, common long")
    def counted(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # of a batch only a few texts are Python values at once, and of their tokens one row's
        for a, b in pairs:
            found = [figures(x, y) for at in range(0, len(a), ROWS) for x, y in zip(a.slice(at, ROWS).to_pylist(), b.slice(at, ROWS).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 3, names=["n_truth", "n_md", "common"])

    return counted(truth, markdown)


def page_quality(pages: DataFrame, keys: list[str], truth: str, markdown: str) -> DataFrame:
    """keys, recall, extra, table_score, heading_score, has_table, tables, expected, headings of parsed pages.

    Scores are null where there is nothing to hold them to: no source text, no table or no heading in it. Headings and
    table rows are lines of the markdown. Tags are no tokens here.
    """
    lines = T.lines(F.col(markdown))
    met = pages.select(
        *keys, T.looks_tabular(F.col(truth)).alias("has_table"), T.expected_headings(F.col(truth)).alias("expected"), (F.trim(F.coalesce(F.col(truth), F.lit(""))) != "").alias("_some"),
        F.size(F.filter(lines, lambda x: x.rlike(T.PIPE_ROW))).alias("table_rows"), F.size(F.filter(lines, lambda x: x.rlike(T.HEADING))).alias("headings"), counts_in_row(F.col(truth), F.col(markdown), tags=True).alias("_n"),
    ).select("*", "_n.*")
    some = lambda c: F.when(F.col("_some"), T.thousandths(c))
    table = F.when(F.col("has_table"), F.when(F.col("table_rows") > 0, 1.0).otherwise(0.0))
    heading = F.when(F.col("expected") > 0, T.thousandths(F.least(F.lit(1.0), F.col("headings") / F.col("expected"))))
    return met.select(*keys, some(recall(F.col("common"), F.col("n_truth"))).alias("recall"), some(extra(F.col("common"), F.col("n_md"))).alias("extra"), table.alias("table_score"), heading.alias("heading_score"), "has_table", "table_rows", "expected", "headings")
