"""Lines that recur from page to page: boilerplate, running furniture, stamps and sign-off rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirekit.functions import text as T


def recurring(lines: DataFrame, normal: Column, share: float, least: int, longest: int | None, shortest: int, min_pages: int, exact_half_even: bool) -> DataFrame:
    """(doc_id, normal, n): normal forms on at least the threshold of a document's pages. lines: doc_id, page_no, line.

    A line counts once a page. Documents are counted apart from their lines, and the two meet only
    after lines below the least threshold are gone, so a document of very many lines is spread out.
    """
    pages = lines.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))
    seen = lines.select("doc_id", "page_no", normal.alias("normal")).where(F.length("normal") >= shortest).distinct()
    counts = seen.groupBy("doc_id", "normal").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    threshold = F.bround(F.col("pages") * share) if exact_half_even else F.floor(F.col("pages") * share)
    met = counts.join(pages, "doc_id").where((F.col("pages") >= min_pages) & (F.col("n") >= F.greatest(F.lit(least), threshold)))
    return (met.where(F.length("normal") <= longest) if longest else met).select("doc_id", "normal", "n")


def boilerplate(lines: DataFrame) -> DataFrame:
    """Lines, without markdown signs, on 30 % of the pages and three at least, of at most 90 characters."""
    return recurring(lines, T.plain_line(F.col("line")), 0.30, 3, 90, 1, 0, False)


def furniture(lines: DataFrame) -> DataFrame:
    """Running headers and footers: lines, digits alike, of six characters or more on half of three or more pages."""
    return recurring(lines, T.running_line(F.col("line")), 0.5, 2, None, 6, 3, True)


def cleaned(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``lines`` (doc_id, page_no, line_no, line) without boilerplate, stamps, and sign-off rows with the separator rows next to them."""
    found = boilerplate(lines) if found is None else found
    plain = lines.withColumn("normal", T.plain_line(F.col("line")))
    kept = plain.join(found.select("doc_id", "normal"), ["doc_id", "normal"], "left_anti").drop("normal").where(~T.is_stamp(F.col("line")))
    near = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    signed = kept.withColumn("_signed", T.is_sign_off(F.col("line")))
    beside = F.coalesce(F.lag("_signed").over(near), F.lit(False)) | F.coalesce(F.lead("_signed").over(near), F.lit(False))
    marked = signed.withColumn("_drop", F.col("_signed") | (F.col("line").rlike(T.SEPARATOR_ROW) & beside))
    return marked.where(~F.col("_drop")).drop("_signed", "_drop")


def joined(lines: DataFrame, keys: list[str], as_: str = "markdown") -> DataFrame:
    """Lines put together in order, one text for each of ``keys``."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias(as_))


def finalized(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new) of texts that cleaning really changes and does not make blank."""
    both = before.select(*keys, F.col("markdown").alias("old")).join(after.select(*keys, F.col("markdown").alias("new")), keys)
    return both.where((F.trim("new") != F.trim("old")) & (F.trim("new") != ""))


def recurring_hashes(pages: DataFrame, owner: list[str], column: str, normal: Callable[[Column], Column], fits: Callable[[Column], Column], threshold: Callable[[Column], Column], least: int, min_pages: int) -> DataFrame:
    """(owner, recurs): 64-bit hashes of the normal forms that recur on an owner's pages, for owners that have any. ``normal`` gives those of a text's lines.

    One row of ``pages`` is one page. Its lines are counted as hashes, each once, before anything is shuffled; what
    recurs on a share of the pages is no longer than a few pages, so the array is bounded by them.
    """
    keys = F.array_distinct(F.transform(F.filter(normal(F.col(column)), fits), lambda x: F.xxhash64(x)))
    counts = pages.select(*owner, F.explode(F.concat(keys, F.array(F.lit(None).cast("long")))).alias("key")).groupBy(*owner, "key").agg(F.count("*").alias("n"))
    of = counts.where(F.col("key").isNull() & (F.col("n") >= min_pages)).select(*owner, F.col("n").alias("pages"))
    met = counts.where(F.col("key").isNotNull() & (F.col("n") >= least)).join(of, owner).where(F.col("n") >= F.greatest(F.lit(least), threshold(F.col("pages"))))
    return met.groupBy(*owner).agg(F.collect_set("key").alias("recurs"))


def boilerplate_keys(text: Column) -> Column:
    """64-bit hashes of the lines of a page that can be boilerplate, each once."""
    normal = F.filter(F.transform(T.lines(text), T.plain_line), lambda x: F.length(x).between(1, 90))
    return F.array_distinct(F.transform(normal, lambda x: F.xxhash64(x)))


def cleaned_text(text: Column, recurs: Column) -> Column:
    """A page's text as :func:`cleaned` leaves it, from the hashes of its owner's boilerplate (null: none)."""
    told = lambda x: F.coalesce(F.array_contains(recurs, F.xxhash64(T.plain_line(x))), F.lit(False))
    kept = F.filter(T.lines(text), lambda x: ~told(x) & ~T.is_stamp(x))

    def stays(lines: Column) -> Column:
        signed = lambda at: F.coalesce(T.is_sign_off(F.get(lines, at)), F.lit(False))
        return F.filter(lines, lambda x, i: ~T.is_sign_off(x) & ~(x.rlike(T.SEPARATOR_ROW) & (signed(i - 1) | signed(i + 1))))

    # a let binding: the lines that are left are worked out once
    return F.array_join(F.element_at(F.transform(F.array(kept), stays), 1), "\n")
