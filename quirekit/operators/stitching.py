"""Tables that a page break cut in two, put together again with windows over a document's pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirekit.functions import text as T


def _stripped(text: Column) -> Column:
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def _ended(text: Column) -> Column:
    """A text without white space at its end; only texts that have some are searched."""
    return F.when(F.substring(text, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text)


def _run(lines: Column) -> Column:
    """How many table rows an array of lines begins with."""
    other = F.array_position(F.transform(lines, lambda x: x.rlike(T.PIPE_ROW)), False)
    return F.when(other == 0, F.size(lines)).otherwise((other - 1).cast("int"))


def _columns(row: Column) -> Column:
    return F.size(F.split(F.regexp_replace(_stripped(row), r"^\|+|\|+$", ""), r"\|", -1))


def stitched(pages: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """pages (doc_id, page_no, markdown and the columns ``carried``), where rows at a page's top go to the table of as many columns that ends the page before.

    A header that comes again is dropped with its separator. Pages are read in order, so a page of nothing but rows
    that moved up is empty and the next page's rows have no table to go to: along such pages every second one moves.
    That alternation is a parity from the last page at which it begins anew, so no page waits for the one before it.
    Untouched texts stay as they are, null ones become ''. Lines end at \\n.
    """
    kept = F.struct(*carried) if carried else F.lit(None)
    own = pages.select("doc_id", "page_no", kept.alias("kept"), F.coalesce("markdown", F.lit("")).alias("text"))
    own = own.withColumns({"upper": F.split(_ended(F.col("text")), "\n", -1), "lower": F.split(F.regexp_replace("text", r"^\n+", ""), "\n", -1)})
    own = own.withColumns({"tail": _run(F.reverse("upper")), "head": _run(F.col("lower"))})
    rest = _stripped(F.array_join(F.slice("lower", F.col("head") + 1, F.size("lower")), "\n"))
    again = (F.col("head") >= 2) & F.get("lower", F.lit(1)).rlike(T.SEPARATOR_ROW)
    rows = F.slice("lower", F.when(again, 3).otherwise(1), F.greatest(F.col("head") - F.when(again, 2).otherwise(0), F.lit(0)))
    own = own.select("doc_id", "page_no", "kept", "text", rest.alias("rest"), rows.alias("rows"), "head", "tail", _columns(F.get("lower", F.lit(0))).alias("head_columns"), _columns(F.get("upper", F.size("upper") - F.col("tail"))).alias("tail_columns"))
    order = Window.partitionBy("doc_id").orderBy("page_no")
    before = lambda c: F.lag(c).over(order)
    fits = (F.col("head") > 0) & (before("tail") > 0) & (F.col("head_columns") == before("tail_columns"))
    placed = own.withColumns({"fits": F.coalesce(fits, F.lit(False)), "after_rows": F.coalesce(before(F.col("rest") == ""), F.lit(False)), "place": F.row_number().over(order)})
    anew = F.when(~(F.col("fits") & F.col("after_rows")), F.struct("place", "fits"))
    begun = placed.withColumn("begun", F.last(anew, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    moved = begun.withColumn("moves", F.when((F.col("place") - F.col("begun.place")) % 2 == 0, F.col("begun.fits")).otherwise(~F.col("begun.fits")))
    gained = moved.withColumn("gained", F.lead(F.when(F.col("moves"), F.col("rows"))).over(order))
    left = F.when(F.col("moves"), F.col("rest")).otherwise(F.col("text"))
    longer = _stripped(F.array_join(F.concat(F.split(_ended(left), "\n", -1), "gained"), "\n"))
    return gained.select("doc_id", "page_no", F.when(F.col("gained").isNotNull(), longer).otherwise(left).alias("markdown"), *[F.col("kept")[c].alias(c) for c in carried])
