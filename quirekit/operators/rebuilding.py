"""Sections made again from their pages, and which section owns a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.operators import layout, references


def rebuilt(pages: DataFrame, tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, id, markdown, pages, overlaps): the sections ``wanted`` (doc_id, id) from all of their pages.

    ``pages``: doc_id, page_no, markdown (canonical texts). ``tree``: doc_id, id, page_start, page_end, lft, rgt. A
    section takes whole pages, so what it shares with neighbours is told: ``overlaps`` has the ids of sections, neither
    above nor below it, that have pages of it. Recurring lines are those of the section's own slice of pages. Tables
    without a separator get one. Sections without a page range, or without pages there, give no row. The texts
    of a document with wanted sections are shuffled once, by document, and its sections are made in that row.
    """
    keys = ["doc_id", "id"]
    asked = tree.where((F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start"))).join(wanted.select(*keys).distinct(), keys, "left_semi")
    near = references.overlapping(tree).join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("other")).alias("overlaps"))
    kind = near.schema["overlaps"].dataType
    told = asked.join(near, keys, "left").withColumn("overlaps", F.coalesce("overlaps", F.array().cast(kind)))
    spans = told.groupBy("doc_id").agg(F.collect_list(F.struct("id", "page_start", "page_end", "overlaps")).alias("spans"))
    texts = pages.join(spans.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "markdown"))).alias("texts"))

    def cut(span: Column) -> Column:
        return F.struct(span["id"].alias("id"), span["overlaps"].alias("overlaps"), F.transform(F.filter("texts", lambda p: p["page_no"].between(span["page_start"], span["page_end"])), lambda p: p["markdown"]).alias("slice"))

    slices = texts.join(spans, "doc_id").select("doc_id", F.explode(F.transform("spans", cut)).alias("s")).select("doc_id", "s.*").where(F.size("slice") > 0)
    counted = slices.withColumns({"keys": F.array_sort(F.flatten(F.transform("slice", layout.boilerplate_keys))), "least": F.greatest(F.lit(3), F.floor(F.size("slice") * 0.30)).cast("int")})
    # of sorted keys, one that comes again so many places on is there so often
    known = counted.withColumn("recurs", F.array_distinct(F.filter("keys", lambda x, i: x == F.get("keys", i + F.col("least") - 1))))
    # bound as an array of one: worked out once a section, not once a line
    page = lambda r: lambda t: F.regexp_replace(layout.cleaned_text(t, r), r"(?U)^\s+|\s+$", "")
    clean = F.element_at(F.transform(F.array("recurs"), lambda r: F.transform("slice", page(r))), 1)
    rows = known.withColumn("clean", clean).select("doc_id", "id", F.size("slice").alias("pages"), "overlaps", F.array_join(F.filter("clean", lambda x: x != ""), "\n\n").alias("markdown"))
    return references.with_separators(rows, [*keys, "pages", "overlaps"], "markdown").select(*keys, "markdown", "pages", "overlaps")


def owners(points: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, page, n_owners, owner, state) of changed pages: the one deepest section over a page, if there is just one.

    state: 'owned', 'no_owner' (no section has the page), 'shared' (a page at the border of several). Repeated points
    are one; null ones are left out.
    """
    asked = points.where("doc_id is not null and page is not null").select("doc_id", "page").distinct()
    found = references.deepest_covering(asked, tree).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return asked.join(found, ["doc_id", "page"], "left").select("doc_id", "page", n.alias("n_owners"), F.when(n == 1, F.col("first")).alias("owner"), F.when(n == 1, "owned").when(n == 0, "no_owner").otherwise("shared").alias("state"))


def propagated(points: DataFrame, pages: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners of the changed pages, their sections made again): a page without a sole owner changes no section."""
    found = owners(points, tree)
    return found, rebuilt(pages, tree, found.where("state = 'owned'").select("doc_id", F.col("owner").alias("id")))
