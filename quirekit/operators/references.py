"""Intervals and graphs: which section a page belongs to, references between sections, degrees, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators.trees import by_document


#: No reference names a later page: they have four digits at most.
LAST_PAGE = 9999
#: Texts that a worker holds as Python values at once.
TEXTS = 64


def by_page(spans: DataFrame, last: int = LAST_PAGE) -> DataFrame:
    """Spans (doc_id, id, page_start, page_end) once for each page up to ``last``, as column ``page``. Null and zero bounds cover nothing.

    Sections of a tree have together no more pages than the document has pages times levels, so an equality join on
    (doc_id, page) stays linear where bounds would be checked for all pairs of a document.
    """
    real = spans.where((F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start")) & (F.col("page_start") <= last))
    return real.withColumn("page", F.explode(F.sequence(F.col("page_start").cast("long"), F.least(F.col("page_end").cast("long"), F.lit(last).cast("long")))))


def covering(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (doc_id, page, from 1 to LAST_PAGE) with every span (doc_id, id, page_start, page_end) that covers them."""
    return points.withColumn("page", F.col("page").cast("long")).join(by_page(spans), ["doc_id", "page"])


def smallest_covering(points: DataFrame, spans: DataFrame, order: str = "ord") -> DataFrame:
    """(doc_id, page, id): the shortest covering span, the first by ``order`` of equal ones; pages without one are left out."""
    kind = points.schema["page"].dataType
    best = by_page(spans).groupBy("doc_id", "page").agg(F.min_by("id", F.struct(F.col("page_end") - F.col("page_start"), F.col(order))).alias("id"))
    wanted = points.select("doc_id", F.col("page").cast("long").alias("page")).distinct()
    return wanted.join(best, ["doc_id", "page"]).select("doc_id", F.col("page").cast(kind).alias("page"), "id")


def deepest_covering(points: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, page, id): covering sections (with lft, rgt) that have no covering section below them.

    A section has one below it if, of those that cover the page and begin later in the tree, the least rgt is smaller.
    """
    kind = points.schema["page"].dataType
    found = covering(points.select("doc_id", "page").distinct(), tree).select("doc_id", "page", "id", "lft", "rgt")
    later = Window.partitionBy("doc_id", "page").orderBy(F.desc("lft")).rangeBetween(Window.unboundedPreceding, -1)
    below = F.min("rgt").over(later) < F.col("rgt")
    return found.withColumn("_below", F.coalesce(below, F.lit(False))).where("not _below").select("doc_id", F.col("page").cast(kind).alias("page"), "id")


def overlapping(spans: DataFrame) -> DataFrame:
    """(doc_id, id, other): sections that share pages and of which neither is above the other.

    Of two sections that share pages, one covers the page on which the other starts: an equality join on that page.
    Null and zero bounds share nothing.
    """
    real = spans.where((F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start")))
    b = real.select("doc_id", F.col("page_start").cast("long").alias("page"), F.col("id").alias("other"), F.col("page_start").alias("s"), F.col("lft").alias("l"), F.col("rgt").alias("r"))
    met = by_page(spans, 2**31 - 1).join(b, ["doc_id", "page"]).where(F.col("id") != F.col("other"))
    apart = ~((F.col("lft") < F.col("l")) & (F.col("r") < F.col("rgt"))) & ~((F.col("l") < F.col("lft")) & (F.col("rgt") < F.col("r")))
    ways = F.when(F.col("s") == F.col("page_start"), F.array(F.struct("id", "other"))).otherwise(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other"))))
    return met.where(apart).select("doc_id", F.explode(ways).alias("w")).select("doc_id", "w.id", "w.other")


def extract(sections: DataFrame, page_counts: DataFrame, order: str = "ord", spans: DataFrame | None = None) -> DataFrame:
    """(doc_id, from_id, to_id, page, anchor, occurrences): references of sections (doc_id, id, ord, page_start, page_end, markdown) to other sections.

    A reference without a cue, or to a page that the document has not, is external; so is none to the
    section itself. ``page_counts``: doc_id, page_count; documents without one take any page. ``anchor`` is the text of
    the reference. ``spans`` has all sections to which references lead, if ``sections`` are only some of them. Texts are searched once and not shuffled but for their references.
    """
    found = sections.select("doc_id", F.col("id").alias("from_id"), F.explode(T.page_references(F.col("markdown"))).alias("r"))
    counted = found.groupBy("doc_id", "from_id", F.col("r.page").alias("page"), F.col("r.anchor").alias("anchor")).agg(F.first("r").alias("r"), F.count("*").alias("occurrences"))
    known = counted.join(page_counts, "doc_id", "left").where(T.is_internal(F.col("r"), F.coalesce("page_count", F.lit(10**9)))).drop("r", "page_count")
    best = by_page(sections if spans is None else spans).groupBy("doc_id", "page").agg(F.min_by("id", F.struct(F.col("page_end") - F.col("page_start"), F.col(order))).alias("to_id"))
    met = known.withColumn("_page", F.col("page").cast("long")).join(best.withColumnRenamed("page", "_page"), ["doc_id", "_page"])
    return met.where(F.col("from_id") != F.col("to_id")).select("doc_id", "from_id", "to_id", "page", "anchor", "occurrences")


def weighted_edges(references: DataFrame) -> DataFrame:
    """(doc_id, from_id, to_id, weight, and anchors if there are any): references between two sections added up; missing or zero occurrences count 1."""
    weight = F.sum(F.coalesce(F.nullif("occurrences", F.lit(0).cast("long")), F.lit(1).cast("long"))).alias("weight")
    anchors = [F.array_sort(F.collect_set("anchor")).alias("anchors")] if "anchor" in references.columns else []
    return references.groupBy("doc_id", "from_id", "to_id").agg(weight, *anchors)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, degree): the weight of the edges at either end; with ``nodes``, zero for those without."""
    ends = edges.select("doc_id", F.col("from_id").alias("id"), "weight").unionByName(edges.select("doc_id", F.col("to_id").alias("id"), "weight"))
    sums = ends.groupBy("doc_id", "id").agg(F.sum("weight").alias("degree"))
    if nodes is None:
        return sums
    return nodes.select("doc_id", "id").join(sums, ["doc_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both in ``nodes``."""
    keys = nodes.select("doc_id", "id").distinct()
    return edges.join(keys.withColumnRenamed("id", "from_id"), ["doc_id", "from_id"], "left_semi").join(keys.withColumnRenamed("id", "to_id"), ["doc_id", "to_id"], "left_semi")


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id, neighbours): how many nodes are one step away, either way, the node included."""
    near = edges.select("doc_id", F.col("from_id").alias("id"), F.col("to_id").alias("n")).unionByName(edges.select("doc_id", F.col("to_id").alias("id"), F.col("from_id").alias("n"))).unionByName(nodes.select("doc_id", "id", F.col("id").alias("n")))
    return near.distinct().groupBy("doc_id", "id").agg(F.count("*").alias("neighbours"))


def graph(tree: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document or of many: sections with span and degree; PART_OF, HAS_SECTION and REFERENCES edges."""
    refs = weighted_edges(references)
    span = F.when((F.col("page_start") != 0) & (F.col("page_end") != 0), F.col("page_end") - F.col("page_start") + 1).otherwise(0)
    nodes = tree.select("doc_id", "id", "title", "page_start", "page_end", F.coalesce(span, F.lit(0)).alias("span")).join(degrees(refs, tree), ["doc_id", "id"])
    text = lambda c: F.col(c).cast("string")
    part = tree.where("parent_id is not null").select("doc_id", text("id").alias("src"), text("parent_id").alias("dst"), F.lit("PART_OF").alias("rel"), F.lit(1).cast("long").alias("weight"))
    top = tree.where("parent_id is null").select("doc_id", text("doc_id").alias("src"), text("id").alias("dst"), F.lit("HAS_SECTION").alias("rel"), F.lit(1).cast("long").alias("weight"))
    return nodes, part.unionByName(top).unionByName(refs.select("doc_id", text("from_id").alias("src"), text("to_id").alias("dst"), F.lit("REFERENCES").alias("rel"), "weight"))


def with_links(sections: DataFrame, routes: DataFrame) -> DataFrame:
    """(doc_id, id, content, links): texts whose page references are links to the smallest covering section's route.

    sections: doc_id, id, ord, page_start, page_end, page_count, markdown; routes: doc_id, id, route. Sections without a
    route, or without keys, are left out. Texts and routes are dealt by document once; a document's pages are given to its
    sections once, the shortest first, so time is linear in both.
    """

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        route = {r[0]: r[-1] for r in rows if r[1]}
        some = [r for r in rows if not r[1] and r[0] in route]
        spans = sorted((end - start, i, start, end) for i, (_, _, _, start, end, *_) in enumerate(some) if start and end)
        last = min(LAST_PAGE, max((r[5] or 0 for r in some), default=0))
        owner: list[int | None] = [None] * (last + 2)
        free = list(range(last + 2))  # the next page from here on that has no owner, or on the way to it

        def next_free(page: int) -> int:
            while free[page] != page:
                free[page] = free[free[page]]
                page = free[page]
            return page

        for _, i, start, end in spans:
            page = next_free(min(max(start, 1), last + 1))
            while page <= min(end, last):
                owner[page], free[page] = i, page + 1
                page = next_free(page + 1)
        route_of = lambda page: route[some[owner[page]][0]] if page <= last and owner[page] is not None else None
        for id_, _, _, _, _, count, markdown, _ in some:
            yield id_, *folds.linked(markdown, count or 0, route_of, route[id_])

    kind = sections.schema["id"].dataType.simpleString()
    texts = sections.select("doc_id", "id", F.lit(False).alias("is_route"), "ord", F.col("page_start").cast("long"), F.col("page_end").cast("long"), F.col("page_count").cast("long"), "markdown", F.lit(None).cast("string").alias("route"))
    named = routes.select("doc_id", "id", F.lit(True).alias("is_route"), *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("ord", "page_start", "page_end", "page_count", "markdown")), "route")
    return by_document(texts.unionByName(named).where("doc_id is not null and id is not null"), ["ord", "id"], fold, f"id {kind}, content string, links int")


def per_text(df: DataFrame, keep: list[str], column: str, schema: str, one) -> DataFrame:
    """Rows that ``one(text)`` (a list of tuples) makes of every text, after the columns ``keep``: lint issues, blocks and the like.

    A worker holds ``TEXTS`` texts as Python values at once, however many come in a batch.
    """
    whole = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(whole)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                out = [(*key, *r) for *key, t in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns)) for r in one(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*keep, column).mapInArrow(rows, whole)


def lint(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    return per_text(df, keep, column, "code string, line int, message string", lambda t: [(x["code"], x["line"], x["message"]) for x in folds.lint(t)])


def with_separators(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    return per_text(df, keep, column, f"{column} string", lambda t: [(folds.with_separators(t),)])


def blocks(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    return per_text(df, keep, column, "block_no int, type string, level int, markdown string", lambda t: [(i, b["type"], b["level"], b["markdown"]) for i, b in enumerate(folds.blocks(t or ""))])


def table_cells(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, row, col, cell: the cells of table rows of a text, rows counted from 0 over the text, separator rows left out."""
    rows = F.filter(T.lines(F.col(column)), lambda x: x.rlike(T.PIPE_ROW) & ~x.rlike(T.SEPARATOR_ROW))
    row = pages.select(*keys, F.posexplode(rows).alias("row", "line"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return row.select(*keys, "row", F.posexplode(F.split(inner, r"\|", -1)).alias("col", "c")).select(*keys, "row", "col", F.trim("c").alias("cell"))
