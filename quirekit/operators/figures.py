"""Images put where a parser left them out of a page's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.operators import records

# What a parser writes for an image that it left out, what it writes before text that it read off one, how far after, and when a page has little text.
PLACEHOLDER = r"\*{0,2}==>\s*picture \[\d+ x \d+\] intentionally omitted <==\*{0,2}"
READ_OFF, NEAR, SPARSE = "Start of picture text", 200, 700


def _figure(page: Column, n: Column, url: Column) -> Column:
    return F.concat(F.lit("![Figure "), page.cast("string"), F.lit("."), n.cast("string"), F.lit("]("), url, F.lit(")"))


def embedded(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown, n_placed): texts with their pages' large images.

    ``pages``: doc_id, page_no, kind, source, markdown; ``images``: doc_id, page_no, xref, ordinal, width, height, url.
    The nth placeholder that is followed by no text read off the image takes the nth large image; placeholders beyond
    the images, and images that could not be kept (null url), leave the placeholder. A page without such placeholders,
    with little source text and no figure yet, gets its first image at the end, if it is not a visual page. Null texts
    are ''. An xref counts once, at its first place; the images of a page are bounded by the page.
    """
    keys = ["doc_id", "page_no"]
    large = records.big_images(images, keys).join(images.select(*keys, "xref", "ordinal", "url").distinct(), [*keys, "xref", "ordinal"])
    urls = large.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "xref", "url"))), lambda r: r["url"]).alias("urls"))
    met = pages.select(*keys, F.coalesce("kind", F.lit("text")).alias("kind"), F.length(F.coalesce("source", F.lit(""))).alias("n_source"), F.coalesce("markdown", F.lit("")).alias("text")).join(urls, keys, "left")
    met = met.withColumns({"marks": F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0)), "parts": F.split("text", PLACEHOLDER, -1)})
    lengths = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    end = lambda i: lengths(F.col("parts"), i + 1) + lengths(F.col("marks"), i + 1)
    genuine = F.transform("marks", lambda _, i: (~F.substring(F.col("text"), end(i) + 1, F.lit(NEAR)).contains(READ_OFF)).cast("int"))
    met = met.withColumn("genuine", genuine)
    nth = lambda i: F.aggregate(F.slice("genuine", 1, i + 1), F.lit(0), lambda s, x: s + x)
    url = lambda i: F.when(F.get("genuine", i) == 1, F.get("urls", nth(i) - 1))
    placed = F.transform("marks", lambda m, i: F.concat(F.get("parts", i), F.coalesce(_figure(F.col("page_no"), nth(i), url(i)), m)))
    spliced = F.concat(F.array_join(placed, ""), F.element_at("parts", -1))
    first = F.get("urls", F.lit(0))
    any_genuine = F.aggregate("genuine", F.lit(0), lambda s, x: s + x) > 0
    sparse = (F.col("kind") != "visual") & ~F.col("text").contains("![") & (F.col("n_source") < SPARSE) & first.isNotNull()
    appended = F.concat(F.regexp_replace("text", r"(?U)\s+$", ""), F.lit("\n\n"), _figure(F.col("page_no"), F.lit(1), first), F.lit("\n"))
    n = F.when(F.col("urls").isNull(), 0).when(any_genuine, F.size(F.filter(F.transform("marks", lambda _, i: url(i)), lambda u: u.isNotNull()))).when(sparse, 1).otherwise(0)
    return met.select(*keys, F.when(F.col("urls").isNull(), F.col("text")).when(any_genuine, spliced).when(sparse, appended).otherwise(F.col("text")).alias("markdown"), n.alias("n_placed"))
