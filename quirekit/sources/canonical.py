"""Raw parser output and model replies, whose JSON drifts from parser to parser, as tables of pages, blocks and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirekit.functions import text as T
from quirekit.operators import references

# Names under which a reply has its text and a response its cost, in order.
TEXT_KEYS = ("markdown", "md", "text", "content")
COST_KEYS = ("cost", "total_cost", "cost_usd")


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parsed(column: Column) -> Column:
    """A text as VARIANT; null where it is no JSON."""
    return F.try_parse_json(column)


def tolerant_list(column: Column) -> Column:
    """The strings of a JSON list; an empty array for null, for what is no JSON, and for what is no list."""
    return F.coalesce(F.try_variant_get(parsed(column), "$", "array<string>"), F.array().cast("array<string>"))


def reply_text(reply: Column) -> Column:
    """The markdown of a model's reply: under the first of its usual names if it is a JSON object, '' if it has none of them, else the reply itself."""
    v = parsed(reply)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    named = F.lit("")
    for key in reversed(TEXT_KEYS):
        there = F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
        named = F.when(there, F.coalesce(_get(v, key, "string"), F.lit(""))).otherwise(named)
    plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.trim(reply))
    return F.when(F.coalesce(reply, F.lit("")) == "", F.lit("")).when(v.isNull(), F.trim(reply)).when(is_object, named).otherwise(plain)


def reply_cost(response: Column) -> Column:
    """What a response says it cost, under usage or at its top; 0 for what is not there or is no number."""
    v = parsed(response)
    found = F.lit(None).cast("variant")
    for key in reversed(COST_KEYS):
        usage, top = F.try_variant_get(v, f"$.usage.{key}", "variant"), F.try_variant_get(v, f"$.{key}", "variant")
        some = F.when(usage.isNotNull() & ~F.is_variant_null(usage) & ~F.coalesce(F.try_variant_get(usage, "$", "double") == 0, F.lit(False)), usage).otherwise(F.when(~F.is_variant_null(top), top))
        found = F.coalesce(some, found)
    return F.coalesce(F.try_variant_get(found, "$", "double"), F.lit(0.0))


def with_replies(df: DataFrame, reply: str = "reply", response: str | None = None) -> DataFrame:
    """Adds markdown, reply_warning (null or a text) and, with ``response``, cost."""
    empty = F.when(F.coalesce(F.col(reply), F.lit("")) == "", F.lit("Model returned empty content."))
    out = df.withColumns({"markdown": reply_text(F.col(reply)), "reply_warning": empty})
    return out.withColumn("cost", reply_cost(F.col(response))) if response else out


def pages(raw: DataFrame) -> DataFrame:
    """(doc_id, place, page_no, page_id, width, height, rotation, source_text, markdown, raw_blocks, provider) of raw output (doc_id, raw).

    A page without a number has its place; one without markdown has its text. What is no JSON, or has no pages, gives
    no row (:func:`warnings` tells of it).
    """
    v = raw.select("doc_id", parsed(F.col("raw")).alias("v"))
    one = v.select("doc_id", F.coalesce(_get(F.col("v"), "provider", "string"), F.lit("unknown")).alias("provider"), F.posexplode(_get(F.col("v"), "pages", "array<variant>")).alias("i", "p"))
    p = F.col("p")
    number = F.coalesce(F.nullif(_get(p, "page_number", "int"), F.lit(0)), F.col("i") + 1)
    return one.select(
        "doc_id", (F.col("i") + 1).alias("place"), number.alias("page_no"), F.format_string("page_%03d", number).alias("page_id"), _get(p, "width", "double").alias("width"), _get(p, "height", "double").alias("height"),
        F.coalesce(_get(p, "rotation", "int"), F.lit(0)).alias("rotation"), F.coalesce(_get(p, "source_text", "string"), F.lit("")).alias("source_text"),
        F.coalesce(_filled(_get(p, "markdown", "string")), _filled(_get(p, "text", "string")), F.lit("")).alias("markdown"), _get(p, "blocks", "array<variant>").alias("raw_blocks"), "provider",
    )


def blocks(raw: DataFrame) -> DataFrame:
    """(doc_id, block_id, page_id, page_no, type, text, markdown, level, bbox, reading_order, provider, raw_id) of raw output (doc_id, raw).

    Blocks that the parser gave are filled in: type paragraph, text from markdown and markdown from text. Other pages'
    markdown is cut into headings, tables, lists and paragraphs. Blocks are numbered through the document.
    """
    p = pages(raw).withColumn("given", F.coalesce(F.size("raw_blocks") > 0, F.lit(False)))
    keep = ["doc_id", "place", "page_no", "page_id", "provider"]
    given = p.where("given").select(*keep, F.posexplode("raw_blocks").alias("i", "b"))
    b = F.col("b")
    kind, level = F.coalesce(_filled(_get(b, "type", "string")), F.lit("paragraph")), _get(b, "level", "int")
    own = given.select(*keep, "i", kind.alias("type"), level.alias("level"), _filled(_get(b, "text", "string")).alias("t"), _filled(_get(b, "markdown", "string")).alias("m"), _get(b, "bbox", "array<double>").alias("bbox"), F.coalesce(_get(b, "reading_order", "int"), F.col("i") + 1).alias("reading_order"), _get(b, "id", "string").alias("raw_id"))
    own = own.withColumn("text", F.trim(F.coalesce("t", T.plain_text(F.coalesce("m", F.lit(""))))))
    marked = F.when(F.col("type") == "heading", F.trim(F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), "text"))).otherwise(F.col("text"))
    own = own.withColumn("markdown", F.coalesce("m", marked)).drop("t", "m")
    cut = references.blocks(p.where("not given").select(*keep, "markdown"), keep, "markdown")
    markdown = F.regexp_replace("markdown", r"(?U)^\s+|\s+$", "")
    made = cut.select(*keep, F.col("block_no").alias("i"), "type", "level", F.lit(None).cast("array<double>").alias("bbox"), (F.col("block_no") + 1).alias("reading_order"), F.lit(None).cast("string").alias("raw_id"), T.plain_text(markdown).alias("text"), markdown.alias("markdown"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "i"))
    named = own.unionByName(made).withColumn("block_id", F.format_string("block_%06d", number))
    return named.select("doc_id", "block_id", "page_id", "page_no", "type", "text", "markdown", "level", "bbox", "reading_order", "provider", "raw_id")


def warnings(raw: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, code, page_no, block_id, message): the parser's own warnings, blocks without a place on their page, documents without pages."""
    v = raw.select("doc_id", parsed(F.col("raw")).alias("v"))
    w = F.col("w")
    told = v.select("doc_id", F.explode(_get(F.col("v"), "warnings", "array<variant>")).alias("w"))
    own = told.select("doc_id", F.coalesce(_get(w, "code", "string"), F.lit("parser")).alias("code"), _get(w, "page_number", "int").alias("page_no"), F.lit(None).cast("string").alias("block_id"), F.coalesce(_get(w, "message", "string"), F.try_variant_get(w, "$", "string"), F.lit("")).alias("message"))
    lost = made.where("bbox is null").select("doc_id", F.lit("missing_bbox").alias("code"), "page_no", "block_id", F.concat(F.lit("Provider did not return a bounding box for "), "type", F.lit(" block.")).alias("message"))
    none = v.where(F.coalesce(F.size(_get(F.col("v"), "pages", "array<variant>")), F.lit(0)) <= 0)
    empty = none.select("doc_id", F.lit("no_pages").alias("code"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("block_id"), F.lit("Parser returned no pages.").alias("message"))
    return own.unionByName(lost).unionByName(empty)
