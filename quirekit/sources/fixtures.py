"""Domain tables made from the general test tables, the same way every time; the oracle SQL repeats each in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a document that make a page.
PER_PAGE = 5
#: Rows whose keys one task tells apart.
PER_TASK = 500_000
# The section types and their labels, in order.
TYPES = [(1, "de", "German"), (2, "en", "English"), (3, "es", "Spanish"), (4, "fr", "French"), (5, "it", "Italian"), (99, "other", "Other")]
LEFT_OUT = "==> picture intentionally omitted <=="
TABLES = ["| A | B |\n|---|---|\n| 1 | 2 |", "| A | B |\n| 1 | 2 |", "| A | B |\n|---|---|\n| 1 |", "| orphan |"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, n of them or fewer, by their keys: PER_TASK on average in a task at most, however many rows there are."""
    parts = -(-n // PER_TASK)
    return rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(*keys)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "ord int, type_name string, label string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no from 1, line)."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, n_pages, body, md): five lines a page; md has a heading, the body, a table and page references around it.

    Pages are cut from the array of a document's lines, so nothing is shuffled.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("x"))
    cut = docs.withColumn("n_pages", F.expr(f"cast(({PER_PAGE - 1} + size(x)) div {PER_PAGE} as int)"))
    one = cut.select("doc_id", "n_pages", "x", F.explode_outer(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_no"))
    body = one.withColumn("body", F.array_join(F.slice("x", (F.col("page_no") - 1) * PER_PAGE + 1, F.lit(PER_PAGE)), "\n")).drop("x")
    kind = F.pmod(F.col("doc_id"), F.lit(4))
    shown = F.when(kind == 0, TABLES[0]).when(kind == 1, TABLES[1]).when(kind == 2, TABLES[2]).otherwise(TABLES[3])
    text = lambda c: c.cast("string")
    heading = F.concat(F.lit("## "), text(F.col("page_no")), F.lit(". Part "), text(F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(7))))
    reference = F.concat(F.lit("See page "), text(F.pmod(F.col("doc_id") + F.col("page_no"), F.col("n_pages")) + 1), F.lit(". Williams p. 820."))
    return body.select("doc_id", "page_no", "n_pages", "body", F.concat_ws("\n", heading, "body", shown, reference).alias("md"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, ord, title, page_start, page_end, markdown): one section a page, and page 1's section spans the document."""
    p = pages(spark, sf_dir)
    end = F.when(F.col("page_no") == 1, F.col("n_pages")).otherwise(F.col("page_no"))
    return p.select("doc_id", F.col("page_no").alias("id"), F.col("page_no").alias("ord"), F.concat(F.lit("Part "), F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(7)).cast("string")).alias("title"), F.col("page_no").alias("page_start"), end.alias("page_end"), "n_pages", F.col("md").alias("markdown"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: (doc_id = source, id, lft, title, path, section_type); those without a label are untagged."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("lft"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("path"), F.when(F.col("has"), F.col("lang")).alias("section_type"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, project_id, title): sources as documents; every third is in project p0, some have no title."""
    one = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id")).distinct()
    n = F.substring("doc_id", 4, 10).cast("int")
    return one.select("doc_id", F.concat(F.lit("p"), F.pmod(n, F.lit(3)).cast("string")).alias("project_id"), F.when(F.pmod(n, F.lit(5)) != 0, F.concat(F.lit("Source "), n.cast("string"))).alias("title"))


def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = host, page_no = page_id, line_no, line): the visible text of web pages, a line for each stretch between tags, a banner and a stamp on top."""
    p = table(spark, sf_dir, "pages").where("html is not null and url is not null")
    text = F.regexp_replace(F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", "<>"), r"[\r\n]+", " ")
    cut = F.concat(F.array(F.lit("**Site Banner**"), F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" of 900"))), F.split(text, r"<[^>]*>", -1))
    rows = p.select(F.regexp_extract("url", r"://([^/:?#]+)", 1).alias("doc_id"), F.col("page_id").alias("page_no"), F.posexplode_outer(cut).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def recall_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, truth, markdown): all visible text of a web page, and its article's."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]+>", " ")
    return p.select("page_id", strip(F.col("html")).alias("truth"), strip(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)).alias("markdown"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as one tree: (doc_id = region, id, parent_id, ord, title, included, markdown)."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    long = lambda x: x.cast("long")
    top = r.select(long(F.col("r_regionkey")).alias("doc_id"), (long(F.col("r_regionkey")) + 1).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ord"), F.col("r_name").alias("title"), F.lit(True).alias("included"))
    mid = n.select(long(F.col("n_regionkey")).alias("doc_id"), (long(F.col("n_nationkey")) + 100).alias("id"), (long(F.col("n_regionkey")) + 1).alias("parent_id"), long(F.col("n_nationkey")).alias("ord"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 3 != 0).alias("included"))
    low = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(long(F.col("n_regionkey")).alias("doc_id"), (F.col("c_custkey") + 1000).alias("id"), (long(F.col("c_nationkey")) + 100).alias("parent_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), (F.col("c_custkey") % 5 != 0).alias("included"))
    return top.unionByName(mid).unionByName(low)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = nation, id = supplier, ord, page_start, page_end)."""
    s = table(spark, sf_dir, "supplier")
    start = F.col("s_suppkey") % 40 + 1
    return s.select(F.col("s_nationkey").cast("long").alias("doc_id"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), start.alias("page_start"), (start + F.pmod(F.col("s_suppkey") * 7, F.lit(12))).alias("page_end"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page): part sizes as pages of nations."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("doc_id"), F.col("p_size").cast("long").alias("page"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id = 0, from_id = supplier, to_id = part + 1000000, page, occurrences): line items as weighted references; even line numbers have no count."""
    li = table(spark, sf_dir, "lineitem")
    occ = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber").cast("long"))
    return li.select(F.lit(0).cast("long").alias("doc_id"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") + 1_000_000).alias("to_id"), F.lit(1).alias("page"), occ.alias("occurrences"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls and job steps: (job, seq, status, label, cost); errors have no cost."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_type") == "view", "judge").otherwise("parse").alias("label"), F.when(F.col("event_type") != "error", F.floor(F.col("value") * 100) / 100).alias("cost"), "ts")


def scores(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """(doc_id, page_no, recall, extra, table_score): scores of run 'a' or 'b', worked out from line items.

    Rows are dealt by their keys before they are told apart, so no task holds more keys than its share.
    """
    items = table(spark, sf_dir, "lineitem")
    li = dealt(items.where("l_linenumber is not null").select("l_orderkey", "l_linenumber"), items.count(), "l_orderkey", "l_linenumber").distinct()
    k = 1 if which == "a" else 3
    n = F.col("l_orderkey") * k + F.col("l_linenumber") * (k + 1)
    own = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), ((100 - n % 30) / 100.0).alias("recall"), ((n % 40) / 100.0).alias("extra"), F.when(n % 4 == 0, F.lit(0.0)).when(n % 4 == 1, F.lit(1.0)).alias("table_score"))
    return own.where(F.col("doc_id") % 7 != 0) if which == "b" else own


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, markdown): pages of table rows; some have a line before or after, other columns, or no header."""
    p = pages(spark, sf_dir).select("doc_id", "page_no", (F.col("doc_id") + F.col("page_no")).alias("k"))
    head = F.when(F.col("k") % 3 == 0, "Intro\n").otherwise("")
    header = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 5 == 0, "| A | B | C |\n|---|:-:|---|\n").otherwise("| A | B |\n|---|---|\n")
    row = F.concat(F.lit("| "), F.col("page_no").cast("string"), F.when(F.col("k") % 5 == 0, F.lit(" | x | y |")).otherwise(F.lit(" | x |")))
    return p.select("doc_id", "page_no", F.concat(head, header, row, F.when(F.col("k") % 7 == 0, "\nEnd").otherwise("")).alias("markdown"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, kind, source, markdown, composite, verdict): pages with a banner and a foot, and a parser's text that lost some lines."""
    p = pages(spark, sf_dir).select("doc_id", "page_no", "n_pages", "body", (F.col("doc_id") + F.col("page_no")).alias("k"))
    text = lambda c: F.col(c).cast("string")
    banner, foot = F.concat(F.lit("Operations Manual "), text("doc_id")), F.concat(F.lit("Page "), text("page_no"), F.lit(" of "), text("n_pages"))
    body = F.split("body", "\n", -1)
    kept = F.when(F.col("k") % 3 == 0, F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    left = F.when(F.col("k") % 5 == 0, F.array(F.lit(LEFT_OUT))).otherwise(F.array().cast("array<string>"))
    parsed = F.array_join(F.concat(F.array(banner), kept, left, F.array(foot)), "\n")
    kind = F.when(F.col("k") % 13 == 0, "visual").otherwise("text")
    verdict = F.when(F.col("k") % 4 == 1, "pass").otherwise("review")
    return p.select("doc_id", "page_no", kind.alias("kind"), F.concat_ws("\n", banner, "body", foot).alias("source"), parsed.alias("markdown"), (F.lit(0.5) + F.col("k") % 5 / 10.0).alias("composite"), verdict.alias("verdict"))


def offline_vlm(page: dict) -> dict:
    """Stands in for a model that reads a page's image: the lines between banner and foot under a heading; no reply for every eleventh."""
    if (page["doc_id"] + page["page_no"]) % 11 == 0:
        raise RuntimeError("no reply")
    return {"text": "\n".join([f"# Page {page['page_no']}", *page["source"].split("\n")[1:-1]]), "cost": 0.002}


def offline_cleanup(page: dict) -> dict:
    """Stands in for a model that cleans a text: banner, foot and what the parser left go; for every seventh half of the lines go as well."""
    lines = [x for x in page["markdown"].split("\n")[1:-1] if x != LEFT_OUT]
    return {"text": "\n".join(lines[: len(lines) // 2] if (page["doc_id"] + page["page_no"]) % 7 == 0 else lines), "cost": 0.0005}


def offline_judge(page: dict, text: str) -> str:
    """Stands in for a judge: a point for each 50 characters."""
    return '{"overall": %d}' % min(5, len(text) // 50)


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents as trees of three levels: every fourth page's section is below the one before it, the others below the first."""
    s = sections(spark, sf_dir)
    parent = F.when(F.col("id") % 4 == 0, F.col("id") - 1).when(F.col("id") > 1, 1)
    return s.select("doc_id", "id", parent.alias("parent_id"), "ord", "title", F.lit(None).cast("string").alias("section_type"), F.lit(True).alias("included"), "page_start", "page_end", "markdown", "n_pages")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine edits for every third document; which can be done depends on how many sections it has."""
    one = pages(spark, sf_dir).where("page_no = 1").where("doc_id % 3 = 0")
    text, null = F.col("doc_id").cast("string"), F.lit(None)

    def edit(seq: int, op: str, **given) -> Column:
        kinds = {"id": "int", "parent_id": "int", "place": "int", "title": "string", "heading": "string", "section_type": "string", "included": "boolean", "markdown": "string", "new_id": "int", "others": "array<int>"}
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), *[given.get(c, null).cast(k).alias(c) for c, k in kinds.items()])

    log = F.array(
        edit(1, "rename", id=F.col("doc_id") % F.col("n_pages") + 1, title=F.concat(F.lit(" Renamed "), text)),
        edit(2, "include", id=F.lit(3), included=F.lit(False)),
        edit(3, "retype", id=F.lit(1), section_type=F.lit("en")),
        edit(4, "retype", id=F.lit(2), section_type=F.lit("zz")),
        edit(5, "delete", id=F.lit(7)),
        edit(6, "create", new_id=F.lit(1000), parent_id=F.lit(1), place=F.lit(0), title=F.lit(" Glossary "), section_type=F.lit("fr"), markdown=F.lit("See page 2.")),
        edit(7, "split", id=F.lit(3), heading=F.concat(F.lit("3. part "), F.pmod(F.col("doc_id") + 3, F.lit(7)).cast("string")), new_id=F.lit(2003)),
        edit(8, "rename", id=F.lit(2), title=F.lit("  ")),
        edit(9, "move", id=F.lit(2), parent_id=F.lit(3)),
    )
    return one.select("doc_id", F.explode(log).alias("e")).select("doc_id", "e.*")


def numbered_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, page_start, page_end, lft, rgt): :func:`outline` with its numbers; sections over others span them, every fifth runs into the next page."""
    s = outline(spark, sf_dir).select("doc_id", "id", "n_pages", "page_start", "page_end")
    over = (F.col("id") % 4 == 3) & (F.col("id") < F.col("n_pages"))
    level = F.when(F.col("id") == 1, 1).when(F.col("id") % 4 == 0, 3).otherwise(2)
    size = F.when(F.col("id") == 1, F.col("n_pages")).when(over, 2).otherwise(1)
    end = F.when((F.col("id") > 1) & (over | (F.col("id") % 5 == 0)), F.least(F.col("id") + 1, F.col("n_pages"))).otherwise(F.col("page_end"))
    lft = 2 * F.col("id") - level
    return s.select("doc_id", "id", "page_start", end.alias("page_end"), lft.alias("lft"), (lft + 2 * size - 1).alias("rgt"))


def raw_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): a parser's JSON for every document. Every third page has blocks, others markdown, some of it under another name; every tenth document's JSON is cut off."""
    p = pages(spark, sf_dir).withColumn("k", F.col("doc_id") + F.col("page_no"))
    line = F.get(F.split("body", "\n", -1), F.lit(0))
    null = F.lit(None)

    def block(kind: Column, level: Column, text: Column, markdown: Column, bbox: Column, id_: Column) -> Column:
        return F.struct(kind.cast("string").alias("type"), level.cast("int").alias("level"), text.cast("string").alias("text"), markdown.cast("string").alias("markdown"), bbox.cast("array<double>").alias("bbox"), id_.cast("string").alias("id"))

    given = F.array(block(F.lit("heading"), F.lit(2), F.concat(F.lit("Part "), F.col("k").cast("string")), null, F.array(F.lit(0.0), F.lit(1.0)), F.lit("h")), block(null, null, null, F.concat(F.lit("**"), line, F.lit("**")), null, null), block(F.lit("table"), null, null, F.lit("| A | B |\n| 1 | 2 |"), F.array(F.lit(2.5)), null))
    page = F.struct(
        F.when(F.col("k") % 4 != 0, F.col("page_no")).alias("page_number"), F.when(F.col("k") % 3 == 0, given).alias("blocks"),
        F.when((F.col("k") % 3 != 0) & (F.col("k") % 2 == 0), F.col("md")).alias("markdown"), F.when((F.col("k") % 3 != 0) & (F.col("k") % 2 == 1), F.col("md")).alias("text"),
    )
    whole = p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    raw = F.to_json(F.struct(F.lit("plain").alias("provider"), "pages", F.array(F.struct(F.lit("slow").alias("code"), F.lit("took long").alias("message"))).alias("warnings")))
    return whole.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.left(raw, F.length(raw) - 2)).otherwise(raw).alias("raw"))


def figure_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, images): pages with two placeholders each, or none, and up to two large images and a small one."""
    p = pages(spark, sf_dir).withColumn("k", F.col("doc_id") + F.col("page_no"))
    first, second = "**==> picture [12 x 34] intentionally omitted <==**", "==> picture [5 x 6] intentionally omitted <=="
    read = F.when(F.col("k") % 3 == 0, "\n---- Start of picture text ----").otherwise("")
    text = F.concat("body", F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit(f"\n{first}\n{'x' * 220}\n{second}"), read)))
    kind = F.when(F.col("k") % 7 == 0, "visual").otherwise("text")
    own = p.select("doc_id", "page_no", "k", kind.alias("kind"), F.col("body").alias("source"), text.alias("markdown"))
    some = own.select("doc_id", "page_no", "k", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("i"))
    url = F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("page_no").cast("string"), F.col("i").cast("string"))
    images = some.select("doc_id", "page_no", F.col("i").alias("xref"), F.col("i").alias("ordinal"), F.when(F.col("i") == 0, 10).otherwise(500).alias("width"), F.lit(400).alias("height"), url.alias("url"))
    return own, images.unionByName(images.where("xref = 1").withColumn("ordinal", F.col("ordinal") + 5))


def capital_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, markdown): documents with their first lines in capitals, tables at the end of some; as markdown, half of the headings are marked."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = F.translate(F.substring_index("text", " ", 3), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    tail = F.when(F.col("doc_id") % 4 == 0, "\naa  bb  cc\ndd  ee  ff\ngg  hh  ii").when(F.col("doc_id") % 4 == 1, "\nRevision Description Issue\n1/2020\n2/2021 3/2022").otherwise("")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), first)).otherwise(first)
    rows = F.when(F.col("doc_id") % 8 == 0, "\n| a | b |").otherwise("")
    return d.select("doc_id", F.concat(first, F.lit("\nSECOND HEADING\n"), "text", tail).alias("source"), F.concat(marked, F.lit("\n"), "text", rows).alias("markdown"))


def parser_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requested, results, runs): three runs over the pages of documents; one parser is missing for some, one fails on some."""
    p = pages(spark, sf_dir).select("doc_id", "page_no", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("r"))
    profile = F.concat(F.lit("run"), F.col("r").cast("string"))
    k = (F.col("doc_id") + F.col("page_no")) * F.col("r")
    error = F.when((F.col("r") == 3) & (F.col("doc_id") % 7 == 0) & (F.col("page_no") == 1), "timed out")
    results = p.where("r <> 2 or doc_id % 5 <> 0").select("doc_id", profile.alias("profile"), "page_no", F.when(k % 11 != 0, (k % 30) / 100.0).alias("recall"), error.alias("error"))
    requested = p.where("page_no = 1").select("doc_id", profile.alias("profile"), ((F.col("r") != 2) | (F.col("doc_id") % 5 != 0)).alias("available"))
    runs = spark.range(1, 4).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run_id"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7) % 5).alias("started_at"))
    return requested, results, runs
