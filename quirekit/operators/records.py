"""Tables of records: exploration by type, upserts, integrity, logs, costs and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirekit.functions import text as T


def is_set(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def scoped(sections: DataFrame, documents: DataFrame, project=None, doc_id=None) -> DataFrame:
    """Sections of one document, else of a project's documents, else all. A project without documents has none."""
    if doc_id is not None:
        return sections.where(F.col("doc_id") == doc_id)
    if project is not None:
        return sections.join(documents.where(F.col("project_id") == project).select("doc_id"), "doc_id", "left_semi")
    return sections


def type_counts(sections: DataFrame) -> DataFrame:
    """(section_type, n); null and '' are one key, null."""
    return sections.groupBy(F.nullif("section_type", F.lit("")).alias("section_type")).agg(F.count("*").alias("n"))


def type_summary(sections: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(ord, type_name, label, n) in the order of the taxonomy (others last), zeros filled, untagged at the end if there are any."""
    counts = type_counts(sections)
    listed = taxonomy.join(counts, taxonomy["type_name"] == counts["section_type"], "left").select("ord", "type_name", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    untagged = counts.where("section_type is null").select(F.lit(1_000_000).alias("ord"), F.lit(None).cast("string").alias("type_name"), F.lit("Untagged").alias("label"), "n")
    return listed.unionByName(untagged)


def by_document(sections: DataFrame, documents: DataFrame, section_type: str | None, needle: str | None = None) -> DataFrame:
    """(title, doc_id, n, ids): sections of a type (None: untagged) grouped by document; the id stands in for a missing title."""
    kind = F.nullif("section_type", F.lit(""))
    some = sections.where(kind.isNull() if section_type is None else kind == section_type)
    if needle:
        some = some.where(F.lower("title").contains(needle.lower()) | F.lower("path").contains(needle.lower()))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("lft", "id"))), lambda r: r["id"].cast("string"))
    grouped = some.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))
    titled = grouped.join(documents.select("doc_id", F.col("title").alias("t")), "doc_id", "left")
    return titled.select(F.coalesce(F.nullif("t", F.lit("")), F.col("doc_id").cast("string")).alias("title"), "doc_id", "n", "ids")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """The next snapshot: new rows replace old ones of the same keys but keep their creation time; other old rows stay."""
    columns = [c for c in new.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_o"))
    n = new.withColumn("_n", F.lit(True))
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o_{c}")).when(F.lit(c == created) & F.col("_o").isNotNull(), F.coalesce(f"_o_{c}", c)).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *[pick(c) for c in columns])


def replaced(old: DataFrame, new: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """All rows of the owners are replaced by the new ones: edges of changed sections, trees of changed documents."""
    return old.join(owners.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def per_owner_limit(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every key, numbered from 1: worst pages, oldest messages, recent sessions."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def systematic(pages: DataFrame, k: int) -> DataFrame:
    """Every max(1, n // k)-th page of a document of n pages, from its first."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return pages.join(n, "doc_id").where(F.pmod(F.col("page_no") - 1, F.greatest(F.lit(1), F.expr(f"_n div {k}"))) == 0).drop("_n")


def missing(wanted: DataFrame, have: DataFrame, on: list[str]) -> DataFrame:
    """Keys that are wanted and not there: dangling references, stale pages, ids not found."""
    return wanted.select(*on).distinct().join(have.select(*on).distinct(), on, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def same_labels(types: DataFrame) -> DataFrame:
    """(name, survivor): types whose labels are the same but for case and spaces; names not made by the system ('t_') win, then the oldest."""
    keyed = types.withColumn("key", T.label_key(F.col("label")))
    first = keyed.groupBy("key").agg(F.min_by("name", F.struct(F.col("name").startswith("t_"), "created", "name")).alias("survivor"))
    return keyed.join(first, "key").where(F.col("name") != F.col("survivor")).select("name", "survivor")


def costs(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, cost (unknown ones as 0), whether all costs are known, and the cost without judging."""
    cost = F.coalesce("cost", F.lit(0.0))
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("cost_known"), F.sum(F.when(F.col("label") != "judge", cost).otherwise(0.0)).alias("parse_cost"))


def invalid_steps(history: DataFrame, allowed: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Status changes that are not among the allowed pairs (src, dst)."""
    steps = history.withColumn("src", F.lag("status").over(Window.partitionBy(*keys).orderBy(*order))).where("src is not null").withColumn("dst", F.col("status"))
    return steps.join(F.broadcast(allowed), ["src", "dst"], "left_anti")


def folded_messages(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (seq, text) of a message put together in order."""
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "").alias("text"), F.count("*").alias("chunks"))


def distinct_in_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The different values of every key in the order in which they first came, joined by commas."""
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda r: r[value]), ",").alias("layers"))


def nonblank(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_of(*values: Column) -> Column:
    """The first value that is set: explicit, project, site, built-in."""
    return F.coalesce(*[nonblank(v) for v in values])


def valid_label(label: Column, allowed: list[str], other: str = "other") -> Column:
    """A classifier's label, trimmed and in lower case, or ``other`` if it is missing or not allowed."""
    plain = F.lower(F.trim(label))
    return F.when(plain.isin(allowed), plain).otherwise(F.lit(other))


def sync_state(page: Column, included: Column, current: Column, written: Column) -> Column:
    """What keeps a section's page from being in step: excluded, no_page, needs_regenerate; null if nothing does."""
    return F.when(~included, "excluded").when(page.isNull(), "no_page").when(F.trim(F.coalesce(current, F.lit(""))) != F.trim(F.coalesce(written, F.lit(""))), "needs_regenerate")


def top_recent(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k rows that come first; Spark keeps k rows a task on the way."""
    return rows.orderBy(*order).limit(k)


def types_present(nodes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(ord, type_name, label, n): the types of the taxonomy that some node has."""
    some = type_counts(nodes).where("section_type is not null")
    return taxonomy.join(some, taxonomy["type_name"] == some["section_type"]).select("ord", "type_name", "label", "n")


def reviewed(pages: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """``pages`` with status and notes of their reviews; a page without one is 'unreviewed'. Reviews are unique by ``keys``."""
    own = reviews.select(*keys, F.nullif("status", F.lit("")).alias("status"), "notes")
    blank = {"status": "unreviewed", "notes": ""}
    return pages.join(own, keys, "left").fillna(blank)


def big_images(images: DataFrame, keys: list[str], least: int = 200_000) -> DataFrame:
    """(keys, xref, ordinal): images of at least that many pixels, each xref once, at its first place."""
    big = images.where(F.col("width") * F.col("height") >= least)
    return big.groupBy(*keys, "xref").agg(F.min("ordinal").alias("ordinal"))


def of_page(warnings: DataFrame, page: int) -> DataFrame:
    """Warnings of a page and those of the whole document (null page)."""
    return warnings.where(F.col("page_no").isNull() | (F.col("page_no") == page))


def hybrid_parts(local: DataFrame, cloud: DataFrame, accepted: DataFrame, generated: DataFrame) -> DataFrame:
    """Assets or warnings of a hybrid run: local ones of pages that were not replaced, all of the cloud run, and the run's own.

    Local rows without a page stay.
    """
    kept = local.join(accepted.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    return kept.select(cloud.columns).unionByName(cloud).unionByName(generated)
