"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window of a benchmark item (13 consecutive words, or a whole shorter item) is contained in a
document exactly where all its shingles are. Shingles are ordered by rarity in the corpus; full
containment needs every shingle, so the necessary prefix is the single rarest one. Documents are
joined to windows on that shingle, the place of the shingle in the window gives where the window
would begin, bounds of position and length discard what cannot fit, and the words themselves are
compared over the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import lower_ascii, store

#: Letters and digits of ASCII and everything beyond ASCII make words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4
#: Windows broadcast at once. A window is at most 13 words; a larger benchmark is joined in several blocks.
BLOCK = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; null where there are fewer words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: words, span (their number), items (sorted ids as strings)."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(window))
    cut = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - span + 1), lambda i: F.slice("w", i, span))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("span", F.size("words")).withColumn("window", F.xxhash64("words"))


def find(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, window: int, block: int) -> DataFrame:
    """Occurrences: id, fingerprint of the text, start (from 0), span, items."""
    table = store(windows_of(items, item_id_col, item_text_col, window), "windows")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words_of(F.col(text_col)).alias("w"))
    found = None
    sizes = sorted(r["k"] for r in table.select(F.least("span", F.lit(SHINGLE)).alias("k")).distinct().collect())
    for k in sizes:
        some = table.where(F.least("span", F.lit(SHINGLE)) == k)
        blocks = max(1, -(-some.count() // block))
        # outer explodes: for inner ones Spark infers a filter that would work the shingles out twice
        read = base.withColumn("s", shingles(F.col("w"), k))
        for b in range(blocks):
            part = some.where(F.pmod("window", F.lit(blocks)) == b)
            inside = part.select("window", F.posexplode(shingles(F.col("words"), k)).alias("offset", "shingle"))
            # how often each of the benchmark's shingles occurs in all documents
            met = read.select(F.explode_outer("s").alias("shingle")).join(F.broadcast(inside.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
            rarest = inside.join(met, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "shingle", "offset")).alias("a"))
            # a shingle that no document has rules its window out
            anchors = store(rarest.where("a.col1 > 0").select("window", "a.shingle", "a.offset").join(part, "window").select("shingle", "offset", "words", "span", "items"), "anchors")
            placed = read.select("id", "mark", "w", F.posexplode_outer("s").alias("at", "shingle")).join(F.broadcast(anchors), "shingle")
            fits = placed.where((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("span") <= F.size("w")))
            same = fits.where(F.slice("w", F.col("at") - F.col("offset") + 1, F.col("span")) == F.col("words"))
            hits = same.select("id", "mark", (F.col("at") - F.col("offset")).alias("start"), "span", "items")
            found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items, items (sorted ids), contaminated.

    A word is hit if it lies in any occurrence of a window; a document is contaminated if any word is
    hit and ``share`` times the hit words are at least all its words. Null or wordless texts have no
    words and no hits. Null item texts have no windows; an item without id counts under the empty id.
    Equal items or windows count once per item id. Rows are told apart by id and text, so repeated
    rows, repeated ids and null ids each keep their own row. Columns of ``docs`` named like the new
    ones are replaced; empty tables on either side give no hits.
    """
    new = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    rows = docs.drop(*(c for c in new if c in docs.columns)).withColumn("_mark", F.xxhash64(text_col))
    rows = rows.withColumn("n_words", F.coalesce(F.regexp_count(lower_ascii(F.col(text_col)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long"))
    found = find(docs, items, id_col, text_col, item_id_col, item_text_col, window, block)
    if found is None:
        none = F.lit(0).cast("long")
        return rows.drop("_mark").withColumns({"n_hit": none, "n_items": none, "items": F.array().cast("array<string>"), "contaminated": F.lit(False)})
    grouped = found.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "span")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["span"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["span"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hit = grouped.select(F.col("id").alias("_id"), F.col("mark").alias("_m"), covered.alias("n_hit"), "items")
    out = rows.join(hit, rows[id_col].eqNullSafe(hit["_id"]) & (rows["_mark"] == hit["_m"]), "left").drop("_id", "_m", "_mark")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.withColumns({"n_hit": n_hit, "items": found_items, "n_items": F.size(found_items).cast("long"), "contaminated": (n_hit > 0) & (n_hit * share >= F.col("n_words"))}).select(*[c for c in rows.columns if c not in ("_mark",)], "n_hit", "n_items", "items", "contaminated")
