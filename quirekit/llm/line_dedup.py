"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Equal sets are one class, kept at its first place. Classes are joined
on the prefixes of their words in order of rarity; pairs are bounded by length, by the places of the
shared word in both prefixes, and by sketches of the whole sets: each word flips one of 128 bits, so
two sketches differ in at most as many bits as the sets differ in words. Jaccard similarity is verified
on the whole sets. A line goes if an earlier line has a similarity of 0.8 or more.

A group of near copies would make as many pairs as the square of its size. So no pair is ever made:
both joins are semi-joins, which end a row's search at its first partner. The first one, on narrow
rows, leaves the prefix words at which a class has some partner within the bounds, in either order;
only these classes get their whole sets, read again from the texts, for the second one, which asks for
an earlier similar class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import discard, lower_ascii, store
from quirekit.llm.postings import bitmap, bitmap_bits, bucket, in_bitmap, in_own_prefixes, near_in_size, positions_allow, prefix_size, sketch_allows

#: Bits of a bucket's number in the rarity table, which has a byte for each bucket: 256 KB.
BUCKET_BITS = 18
#: Bits of a key that tell rarity, in half powers of two of the count; the others are of the word's hash.
LEVEL_BITS = 6
#: The longs of a sketch.
SKETCHES = ["s0", "s1"]
SPACES = r"[\x20\x09-\x0D]+"
SPACES_BUT_BLANKS = r"[\x09-\x0D]"
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
SOME_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased, and perhaps empty strings.

    Where nothing but ASCII is upper case, lower() does just that at less cost; where all white space
    is blanks, they are cut one by one, without a regular expression.
    """
    other = (F.octet_length(text) != F.char_length(text)) & text.rlike(OTHER_UPPER)
    low = F.when(other, lower_ascii(text)).otherwise(F.lower(text))
    return F.when(text.rlike(SPACES_BUT_BLANKS), F.split(low, SPACES)).otherwise(F.split(low, " "))


def rarity(docs: DataFrame) -> DataFrame:
    """(place, levels): the buckets' levels of frequency, eight in each long, for every place."""
    texts = docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    met = texts.select(F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''").groupBy(bucket(F.xxhash64("word"), 1 << BUCKET_BITS).alias("bucket")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(F.log2("n") * 2), F.lit((1 << LEVEL_BITS) - 1)).cast("long").alias("level")
    packed = met.select(F.shiftright("bucket", 3).alias("place"), (F.col("bucket").bitwiseAND(F.lit(7)) * 8).alias("at"), level)
    blank = docs.sparkSession.range(1 << (BUCKET_BITS - 3)).select(F.col("id").cast("int").alias("place"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("level"))
    return store(packed.unionByName(blank).groupBy("place").agg(F.expr("bit_or(shiftleft(level, at))").alias("levels")), "rarity")


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, mark, line_no from 0, line) of lines that have a word."""
    every = docs.select("id", "mark", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return every.where(F.col("line").rlike(SOME_WORD))


def keyed(lines: DataFrame, order: DataFrame) -> DataFrame:
    """Adds keys (the line's distinct words, rare ones first) and k, k2, which tell sets apart."""
    # a long for each bucket, its level in the highest bits: little is left to do for each word
    level = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
    high = lambda x: F.array(*[F.shiftleft(level(x, i) - (1 << (LEVEL_BITS - 1)), 64 - LEVEL_BITS) for i in range(8)])
    table = order.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "levels"))), lambda s: high(s["levels"])))).scalar()

    def key(h: Column) -> Column:
        return F.get("_levels", bucket(h, 1 << BUCKET_BITS)).bitwiseOR(F.shiftrightunsigned(h, LEVEL_BITS))

    # the table is a column as a lambda may not have a subquery; the optimizer puts it into the lambda, so no row holds it
    hashes = F.transform(F.array_remove(words_of(F.col("line")), ""), lambda w: F.xxhash64(w))
    found = lines.withColumn("_levels", table).withColumn("keys", F.sort_array(F.transform(F.array_distinct(hashes), key))).drop("line", "_levels")
    return found.withColumn("k", F.xxhash64("keys")).withColumn("k2", F.xxhash64(F.lit(1), "keys"))


def sketch(keys: Column, i: int) -> Column:
    """The ith long of a set's sketch: of the words whose key names this long, each flips the bit that its key names."""
    own = lambda x: F.shiftright(x if i else F.bitwise_not(x), 6).bitwiseAND(F.lit(1))
    flip = lambda x: F.call_function("shiftleft", own(x), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(flip(x)))


def within_bounds(a: str, b: str) -> Column:
    """Whether the sets of two postings of one word can have Jaccard 0.8: length, position and sketch."""
    return near_in_size(F.col(f"{a}.n"), F.col(f"{b}.n")) & in_own_prefixes(a, b) & positions_allow(a, b) & sketch_allows(a, b, SKETCHES)


def kept_lines(docs: DataFrame) -> DataFrame:
    """(id, mark, kept): the numbers of the lines with words that stay. docs: id, mark, text."""
    order = rarity(docs)
    n = F.size("keys")
    place = F.struct("id", "mark", "line_no")
    found = keyed(lines_of(docs), order)
    found = found.select("k", "k2", place.alias("at"), n.alias("n"), F.slice("keys", F.lit(1), prefix_size(n)).alias("prefix"), *[sketch(F.col("keys"), i).alias(s) for i, s in enumerate(SKETCHES)])
    classes = found.groupBy("k", "k2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("n", "prefix", *SKETCHES)])
    classes = store(classes, "lines")

    # the words of the prefixes at which a class has a partner within the bounds
    posted = classes.select("k", "n", *SKETCHES, F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    met = posted.alias("x").join(posted.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.k") != F.col("y.k")) & within_bounds("x", "y"), "left_semi")
    met = store(met.select("k", "n", *SKETCHES, "pos", "token"), "met")

    # their classes' whole sets, from the texts, and the search for an earlier similar one; a further line of
    # a class that the bitmap lets through is a later place of an equal set, which changes nothing
    wanted = store(classes.join(met.select("k"), "k", "left_semi").select("at"), "wanted")
    bits = bitmap_bits(wanted.count())
    places = bitmap(wanted.select(F.xxhash64("at.id", "at.mark", "at.line_no").alias("line")), "line", bits)
    sets = keyed(lines_of(docs).where(in_bitmap(F.xxhash64("id", "mark", "line_no"), places, bits)), order)
    full = met.join(sets.select("k", place.alias("at"), "keys"), "k").select("token", "pos", "n", *SKETCHES, "at", "keys")
    similar = F.size(F.array_intersect("x.keys", "y.keys")) * 9 >= (F.col("x.n") + F.col("y.n")) * 4
    gone = full.alias("x").join(full.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("y.at") < F.col("x.at")) & within_bounds("x", "y") & similar, "left_semi")
    gone = store(gone.select("at").distinct(), "gone")
    discard(met)

    stay = classes.select("at").join(gone, "at", "left_anti")
    return stay.groupBy(F.col("at.id").alias("id"), F.col("at.mark").alias("mark")).agg(F.collect_list("at.line_no").alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, its text without repeated lines, and n_lines, n_removed, kept (line numbers).

    Lines end at \\n; words are what ASCII white space separates, A-Z lower-cased. Lines come in the
    order of id (null first), a hash of the text for rows of one id, and line number; a line goes if
    any earlier one is similar, whether or not that one stays. Lines without words always stay. A
    null text stays null with 0 lines; an empty text is one line without words. A document may lose
    all its lines: its text is then empty. Repeated rows (same id and text) are one document and stay
    alike. Columns of ``docs`` named like the new ones are replaced; an empty table gives no rows.
    """
    new = ["n_lines", "n_removed", "kept"]
    rows = docs.drop(*(c for c in new if c in docs.columns)).withColumn("_mark", F.xxhash64(text_col))
    lines = F.split(text_col, "\n", -1)
    blank = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(SOME_WORD), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    rows = rows.withColumn("_blank", F.coalesce(blank, F.array().cast("array<int>"))).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    stay = kept_lines(plain)
    # documents that lose a line, by narrow rows; only their texts are shuffled
    with_words = rows.select(F.col(id_col).alias("_id"), F.col("_mark").alias("_m"), (F.col("n_lines") - F.size("_blank")).alias("_n")).where("_n > 0").distinct()
    lost = with_words.join(stay, with_words["_id"].eqNullSafe(stay["id"]) & (with_words["_m"] == stay["mark"]), "left")
    lost = lost.withColumn("_kept", F.coalesce("kept", F.array().cast("array<int>"))).where(F.size("_kept") < F.col("_n"))
    lost = store(lost.select("_id", "_m", "_kept"), "lost")
    bits = bitmap_bits(lost.count())
    touched = in_bitmap(F.xxhash64(id_col, "_mark"), bitmap(lost.select(F.xxhash64("_id", "_m").alias("doc")), "doc", bits), bits)
    every = F.when(F.col("n_lines") > 0, F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    whole = rows.where(~touched).withColumn("kept", every)
    some = rows.where(touched).join(lost, rows[id_col].eqNullSafe(lost["_id"]) & (rows["_mark"] == lost["_m"]), "left")
    some = some.withColumn("kept", F.when(F.col("_kept").isNull(), every).otherwise(F.array_sort(F.concat("_kept", "_blank"))))
    some = some.withColumn("_lines", lines).withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(F.transform("kept", lambda i: F.get("_lines", i)), "\n")))
    names = [c for c in rows.columns if c not in ("_mark", "_blank", "n_lines")]
    removed = (F.col("n_lines") - F.size("kept")).alias("n_removed")
    return some.select(*names, "n_lines", removed, "kept").unionByName(whole.select(*names, "n_lines", removed, "kept"))
