"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected copies are the target shared by preference (one for all by
default): whole copies are certain, and the rest is the chance of one copy more. Documents are ranked by the odds of a
random number over the odds of that chance, and a source takes them in rising order until its target is met: samples of
a fixed size in words with unequal chances. Ranks are running totals over ranges of the order, so no task sees a whole
source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import SPACED_WORDS, store
from quirekit.llm.running import running_totals

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A source's documents meet the row of their source in so many parts.
SALTS = 32


def sized(docs: DataFrame, preference: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, preference), stored: size is the text's words between white space, null has none.

    A null or negative preference counts as 0: such documents are never taken.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORDS)), F.lit(0)).cast("long")
    liked = F.lit(1.0) if preference is None else F.greatest(F.coalesce(preference.cast("double"), F.lit(0.0)), F.lit(0.0))
    return store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), liked.alias("preference")), "mixing_sizes")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources by code point, null last, have the weights in turn and share the words of all; a target stops at ``most``
    times its source's size, and what is over is shared again by weight among those below, until none is above. A
    source without words has target 0. source_start is the number of words of earlier sources.
    """
    sums = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long")), "mixing_sources")
    placed = running_totals(sums, [F.col("source").asc_nulls_last()], "_one", "mixing_places")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    found = placed.select("source", "source_size", weight.alias("_weight"), F.lit(most * F.col("source_size")).alias("_cap"), F.lit(False).alias("_full"))
    while True:  # each round fills one source more at least; as the shares only grow, few rounds do
        now = found.agg(F.sum(F.when(F.col("_full"), F.col("_cap"))).alias("used"), F.sum(F.when(~F.col("_full"), F.col("_weight"))).alias("weights")).first()
        left, shared = total - (now["used"] or 0), now["weights"] or 1
        share = F.lit(float(left)) * F.col("_weight") / F.lit(float(shared))
        over = ~F.col("_full") & (share > F.col("_cap"))
        if not found.where(over).limit(1).count():
            break
        found = store(found.withColumn("_full", F.col("_full") | over), "mixing_filled")
    return found.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def _met(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """Documents with the columns of their source; the documents of one source are in ``SALTS`` parts."""
    salted = per_source.withColumnRenamed("source", "_source").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = sizes.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return parts.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_part"))).drop("_source", "_part", "_salt")


def _expected(most: int) -> tuple[Column, Column, Column]:
    """A document's expected copies, the certain ones, and the chance of one more."""
    copies = F.least(F.col("level") * F.col("preference"), F.lit(float(most)))
    return copies, F.floor(copies), copies - F.floor(copies)


def _levels(sizes: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """Per source, ``level``: expected copies for each unit of preference, so that with the cap on copies the words meet the target.

    Also ``rest``, what certain copies leave of the target, and ``open_words``, the words of documents with a chance of
    one copy more. Levels rise each round, until no document goes over the cap by one.
    """
    copies, certain, chance = _expected(most)
    full = F.col("level") * F.col("preference") >= most
    found = goal.withColumn("level", F.lit(0.0))
    while True:
        sums = _met(sizes, found).groupBy("source").agg(
            F.sum(F.when(full, most * F.col("size")).otherwise(0)).alias("_full"),
            F.sum(F.when(~full, F.col("preference") * F.col("size")).otherwise(0.0)).alias("_open"),
            F.sum(certain * F.col("size")).alias("_certain"),
            F.sum(F.when(chance > 0, F.col("size")).otherwise(0)).alias("open_words"),
        )
        level = F.when(F.col("_open") > 0, (F.col("target") - F.col("_full")) / F.col("_open")).otherwise(F.col("level"))
        joined = found.join(sums.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        found = store(joined.withColumn("_next", level), "mixing_levels")
        if not found.where(F.col("_next") > F.col("level") * (1 + 1e-12)).limit(1).count():
            return found.select(*goal.columns, "level", (F.col("target") - F.col("_certain")).alias("rest"), "open_words")
        found = found.select(*goal.columns, F.greatest("_next", "level").alias("level"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, preference: Column | None = None, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target (its source's), copies, taken (copies times size).

    ``docs`` has doc_id, text and source; further columns are ignored but in ``preference``, which scales a document's
    expected copies against others of its source. No document has more than ``most`` copies. The words taken of a
    source miss its target by at most half a document, unless preferences of 0 leave too little. A null source is a
    source; null and empty texts have size 0 and are taken 0 times or more with no words. Random numbers come from the
    seed and the id (null: one id), ties go by id, size and row; repeated rows are documents of their own. Reruns agree.
    No rows, no result.
    """
    sizes = sized(docs, preference)
    levels = _levels(sizes, targets(sizes, weights, most), most)
    starts = running_totals(levels, [F.col("source").asc_nulls_last()], "open_words", "mixing_starts").withColumnRenamed("before", "_start")
    _, certain, chance = _expected(most)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = u / (1 - u) / (F.col("chance") / (1 - F.col("chance")))
    ranked = (
        _met(sizes, starts)
        .withColumns({"certain": certain.cast("long"), "chance": chance})
        .withColumns({"_rank": F.when(F.col("chance") > 0, odds), "_open": F.when(F.col("chance") > 0, F.col("size")).otherwise(0)})
    )
    order = [F.col("source").asc_nulls_last(), F.col("_rank").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size").asc(), F.col("row").asc()]
    placed = running_totals(store(ranked, "mixing_odds"), order, "_open", "mixing_ranks")
    drawn = (F.col("chance") > 0) & (2 * (F.col("before") - F.col("_start")) + F.col("size") <= 2 * F.col("rest"))
    copies = F.col("certain") + drawn.cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
