"""Parts of exact set-similarity joins: rarity order, prefix postings, shared tokens.

A token is a 64-bit hash. Rarity is how often hashes of one bucket (the same lowest bits) occur in all
documents: a table of fixed size, however many documents there are. A key puts the rank of a bucket
above the rest of the hash, so sorting keys puts rare tokens first. Any one order of all tokens makes
the prefix filter exact; rarity makes it cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import store

BUCKETS = 1 << 16
#: Least and most bits of a bitmap's places (it has two to that power): 8 KB and 16 MB. A fuller bitmap prunes less, but loses nothing.
LEAST_BITS, MOST_BITS = 16, 27
#: Bits of a bitmap whose number of values isn't known.
BITMAP_BITS = 24


def ranks(bucket_counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """From rows (bucket, n), one for each bucket at most, the rank of every bucket, from -buckets/2 (rarest) up."""
    counts = dict.fromkeys(range(buckets), 0) | {r["bucket"]: r["n"] for r in bucket_counts.collect()}
    out = [0] * buckets
    for rank, bucket in enumerate(sorted(counts, key=lambda b: (counts[b], b))):
        out[bucket] = rank - buckets // 2
    return out


def bucket(hash_: Column, buckets: int) -> Column:
    return hash_.bitwiseAND(F.lit(buckets - 1)).cast("int")


def key_of(ranked: Column, token: Column, ranks_: list[int]) -> Column:
    """A sortable key: the rank of the bucket of ``ranked`` above the high bits of the hash ``token``."""
    bits = len(ranks_).bit_length() - 1
    table = F.expr(f"cast(split('{','.join(map(str, ranks_))}', ',') as array<bigint>)")  # folded to one literal
    return F.shiftleft(F.get(table, bucket(ranked, len(ranks_))), 64 - bits).bitwiseOR(F.shiftrightunsigned(token, bits))


def prefix_size(n: Column) -> Column:
    """How many of n ordered tokens must hold one of any set of Jaccard 0.8 or more: n - ceil(0.8 n) + 1."""
    return (F.floor(n / 5) + 1).cast("int")


def bitmap_bits(values: int) -> int:
    """The bits of a bitmap over so many values: 16 places or more for each, as long as that is allowed."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * values).bit_length()))


def bitmap(df: DataFrame, value: str, bits: int = BITMAP_BITS) -> Column:
    """A scalar column: a Bloom filter of two hash functions over ``value`` (a 64-bit hash), as an array of longs."""
    places = F.explode(F.array(*_places(F.col(value), bits))).alias("place")
    words = df.select(places).select(F.shiftright("place", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    blank = df.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = words.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("m")).scalar()


def _places(value: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1)
    return [value.bitwiseAND(mask), F.shiftrightunsigned(value, 32).bitwiseAND(mask)]


def in_bitmap(value: Column, bits_: Column, bits: int = BITMAP_BITS) -> Column:
    one, other = (F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get(bits_, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int"))) == 1 for p in _places(value, bits))
    return one & other


def shared(sets: DataFrame, carried: list[str]) -> DataFrame:
    """Postings (carried columns, pos from 1, token) of the tokens in the prefixes of at least two sets, and of a few more (the filter's false positives).

    ``sets`` has a long column ``k`` that tells sets apart and ``prefix``, ordered keys. The first
    shuffle takes only token and k, pre-aggregated, so a token of many sets is one row per task; later
    steps get only postings whose token is in the bitmap of shared ones.
    """
    spread = sets.select("k", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    tokens = store(spread.where("lo < hi").select(F.xxhash64("token").alias("mix")), "tokens")
    posted = sets.select(*carried, F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    return posted.where(in_bitmap(F.xxhash64("token"), bitmap(tokens, "mix")))


def overlap_needed(n: Column, m: Column) -> Column:
    """Common tokens that sets of n and m tokens need for Jaccard 0.8: ceil(4 (n + m) / 9)."""
    return F.ceil((n + m) * 4 / 9)


def near_in_size(n: Column, m: Column) -> Column:
    """The length bound for Jaccard 0.8."""
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


def common_needed(n: Column, last: Column, m: Column, other_last: Column) -> Column:
    """How many tokens the prefixes of two sets must have in common: the positional bound.

    ``last`` is the last key of a prefix. Any further common token comes after the prefix that ends
    first, so there are at most as many as that set has tokens beyond its prefix.
    """
    own, other = n - prefix_size(n), m - prefix_size(m)
    beyond = F.when(last < other_last, own).when(last > other_last, other).otherwise(F.least(own, other))
    return overlap_needed(n, m) - beyond


def sketch_allows(a: str, b: str, names: list[str]) -> Column:
    """Whether two sets can have Jaccard 0.8 by their sketches, in which each token flips one bit: they differ in at most as many bits as the sets in tokens."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in names), F.lit(0))
    return differ <= n + m - overlap_needed(n, m) * 2


def positions_allow(a: str, b: str) -> Column:
    """Whether two sets that share a token, at pos (from 1) of their ordered tokens, can have Jaccard 0.8: what is before and after in both must do."""
    n, m, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (a, b))
    return F.least(i, j) + F.least(n - i, m - j) >= overlap_needed(n, m)


def in_own_prefixes(a: str, b: str) -> Column:
    """Whether the place of a shared token is in the prefixes that this pair's sizes call for: sets with Jaccard 0.8 share a token there."""
    n, m, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (a, b))
    need = overlap_needed(n, m)
    return (i <= n - need + 1) & (j <= m - need + 1)
