"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct five-word shingles, ordered by one global order (rarity). Sets
that can reach a Jaccard similarity of 0.8 share a token of their prefixes in that order, which
brings candidates together. Their whole sets are then stored as paths of a trie, from the most
common token to the rarest, so that copies share long paths: the probing set walks it once, paths
that share a beginning share the overlap counted so far, and a subtree is left as soon as the overlap
and what can still come on either side fall short of what is needed.

Postings carry a sketch of the whole set, in which each token flips one of 512 bits: sets differ in at
least as many tokens as their sketches in bits. A semi-join drops all postings without any partner
within the bounds of length, position and sketch, so what shares a passage only makes no pairs.

A group of n near copies has n^2 links, but their component needs n - 1. Every set is first
compared with the first set of each token it shares; sets that this connects are never compared
again. If that would leave many pairs, sets outside a token's largest component are compared with a
few sets of it, which share the largest parts of themselves. At last all pairs across components that
share a token are compared, within the bounds, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import discard, slices, store
from quirekit.llm.components import components
from quirekit.llm.postings import BUCKETS, bitmap, common_needed, in_bitmap, near_in_size, positions_allow, ranks, shared, sketch_allows

GRAM = 5
#: Member sets in one trie; larger groups are cut into several, each with its own copy of the probing set.
TRIE = 512
#: Sets of a task that make a token frequent, tokens looked at together, and frequent tokens kept (16 bytes each).
SEEN, HELD, FREQUENT = 3, 2_000_000, 500_000
#: The longs of a sketch.
SKETCHES = [f"s{i}" for i in range(8)]
#: Turns with a few sets of each largest component, how many, and the pairs a posting that are compared at once without them.
LEADERS, LOTS, EASY = 1, 3, 4
#: Word hashes that a task remembers before it starts anew.
REMEMBERED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, known: Words, n: int = GRAM) -> np.ndarray:
    """Hashes (uint64, distinct, sorted) of the n-word shingles; a shorter text is one shingle, an empty one none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for j in range(size):  # a chain of multiply and rotate, so that order counts
        h = (h ^ w[j : len(w) - size + 1 + j]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Order:
    """The global order of tokens: by the rank of their bucket; frequent tokens, known one by one, after all others by their count."""

    def __init__(self, ranks_: np.ndarray, frequent: np.ndarray, counts: np.ndarray):
        self.ranks = (ranks_ >> 1) - BUCKETS // 4  # the lower half of 16 bits
        self.frequent, self.places = frequent, np.minimum(32767, (64 * np.log2(counts)).astype(np.int64))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Sortable keys (int64) of distinct sorted hashes, rare tokens first: the rank above the hash's other 48 bits."""
        rank = self.ranks[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            known = self.frequent[at] == hashes
            rank[known] = self.places[at[known]]
        return np.sort((rank << 48) | (hashes >> np.uint64(16)).astype(np.int64))


def trie_join(probe: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """The places of the members whose Jaccard similarity with ``probe`` is 0.8 or more.

    All are sorted key arrays. The trie is the sorted list of the reversed arrays: two neighbours
    share the path down to their first difference, with the overlaps counted along it.
    """
    paths = [m[::-1] for m in members]
    order = sorted(range(len(paths)), key=lambda i: (paths[i] ^ np.int64(-(2**63))).astype(">i8").tobytes())
    most = max((len(p) for p in paths), default=0)
    common, below = np.zeros(most + 1, dtype=np.int64), np.zeros(most, dtype=np.int64)
    last, valid, found = np.zeros(0, dtype=np.int64), 0, []
    for i in order:
        path = paths[i]
        n = len(path)
        need = -(-4 * (n + len(probe)) // 9)
        least = min(len(last), n, valid)
        differ = np.flatnonzero(last[:least] != path[:least])
        depth = int(differ[0]) if len(differ) else least
        left = n - np.arange(1, n + 1)
        reach = lambda a, b: common[a + 1 : b + 1] + np.minimum(left[a:b], below[a:b])  # noqa: E731, B023
        last, valid = path, depth
        if 5 * min(n, len(probe)) < 4 * max(n, len(probe)) or depth and (reach(0, depth) < need).any():
            continue
        while valid < n:  # walk down, leaving where the rest can't do
            to = min(n, valid + 256)
            tail = path[valid:to]
            at = np.searchsorted(probe, tail)
            hit = (at < len(probe)) & (probe[np.minimum(at, len(probe) - 1)] == tail) if len(probe) else np.zeros(len(tail), dtype=bool)
            common[valid + 1 : to + 1] = common[valid] + np.cumsum(hit)
            below[valid:to] = at
            start, valid = valid, to
            if (reach(start, to) < need).any():
                break
        else:
            if common[n] >= need:
                found.append(i)
    return found


def token_order(docs: DataFrame, n: int) -> Order:
    """The order of tokens by how many documents' sets hold them.

    Every token counts in its bucket. A task also sends the tokens that at least SEEN sets of some
    millions of its tokens hold, with their counts; of these the most frequent ones, FREQUENT at most,
    are known one by one. Both tables are of bounded size; they decide what is cheap, not what is found.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, held, size = Words(), np.zeros(BUCKETS, dtype=np.int64), [], 0

        def often():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= SEEN
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), -1, dtype=np.int32)), pa.array(found[some].astype(np.int64)), pa.array(times[some])], names=names)

        names = ["bucket", "token", "n"]
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                hashes = shingle_hashes(text, known, n)
                total += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                held.append(hashes)
                size += len(hashes)
                if size >= HELD:
                    yield often()
                    size = 0
        if held:
            yield often()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), dtype=np.int64)), pa.array(total[at])], names=names)

    met = store(docs.select("text").mapInArrow(counts, "bucket int, token long, n long").groupBy("bucket", "token").agg(F.sum("n").alias("n")), "counts")
    ranks_ = np.array(ranks(met.where("bucket >= 0").select("bucket", "n")), dtype=np.int64)
    tokens = met.where("bucket < 0")
    sizes = {r["k"]: r["count"] for r in tokens.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    least, room = 64, FREQUENT
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    kept = tokens.where(F.col("n") >= 2**least).select("token", "n").toArrow() if least < 64 else None
    hashes, times = (np.asarray(kept.column(c).combine_chunks()).astype(t) for c, t in (("token", np.uint64), ("n", np.int64))) if kept is not None else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    by_hash = np.argsort(hashes)
    return Order(ranks_, hashes[by_hash], times[by_hash])


def sketch(keys: np.ndarray) -> list[int]:
    """The longs of a set's sketch: each token flips one of the bits."""
    flips = np.bincount(keys & (64 * len(SKETCHES) - 1), minlength=64 * len(SKETCHES)) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def sets_of(docs: DataFrame, order: Order, n: int, id_kind: str) -> DataFrame:
    """(id, mark, n, k, k2, the sketch's longs, prefix) per row. k and k2 tell sets apart; prefix is null for a set that the task has met before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = Words(), set()
        for batch in slices(batches):
            sizes, k, k2, prefixes, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                keys = order.keys(shingle_hashes(text, known, n))
                digest = xxhash.xxh3_128_digest(keys.tobytes())
                sizes.append(len(keys))
                k.append(int.from_bytes(digest[:8], "big", signed=True))
                k2.append(int.from_bytes(digest[8:], "big", signed=True))
                sketches.append(sketch(keys))
                prefixes.append(None if digest in met or not len(keys) else keys[: len(keys) // 5 + 1])
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(k, pa.int64()), pa.array(k2, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*sketches)), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["id", "mark", "n", "k", "k2", *SKETCHES, "prefix"],
            )

    return docs.select("id", "mark", "text").mapInArrow(rows, f"id {id_kind}, mark long, n int, k long, k2 long, {', '.join(f'{x} long' for x in SKETCHES)}, prefix array<long>")


def verified(pairs: DataFrame, base: DataFrame, sets: DataFrame, order: Order, n: int) -> DataFrame:
    """The pairs (a, b: structs k, k2) that link. The texts of the sets are where ``sets`` says."""
    wanted = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    places = sets.select(F.struct("k", "k2").alias("s"), F.struct("id", "mark").alias("at")).join(wanted, "s", "left_semi")
    p = store(places.groupBy("s").agg(F.min("at").alias("at")), "wanted").alias("p")
    near = base.where(in_bitmap(F.xxhash64("id", "mark"), bitmap(p.select(F.xxhash64("at.id", "at.mark").alias("doc")), "doc"))).alias("d")
    texts = near.join(p, F.col("d.id").eqNullSafe(F.col("p.at.id")) & (F.col("d.mark") == F.col("p.at.mark"))).select("s", "text")
    texts = store(texts.groupBy("s").agg(F.first("text").alias("text")), "texts")
    many = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / TRIE)))
    members = dealt.join(texts.select(F.col("s").alias("b"), "text"), "b").select("a", "part", "b", "text")
    probes = dealt.select("a", "part").distinct().join(texts.select(F.col("s").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("struct<k:bigint,k2:bigint>").alias("b"), "text")
    flat = members.unionByName(probes).select(F.col("a.k").alias("ak"), F.col("a.k2").alias("ak2"), "part", F.col("b.k").alias("bk"), F.col("b.k2").alias("bk2"), "text")
    groups = flat.repartition("ak", "ak2", "part").sortWithinPartitions("ak", "ak2", "part", F.col("bk").asc_nulls_first(), F.col("bk2").asc_nulls_first())

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, probe, held = Words(), None, None, []

        def ended():
            won = [held[i][0] for i in trie_join(probe, [keys for _, keys in held])] if held else []
            held.clear()
            columns = [[now[0]] * len(won), [now[1]] * len(won), [b[0] for b in won], [b[1] for b in won]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["ak", "ak2", "bk", "bk2"])

        for batch in slices(batches, 64):
            for ak, ak2, part, bk, bk2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (ak, ak2, part) != now:
                    if held:
                        yield ended()
                    now = (ak, ak2, part)
                keys = order.keys(shingle_hashes(text, known, n))
                if bk is None:
                    probe = keys
                else:
                    held.append(((bk, bk2), keys))
                    if len(held) >= TRIE:
                        yield ended()
        if held:
            yield ended()

    found = groups.mapInArrow(links, "ak long, ak2 long, bk long, bk2 long")
    return found.select(F.struct(F.col("ak").alias("k"), F.col("ak2").alias("k2")).alias("a"), F.struct(F.col("bk").alias("k"), F.col("bk2").alias("k2")).alias("b"))


def mixed_postings(postings: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """Postings of the tokens that sets of different components share, with label and major (the token's commonest label).

    Also how many these are, and how many pairs of one of another component with any it would take to compare them all.
    """
    marked = postings.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    marked = store(marked, "marked")
    by_label = marked.groupBy("token", "label").agg(F.count("*").alias("m"))
    mixed = by_label.groupBy("token").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    mixed = store(mixed.select("token", F.col("most.label").alias("major"), "all", (F.col("all") - F.col("most.m")).alias("others")), "mixed")
    load = mixed.agg(F.sum("all").alias("rows"), F.sum(F.col("all") * F.col("others")).alias("pairs")).first().asDict()
    met = store(marked.join(mixed.select("token", "major"), "token"), "mixed-postings")
    discard(marked)
    return met, load


def in_reach(rows: DataFrame, other: DataFrame, fits: Column) -> DataFrame:
    """Pairs (a, b), a < b, of sets whose prefixes hold so many common tokens, and that are so near in size and sketch, that they can link."""
    x, y = rows.alias("x"), other.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits & within_bounds("x", "y"))
    of = lambda side, c: F.col(f"{side}.{c}")
    need = common_needed(of("x", "n"), of("x", "last"), of("y", "n"), of("y", "last")).alias("need")
    counted = pairs.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"), need).groupBy("a", "b", "need").agg(F.count("*").alias("common"))
    return counted.where("common >= need").select("a", "b")


def within_bounds(a: str, b: str) -> Column:
    """Whether the sets of two postings of one token can link: length, position and sketch."""
    return near_in_size(F.col(f"{a}.n"), F.col(f"{b}.n")) & positions_allow(a, b) & sketch_allows(a, b, SKETCHES)


def across(met: DataFrame, turn: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of sets of different components that share tokens, within the bounds.

    ``whole``: all of them. Otherwise every set outside the major component of a token with LOTS sets of
    it, others each turn: as many pairs as LOTS times the postings at most. These are the sets that share
    the largest parts of themselves, as what all are copies of does.
    """
    outside = met.where(F.col("label") != F.col("major"))
    if whole:
        other = met
        fits = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("x.major")) | (F.col("x.s") < F.col("y.s")))
    else:
        inside = met.where(F.col("label") == F.col("major"))
        shared_ones = inside.groupBy("label", "s").agg((F.count("*") / F.first("n")).alias("share"))
        lots = F.array(*[F.max(F.when(F.pmod(F.xxhash64("s", F.lit(turn)), F.lit(LOTS)) == i, F.struct("share", "s")))["s"] for i in range(LOTS)])
        chosen = shared_ones.groupBy("label").agg(lots.alias("l")).select(F.explode("l").alias("s")).where("s is not null")
        other = store(inside.join(chosen, "s", "left_semi"), "leaders")
        fits = F.lit(True)
    return in_reach(outside, other, fits)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles (set size) and component_id, the least id reachable by links.

    Also mark, a hash of the text, and component_key, a hash that is one for a component (null for empty sets).

    Rows link whose sets have 100 * intersection >= 80 * union. Words are what ASCII white space
    separates, A-Z lower-cased. Null, empty and wordless texts have the empty set and link with
    nothing; a text of fewer than n words is one shingle. Rows of equal sets are linked whatever
    their ids. A null id is never the least; a component of null ids only has a null component_id.
    Repeated rows give repeated rows; further columns are not read; an empty table gives no rows.
    Tokens are 64-bit hashes, sets are told apart by 128 bits.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    order = token_order(base, n)
    sets = store(sets_of(base, order, n, docs.schema[id_col].dataType.simpleString()), "sets")
    some = sets.where("prefix is not null")
    s = F.struct("k", "k2")
    likely = shared(some.withColumn("last", F.element_at("prefix", -1)), ["n", "k", "k2", "last", *SKETCHES])
    # dealt by token once: both sides of the semi-join are the same shuffle
    once = likely.select("token", "n", "pos", s.alias("s"), "last", *SKETCHES).repartition("token").distinct()

    # postings that have a partner within the bounds; a semi-join ends a row's search at the first
    postings = once.alias("x").join(once.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.s") != F.col("y.s")) & within_bounds("x", "y"), "left_semi")
    postings = store(postings, "postings")

    # every set with the first set, by its hash, of each of its tokens
    first = F.min(F.struct("s", "n", "pos", "last", *SKETCHES)).alias("e")
    firsts = store(postings.groupBy("token").agg(first).select("token", "e.*"), "firsts")
    star = store(in_reach(postings, firsts, F.col("x.s") != F.col("y.s")), "star")
    links = store(verified(star, base, sets, order, n), "links")
    labels = components(links)

    tried, more = star, True
    for turn in range(LEADERS + 1):
        met, load = mixed_postings(postings, labels)
        if not load["rows"]:
            break
        last_turn = turn == LEADERS or not more or load["pairs"] <= EASY * load["rows"]
        pairs = across(met, turn, whole=last_turn).join(tried, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        found = store(verified(pairs, base, sets, order, n), "links")
        won = found.count()
        if won:
            links = links.unionByName(found)
            labels = components(links)
        if last_turn:
            break
        tried, more = tried.unionByName(pairs), won * 10 >= pairs.count() > 0

    classes = sets.where("n > 0").groupBy("k", "k2").agg(F.min("id").alias("first"))
    named = classes.join(labels.select(F.col("node.k").alias("k"), F.col("node.k2").alias("k2"), "label"), ["k", "k2"], "left").withColumn("label", F.coalesce("label", s))
    named = store(named, "classes")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = store(named.join(least, "label").select(F.col("k").alias("c_k"), F.col("k2").alias("c_k2"), "component_id", F.xxhash64("label").alias("component_key")), "of-class")
    out = sets.join(of_class, (F.col("k") == F.col("c_k")) & (F.col("k2") == F.col("c_k2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "mark", "component_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM) -> DataFrame:
    """``docs`` with one document of each component: the one of least id (null last), then least hash of the text.

    All documents of the empty set stay. Of repeated rows that stay, one does; documents of one id
    that do not link all stay.
    """
    found = ngram_components(docs, id_col, text_col, n)
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "mark")
    chosen = found.where("component_key is not null").groupBy("component_key").agg(F.min(place).alias("p")).select("p.id", "p.mark")
    alone = found.where("component_key is null").select(F.col(id_col).alias("id"), "mark").distinct()
    stay = chosen.unionByName(alone).withColumnsRenamed({"id": "_id", "mark": "_m"})
    rows = docs.withColumn("_mark", F.xxhash64(text_col))
    kept = rows.join(stay, rows[id_col].eqNullSafe(stay["_id"]) & (rows["_mark"] == stay["_m"]), "left_semi")
    return kept.dropDuplicates([id_col, "_mark"]).select(*docs.columns)
