"""Language model scores from a log-frequency Bloom filter.

A word is scored by the word before it: bigrams back off to single words. Counts of word bigrams and
of their contexts, over all training texts, are kept as quantised logarithms in a Bloom filter: an
n-gram of level q is in the filter with each of the levels 1 to q, and a count is found again by asking
for level after level until one is missing or the highest is reached. Texts begin with a start mark and
have an end. The filter has 12 bits for each entry, so it grows with the distinct bigrams of the corpus;
it is sent to all workers, whose memory bounds the corpus (about 1.5 bytes for each distinct bigram).

The events of single words are those of the base score: the end, every word of the training tokens,
and one event for all other words. A word's probability is its discounted share of the training
tokens, by exact counts; what the discount frees, as much as the words seen once weigh, goes to unseen
words. These probabilities add up to one; those with context do so up to the quantisation of counts and
the filter's false positives. The exact counts of words stay in a table of the shared folder.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import discard, slices, store, training_row
from quirekit.llm.ngram_join import Words

FOLDS = 10
#: Base of the logarithms, hash functions, bits for each entry, least number of segments.
BASE, HASHES, ENTRY_BITS, SEGMENTS = 1.2, 3, 12, 64
#: Bits of a word n-gram's code; codes that a task sorts and passes on at once; codes of a segment, about.
CODE_BITS, CHUNK, SEGMENT_CODES = 48, 4_000_000, 2_000_000
#: Blocks (of some 3 MB) fetched at once.
FETCHED = 8
#: Words whose counts are sent to all workers at once (12 or 16 bytes each): with more, those seen most often; the others' places are joined.
BROADCAST_WORDS = 5_000_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
START, END = 2, 3
#: What the next shorter word n-gram weighs after a context seen c times: CONTEXT_WEIGHT * c ** CONTEXT_POWER.
CONTEXT_WEIGHT, CONTEXT_POWER = 3.0, 0.8
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * P1
    x = (x ^ (x >> np.uint64(32))) * P2
    return x ^ (x >> np.uint64(29))


def level_values(most: float = 1e18) -> np.ndarray:
    """The counts that levels 1, 2, ... stand for: whole numbers to 10, then in steps of BASE."""
    return np.concatenate([np.arange(1.0, 10.0), 10.0 * BASE ** np.arange(0, np.log(most / 10) / np.log(BASE))])


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised logarithms of counts: the level whose value is nearest."""
    between = np.log(level_values())
    return 1 + np.searchsorted((between[1:] + between[:-1]) / 2, np.log(counts))


class Filter:
    """A Bloom filter over (n-gram, level), in segments, each sized by its entries."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, most: int):
        """The segments' words in a row, how many each has, and the highest level in the filter, where each search ends."""
        sizes = sizes.astype(np.uint64)
        self.words, self.bits, self.most = words, sizes * np.uint64(64), most
        self.starts = (np.cumsum(sizes) - sizes) * np.uint64(64)

    @staticmethod
    def places(codes: np.ndarray, level: np.ndarray | int, bits: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
        """The places of each code with a level in a segment of so many bits (under 2**32), one hash function after the other."""
        base = mix(codes + np.asarray(level, dtype=np.uint64) * P2, 7)
        step = mix(base, 11) | np.uint64(1)
        for i in range(HASHES):
            yield (((base + np.uint64(i) * step) >> np.uint64(32)) * bits) >> np.uint64(32)

    @staticmethod
    def segment(codes: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
        """By the high bits of codes, so that sorted codes are sorted by segment."""
        return ((codes >> np.uint64(CODE_BITS - 32)) * np.uint64(segments)) >> np.uint64(32)

    @staticmethod
    def fill(block: np.ndarray, codes: np.ndarray, level: np.ndarray) -> None:
        """Sets in ``block`` the bits of each code with each of its levels."""
        for q in range(1, int(level.max(initial=0)) + 1):
            for at in Filter.places(codes[level >= q], q, np.uint64(len(block) * 64)):
                np.bitwise_or.at(block, (at >> np.uint64(6)).astype(np.intp), np.uint64(1) << (at & np.uint64(63)))

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """The quantised counts of n-grams or contexts, 0 where the filter has none."""
        unique, back = np.unique(codes, return_inverse=True)
        segment = self.segment(unique, len(self.bits)).astype(np.intp)
        level, on = np.zeros(len(unique), dtype=np.int64), np.arange(len(unique))
        for q in range(1, self.most + 1):
            hit = np.ones(len(on), dtype=bool)
            where = segment[on]
            start = self.starts[where]
            for p in self.places(unique[on], q, self.bits[where]):
                at = start + p
                hit &= (self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            on = on[hit]
            if not len(on):
                break
            level[on] = q
        return np.concatenate([[0.0], level_values()])[level][back]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of all texts with its count in training texts. docs: text, training."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in slices(batches):
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().lower().split() if text else ()
                if training:
                    held.update(words)
                else:
                    for w in words:
                        held.setdefault(w, 0)
            if len(held) >= HELD:
                yield flush()
        yield flush()

    return store(docs.select("text", "training").mapInArrow(rows, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, c) to (h, c): the word's hash as a signed number."""
    for batch in slices(batches, 20_000):
        h = (hashed(batch.column(0).to_pylist(), Words()) - np.uint64(1 << 63)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(1)], names=["h", "c"])


def hashed(words: Iterable[bytes], known: Words) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64)


def word_grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of one and of two words that end at each event of texts given as word hashes, and which are real.

    The events of a text are a start mark, its words and an end; the mark is the one event that is not real.
    """
    start, end = np.array([START], dtype=np.uint64), np.array([END], dtype=np.uint64)
    every = np.concatenate([x for t in texts for x in (start, t, end)]) if texts else np.zeros(0, dtype=np.uint64)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    real = np.ones(len(every), dtype=bool)
    real[np.cumsum(sizes) - sizes] = False
    short = np.uint64(64 - CODE_BITS)
    return mix(every, 21) >> short, mix(mix(np.roll(every, 1), 22) + every, 23) >> short, real


def packed(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes and their counts as bytes: the width of a difference, differences, and the counts other than 1 by place."""
    steps = np.diff(codes, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    often = np.flatnonzero(n > 1)
    head = np.array([width, len(codes), len(often)], dtype=np.int64).tobytes()
    return head + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + often.astype(np.uint32).tobytes() + n[often].astype(np.int64).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, size, often = np.frombuffer(data, dtype=np.int64, count=3).tolist()
    steps = np.zeros((size, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, dtype=np.uint8, count=size * width, offset=24).reshape(size, width)
    n = np.ones(size, dtype=np.int64)
    at = np.frombuffer(data, dtype=np.uint32, count=often, offset=24 + size * width)
    n[at] = np.frombuffer(data, dtype=np.int64, count=often, offset=24 + size * width + 4 * often)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), n


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted codes with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.intp)
    return codes[starts], np.add.reduceat(n[order], starts) if len(codes) else n


def word_filter(docs: DataFrame, events: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The filter over the word n-grams of training texts, as Filter takes it. docs: text, training; events: their number.

    Tasks pass on sorted runs of codes, cut by segment and packed; a segment's runs meet in one task,
    which counts, quantises and fills its block. Segments grow in number with the events, so none is large.
    Blocks reach the driver a few at a time.
    """
    segments = max(SEGMENTS, -(-2 * events // SEGMENT_CODES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, Words()

        def passed() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            codes, n = every[starts], np.diff(starts, append=len(every))
            cuts = np.searchsorted(Filter.segment(codes, segments), np.arange(segments + 1, dtype=np.uint64))
            runs = [(s, packed(codes[i:j], n[i:j])) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["segment", "run"])

        for batch in slices(batches):
            one, two, real = word_grams([hashed(t.encode().lower().split() if t else (), known) for t in batch.column(0).to_pylist()])
            held += [one, two[real]]
            size += len(one) * 2
            if size >= CHUNK:
                yield passed()
                size = 0
        if held:
            yield passed()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def block() -> pa.RecordBatch:
            codes, n = summed(*(np.concatenate(x) for x in zip(*map(unpacked, runs))))
            runs.clear()
            level = levels(n)
            made = np.zeros(int(level.sum()) * ENTRY_BITS // 64 + 1, dtype=np.uint64)
            Filter.fill(made, codes, level)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([made.tobytes()], pa.binary()), pa.array([int(level.max())], pa.int32())], names=["segment", "block", "most"])

        for batch in batches:
            for s, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != now and runs:
                    yield block()
                now = s
                runs.append(run.as_py())
        if runs:
            yield block()

    runs = docs.where("training").select("text").mapInArrow(rows, "segment int, run binary")
    made = store(runs.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(filled, "segment int, block binary, most int"), "filter")
    sizes, most = np.ones(segments, dtype=np.int64), 0
    for r in made.select("segment", F.octet_length("block").alias("n"), "most").collect():
        sizes[r["segment"]], most = r["n"] // 8, max(most, r["most"])
    words, starts = np.zeros(sizes.sum(), dtype=np.uint64), np.cumsum(sizes) - sizes
    for first in range(0, segments, FETCHED):
        for r in made.where((F.col("segment") >= first) & (F.col("segment") < first + FETCHED)).select("segment", "block").collect():
            words[starts[r["segment"]] :][: sizes[r["segment"]]] = np.frombuffer(r["block"], dtype=np.uint64)
        docs.sparkSession.sparkContext._jvm.System.gc()
    discard(made)
    return words, sizes, most


def in_context(known: Filter, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for every word and end of the texts: with its probability p as a single word, that in its context is a + b p."""
    one, two, real = word_grams(texts)
    before, seen = np.split(known.counts(np.concatenate([np.roll(one, 1)[real], two[real]])), 2)
    weight = np.where(before > 0, CONTEXT_WEIGHT * before**CONTEXT_POWER, 1.0)
    return np.minimum(seen, before) / (before + weight), weight / (before + weight)


def discounted(total: int, distinct: int, once: int) -> tuple[float, float]:
    """How much less each word counts, and the probability of all unseen words together."""
    discount = min(0.9, max(0.01, once / distinct)) if distinct else 0.0
    return discount, discount * distinct / total if total else 1.0


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32 of the id's text modulo ``folds`` is not 0 (a null id counts as
    '' and is held out). A null text is empty: one token, the end. base_score is the add-0.1 unigram
    score, score the model's log10 probability. Without training rows every word is new: N = V = 0.
    Repeated rows give repeated rows; further columns are not read; an empty table gives no rows.
    Words are known by a 64-bit hash when texts are scored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), training_row(F.col(id_col), folds).alias("training"))
    words = word_counts(base)
    ends = base.where("training").count()
    tallied = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count("*").alias("all"), F.count_if(F.col("c") == 1).alias("once")).first()
    total, distinct = (tallied["n"] or 0) + ends, (tallied["v"] or 0) + (ends > 0)
    discount, unseen = discounted(total, distinct, tallied["once"] or 0)
    base_log = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    end_p = (ends - discount) / total if ends else 1.0
    end_base, end_known = float(base_log(ends)), int(ends > 0)
    grams = docs.sparkSession.sparkContext.broadcast(word_filter(base, total))
    docs.sparkSession.sparkContext._jvm.System.gc()  # lets Spark delete the runs' shuffle files
    by_hash = words.mapInArrow(hashed_words, "h long, c long")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    least = 0 if tallied["all"] <= broadcast_words else least_sent(words, broadcast_words)
    held = by_hash.where(F.col("c") >= least).toArrow()
    h, c = (held.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h)
    sent = docs.sparkSession.sparkContext.broadcast((h[order], c[order].astype(np.uint32 if total < 2**32 else np.int64)))
    del held, h, c, order

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Batches, their texts' lengths with ends, (known, base, score) added up over ends and words that were sent, and the other words: (text, hash, a, b)."""
        h, c = sent.value
        known = Filter(*grams.value)
        place: dict[bytes, int] = {}  # below 0: the place among the words that were not sent, from -1 down
        others = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            texts = [t.encode().lower().split() if t else [] for t in batch.column(1).to_pylist()]
            if len(place) > HELD:
                place, others = {}, others[:0]
            fresh = list(set().union(*texts).difference(place))
            sought = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), dtype=np.uint64, count=len(fresh))
            sought = (sought - np.uint64(1 << 63)).view(np.int64)
            order = np.argsort(sought)  # neighbours are near in memory
            sought = sought[order]
            at = np.searchsorted(h, sought)
            if least:
                absent = h[np.minimum(at, len(h) - 1)] != sought if len(h) else np.ones(len(at), dtype=bool)
                at[absent] = -1 - len(others) - np.arange(absent.sum())
                others = np.concatenate([others, sought[absent]])
            for i, x in zip(order.tolist(), at.tolist()):
                place[fresh[i]] = x
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            places = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), dtype=np.intp, count=sizes.sum())
            was_sent = places >= 0
            hashes, n = np.empty(len(places), dtype=np.int64), np.zeros(len(places))
            hashes[was_sent], hashes[~was_sent], n[was_sent] = h[places[was_sent]], others[-1 - places[~was_sent]], c[places[was_sent]]
            a, b = in_context(known, np.split(hashes.view(np.uint64) + np.uint64(1 << 63), np.cumsum(sizes)[:-1]) if len(sizes) else [])
            ends_at = np.cumsum(sizes + 1) - 1
            word = np.ones(len(a), dtype=bool)
            word[ends_at] = False
            p, base_logs, seen = np.full(len(a), end_p), np.full(len(a), end_base), np.full(len(a), end_known)
            p[word], base_logs[word], seen[word] = np.where(n > 0, (n - discount) / max(1, total), unseen), base_log(n), n > 0
            logs = np.log10(a + b * p)
            left = np.flatnonzero(word)[~was_sent]
            seen[left], base_logs[left], logs[left] = 0, 0.0, 0.0
            sums = [np.add.reduceat(x, ends_at - sizes) for x in (seen, base_logs, logs)] if len(sizes) else [np.zeros(0)] * 3
            yield batch, sizes + 1, sums, (np.repeat(np.arange(len(sizes)), sizes)[~was_sent], hashes[~was_sent], a[left], b[left])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, (seen, base_logs, logs), _ in scored(batches):
            held_out = pa.array([not t for t in batch.column(2).to_pylist()], pa.bool_())
            columns = [pa.array(x, pa.int64()) for x in (sizes, seen.astype(np.int64), np.full(len(sizes), total))] + [pa.array(x, pa.float64()) for x in (base_logs, logs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), held_out, *columns], names=names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, sums, (of, *other) in scored(batches):
            at = pa.array(np.concatenate([np.arange(len(sizes)), of]))
            first = np.arange(len(at)) < len(sizes)
            of_word = [pa.array(np.concatenate([np.zeros(len(sizes), dtype=x.dtype), x]), mask=first) for x in other]
            of_text = [pa.array(np.concatenate([x, np.zeros(len(of))]).astype(k), mask=~first) for x, k in zip((sizes, *sums), (np.int64, np.int64, float, float))]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 2, 3)] + of_word + of_text, names=["id", "training", "mark", "h", "a", "b", "n", "k", "base", "log"])

    if not least:
        return base.mapInArrow(whole, schema)
    rows = base.withColumn("mark", F.xxhash64("id", "text")).mapInArrow(parts, f"id {kind}, training boolean, mark long, h long, a double, b double, n long, k long, base double, log double")
    return whole_texts(rows, by_hash.where(F.col("c") < least), total, distinct, discount, unseen).select(
        F.col("id").alias(id_col), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def least_sent(words: DataFrame, most: int) -> int:
    """The least count, from 1, of which no more than ``most`` words (word, c) have it or a higher one."""
    least, n = None, 0
    for r in words.where("c > 0").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        n += r["n"]
        if n > most:
            return r["c"] + 1
        least = r["c"]
    return least or 1


def whole_texts(rows: DataFrame, counts: DataFrame, total: int, distinct: int, discount: float, unseen: float) -> DataFrame:
    """(id, training, n_tokens, n_known, base_score, score) of texts from rows in parts, as often as each text is there.

    ``rows``: id, training, mark (of id and text); a text has one row with n, k, base and log, its sums without the words
    that were not sent, and one for each of those words, with h, a and b. ``counts``: h, c of those words. Only they are
    shuffled: the rest of the vocabulary, whose words come a few times each, and one row a text.
    """
    is_word, c = F.col("h").isNotNull(), F.when(F.col("h").isNotNull(), F.coalesce("c", F.lit(0)))
    joined = rows.withColumn("key", F.coalesce("h", "mark")).join(counts.withColumnRenamed("h", "key"), "key", "left")  # texts' own rows go by their marks
    p = F.when(c > 0, (c - discount) / max(1, total)).otherwise(F.lit(unseen))
    base = F.when(is_word, F.log10((c + 0.1) / F.lit(total + 0.1 * (distinct + 1)))).otherwise(F.col("base"))
    log = F.when(is_word, F.log10(F.col("a") + F.col("b") * p)).otherwise(F.col("log"))
    known = F.when(is_word, (c > 0).cast("long")).otherwise(F.col("k"))
    sums = joined.groupBy("id", "training", "mark").agg(F.count("n").alias("times"), F.max("n").alias("n_tokens"), F.sum(known).alias("k"), F.sum(base).alias("b"), F.sum(log).alias("s"))
    once = sums.select("id", "training", "n_tokens", F.expr("k div times").alias("n_known"), (F.col("b") / F.col("times")).alias("base_score"), (F.col("s") / F.col("times")).alias("score"), "times")
    return once.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_i", "times")
