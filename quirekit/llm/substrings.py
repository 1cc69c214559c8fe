"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text gives cut candidates; a candidate cuts if no other lies
closely before it, and a stretch without candidates is cut at fixed distances from its start. All of
this looks at nearby bytes only, so an insertion changes the chunks around it and no others. Chunks
are known by a 128-bit digest. Runs of neighbouring chunks that occur before (earlier document, or
earlier in the same one) are repeated passages; runs of enough words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import slices, store
from quirekit.llm.postings import BITMAP_BITS, bitmap

#: A candidate is one byte position in so many; chunks are at least MIN and at most MAX bytes, about 43 on average.
MASK = np.uint32(15 << 20)
MIN, MAX = 16, 256
#: Words that a run of repeated chunks needs to count as a repeated passage. A passage loses up to a chunk at either end.
RUN_WORDS = 25
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: bytes) -> np.ndarray:
    """The ends of the chunks of ``data``, its length last. The gear hash covers the last 32 bytes of each position."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step) if step < n else 0
        h = h + moved
    at = np.flatnonzero((h & MASK) == 0) + 1
    if len(at):
        at = at[np.diff(at, prepend=-MIN) >= MIN]
        at = at[at < n]
    edges = np.concatenate([[0], at, [n]])
    if (np.diff(edges) > MAX).any():
        parts = [np.arange(a + MAX, b, MAX) for a, b in zip(edges[:-1], edges[1:]) if b - a > MAX]
        edges = np.unique(np.concatenate([edges, *parts]))
    return edges[1:].astype(np.int64)


def chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, words begun in each chunk, high and low half of each digest)."""
    ends = cuts(data)
    if not len(ends):
        return ends, ends, ends, ends
    space = SPACE[np.frombuffer(data, dtype=np.uint8)]
    begun = np.cumsum(~space & np.concatenate([[True], space[:-1]]))
    words = np.diff(begun[ends - 1], prepend=0)
    digests = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
    halves = np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)
    return ends, words, halves[:, 0], halves[:, 1]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, mark, n_bytes, n_chunks, repeated_words, removed_words, removed_bytes, spans.

    repeated_words: in runs of at least ``run_words`` words whose chunks all occur more than once
    anywhere. removed_words, removed_bytes and spans (array of structs start, end: byte offsets of the
    UTF-8 text) tell of such runs whose chunks all occur earlier; order is by id (null first), then a
    hash of the text, then offset. The first place of a passage is kept. A null or empty text has no
    chunks. Repeated rows (same id and text) are one document with one result each. Further columns
    are not read; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            high = [chunk(t.encode())[2] if t else np.zeros(0, dtype=np.int64) for t in batch.column(0).to_pylist()]
            for i in range(0, len(high), 256):
                some = np.concatenate(high[i : i + 256])
                found, n = np.unique(some, return_counts=True)  # pre-aggregated
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(n, 2).astype(np.int32))], names=["d", "n"])

    met = base.select("text").mapInArrow(batched, "d long, n int").groupBy("d").agg(F.sum("n").alias("n"))
    often = store(met.where("n > 1").select(F.xxhash64("d").alias("mix")), "repeated")
    bits = store(often.sparkSession.range(1).select(bitmap(often, "mix").alias("bits")), "bitmap").first()["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(np.array(bits, dtype=np.int64).tobytes())
    mask = np.uint64((1 << BITMAP_BITS) - 1)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, dtype=np.uint64)
        for batch in slices(batches):
            sizes, numbers, columns = [], [], [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                data = text.encode() if text else b""
                ends, words, high, low = chunk(data)
                sizes.append(len(data))
                numbers.append(len(ends))
                mixed = xxhash64_longs(high)
                there = lambda m: (table[(m >> np.uint64(6)).astype(np.intp)] >> (m & np.uint64(63))) & np.uint64(1)  # noqa: E731, B023
                on = np.flatnonzero(there(mixed & mask) & there((mixed >> np.uint64(32)) & mask))
                starts = ends - np.diff(ends, prepend=0)
                for c, x in zip(columns, (on, starts[on], ends[on], words[on], high[on], low[on])):
                    c.append(x.astype(np.int64))
            arrays = [pa.array(c, pa.list_(pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), *arrays], names=["id", "mark", "n_bytes", "n_chunks", "no", "begin", "end", "words", "d", "e"])

    lists = ", ".join(f"{c} array<long>" for c in ("no", "begin", "end", "words", "d", "e"))
    chunks = store(base.mapInArrow(likely, f"id {kind}, mark long, n_bytes long, n_chunks long, {lists}"), "chunks")
    flat = chunks.where(F.size("no") > 0).select("id", "mark", F.explode(F.arrays_zip("no", "begin", "end", "words", "d", "e")).alias("c")).select("id", "mark", "c.*")
    place = F.struct("id", "mark", "begin")
    first = flat.groupBy("d", "e").agg(F.min(place).alias("at"), F.max(place).alias("last")).where("at < last").select("d", "e", "at")
    first = store(first, "firsts")
    flagged = flat.join(first, ["d", "e"]).select("id", "mark", "no", "begin", "end", "words", (place == F.col("at")).alias("is_first"))
    per_doc = flagged.distinct().groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("no", "begin", "end", "words", "is_first"))).alias("c"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            repeated, removed, cut, spans = [], [], [], []
            for found in batch.column(2).to_pylist():
                totals = {}
                for later in (False, True):
                    done, now = [], None
                    for c in found:
                        if later and c["is_first"]:
                            continue
                        if now and c["no"] == now[0] + 1:
                            now[0], now[2] = c["no"], c["end"]
                            now[3] += c["words"]
                        else:
                            now = [c["no"], c["begin"], c["end"], c["words"]]
                            done.append(now)
                    totals[later] = [r for r in done if r[3] >= run_words]
                repeated.append(sum(r[3] for r in totals[False]))
                removed.append(sum(r[3] for r in totals[True]))
                cut.append(sum(r[2] - r[1] for r in totals[True]))
                spans.append([{"start": r[1], "end": r[2]} for r in totals[True]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (repeated, removed, cut)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["_id", "_m", "repeated_words", "removed_words", "removed_bytes", "spans"],
            )

    told = per_doc.mapInArrow(runs, f"_id {kind}, _m long, repeated_words long, removed_words long, removed_bytes long, spans array<struct<start:bigint,end:bigint>>")
    out = chunks.select("id", "mark", "n_bytes", "n_chunks").join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left").drop("_id", "_m")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "mark", "n_bytes", "n_chunks", *[F.coalesce(c, zero).alias(c) for c in ("repeated_words", "removed_words", "removed_bytes")], F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def xxhash64_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of each long."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(values), (seed + int(p5) + 8) % 2**64, dtype=np.uint64)
    h ^= turn(values.astype(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ (h >> np.uint64(32))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text; other columns stay. Half a character at a cut stays whole."""
    found = repeats(docs, id_col, text_col, run_words).where(F.size("spans") > 0).select(F.col(id_col).alias("_id"), F.col("mark").alias("_m"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_m"])

    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, found):
            if t is None or found is None or not len(found):
                return t
            data, at, out = t.encode(), 0, []
            for s in found:
                start, end = s["start"], s["end"]
                while start < end and data[start] & 0xC0 == 0x80:
                    start += 1
                while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
                    end -= 1
                out.append(data[at:start])
                at = end
            out.append(data[at:])
            return b"".join(out).decode(errors="ignore")

        return text.combine(spans, one)

    rows = docs.withColumn("_mark", F.xxhash64(text_col))
    joined = rows.join(found, rows[id_col].eqNullSafe(found["_id"]) & (rows["_mark"] == found["_m"]), "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_spans")))).select(*docs.columns)
