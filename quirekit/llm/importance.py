"""Importance resampling towards a target: documents whose word n-grams are likelier in the target are drawn more.

Features are runs of one to three words, hashed to buckets. Texts longer than ``CHUNK_BYTES`` are split at word
boundaries; a chunk owns the n-grams that start in it and carries the next two words, so each n-gram of a document is
owned once, whatever the cuts. Chunks of long texts are dealt out over the executors and their counts and weights are
summed by document; shorter texts are worked on where they are read, and are never shuffled. What the driver holds is
one number a bucket.

CRC-32 is linear: an n-gram's checksum follows from those of its words by a shift for the bytes that come after, so
whole batches are hashed as arrays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quirekit.llm.common import slices, store
from quirekit.llm.running import running_totals

ORDER = 3
BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
#: Texts of so many bytes are hashed as one array.
BATCH_BYTES = 1 << 21
#: Shifts by fewer bytes are looked up; words of so many bytes or more are hashed one by one.
SHORT = 64

_BYTE_OF_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OTHER_BYTE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The checksum's byte table; shifts by 0 .. SHORT-1 zero bytes; shifts by 1, 2, 4 ... zero bytes."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    shifts = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)]
    for _ in range(SHORT - 1):
        shifts.append(crc[shifts[-1] & 255] ^ shifts[-1] >> 8)
    powers = [shifts[1]]
    for _ in range(31):
        powers.append(_through(powers[-1], powers[-1]))
    return crc, np.stack(shifts), np.stack(powers)


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


CRC, SHIFTS, POWERS = _tables()
_IS_WORD = np.array([bool(_BYTE_OF_WORD.match(bytes([b]))) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums ``c`` moved on by ``n`` bytes each."""
    near = np.minimum(n, SHORT - 1)
    flat, at = SHIFTS.reshape(-1), near * 1024
    out = flat[at + (c & 255)] ^ flat[at + 256 + (c >> 8 & 255)] ^ flat[at + 512 + (c >> 16 & 255)] ^ flat[at + 768 + (c >> 24)]
    far = np.flatnonzero(n >= SHORT)
    if len(far):
        moved, left = c[far], n[far]
        for j in range(int(left.max()).bit_length()):
            moved = np.where(left >> j & 1, _through(POWERS[j], moved), moved)
        out[far] = moved
    return out


def hashed(chunks: list[bytes], own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, n_features) of each chunk, and (chunk, checksum) of each n-gram that starts in its first ``own`` bytes."""
    joined = b"\n".join(chunks) + b"\n"
    raw = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(_IS_WORD[raw].astype(np.int8), prepend=np.int8(0)))
    first, size = edge[::2], edge[1::2] - edge[::2]  # the last byte is no word's, so edges come in pairs
    begins = np.cumsum([0] + [len(c) + 1 for c in chunks[:-1]])
    chunk = np.searchsorted(begins, first, side="right") - 1
    word = np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    active = np.flatnonzero(size < SHORT)
    for k in range(int(size[active].max(initial=0))):
        active = active[size[active] > k]
        word[active] = CRC[(word[active] ^ raw[first[active] + k]) & 255] ^ word[active] >> 8
    word ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size >= SHORT):
        word[i] = zlib.crc32(raw[first[i] : first[i] + size[i]].tobytes())
    owned = first - begins[chunk] < np.array(own)[chunk]
    space = np.uint32(zlib.crc32(b" "))
    gram, grams, of = word, [word[owned]], [chunk[owned]]
    for n in range(1, ORDER):
        whole = chunk[n:] == chunk[:-n] if n < len(chunk) else np.zeros(0, dtype=bool)
        gram = CRC[gram[: len(whole)] & 255] ^ gram[: len(whole)] >> 8 ^ space
        gram = shifted(gram, size[n : n + len(whole)]) ^ word[n : n + len(whole)]
        some = whole & owned[: len(whole)]
        grams.append(gram[some])
        of.append(chunk[: len(whole)][some])
    words = np.bincount(of[0], minlength=len(chunks))
    features = sum(np.bincount(x, minlength=len(chunks)) for x in of)
    return words, features, np.concatenate(of), np.concatenate(grams)


def cut(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Chunks of a text as (own bytes, bytes): each owns about ``size`` bytes up to a word's end and carries ORDER-1 words more."""
    at = 0
    while at < len(text):
        end = _OTHER_BYTE.search(text, at + size)
        end = end.start() if end else len(text)
        carried = [m.end() for m in islice(_BYTE_OF_WORD.finditer(text, end), ORDER - 1)]
        yield end - at, text[at : carried[-1] if carried else end]
        at = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches):
        yield batch, [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]


def _grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_BYTES or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def _tally(tally: np.ndarray, texts: list[bytes], own: list[int]) -> None:
    for a, b in _grouped(texts):
        tally += np.bincount(hashed(texts[a:b], own[a:b])[3] % BUCKETS, minlength=BUCKETS)


def _counted(tally: np.ndarray) -> tuple[pa.Array, pa.Array]:
    some = np.flatnonzero(tally)
    return pa.array(some.astype(np.int32)), pa.array(tally[some].astype(np.int64))


def _weighed(gains: np.ndarray, texts: list[bytes], own: list[int]) -> list[np.ndarray]:
    """Words, features and weight of each text."""
    out = [np.zeros(len(texts), dtype=np.int64) for _ in range(3)]
    for a, b in _grouped(texts):
        words, features, of, grams = hashed(texts[a:b], own[a:b])
        weight = np.bincount(of, weights=gains[grams % BUCKETS], minlength=b - a)  # whole numbers far below 2**53: exact
        for o, x in zip(out, (words, features, weight)):
            o[a:b] = x.astype(np.int64)
    return out


def _first_pass(docs: DataFrame, chunk_bytes: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """The chunks of long texts as a stored table (row, doc_id, at, own, chunk), and the bucket counts of all texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "at", "own", "chunk", "bucket", "n"]
    schema = f"row long, doc_id {kind}, at long, own long, chunk binary, bucket int, n long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, row, id_type = np.zeros(BUCKETS, dtype=np.int64), TaskContext.get().partitionId() << 40, None
        for batch, texts in _texts(batches):
            id_type = batch.column(0).type
            short = [t for t in texts if len(t) <= chunk_bytes]
            _tally(tally, short, [len(t) for t in short])
            for i, t in enumerate(texts):
                row += 1
                if len(t) > chunk_bytes:
                    for at, (own, part) in enumerate(cut(t, chunk_bytes)):
                        one = [pa.array([row]), batch.column(0).slice(i, 1), pa.array([at]), pa.array([own]), pa.array([part]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
                        yield pa.RecordBatch.from_arrays(one, names=names)
        bucket, n = _counted(tally)
        if len(bucket):
            none = [pa.nulls(len(bucket), t) for t in (pa.int64(), id_type, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, bucket, n], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches, 32):
            _tally(tally, batch.column(1).to_pylist(), batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays(list(_counted(tally)), names=["bucket", "n"])

    parts = store(docs.select("doc_id", "text").mapInArrow(split, schema), name)
    chunks = parts.where("chunk is not null").select("row", "doc_id", "at", "own", "chunk")
    of_chunks = chunks.repartition("row", "at").select("own", "chunk").mapInArrow(count, "bucket int, n long")
    counts = parts.where("bucket is not null").select("bucket", "n").unionByName(of_chunks).groupBy("bucket").agg(F.sum("n").alias("n"))
    tally = np.zeros(BUCKETS, dtype=np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        tally[r["bucket"]] = r["n"]
    return chunks, tally


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    t, s = (float(x.sum()) + BUCKETS for x in (target, source))
    return np.array([math.floor(1000 * math.log((float(a) + 1) * s / ((float(b) + 1) * t))) for a, b in zip(target, source)], dtype=np.int64)


def weights(docs: DataFrame, target: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_features, weight (the sum of its features' gains).

    ``docs`` has doc_id and text, ``target`` has text; further columns are ignored. Null and empty texts have no words:
    weight 0. Repeated rows are weighed each for itself; null ids are ids like others. With an empty target or empty
    documents all counts are 0 and the gains follow from the smoothing alone.
    """
    chunks, source = _first_pass(docs, chunk_bytes, "importance_chunks")
    _, wanted = _first_pass(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), chunk_bytes, "importance_target")
    gain = gains(wanted, source)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            here = [i for i, t in enumerate(texts) if len(t) <= chunk_bytes]
            some = [texts[i] for i in here]
            columns = [batch.column(0).take(pa.array(here, pa.int64())), *map(pa.array, _weighed(gain, some, [len(t) for t in some]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    def weigh_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            found = _weighed(gain, batch.column(3).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    short = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    dealt = chunks.repartition("row", "at").select("row", "doc_id", "own", "chunk").mapInArrow(weigh_chunks, f"row long, doc_id {kind}, n_words long, n_features long, weight long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    return short.unionByName(dealt.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums).drop("row"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Draws ``percent`` of the documents of ``least_words`` or more, the best by weight and Gumbel noise.

    One row a document: doc_id, n_words, n_features, weight, score, rank. rank is 1, 2, 3 ... in falling score for the
    drawn, null for others. Ties go to the smaller doc_id, null ids last; equal rows follow each other. The noise comes
    from the seed and the id, so reruns agree; a null id counts as ''. Nulls, repeats and empty tables: see :func:`weights`.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = store(weights(docs, target, chunk_bytes).withColumn("score", F.col("weight") + noise), "importance_scores")
    able = scored.where(F.col("n_words") >= least_words).withColumn("_one", F.lit(1).cast("long"))
    drawn = able.count() * percent // 100
    ranked = running_totals(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()], "_one", "importance_ranks")
    place = F.when(F.col("before") < drawn, F.col("before") + 1)
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", place).drop("before", "_one").unionByName(short)


def drawn_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, with all their columns (null ids are never equal, so they don't come)."""
    return docs.join(resampled.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")
