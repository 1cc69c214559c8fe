"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is above zero. Codes are cut into
8-bit segments, each with its own table. A query first looks up its own segment values, then values
at distance 1, 2 and so on. After radius s is done in the first a of m segments, every code within
m*s + a - 1 has been seen in some segment; once the kth verified distance is no more than that, the
answer is provably complete and the search ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to the workers at once: 8 bytes of id and a code each, so a few megabytes at most.
BLOCK = 50_000
BITS = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
#: The 8-bit values by their number of set bits: what to add to a segment to change it by that distance.
FLIPS = [np.flatnonzero(BITS == d).astype(np.uint8) for d in range(9)]


class Index:
    """Segment tables over the codes of one partition (rows of bytes)."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes, self.m = ids, codes, codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(self.m)]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def search(self, code: np.ndarray, k: int, skip: int | None = None) -> list[tuple[int, int]]:
        """The k least (distance, id) among the codes, ties by id; ``skip`` is an id to leave out."""
        seen = np.zeros(len(self.ids), dtype=bool)
        if skip is not None:
            seen |= self.ids == skip
        found_d, found_i = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for radius in range(9):
            for j in range(self.m):
                values = code[j] ^ FLIPS[radius]
                rows = [self.order[j][self.starts[j][v] : self.starts[j][v + 1]] for v in values.astype(int)]
                rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
                rows = rows[~seen[rows]]
                seen[rows] = True
                if len(rows):
                    found_d = np.concatenate([found_d, BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64)])
                    found_i = np.concatenate([found_i, self.ids[rows]])
                    if len(found_d) > k:
                        best = np.lexsort((found_i, found_d))[:k]
                        found_d, found_i = found_d[best], found_i[best]
                covered = self.m * radius + j  # every code up to this distance has been seen
                if len(found_d) >= k and found_d.max() <= covered:
                    best = np.lexsort((found_i, found_d))[:k]
                    return list(zip(found_d[best].tolist(), found_i[best].tolist()))
        best = np.lexsort((found_i, found_d))[:k]
        return list(zip(found_d[best].tolist(), found_i[best].tolist()))


def codes_of(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """Rows (id, code): one byte per 8 dimensions, highest bit first. Vectors of another length, null or with null or NaN values are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, out = [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                if v is not None and len(v) == dims and None not in v:
                    x = np.asarray(v, dtype=np.float64)
                    if not np.isnan(x).any():
                        good.append(i)
                        out.append(np.packbits(x > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array(out, pa.binary())], names=["id", "code"])

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(rows, "id long, code binary")


def top_k(vectors: DataFrame, query_rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, block: int = BLOCK) -> DataFrame:
    """For every query row its k nearest rows by Hamming distance: query_id, rank (from 1), vec_id, distance.

    Exact over all rows; ties go to the smaller id; a row is not its own neighbour (rows of the same
    id are one vector: the smallest code counts). Queries travel in blocks of bounded size; each
    partition answers from its own index and sends k rows a query, of which the k best stay. Rows
    whose id or vector is null, of another dimension, or holds null or NaN values are neither queries
    nor answers. With fewer than k other rows all are returned; empty tables give no rows.
    """
    spark = vectors.sparkSession
    unique = lambda df: codes_of(df, id_col, vector_col, dims).groupBy("id").agg(F.min("code").alias("code"))
    asked = unique(query_rows)
    total = asked.count()
    blocks = max(1, -(-total // block))
    table = unique(vectors)
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(([r["id"] for r in part], [bytes(r["code"]) for r in part]))

        def answers(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [(np.asarray(x.column(0)), b"".join(x.column(1).to_pylist())) for x in batches]
            ids = np.concatenate([x for x, _ in held]) if held else np.zeros(0, dtype=np.int64)
            if not len(ids):
                return
            index = Index(ids, np.frombuffer(b"".join(c for _, c in held), dtype=np.uint8).reshape(len(ids), -1))
            for query, code in zip(*sent.value):
                best = index.search(np.frombuffer(code, dtype=np.uint8), k, query)
                if best:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([query] * len(best), pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array([d for d, _ in best], pa.int32())],
                        names=["query_id", "vec_id", "distance"],
                    )

        some = table.mapInArrow(answers, "query_id long, vec_id long, distance int")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
