"""Variable-capacity best-fit packing.

Lengths are whole numbers up to the largest permitted capacity, so the packing of any number of
items is decided on their histogram: a driver-side plan over at most ``max(capacities)`` distinct
lengths, independent of the number of rows. Rows then find their place by their rank within their
length. Items are placed in falling length; those of one length go to the open bins that they fill
best, and where none is large enough, bins of the capacity that costs least per packed token are
opened. At the end each bin shrinks to the smallest permitted capacity that holds its contents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of one length are ranked in this many separate groups, so that a hot length is no single task.
SALTS = 64


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """Decide the packing of ``histogram[length]`` items of each length.

    Returns (placements, bins). A placement (length, first_rank, count, first_bin, per_bin, offset)
    puts the items of that length with ranks first_rank .. first_rank+count-1 into consecutive bins,
    per_bin in each, the first of each at ``offset``. A row of bins (first_bin, count, capacity,
    filled) tells of equal bins. Both grow with the number of distinct lengths, not of items.
    """
    sizes = sorted(capacities)
    open_bins: dict[int, list[list[int]]] = {}  # room left -> groups [first bin, bins, filled]
    rooms: list[int] = []  # heap of rooms, largest first; kept for the final pass
    placements, made = [], 0
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        fitting = sorted(r for r in open_bins if r >= length)
        while left:
            if fitting:
                room = fitting[0]
                groups = open_bins[room]
                first, bins, filled = groups.pop()
                if not groups:
                    del open_bins[room]
                    fitting.pop(0)
            else:
                size = min((c for c in sizes if c >= length), key=lambda c: (c / (c // length * length), -c))
                room, filled, first, bins = size, 0, made, -(-left // (size // length))
                made += bins
            per = min(room // length, left)
            full = min(bins, left // per)
            placements.append((length, rank, full * per, first, per, filled))
            _reopen(open_bins, room - per * length, [first, full, filled + per * length])
            rank, left = rank + full * per, left - full * per
            if full < bins and left and left < per:
                placements.append((length, rank, left, first + full, left, filled))
                _reopen(open_bins, room - left * length, [first + full, 1, filled + left * length])
                rank, left, full = rank + left, 0, full + 1
            if full < bins:
                _reopen(open_bins, room, [first + full, bins - full, filled])
                if room not in fitting:
                    heapq.heappush(fitting, room)
                    fitting.sort()
    bins = [(first, n, min(c for c in sizes if c >= filled), filled) for groups in open_bins.values() for first, n, filled in groups]
    return (
        np.array(sorted(placements), dtype=np.int64).reshape(-1, 6),
        np.array(sorted(bins), dtype=np.int64).reshape(-1, 4),
    )


def _reopen(open_bins: dict[int, list[list[int]]], room: int, group: list[int]) -> None:
    open_bins.setdefault(room, []).append(group)


def pack(items: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, salts: int = SALTS) -> DataFrame:
    """Place every item in a bin. One row per piece: id, piece, piece_len, bin_id, bin_offset, bin_capacity, bin_filled.

    An item longer than the largest capacity becomes several pieces, all but the last of that
    capacity; nothing is cut off. An item of null, zero or negative length takes no room: it gives one
    row of piece 0 with length 0 and null bin columns. Null ids are items like others; repeated rows
    are packed each for itself; ties are broken by id and piece, so equal rows may swap places. An
    empty table gives no rows. Further columns are ignored.
    """
    most = max(capacities)
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    pieces = (
        items.select(F.col(id_col), n.alias("_n"))
        .withColumn("piece", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(_n + {most} - 1) div {most} - 1"), F.lit(0).cast("long")))))
        .withColumn("piece_len", F.least(F.lit(most).cast("long"), F.col("_n") - F.col("piece") * most))
        .withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(salts)))
        .drop("_n")
    )
    counted = pieces.where("piece_len > 0").groupBy("piece_len", "_salt").count().collect()
    counts = np.zeros((most + 1, salts), dtype=np.int64)
    for row in counted:
        counts[row["piece_len"], row["_salt"]] = row["count"]
    starts = np.cumsum(counts, axis=1) - counts
    places, bins = plan({int(k): int(v) for k, v in enumerate(counts.sum(axis=1)) if v and k}, capacities)
    # ranks of all lengths on one line, so that one search finds an item's placement
    base = np.cumsum(counts.sum(axis=1)) - counts.sum(axis=1)
    line = base[places[:, 0]] + places[:, 1] if len(places) else np.zeros(0, dtype=np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (2, 3, 4))
            some = length > 0
            out = np.zeros((4, len(length)), dtype=np.int64)
            if some.any():
                ell = length[some]
                at = rank[some] - 1 + starts[ell, salt[some]]
                p = places[np.searchsorted(line, base[ell] + at, side="right") - 1]
                into = at - p[:, 1]
                bin_id = p[:, 3] + into // p[:, 4]
                b = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
                out[:, some] = bin_id, p[:, 5] + into % p[:, 4] * ell, b[:, 2], b[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, mask=~some) for x in out)], names=names)

    names = [id_col, "piece", "piece_len", "bin_id", "bin_offset", "bin_capacity", "bin_filled"]
    kind = items.schema[id_col].dataType.simpleString()
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("piece_len", "_salt").orderBy(F.col(id_col).asc_nulls_first(), "piece")))
    return ranked.select(id_col, "piece", "piece_len", "_salt", "_rank").mapInArrow(placed, f"`{id_col}` {kind}, " + ", ".join(f"{x} long" for x in names[1:]))
