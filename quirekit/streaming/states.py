"""State for each key over ordered events: a status machine, and one running turn for each session.

A machine is a pure step: (state, event) to (state, outcomes). Over a table, the rows of a key come sorted and only its
state is held; over a stream, the state is kept for each key and deadlines are event-time timeouts. Both give the same
outcomes for the same order of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept for a key: the last event's number, a value, and since when (microseconds; 0 for never).
STATE = "seq long, value string, since long"
OUTCOME = "seq long, at timestamp, source string, outcome string, value string"


@dataclass(frozen=True)
class Statuses:
    """Accepts a change of status if (from, to) is allowed; '' is the status of a key that has none."""

    allowed: frozenset[tuple[str, str]]
    limit: int | None = None

    def step(self, state: tuple, seq: int, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        _, value, since = state
        if (value, kind) in self.allowed:
            return (seq, kind, at), [(seq, at, value, "accepted", kind)]
        return (seq, value, since), [(seq, at, value, "refused", value)]

    def deadline(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


@dataclass(frozen=True)
class Turns:
    """One running turn a session: a start while one runs is refused; a finish or cancel ends it; after ``limit`` microseconds it expires."""

    limit: int

    def step(self, state: tuple, seq: int, at: int, kind: str) -> tuple[tuple, list[tuple]]:
        _, value, since = state
        running = value == "running"
        if kind == "start":
            return ((seq, value, since), [(seq, at, value, "refused", value)]) if running else ((seq, "running", at), [(seq, at, value, "started", "running")])
        if kind in ("finish", "cancel") and running:
            return (seq, "idle", 0), [(seq, at, value, "finished" if kind == "finish" else "cancelled", "idle")]
        return (seq, value, since), [(seq, at, value, "ignored", value)]

    def deadline(self, state: tuple) -> int | None:
        return state[2] + self.limit if state[1] == "running" else None

    def expire(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return (state[0], "idle", 0), [(state[0], self.deadline(state), "running", "expired", "idle")]


Machine = Statuses | Turns
FRESH = (-1, "", 0)


def advanced(machine: Machine, state: tuple, events: Iterator[tuple[int, int, str]]) -> tuple[tuple, list[tuple]]:
    """The state after ordered events (seq, at, kind), and all outcomes. Events that are not newer than the last are repeats."""
    out: list[tuple] = []
    for seq, at, kind in events:
        if seq <= state[0]:
            continue
        due = machine.deadline(state)
        if due is not None and at >= due:
            state, told = machine.expire(state)
            out += told
        state, told = machine.step(state, seq, at, kind)
        out += told
    return state, out


def outcomes(events: DataFrame, machine: Machine) -> DataFrame:
    """(key, seq, at, source, outcome, value) of a table of events (key, seq, at, kind), as if they had come one by one.

    seq orders a key's events and is unique in it; repeats of a seq after the first are left out, and so are events
    with null seq, at or kind. A null key is a key. Turns that still run when a key's events end are left running. A
    key's events are read in one task as a stream; what is held is its state.
    """
    kind = events.schema["key"].dataType.simpleString()
    real = events.where("seq is not null and at is not null and kind is not null")
    ordered = real.select("key", F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind").repartition("key").sortWithinPartitions("key", "seq", "at", "kind")
    names = ["key", "seq", "at", "source", "outcome", "value"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, some = None, FRESH, False
        for batch in batches:
            out = []
            for k, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if not some or k != key:
                    key, state, some = k, FRESH, True
                state, told = advanced(machine, state, iter([event]))
                out += [(k, *t) for t in told]
            columns = list(zip(*out)) or [[]] * 6
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = ordered.mapInArrow(walk, f"key {kind}, seq long, at long, source string, outcome string, value string")
    return found.withColumn("at", F.timestamp_micros("at"))


def streamed(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """:func:`outcomes` over a stream of events.

    Events of a key must come in the order of seq from batch to batch (within a batch they are sorted): one that is
    not newer than the last is taken for a repeat. Running turns expire when the watermark, ``late`` behind the newest
    event, passes their deadline. State is kept in the checkpoint, so a restart goes on where it ended.
    """
    kind = events.schema["key"].dataType.simpleString()
    real = events.where("seq is not null and at is not null and kind is not null").select("key", F.col("seq").cast("long").alias("seq"), "at", "kind").withWatermark("at", late)

    def told(key: tuple, found: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], seq, pd.Timestamp(at, unit="us"), source, outcome, value) for seq, at, source, outcome, value in found]
        return pd.DataFrame(rows, columns=["key", "seq", "at", "source", "outcome", "value"])

    def advance(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(kept.get) if kept.exists else FRESH
        if kept.hasTimedOut:
            state, found = machine.expire(state)
        else:
            frame = pd.concat(list(frames)).sort_values(["seq", "at", "kind"])
            rows = zip(frame["seq"], frame["at"], frame["kind"])
            state, found = advanced(machine, state, ((int(n), pd.Timestamp(t).value // 1000, k) for n, t, k in rows))
        due = machine.deadline(state)
        if due is not None and due <= kept.getCurrentWatermarkMs() * 1000:
            state, more = machine.expire(state)
            found, due = found + more, None
        kept.update(state)
        if due is not None:
            kept.setTimeoutTimestamp(-(-due // 1000))
        if found:
            yield told(key, found)

    return real.groupBy("key").applyInPandasWithState(advance, f"key {kind}, {OUTCOME}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
