"""Conversation structure repair: the cheapest edits that make a conversation's roles follow the grammar.

Roles must read ``(s?(ua)+)?`` by their initials. The lattice of (turns read, grammar state) is never built: Dijkstra's
search grows it from the start, ordered by (cost, audit), and stops at the first accepting end node that it takes from
its queue. No edit is free of cost and of progress at once, so two equally cheap audits of one node are never each
other's beginnings, and the order by (cost, audit) survives every further edit.

A conversation is cut in segments of ``SEGMENT`` turns: each but the last is searched from every state it can begin in
until all states at its end are settled, and the best ways are joined. So memory and time are linear in the turns.
Spark sorts the turns of each conversation and finds the duplicates; Python reads them as a stream. Of a conversation
it holds two bytes a turn, and its texts go to a spooled file beyond ``SPOOLED_BYTES``: the digest of the repaired text
can only be taken in order, once all edits are known.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import tempfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirekit.llm.common import slices

SEGMENT = 256
SPOOLED_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"
# Costs of the edits, and the charge for a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# The grammar's moves by state and initial (0 nothing yet, 1 system, 2 user, 3 assistant), and where it may end.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: A turn's fault: none, blank, truncated, duplicate. Of equal turns the duplicates are read last, so theirs is the highest.
FINE, BLANK, CUT, DUPLICATE = range(4)

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn``, modulo 20; nulls of any column count as one space there.

    0 drops the turn (it stays as a row with ``present`` false), 1 empties its text, 2 takes its full stops, question
    and exclamation marks, 3 repeats it, 4 gives it the role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    times = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), F.explode(times).alias("present"))


def ways(initials: str, faults: bytes, state: int, last: bool) -> dict[int, tuple[int, str]]:
    """Dijkstra over one segment from ``state``: (cost, audit) of the best way to each state at its end.

    With ``last``, the search stops at the first accepting end node, and only that one is returned.
    """
    n, settled, found = len(initials), set(), {}
    queue = [(0, "", 0, state)]
    while queue:
        cost, audit, at, now = heapq.heappop(queue)
        if (at, now) in settled:
            continue
        settled.add((at, now))
        if at == n:
            if last and now in ENDS:
                return {now: (cost, audit)}
            if not last:
                found[now] = (cost, audit)
                if len(found) == 4:
                    break
        after = MOVES[now, NEXT_ROLE[now][0]]
        edits = [(INSERT, "I", at, after)]
        if at < n:
            edits.append((DELETE, "D", at + 1, now))
            if faults[at] not in (BLANK, DUPLICATE):
                more = TRUNCATED if faults[at] == CUT else 0
                edits.append((REROLE + more, "R", at + 1, after))
                if (now, initials[at]) in MOVES:
                    edits.append((KEEP + more, "K", at + 1, MOVES[now, initials[at]]))
        for price, letter, i, s in edits:
            if (i, s) not in settled:
                heapq.heappush(queue, (cost + price, audit + letter, i, s))
    return found


def repaired(initials: str, faults: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the least audit among the cheapest."""
    best = {0: (0, "")}
    for start in range(0, max(len(initials), 1), segment):
        end, last = start + segment, start + segment >= len(initials)
        joined: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in best.items():
            for to, (more, added) in ways(initials[start:end], faults[start:end], state, last).items():
                way = (cost + more, audit + added)
                joined[to] = min(joined.get(to, way), way)
        best = joined
    return min(best.values())


def applied(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation."""
    state = 0
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = NEXT_ROLE[state]
        state = MOVES[state, role[0]]
        yield letter, role, text


class Conversation:
    """One conversation, read turn by turn in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.initials: list[str] = []
        self.faults = bytearray()
        self.texts = tempfile.SpooledTemporaryFile(SPOOLED_BYTES)
        self.first = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        self.illegal += bool(self.faults) and self.initials[-1] + initial not in LEGAL_PAIRS
        self.initials.append(initial)
        self.faults.append(fault)
        self.texts.write(json.dumps([role, text]).encode() + b"\n")

    def close(self) -> tuple[list[int], str]:
        # one character a turn: an empty role has no initial and fits nowhere
        cost, audit = repaired("".join(i or " " for i in self.initials), bytes(self.faults))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [gaps, *(self.faults.count(x) for x in (BLANK, DUPLICATE, CUT)), self.illegal, cost], audit

    def turns(self, audit: str) -> Iterator[tuple[str, str, str]]:
        self.texts.seek(0)
        return applied((tuple(json.loads(line)) for line in self.texts), audit)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """Conversations out of turns that come in order."""
    one = None
    for batch in slices(batches):
        for conv_id, turn, present, role, text, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if one is None or conv_id != one.conv_id:
                if one:
                    yield one
                one = Conversation(conv_id)
            if present:
                one.add(turn, role, text, fault)
    if one:
        yield one


def _in_order(rows: DataFrame, present: Column | None) -> DataFrame:
    """(conv_id, turn, present, role, text, fault): each conversation in one partition, in order, with each turn's first fault."""
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), (F.lit(True) if present is None else present).alias("present"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    dealt = said.withColumn("_digest", F.unhex(F.md5("text"))).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "_digest").orderBy(F.col("turn").asc_nulls_first()))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", F.lit(BLANK)).when(seen > 1, F.lit(DUPLICATE)).when(~end.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(FINE))
    placed = dealt.select("conv_id", "turn", "present", "role", "text", fault.alias("fault"))
    return placed.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")


def repair(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text; further columns are ignored. Turns are read by turn (nulls first), then
    role and text. Null roles and texts count as one space, so a null text is blank; a null conv_id is a conversation
    of its own; an empty role has no initial and can't be kept. Repeated rows are turns of their own, of which all but
    the first are duplicates. A conversation of which ``present`` holds for no row has zeros, an empty audit and the
    digest of nothing. No rows, no result. A conversation is read in one task as a stream, since its digest is
    sequential.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, id_type = ["conv_id", *FIGURES, "audit", "repaired_sha256"], None

        def noted(source):
            nonlocal id_type
            for batch in source:
                id_type = batch.column(0).type
                yield batch

        out: list[list] = []
        for one in _conversations(noted(batches)):
            figures, audit = one.close()
            digest = hashlib.sha256()
            for n, (_, role, text) in enumerate(one.turns(audit)):
                digest.update(("\n" if n else "").encode() + f"{role}:{text}".encode())
            out.append([one.conv_id, *figures, audit, digest.hexdigest()])
            if len(out) == 1000:
                yield _batch(out, names, id_type)
                out = []
        if out:
            yield _batch(out, names, id_type)

    return _in_order(rows, present).mapInArrow(read, f"conv_id {kind}, {', '.join(f'{x} long' for x in FIGURES)}, audit string, repaired_sha256 string")


def _batch(rows: list[list], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def repaired_turns(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text. Defined as :func:`repair`."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _conversations(batches):
            turns = one.turns(one.close()[1])
            place = 0
            while some := list(islice(turns, 512)):
                columns = [[one.conv_id] * len(some), range(place, place + len(some)), *zip(*some)]
                place += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "place", "edit", "role", "text"])

    return _in_order(rows, present).mapInArrow(read, f"conv_id {kind}, place long, edit string, role string, text string")
