"""Machines over tables and over streams: the same outcomes, each event once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirekit.streaming import states

EVENTS = "key string, seq long, at timestamp, kind string"
START = datetime(2024, 1, 1)
HOUR = 3_600_000_000
KINDS = ["start", "start", "finish", "cancel", "look"]


def events(n=300, keys=5, seed=2):
    rnd, clock, rows = random.Random(seed), START, []
    for seq in range(n):
        clock += timedelta(minutes=rnd.randint(1, 25))
        rows.append((rnd.choice(["a", "b", "c", "d", None][:keys]), seq, clock, rnd.choice(KINDS)))
    return rows


def by_hand(rows, limit):
    """Turns one by one, with the hour as a plain number."""
    out, since = [], {}
    for key, seq, at, kind in sorted(rows, key=lambda r: r[1]):
        began = since.get(key)
        if began is not None and at >= began + timedelta(microseconds=limit):
            out.append((key, "expired"))
            began = since[key] = None
        if kind == "start":
            out.append((key, "started" if began is None else "refused"))
            since[key] = at if began is None else began
        elif kind == "look" or began is None:
            out.append((key, "ignored"))
        else:
            out.append((key, "finished" if kind == "finish" else "cancelled"))
            since[key] = None
    return sorted(out, key=str)


def test_turns_over_a_table(spark):
    rows = events()
    df = spark.createDataFrame(rows + [rows[5], ("a", None, START, "start"), ("a", 7000, None, "start"), ("a", 7001, START, None)], EVENTS).repartition(7)
    got = states.outcomes(df, states.Turns(HOUR))
    assert sorted(((r["key"], r["outcome"]) for r in got.collect()), key=str) == by_hand(rows, HOUR)
    assert {r[0] for r in got.select("outcome").distinct().collect()} == {"started", "refused", "finished", "cancelled", "ignored", "expired"}
    assert states.outcomes(df.limit(0), states.Turns(HOUR)).count() == 0


def test_statuses_over_a_table(spark):
    allowed = frozenset({("", "queued"), ("queued", "parsing"), ("parsing", "review"), ("parsing", "failed")})
    rows = [("x", 1, START, "parsing"), ("x", 2, START, "queued"), ("x", 3, START, "review"), ("x", 4, START, "parsing"), ("x", 5, START, "failed"), ("y", 1, START, "queued")]
    got = states.outcomes(spark.createDataFrame(rows, EVENTS), states.Statuses(allowed)).orderBy("key", "seq").collect()
    assert [(r["source"], r["outcome"], r["value"]) for r in got] == [("", "refused", ""), ("", "accepted", "queued"), ("queued", "refused", "queued"), ("queued", "accepted", "parsing"), ("parsing", "accepted", "failed"), ("", "accepted", "queued")]


@pytest.mark.parametrize("machine", [states.Turns(HOUR), states.Statuses(frozenset({("", "start"), ("start", "finish"), ("finish", "look"), ("look", "start"), ("start", "cancel")}))])
def test_a_stream_tells_the_same(spark, tmp_path, machine):
    rows = events(120, keys=4)
    rows.append(("z", 9999, rows[-1][2] + timedelta(days=3), "look"))  # moves the watermark past all deadlines
    source = tmp_path / "in"
    query = None
    for n in range(0, len(rows), 40):
        part = rows[n : n + 40]
        spark.createDataFrame(part + part[:3], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = states.streamed(spark.readStream.schema(EVENTS).parquet(str(source)), machine)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = states.outcomes(spark.createDataFrame(rows, EVENTS), machine)
    columns = ["key", "seq", "at", "source", "outcome", "value"]
    told = [str(tuple(r)) for r in got.select(*columns).collect()]
    expected = [str(tuple(r)) for r in want.select(*columns).collect()]
    left = set(told) - set(expected)
    assert not set(expected) - set(told) and len(told) == len(set(told))
    assert all("'expired'" in x for x in left) and len(left) <= 4  # turns that ran when the table ended
    assert got.where(F.col("outcome") == "expired").count() > 0 or isinstance(machine, states.Statuses)
