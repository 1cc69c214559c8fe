"""Importance resampling, conversation repair and source mixing against brute force, with the edge cases of their docstrings."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirekit.llm import conversations, importance, mixing, queries
from quirekit.llm.running import running_totals

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    w = WORDS.findall(low(text))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = np.zeros(10000, dtype=int), np.zeros(10000, dtype=int)
    for tally, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x)[1]:
                tally[bucket(g)] += 1
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (big_s + 10000) / ((int(s[b]) + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, g = grams(x)
        weight = sum(gain[bucket(f)] for f in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def resampled(spark, docs, target, **more):
    df = spark.createDataFrame([(i, x, 1) for i, x in docs], "doc_id long, text string, rank int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(df, t, **more).collect()), key=str)


@pytest.mark.parametrize("chunk", [7, 40, 1 << 16])
def test_resampling_equals_brute_force(spark, chunk):
    rnd = random.Random(5)
    vocabulary = ["a", "Été", "x1", "日本", "the", "w" * 63, "v" * 64, "u" * 300, "Zz", "né"]
    texts = [" ,\n-.".join(["", *[rnd.choice(vocabulary) + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 1, 2, 3, 19, 20, 21, 60]))]]) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "..."), (None, texts[5] + " the a x1" * 30), (None, "the " * 40), (3, texts[3]), (3, texts[3]), (904, "the a " * 4000), (905, "q" * 200000 + " a b")]
    target = ["the a x1 日本", None, "", "Zz " * 30, "né Été " * 20]
    assert resampled(spark, docs, target, percent=20, chunk_bytes=chunk) == brute_resample(docs, target, percent=20)


def test_resampling_of_the_table_and_of_nothing(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    target = [r["text"] for r in queries.table(spark, sf_dir, "benchmark").collect()]
    found = queries.op11_importance_resampling(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_resample(docs, target)
    assert resampled(spark, [], target) == []
    assert resampled(spark, docs[:30], []) == brute_resample(docs[:30], [])
    df = queries.table(spark, sf_dir, "documents")
    drawn = importance.drawn_documents(df, found)
    assert drawn.columns == df.columns and drawn.count() == found.where("rank is not null").count()


def test_checksums_of_many_bytes():
    rnd = random.Random(1)
    for n in (1, 5, 63, 64, 65, 1000, 70001):
        head, tail = rnd.randbytes(9), rnd.randbytes(n)
        moved = importance.shifted(np.array([zlib.crc32(head)], dtype=np.uint32), np.array([n]))[0]
        assert int(moved) ^ zlib.crc32(tail) == zlib.crc32(head + tail)


def test_running_totals(spark):
    rows = [(i % 7, i, i % 5 if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = {r["i"]: r["before"] for r in running_totals(df, [F.col("k").desc(), F.col("i").asc()], "v", "t").collect()}
    total = 0
    for k, i, v in sorted(rows, key=lambda r: (-r[0], r[1])):
        assert got[i] == total
        total += v or 0
    assert running_totals(df.limit(0), [F.col("k").asc()], "v", "t").count() == 0


# ---- conversation repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def fault_list(turns):
    seen, out = set(), []
    for role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(turns, faults, inserts):
    """Every edit sequence with at most so many inserts, as (cost, audit, repaired)."""

    def go(i, left, cost, audit, kept):
        if i == len(turns):
            yield cost, audit, kept
        else:
            role, text = turns[i]
            yield from go(i + 1, left, cost + 4, audit + "D", kept)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                yield from go(i + 1, left, cost + more, audit + "K", [*kept, (role, text)])
                for other in ("user", "assistant"):
                    yield from go(i + 1, left, cost + 3 + more, audit + "R", [*kept, (other, text)])
        if left:
            for role in ("user", "assistant"):
                yield from go(i, left - 1, cost + 3, audit + "I", [*kept, (role, "")])

    for cost, audit, kept in go(0, inserts, 0, "", []):
        initials = [r[:1] for r, _ in kept]
        if all(initials) and GRAMMAR.fullmatch("".join(initials)):
            yield cost, audit, kept


def brute_conversation(turns):
    faults = fault_list([t[1:] for t in turns])
    cost, audit, kept = min(all_repairs([t[1:] for t in turns], faults, 3))
    known = [t[0] for t in turns if t[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [t[1][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def in_order(rows):
    fill = lambda v: " " if v is None else v
    return sorted(((t, fill(r), fill(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repair_equals_brute_force(spark):
    rnd = random.Random(8)
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for c in range(120):
        for t in range(rnd.randint(1, 4)):
            rows.append((c if c else None, rnd.choice([t, t, t + 1, None]), rnd.choice(roles[: rnd.choice([2, 3, 7])]), rnd.choice(["Hi.", "Well?", "no end", " ", None, "", "Ja!\n ", "é. x", "Hi."]), 0))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(df).collect()}
    groups = {c: [r[1:4] for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        assert got[c] == brute_conversation(in_order(turns)), turns
    out = {}
    for r in conversations.repaired_turns(df).orderBy("place").collect():
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() == got[c][-1] for c in groups)
    assert conversations.repair(df.limit(0)).count() == 0


def test_of_equal_turns_the_later_are_duplicates(spark):
    rows = [(1, 1, "user", "no end")] * 3 + [(1, 2, "assistant", "Fine."), (2, None, "user", "cut"), (2, None, "user", "cut"), (2, 1, "assistant", "end"), (2, 1, "assistant", "end")]
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, 2):
        assert got[c] == brute_conversation(in_order([r[1:] for r in rows if r[0] == c]))
    assert got[1][6] == "KDDK"


def slow_repair(initials, faults):
    """Bellman-Ford over (cost, audit) on the whole lattice."""
    best = {(0, 0): (0, "")}
    for _ in range(3 * len(initials) + 8):
        for (i, s), (cost, audit) in list(best.items()):
            steps = [(3, "I", (i, conversations.MOVES[s, conversations.NEXT_ROLE[s][0]]))]
            if i < len(initials):
                more = 3 * (faults[i] == conversations.CUT)
                steps.append((4, "D", (i + 1, s)))
                if faults[i] not in (conversations.BLANK, conversations.DUPLICATE):
                    steps.append((3 + more, "R", (i + 1, conversations.MOVES[s, conversations.NEXT_ROLE[s][0]])))
                    if (s, initials[i]) in conversations.MOVES:
                        steps.append((more, "K", (i + 1, conversations.MOVES[s, initials[i]])))
            for price, letter, node in steps:
                way = (cost + price, audit + letter)
                if node not in best or way < best[node]:
                    best[node] = way
    return min(best[len(initials), s] for s in (0, 3) if (len(initials), s) in best)


@pytest.mark.parametrize("seed", range(25))
def test_segments_give_the_same_repair(seed):
    rnd = random.Random(seed)
    n = rnd.randint(0, 14)
    initials, faults = "".join(rnd.choice("uuaasx") for _ in range(n)), bytes(rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
    whole = slow_repair(initials, faults)
    assert conversations.repaired(initials, faults) == whole
    assert all(conversations.repaired(initials, faults, k) == whole for k in (1, 2, 5))


def test_a_long_conversation(spark, monkeypatch):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}." + "x" * (i % 3) + ".") for i in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = conversations.repair(df).collect()
    assert (r["cost"], r["audit"]) == (0, "K" * 6000)
    assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for *_, a, b in rows).encode()).hexdigest()


def brute_damage(rows):
    out = {}
    for c, t, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{fill(c)}:{fill(t)}".encode()) % 20
        role, text = fill(role), fill(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def test_repair_of_the_damaged_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, None, None, None), (None, 3, "user", None), *[(77000 + i, 1, "user", "Alone.") for i in range(60)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df), F.col("present")).collect()}
    hurt = brute_damage(rows)
    assert set(got) == set(hurt) and any(not t for t in hurt.values())
    for c, turns in hurt.items():
        turns = in_order(turns)
        if len(turns) <= 4:
            assert got[c] == brute_conversation(turns), c
        else:
            faults = bytes({"": conversations.FINE, "blank": conversations.BLANK, "duplicate": conversations.DUPLICATE, "truncated": conversations.CUT}[f] for f in fault_list([t[1:] for t in turns]))
            assert got[c][5:7] == slow_repair("".join(t[1][:1] for t in turns), faults)
    assert got[next(c for c, t in hurt.items() if not t)] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = queries.op12_conversation_repair(spark, sf_dir)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full) or 1
        over = {s for s in names if s not in full and left * w[s] / rest > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else left * w[s] / rest for s in names}
        full |= over


def check_mix(rows, docs, most=3):
    sizes, largest, taken = {}, {}, {}
    for _, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    goal = brute_targets(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= most
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - goal[s]) <= largest[s] / 2 + 1e-6, s
    return goal


def test_mixing(spark, sf_dir):
    rnd = random.Random(2)
    docs = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "é", "b", "B", None, *["hot"] * 5])) for i in range(800)]
    docs += [(None, "x y", "a"), (None, None, "b"), (5, "x\ty\nz", "hot"), (5, "x\ty\nz", "hot"), (9000, "one", "zz"), (9001, None, "none"), (9002, "", "none")]
    docs += [(None, "n n n n", "nulls")] * 200
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    rows = mixing.mix(df).collect()
    check_mix(rows, docs)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0
    table = queries.table(spark, sf_dir, "documents")
    check_mix(mixing.mix(table).collect(), [(r["doc_id"], r["text"], r["source"]) for r in table.collect()])
    assert queries.op13_source_mixing(spark, sf_dir).dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]


def test_draw_is_the_pareto_order(spark):
    """With preferences: certain copies, chances and the order of odds, one by one."""
    docs = [(i, "w " * (1 + i % 5), "s") for i in range(60)] + [(100 + i, "w " * 7, "t") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    liked = F.when(F.col("doc_id") % 10 == 0, 8.0).when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(1.0 + F.col("doc_id") % 3)
    rows = {r["doc_id"]: r for r in mixing.mix(df, preference=liked).collect()}
    like = lambda i: 8.0 if i % 10 == 0 else 0.0 if i % 10 == 1 else 1.0 + i % 3
    u = {r["doc_id"]: (r["u"] % (1 << 52) + 0.5) / (1 << 52) for r in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("u")).collect()}
    for s in ("s", "t"):
        ids = [i for i, _, x in docs if x == s]
        size = {i: len(t.split()) for i, t, _ in docs}
        target, lo, hi = rows[ids[0]]["target"], 0.0, 1e6
        for _ in range(200):  # the level at which capped copies meet the target
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(3, mid * like(i)) * size[i] for i in ids) < target else (lo, mid)
        copies = {i: min(3.0, lo * like(i)) for i in ids}
        near = {i: round(copies[i]) if abs(copies[i] - round(copies[i])) < 1e-6 else math.floor(copies[i]) for i in ids}
        chance = {i: copies[i] - near[i] for i in ids}
        rest = target - sum(near[i] * size[i] for i in ids)
        before = 0
        for i in sorted((i for i in ids if chance[i] > 1e-6), key=lambda i: u[i] / (1 - u[i]) / (chance[i] / (1 - chance[i]))):
            near[i] += 2 * before + size[i] <= 2 * rest
            before += size[i]
        assert {i: rows[i]["copies"] for i in ids} == near
    assert all(r["copies"] == 0 for i, r in rows.items() if i % 10 == 1)
