"""Decontamination against brute force, with the edge cases of its docstring."""

import random
import re

import pytest

from quirekit.llm import decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=13, share=20):
    out = []
    wins = {}
    for item, text in items:
        w = words(text)
        span = min(len(w), window)
        for i in range(len(w) - span + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + span]), set()).add("" if item is None else str(item))
    spans = {len(w) for w in wins}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for span in spans:
            for i in range(len(w) - span + 1):
                if (got := wins.get(tuple(w[i : i + span]))) is not None:
                    hit |= set(range(i, i + span))
                    found |= got
        out.append((doc_id, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "7 AS span", "1 AS window")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS words", "0 AS n_hit")
    got = decontaminate.decontaminate(d, b, **more)
    assert {"span", "window"} <= set(got.columns)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed,block", [(0, 100_000), (1, 20), (2, 7)])
def test_equals_brute_force(spark, seed, block):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "Straße", "don't", "A-B"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 12, 13, 14, 30, 60])] + [(50, None), (51, ""), (52, "..."), (None, text(20))]
    items += [(60, items[8][1]), (8, items[8][1]), (61, "a a a a a a a a a a a a a a a a")]
    docs = [(i, text(rnd.randint(0, 80))) for i in range(40)]
    docs += [(100 + i, text(20) + " " + items[i % len(items)][1] + ", " + text(10) if items[i % len(items)][1] else None) for i in range(30)]
    docs += [(7, docs[7][1]), (7, "another text"), (None, items[8][1]), (None, None), (None, ""), (200, "A " * 40), (201, text(3000) + " " + items[9][1].upper())]
    assert run(spark, docs, items, block=block) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (2, None)], []) == [(1, 3, 0, (), False), (2, 0, 0, (), False)]
    assert run(spark, [(1, "a b c")], [(1, "zz yy")]) == [(1, 3, 0, (), False)]
