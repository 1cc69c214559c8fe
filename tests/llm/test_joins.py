"""The n-gram join and line dedup against brute force, with the edge cases of their docstrings."""

import random
import re

import numpy as np
import pytest

from quirekit.llm import line_dedup, ngram_join
from quirekit.llm.components import components


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, size=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Straße", "THE", "the"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    common = text(30)
    rows = []
    for i in range(size):
        w = text(rnd.choice([3, 5, 8, 40, 90, 200]))
        if rnd.random() < 0.3:
            w = w[: len(w) // 2] + common + w[len(w) // 2 :]
        rows.append((i, " ".join(w)))
    for i in range(size):  # near copies, chains of them and exact copies
        w = rows[rnd.randrange(len(rows))][1].split(" ")
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((size + i, rnd.choice([" ", "  ", "\n"]).join(w)))
    big = text(150)
    for i in range(60):
        w = list(big)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (None, "a b c d e f"), (2005, "a b c d e f"), (None, "solo text here"), (None, None), (7, rows[7][1]), (8, "another text of eight, that is not alike")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "TRIE", 4)
        monkeypatch.setattr(ngram_join, "EASY", 0)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "'x' AS label", "2 AS n")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == brute_components(rows)


def test_components_of_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ngram_join.ngram_components(df).collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("seed", range(8))
def test_trie_join_equals_brute_force(seed):
    rnd = np.random.default_rng(seed)
    base = np.unique(rnd.integers(-(2**62), 2**62, rnd.integers(1, 900)))
    members = [base, np.zeros(0, dtype=np.int64), base[:-1]]
    for _ in range(60):
        keep = base[rnd.random(len(base)) > rnd.choice([0.02, 0.1, 0.2, 0.3])]
        members.append(np.unique(np.concatenate([keep, rnd.integers(-(2**62), 2**62, rnd.integers(0, 1 + len(base) // 5))])))
    expected = {i for i, m in enumerate(members) if len(c := np.intersect1d(m, base)) and 5 * len(c) >= 4 * len(np.union1d(m, base))}
    assert set(ngram_join.trie_join(base, members)) == expected


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 501 + i) for i in range(40)] + [(900, 901), (901, 900)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 541), 500), 900: 900, 901: 900}


def brute_lines(rows):
    """rows of distinct (id, text), in order."""
    seen, out = [], []
    for d, text in rows:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        lines, keep = text.split("\n"), []
        for line in lines:
            w = set(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in line)))
            if not w or not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                keep.append(line)
            if w:
                seen.append(w)
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(90)] + ["É", "THE", "the"]
    pool = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 9, 20, 45]))) for _ in range(60)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            w = rnd.choice(pool).split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            lines.append(rnd.choice(["", "  ", "\r"]) + " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "the the the"), (204, "THE"), (205, " ".join(vocab * 20))]
    rows = [(None, "first of all\nw1 w2 w3 w4")] + rows
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "'x' AS kept", "2 AS line_no", "3 AS n")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "d e f\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(df).collect()) == ["a b c\nd e f", "a b c\nd e f", "x"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_with_one_word_changed_in_the_middle_goes(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:6] + ["x"] + base[7:])), (3, " ".join(base[::-1])), (4, " ".join(base[:6] + ["x", "y", "z"] + base[9:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_near_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """Copies with more and fewer changes: what one central text connects is not compared pair by pair."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(160)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in r.sample(range(len(words)), r.randrange(1, 5)):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    compared, plain = [], ngram_join.verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(ngram_join, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in ngram_join.ngram_components(docs).collect()), key=str)
    assert got == brute_components(list(enumerate(texts)))
    assert sum(compared) <= 4 * len(texts)
