"""Token counts, exact top-k and packing against brute force, with the edge cases of their docstrings."""

import random

import numpy as np
import pytest

from quirekit.llm import hamming, packing, tokens

MODEL = None


def model_path():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c ", "The quick\nbrown\r\n fox", "▁a ▁▁b▁", "<s> x</s> <unk>", "日本語 ñandú ß x", "\x00 \x01",
    "word " * 5000, "x" * 3000, "\n\n\n", "a\tb", "é" * 40, " \n a", "0 1 22 333 4444  55555",
]


def test_token_counts_equal_the_library(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 2), (0, None, 3)], "doc_id long, text string, n_tokens long")
    got = tokens.count_tokens(df, model_path(), limit=3).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, t in enumerate(TEXTS):
        if i:
            assert by[i]["n_tokens"] == len(sp.encode(t or "")), t
            assert by[i]["n_bytes"] == len((t or "").encode())
            assert by[i]["over_limit"] == (by[i]["n_tokens"] > 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokens.count_tokens(docs, model_path()).collect():
        assert r["n_tokens"] == len(sp.encode(texts[r["doc_id"]] or ""))
    assert tokens.count_tokens(docs.limit(0), model_path()).count() == 0


def test_units_beyond_what_is_remembered(monkeypatch):
    with open(model_path(), "rb") as f:
        counter = tokens.Counter(f.read())
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    for n in range(30):
        text = " ".join(f"qzx{n}w{i}" for i in range(12))
        assert counter.count(text) == len(counter.encoder.encode(text))


def brute_top_k(rows, queries, k):
    codes = {i: [x > 0 for x in v] for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v}
    out = set()
    for q in queries:
        if q in codes:
            best = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:k]
            out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_top_k_is_exact(spark, block):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # ties: exact copies
    rows += [(400, None), (401, [1.0] * 63), (402, [None] * 64), (None, [1.0] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = hamming.top_k(df, df.where("vec_id % 50 = 0"), k=7, block=block)
    assert {tuple(r) for r in got.collect()} == brute_top_k(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 7)


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hamming.top_k(df, df.where("vec_id = 0"), k=5).collect()] == [(0, 1, 1, 64)]
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rnd = random.Random(seed)
    caps = [(8, 16), (512, 1024, 2048, 4096), (10,), (5, 7, 30), (64, 128), (100, 400)][seed]
    hist = {rnd.randint(1, max(caps)): rnd.randint(1, 5000) for _ in range(rnd.randint(1, 60))}
    places, bins = packing.plan(hist, caps)
    content: dict[int, list[tuple[int, int]]] = {}
    seen = {n: np.zeros(c, dtype=int) for n, c in hist.items()}
    for length, rank, count, first, per, offset in places.tolist():
        seen[length][rank : rank + count] += 1
        for i in range(count):
            content.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert all((s == 1).all() for s in seen.values())
    total = 0
    for first, n, capacity, filled in bins.tolist():
        for b in range(first, first + n):
            at = 0
            for start, length in sorted(content.pop(b)):
                assert start == at
                at += length
            assert at == filled <= capacity
            assert capacity == min(c for c in caps if c >= filled)
            total += capacity
    assert not content
    waste = 1 - sum(n * c for n, c in hist.items()) / total
    assert waste < 0.5


def test_pack_rows(spark):
    rows = [(1, 5, 9), (2, None, 9), (3, 0, 9), (4, -2, 9), (None, 7, 9), (5, 21, 9), (1, 5, 9), (6, 8, 9)] + [(100 + i, 3, 9) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin_id long")
    got = packing.pack(df, capacities=(4, 8)).collect()
    assert sorted((r["doc_id"], r["piece_len"]) for r in got if r["doc_id"] == 5) == [(5, 5), (5, 8), (5, 8)]
    assert sum(r["piece_len"] for r in got) == 5 + 7 + 21 + 5 + 8 + 150
    assert all(r["bin_id"] is None and r["bin_capacity"] is None for r in got if r["doc_id"] in (2, 3, 4))
    bins: dict[int, list] = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_len"]
        assert all(r["bin_filled"] == at and r["bin_capacity"] == (4 if at <= 4 else 8) for r in members)
    assert packing.pack(df.limit(0)).count() == 0
