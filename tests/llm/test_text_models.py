"""HTML extraction, language ID, LM scoring and substring dedup: brute force, held-out accuracy and the edge cases of the docstrings."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirekit.llm import html_text, language, lm, substrings


def text_of(source, template=frozenset()):
    return html_text.Page(source).main_text(template)


PAGES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>a&amp;b&nbsp;c<p>d &lt;x&gt; &#233;&#x41;", "a&b c\nd <x> éA"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>T</h1><p><b>one<br>two<p>three</p></article><footer>f</footer></body></html>", "T\none two\nthree"),
    ("<body><script>var a='</p><p>x';</script><p>kept</p><!-- no <p>x</p> --><form>name <input></form></body>", "kept"),
    ('<body><div class="site-header">h</div><div id="cookie-notice">c</div><div class="content">Text <i>in</i>line</div><section class="comments">bad</section></body>', "Text inline"),
    ("<main><ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table></main>x", "one\ntwo\na b"),
    ("<article>a<aside>side</aside>b<div hidden>no</div><p style='display: none'>no</p></article>", "a\nb"),
    ("<article><p>cut <b", "cut"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<article><header><h1>Title</h1></header><p>x</article><p>outside", "Title\nx"),
    ("<ARTICLE><P>up</P></ARTICLE>", "up"),
    ("<article><p>a</b></i>b</p></article></div></body>", "ab"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>x</article>', "Title\nx"),
    ('<article><section class="related work"><p>On related work.</p></section><div id="search"><p>We search.</p></div></article>', "On related work.\nWe search."),
    ('<article class="social history"><p>The guilds</p></article>', "The guilds"),
    ('<article><p>a <span class="form">form</span> and <math><mi>x</mi></math></p><div class="comments">bad</div></article>', "a form and x"),
    ('<p>a <b title="never closed>x</p><p>y', "a x\ny"),
]


def test_very_long_and_broken_pages_take_linear_time():
    import time

    for piece in ("<a ", '<a x="', "<a '", "<!--", "<p>&amp;", '<b "<b \'', "<div>", "</p>"):
        began = time.perf_counter()
        html_text.Page("<p>start" + piece * 40_000).main_text(frozenset())
        assert time.perf_counter() - began < 20, piece


def test_templates_decide_on_pages_without_an_article(spark):
    """Brute force: of pages without names or places that tell, blocks that recur on many pages of the host go, all others stay."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    fixed = {h: [" ".join(word() for _ in range(5)) for _ in range(4)] for h in ("a", "b")}
    rows, expected = [], {}
    for i in range(40):
        host = "ab"[i % 2]
        own = [" ".join(word() for _ in range(12)) for _ in range(rnd.randint(1, 4))]
        parts = [f"<div><div>{t}</div></div>" for t in fixed[host][:2]] + [f"<div><p>{t}</p></div>" for t in own] + [f"<div><ul><li>{t}</ul></div>" for t in fixed[host][2:]]
        rows.append((i, f"http://{host}.example/{i}", f"<body>{''.join(parts)}</body>"))
        expected[i] = "\n".join(own)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


@pytest.mark.parametrize("source,expected", PAGES)
def test_main_text(source, expected):
    assert text_of(source) == expected


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_templates_go_and_articles_stay(spark, broadcast):
    shared = "<p>A license line that all articles share, word for word.</p>"
    page = lambda i: f"<body><div><div>Best site in town</div><ul><li>Home<li>About</ul></div><div><p>Story {i} is told here.</p>{shared}</div><div>All rights kept</div></body>"
    art = lambda i: f"<body><div>Top of the page</div><article><p>News {i}</p>{shared}</article></body>"
    rows = [(i, "https://one.example/p", page(i)) for i in range(12)] + [(100 + i, "http://two.example:80/x?y", art(i)) for i in range(9)]
    rows += [(200 + i, "http://copies.example", "<body><div><p>Same article everywhere.</p></div></body>") for i in range(20)]
    rows += [(300, None, "<p>alone</p>"), (301, "http://x", None), (302, "", ""), (None, "nonsense", "<p>no host"), (None, "nonsense", "<p>no host")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df, broadcast=broadcast).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    license_line = "A license line that all articles share, word for word."
    for i in range(9):
        assert by[100 + i]["text"] == f"News {i}\n{license_line}"
    for i in range(12):
        assert by[i]["text"].split("\n")[0] == f"Story {i} is told here."
        assert "town" not in by[i]["text"] and "rights" not in by[i]["text"] and "About" not in by[i]["text"]
    assert by[205]["text"] == "Same article everywhere."
    assert by[300]["text"] == "alone" and by[301]["text"] == "" and by[302]["n_chars"] == 0 and by[None]["text"] == "no host"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.predict_all(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_equal_brute_force_em():
    """The proportions of every set of languages that the model may choose, by EM over single n-grams."""
    rnd = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], rnd.integers(0, 50, (3, 1 << language.BITS)) * (rnd.random((3, 1 << language.BITS)) < 0.05))
    text = "".join(rnd.choice(list("abcdefghij klm"), 3000))
    chosen, share = model.mixture(text)
    p, w = model.p[language.grams(text)][:, chosen], np.full(len(chosen), 1 / len(chosen))
    for _ in range(500):
        w = (p * w / (p @ w)[:, None]).mean(axis=0)
    assert share == pytest.approx(w, abs=0.02)
    best = max(np.log(model.p[language.grams(text)][:, i]).sum() for i in range(3))
    assert np.log(p @ share).sum() >= best - 1e-6


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(1, "the cat of the house", "en"), (2, "\u00bd \u00b2 7", None), (3, "\u00e9", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_all(docs).collect()}
    assert got[2] == "und" and got[3] in ("en", "und")


def test_language_mixtures_and_odd_rows(spark):
    rnd = random.Random(1)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, make("abcde", 60), "xx") for i in range(30)] + [(100 + i, make("lmnop", 60), "yy") for i in range(30)]
    rows += [(200, None, "xx"), (201, "", "xx"), (202, "12 34 ?!", "yy"), (203, make("abcde", 90) + " " + make("lmnop", 30), None), (None, make("lmnop", 40), None), (None, make("lmnop", 40), None)]
    df = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.predict_all(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[d]["lang_pred"] for d in (200, 201, 202)] == ["und"] * 3 and by[200]["score"] == 0
    assert by[203]["lang_pred"] == "xx" and 0.6 < by[203]["score"] < 0.9
    assert by[None]["lang_pred"] == "yy" and by[None]["held_out"]
    assert all(r["lang_pred"] == "xx" for r in got if r["doc_id"] is not None and r["doc_id"] < 30)
    unlabelled = language.predict_all(df.withColumn("lang", df["lang"].substr(100, 1)).where("doc_id = 203"))
    assert [r["lang_pred"] for r in unlabelled.collect()] == ["und"]
    assert language.predict_all(df.limit(0)).count() == 0


def brute_base(rows, folds=10):
    train = Counter()
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % folds == 0
    for d, t in rows:
        if not held(d):
            train.update(words(t))
            train["end"] += 1
    total, distinct = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        tokens = [*words(t), "end"]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((d, held(d), len(tokens), sum(train[w] > 0 for w in tokens), total, base))
    return out


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_lm_base_is_exact_and_the_model_is_better(spark, sf_dir, broadcast):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "UNSEENWORD zzqy \x02"), (None, "the of"), (9004, "the  the\tthe\n")]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, c int, score string")
    got = {r["doc_id"]: r for r in lm.score_texts(df, broadcast_words=broadcast).collect()}
    assert len(got) == len(rows)
    for d, held, n, known, total, base in brute_base(rows):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_joins_only_words_that_were_not_sent(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "UNSEENWORD zzqy"), (9004, "unseenword zzqy zzqy"), (7, "the copy"), (7, "the copy"), (None, "zzqy"), (None, "zzqy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for d, t in rows if zlib.crc32(str(d if d is not None else "").encode()) % 10 for w in (t or "").encode().lower().split())
    limit = 2000
    least = lm.least_sent(lm.word_counts(df.selectExpr("text", "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 != 0 AS training")), limit)
    assert sum(c >= least for c in counts.values()) <= limit < sum(c >= least - 1 for c in counts.values())
    joined, whole_texts = [], lm.whole_texts
    monkeypatch.setattr(lm, "whole_texts", lambda made, *rest: joined.append(made.count()) or whole_texts(made, *rest))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])
    got, want = (sorted(lm.score_texts(df, broadcast_words=n).collect(), key=key) for n in (limit, 10**6))
    words = [w for _, t in rows for w in (t or "").encode().lower().split()]
    assert joined == [len(rows) + sum(counts[w] < least for w in words)] and joined[0] < 0.5 * len(words)
    assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in want]
    for i in ("base_score", "score"):
        assert [r[i] for r in got] == pytest.approx([r[i] for r in want], rel=1e-9)


def test_lm_probabilities_add_up_to_one(spark):
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = sorted({w for _, t in rows for w in t.split()})
    both = df.unionByName(spark.createDataFrame([(10_000_000 + i, w) for i, w in enumerate([*words, "neverseen", ""])], df.schema))
    held = [r for r in lm.score_texts(both.where("doc_id < 10000000 or crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")).collect()]
    assert held and all(r["score"] <= 0 for r in held)
    base = lm.word_counts(df.selectExpr("text", "true AS training"))
    t = base.selectExpr("sum(c) n", "count(*) v", "count_if(c=1) o").first()
    total, distinct = t["n"] + 60, t["v"] + 1
    discount, unseen = lm.discounted(total, distinct, t["o"])
    assert sum((r["c"] - discount) / total for r in base.collect()) + (60 - discount) / total + unseen == pytest.approx(1)


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = lm.score_texts(df).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score_texts(df.limit(0)).count() == 0


def test_lm_looks_at_words_before(spark):
    order = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(order)) for i in range(1, 60)] + [(100 + i, " ".join(order[i % 30 :] + order[: i % 30][::-1])) for i in range(60)]
    df = spark.createDataFrame(rows + [(1000, " ".join(order)), (1001, " ".join(order[::2] + order[1::2]))], "doc_id long, text string")
    one, other = ({r["doc_id"]: r["score"] for r in lm.score_texts(df, broadcast_words=n).collect()} for n in (10**6, 0))
    assert one == pytest.approx(other, rel=1e-5)
    assert one[1000] > one[1001] + 10  # the same words in another order


def test_filter_gives_back_quantised_counts():
    rnd = np.random.default_rng(5)
    codes, counts = np.unique(rnd.integers(0, 1 << lm.CODE_BITS, 3000).astype(np.uint64)), rnd.integers(1, 100_000, 3000)[: len(np.unique(rnd.integers(0, 1, 1)))]
    counts = rnd.integers(1, 100_000, len(codes))
    level = lm.levels(counts)
    segments = [np.zeros(1 << 10, dtype=np.uint64) for _ in range(lm.SEGMENTS)]
    where = lm.Filter.segment(codes).astype(int)
    for i in range(lm.SEGMENTS):
        lm.Filter.fill(segments[i], codes[where == i], level[where == i])
    sizes = np.full(lm.SEGMENTS, 1 << 10)
    known = lm.Filter(np.concatenate(segments), sizes, int(level.max()))
    found = known.counts(codes)
    assert (found >= lm.level_values()[level - 1]).all()
    assert np.median(found / counts) < 1.2 and (known.counts(codes ^ np.uint64(1 << 40)) == 0).mean() > 0.5
    full = lm.Filter(np.full(4 * lm.SEGMENTS, ~np.uint64(0)), np.full(lm.SEGMENTS, 4), 9)  # the search ends at the highest level
    assert (full.counts(codes) == 9).all()


def test_runs_are_packed_and_unpacked():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 5000):
        codes = np.unique(rnd.integers(0, 1 << lm.CODE_BITS, size).astype(np.uint64))
        n = rnd.integers(1, 3, len(codes)) * rnd.integers(1, 10**12, len(codes)) ** rnd.integers(0, 2, len(codes))
        got = lm.unpacked(lm.packed(codes, n))
        assert (got[0] == codes).all() and (got[1] == n).all()


def brute_lm(rows, no_context=False):
    """Scores with back-off by exact counts of word n-grams, quantised, over the unigram of the base score's events."""
    from collections import Counter
    from zlib import crc32

    words = {d: [*(t or "").lower().split()] for d, t in rows}
    held = {d: crc32(str(d).encode()) % lm.FOLDS == 0 for d in words}
    grams = Counter()
    for d, w in words.items():
        if not held[d]:
            events = ["<s>", *w, "</s>"]
            grams.update((e,) for e in events)
            grams.update(zip(events, events[1:]))
    count = lambda g: lm.level_values()[lm.levels(np.array([grams[g]]))[0] - 1] if grams[g] and not no_context else 0.0
    out = {}
    for d, w in words.items():
        events, pairs = ["<s>", *w, "</s>"], []
        for one, two in zip(events, events[1:]):
            seen, before = count((one, two)), count((one,))
            weight = lm.CONTEXT_WEIGHT * before**lm.CONTEXT_POWER if before else 1.0
            pairs.append((two, min(seen, before) / (before + weight), weight / (before + weight)))
        out[d] = pairs
    return out


def test_scores_equal_brute_force_and_come_from_the_filter(spark, monkeypatch):
    monkeypatch.setattr(lm, "ENTRY_BITS", 400)  # no false positives to speak of
    monkeypatch.setattr(lm, "CHUNK", 500)  # several runs a task
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    phrases = [[rnd.choice(vocab) for _ in range(12)] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(rnd.randint(1, 4)) for w in rnd.choice(phrases))) for i in range(150)] + [(900, None), (901, ""), (902, "v1 new words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df).collect()}
    base = df.selectExpr("text", "crc32(cast(cast(doc_id as string) as binary)) % 10 != 0 AS training")
    words = lm.word_counts(base)
    t = words.selectExpr("sum(c) n", "count_if(c > 0) v", "count_if(c = 1) o").first()
    ends = base.where("training").count()
    total = t["n"] + ends
    discount, unseen = lm.discounted(total, t["v"] + 1, t["o"])
    c = {r["word"].decode(): r["c"] for r in words.collect()} | {"</s>": ends}
    p_of = lambda w: (c[w] - discount) / total if c[w] else unseen
    for d, pairs in brute_lm(rows).items():
        assert got[d] == pytest.approx(sum(np.log10(a + b * p_of(w)) for w, a, b in pairs), rel=1e-4)
    without = sum(np.log10(a + b * p_of(w)) for d, pairs in brute_lm(rows, no_context=True).items() for w, a, b in pairs)
    assert sum(got.values()) > 0.5 * without  # log10: without the filter the texts are less than half as likely in bits


def test_chunks_cover_and_resist_shifts():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 15, 16, 31, 200, 5000, 100_000):
        data = rnd.integers(97, 123, n, dtype=np.uint8).tobytes()
        ends = substrings.cuts(data)
        assert (ends[-1] == n if n else len(ends) == 0) and (np.diff(ends, prepend=0) > 0).all() and (np.diff(ends, prepend=0) <= substrings.MAX).all()
    assert (np.diff(substrings.cuts(b"a" * 5000), prepend=0) <= substrings.MAX).all()
    passage = rnd.integers(97, 123, 3000, dtype=np.uint8).tobytes()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *substrings.cuts(d)[:-1]], substrings.cuts(d))}
    shared = pieces(b"x" * 101 + passage) & pieces(b"another start, " + passage + b"end")
    assert sum(map(len, shared)) > 2700


def test_hash_equals_spark(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2**62, -(2**63), 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d long").select(F.xxhash64("d")).collect()]
    assert substrings.xxhash64_longs(np.array(values, dtype=np.int64)).astype(np.int64).tolist() == got


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passages = [text(n) for n in (60, 60, 70, 80, 100, 150, 200, 400)]
    short = text(8)
    rows, holders = [], {}
    for i in range(120):
        parts = [text(80), text(90)]
        if i % 3 == 0:
            p = rnd.randrange(len(passages))
            parts.insert(1, passages[p])
            holders.setdefault(p, []).append(i)
        if i % 3 == 1:
            parts.insert(1, short)
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (None, "x"), (502, "word " * 3000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, no int, spans string")
    got = {r["doc_id"]: r for r in substrings.repeats(df).collect()}
    assert len(got) == len(rows)
    for p, who in holders.items():
        if len(who) > 1:
            assert got[who[0]]["removed_words"] == 0 and got[who[0]]["repeated_words"] > 0
            for i in who[1:]:
                n = len(passages[p].split())
                assert n - 25 <= got[i]["removed_words"] <= n + 2
    for i in range(120):
        if i % 3:
            assert got[i]["repeated_words"] == 0 and got[i]["spans"] == []
    assert got[500]["n_chunks"] == 0 and got[501]["n_bytes"] == 0
    cut = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df).collect()}
    for i, t in rows:
        removed = sum(s["end"] - s["start"] for s in got[i]["spans"])
        assert (cut[i] is None) if t is None else len(t.encode()) - removed <= len(cut[i].encode()) <= len(t.encode()) - removed + 8 * len(got[i]["spans"])
    assert substrings.repeats(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(80)))] * 2 + [(2, "x y " + " ".join(f"word{i}" for i in range(80)))]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["removed_words"] > 40) for r in got) == [(1, False), (1, False), (2, True)]


def test_lm_counts_are_kept_to_a_tenth():
    counts = np.arange(1, 5000)
    assert np.abs(np.log(lm.level_values()[lm.levels(counts) - 1] / counts)).max() < 0.1
