"""Sections made again from their pages, against the line-by-line operators; who owns a page."""

import random

from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.operators import layout, rebuilding

LINES = ["# **FARM HANDBOOK**", "Page {n} of 9", "Ver: 2", "body {r}", "| Prepared by: R. Stone | Approved by: L. Field |", "|---|---|", "| A | B |", "| 1 | {r} |", "", "   ", "Éa  ünd {r}"]
SECTIONS = [(1, 1, 9, 1, 10), (2, 1, 4, 2, 5), (3, 3, 3, 3, 4), (4, 4, 6, 6, 7), (5, 7, 9, 8, 9), (6, None, 3, 11, 12), (7, 20, 21, 13, 14)]


def made(spark):
    rnd = random.Random(3)
    pages = [(d, n, "\n".join(rnd.choice(LINES).format(n=n, r=rnd.randint(0, 99)) for _ in range(rnd.randint(0, 9))) if rnd.random() > 0.05 else None) for d in range(12) for n in range(1, 10)]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, markdown string")
    tree = spark.createDataFrame([(d, *s) for d in range(12) for s in SECTIONS], "doc_id int, id int, page_start int, page_end int, lft int, rgt int")
    return pages, df, tree


def test_sections_from_pages(spark):
    pages, df, tree = made(spark)
    wanted = tree.where("id <> 5").select("doc_id", "id")
    got = {(r["doc_id"], r["id"]): r for r in rebuilding.rebuilt(df, tree, wanted.unionByName(wanted)).collect()}
    assert set(got) == {(d, i) for d in range(12) for i in (1, 2, 3, 4)}
    assert {i: got[0, i]["overlaps"] for i in (1, 2, 3, 4)} == {1: [], 2: [4], 3: [], 4: [2]}
    rows = [(d * 100 + i, n, k, line) for d, n, t in pages for i, s, e, _, _ in SECTIONS[:4] if s <= n <= e for k, line in enumerate((t or "").split("\n"))]
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, line string")
    texts: dict = {}
    for r in layout.joined(layout.cleaned(lines), ["doc_id", "page_no"]).orderBy("page_no").collect():
        texts.setdefault(divmod(r["doc_id"], 100), []).append(r["markdown"].strip())
    for key, r in got.items():
        assert r["markdown"] == folds.with_separators("\n\n".join(t for t in texts.get(key, []) if t)), key
        assert r["pages"] == {1: 9, 2: 4, 3: 1, 4: 3}[key[1]]
    assert rebuilding.rebuilt(df, tree, wanted.limit(0)).count() == 0


def test_owners(spark):
    _, df, tree = made(spark)
    points = spark.createDataFrame([(1, n) for n in (1, 3, 4, 5, 8, 12, 20)] + [(1, 3), (None, 1), (1, None), (77, 1)], "doc_id int, page int")
    found, again = rebuilding.propagated(points, df, tree)
    got = {(r["doc_id"], r["page"]): (r["n_owners"], r["owner"], r["state"]) for r in found.collect()}
    assert got == {(1, 1): (1, 2, "owned"), (1, 3): (1, 3, "owned"), (1, 4): (2, None, "shared"), (1, 5): (1, 4, "owned"), (1, 8): (1, 5, "owned"), (1, 12): (0, None, "no_owner"), (1, 20): (1, 7, "owned"), (77, 1): (0, None, "no_owner")}
    assert sorted(r["id"] for r in again.collect()) == [2, 3, 4, 5]  # section 7 has no pages


def test_cleaned_text_without_boilerplate(spark):
    df = spark.createDataFrame([("a\n| Prepared by: x | Issued by: y |\n|---|---|\n| keep | me |\nPage 1 of 2",), (None,)], "t string")
    got = [r[0] for r in df.select(layout.cleaned_text(F.col("t"), F.lit(None).cast("array<long>"))).collect()]
    assert got == ["a\n| keep | me |", ""]
