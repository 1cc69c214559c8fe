"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators import layout, quality, records, references, trees
from quirekit.plans import catalog
from quirekit.sources import readers
from quirekit.streaming import jobs


def test_scores_of_literal_pages(spark):
    truth = "The quick brown fox jumps over the lazy dog. Section one covers setup."
    rows = [(1, truth, truth, "text", None), (2, truth, "The fox.", "text", None), (3, "", "x", "visual", None), (4, "", "x", "visual", 1.0), (5, "", None, "text", None), (6, truth, f"{truth}\nintentionally omitted", "text", None), (7, None, None, "text", None)]
    df = spark.createDataFrame(rows, "page_no int, truth string, md string, kind string, judge double")
    got = {r["page_no"]: r for r in quality.score_pages(df, ["page_no"], "truth", "md", "kind", "judge").collect()}
    assert got[1]["verdict"] == "pass" and got[1]["recall"] == 1.0 and got[1]["extra"] == 0.0
    assert got[2]["recall"] < 0.85 and "low text recall" in got[2]["notes"]
    assert got[3]["verdict"] == "review" and got[4]["composite"] == 1.0
    assert got[5]["recall"] == 1.0 and got[7]["extra"] == 0.0
    assert got[6]["composite"] < 0.7 and any("picture omitted" in n for n in got[6]["notes"])


def test_tables_in_texts(spark):
    rows = [("a  b  c\nd  e  f\ng  h  i", "| a | b |\n|---|---|\n| 1 | 2 |"), ("a  b  c\nd  e  f\ng  h  i", "none"), ("plain", "| a |")]
    got = spark.createDataFrame(rows, "t string, m string").select(quality.table_score(F.col("t"), F.col("m")).alias("s"), T.table_cells(F.col("m")).alias("n")).collect()
    assert [(r["s"], r["n"]) for r in got] == [(1.0, 4), (0.0, 0), (None, 1)]
    cells = spark.createDataFrame([("| a \\| b | c |",), ("a|b",), ("| x |",)], "r string").select(T.cell_count(F.col("r"))).collect()
    assert [r[0] for r in cells] == [2, 2, 1]


def test_adoption(spark):
    rows = [(1, 0.5, 0.9, 0.9, 1.0, 1.0), (2, 0.5, 0.4, 0.3, 1.0, 0.95), (3, 0.5, 0.5, None, 1.0, None), (4, 0.5, None, 0.9, 1.0, 0.5), (5, 0.5, 0.6, 0.8, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "page_no int, base double, vlm double, cleanup double, base_content double, cleanup_content double")
    got = {r["page_no"]: (r["method"], r["recorded"]) for r in quality.adopt(df, ["page_no"]).collect()}
    assert got == {1: ("vlm", "vlm"), 2: ("cleanup", "cleanup"), 3: ("baseline", "vlm"), 4: ("baseline", "cleanup"), 5: ("cleanup", "cleanup")}


def test_second_parse_must_be_better(spark):
    rows = [(1.0, 0.22, None, 0.99, 0.01, None), (1.0, 0.22, None, 0.43, 0.02, None), (None,) * 6]
    df = spark.createDataFrame(rows, "lr double, le double, lt double, cr double, ce double, ct double")
    c = {k: F.col(k) for k in df.columns}
    got = df.select(quality.cloud_is_better({"recall": c["lr"], "extra": c["le"], "table": c["lt"]}, {"recall": c["cr"], "extra": c["ce"], "table": c["ct"]})).collect()
    assert [r[0] for r in got] == [True, False, False]


def page_lines(spark, pages):
    rows = [(1, n, i, line) for n, text in pages for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, line string")


def test_cleaning_of_stamps_and_sign_offs(spark):
    text = "# **FARM HANDBOOK**\nPage {n} of 3\nbody {n}\n| Prepared by: R. Stone | Approved by: L. Field |\n|---|---|\n| Soil approved by the lab | yes |\n> Pg {n} of 3"
    lines = page_lines(spark, [(n, text.format(n=n)) for n in (1, 2, 3)])
    left = layout.joined(layout.cleaned(lines, layout.boilerplate(lines).where("normal like '%handbook%'")), ["doc_id", "page_no"]).orderBy("page_no").collect()
    assert [r["markdown"] for r in left] == [f"body {n}\n| Soil approved by the lab | yes |" for n in (1, 2, 3)]


def test_furniture_thresholds(spark):
    lines = page_lines(spark, [(n, f"Running head {n}\n{'abc' if n < 3 else 'words of page'} {n}") for n in range(1, 6)])
    assert {(r["normal"], r["n"]) for r in layout.furniture(lines).collect()} == {("running head #", 5), ("words of page #", 3)}
    assert layout.furniture(lines.where("page_no < 3")).count() == 0


def test_only_real_changes_are_finalized(spark):
    make = lambda rows: spark.createDataFrame(rows, "page_no int, markdown string")
    got = layout.finalized(make([(1, "a"), (2, "b"), (3, "c ")]), make([(1, "a2"), (2, ""), (3, "c")]), ["page_no"]).collect()
    assert [(r["page_no"], r["new"]) for r in got] == [(1, "a2")]


@pytest.fixture()
def tree(spark):
    rows = [(1, 1, None, 0, "1. Alpha", "a", 1, 2, True), (1, 2, 1, 0, "1.1 Alpha-One", "b", 2, 0, False), (1, 3, None, 1, "2. Beta", "c", 3, 4, True), (1, 4, 2, 0, "Deep", "", 2, 2, True)]
    return trees.nested_set(spark.createDataFrame(rows, "doc_id int, id int, parent_id int, ord int, title string, markdown string, page_start int, page_end int, included boolean"))


def numbers(tree):
    return {r["id"]: (r["level"], r["lft"], r["rgt"]) for r in tree.collect()}


def test_nested_set_and_ancestors(tree):
    assert numbers(tree) == {1: (1, 1, 6), 2: (2, 2, 5), 4: (3, 3, 4), 3: (1, 7, 8)}
    assert {r["id"]: r["ancestor"] for r in trees.nearest_included(tree).collect()} == {1: None, 4: 1, 3: None}


def test_moving_and_its_guard(tree):
    moved = trees.moved(tree, 1, 3, 1, 0)
    assert numbers(moved) == {1: (1, 1, 8), 3: (2, 2, 3), 2: (2, 4, 7), 4: (3, 5, 6)}
    with pytest.raises(ValueError):
        trees.moved(tree, 1, 1, 4)
    with pytest.raises(ValueError):
        trees.moved(tree, 1, 99, None)


def test_merging_and_deleting(spark, tree):
    merged = {r["id"]: r for r in trees.merged(tree, 1, [3, 1]).collect()}
    assert set(merged) == {2, 3, 4} and merged[3]["markdown"] == "a\n\nc" and (merged[3]["page_start"], merged[3]["page_end"]) == (1, 4)
    assert merged[2]["parent_id"] == 3
    with pytest.raises(ValueError):
        trees.merged(tree, 1, [1, 4])
    left = trees.without_subtree(tree, spark.createDataFrame([(1, 2)], "doc_id int, id int"))
    assert {r["id"] for r in left.collect()} == {1, 3}


def test_parents_by_path(spark):
    rows = [(1, 0, ["A"]), (1, 1, ["A", "B"]), (1, 2, ["A"]), (1, 3, ["A", "B"]), (1, 4, ["Z", "Q"]), (2, 0, ["A", "B"])]
    got = {(r["doc_id"], r["ord"]): (r["parent_ord"], r["is_group"]) for r in trees.parents_by_path(spark.createDataFrame(rows, "doc_id int, ord int, path array<string>")).collect()}
    assert got == {(1, 0): (None, True), (1, 1): (0, False), (1, 2): (None, True), (1, 3): (2, False), (1, 4): (None, False), (2, 0): (None, False)}


def test_routes_and_contents(tree):
    routes = {r["id"]: r["route"] for r in trees.slug_routes(tree).collect()}
    assert routes == {1: "wiki/1-alpha", 2: "wiki/1-alpha/1-1-alpha-one", 4: "wiki/1-alpha/1-1-alpha-one/deep", 3: "wiki/2-beta"}
    blank = tree.withColumn("markdown", F.lit(""))
    got = {r["id"]: r["content"] for r in trees.contents(blank, trees.slug_routes(tree)).collect()}
    assert got[1] == "## Contents\n\n- [1.1 Alpha-One](/wiki/1-alpha/1-1-alpha-one)\n" and set(got) == {1, 2}


def old_unique(titles):
    taken, out = set(), []
    for title in titles:
        base = name = folds.slug(title)
        n = 2
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


def test_slugs_among_many_siblings_are_ranked_not_searched(spark, monkeypatch):
    rnd = random.Random(4)
    titles = [rnd.choice(["A", "A 2", "A 2 2", "A-3", "B", "B 9", "C 7", "", "\u00e9", "x" * 70, "A 02"]) for _ in range(400)]
    rows = [(1, 0, None, 0, "Top")] + [(1, i + 1, 0 if i % 3 else (None if i % 2 else 999), i + 1, t) for i, t in enumerate(titles)] + [(1, 1000, 2, 999, None)]
    got = {r["id"]: (r["slug"], r["route"]) for r in trees.slug_routes(spark.createDataFrame(rows, "doc_id int, id int, parent_id int, lft int, title string")).collect()}
    names = {}
    for parent in {r[2] for r in rows}:
        some = [r for r in rows if r[2] == parent]
        names |= dict(zip((r[1] for r in some), old_unique(r[4] or "" for r in some)))
    route = lambda i, above={r[1]: r[2] for r in rows}: (route(above[i]) if above[i] in above else "wiki") + f"/{names[i]}"
    assert got == {i: (n, route(i)) for i, n in names.items()}
    many = spark.range(1, 60_001).selectExpr("1 AS doc_id", "id", "cast(null as long) AS parent_id", "id AS lft", "'Same' AS title")
    assert {r["slug"] for r in trees.slug_routes(many).where("id in (1, 2, 60000)").collect()} == {"same", "same-2", "same-60000"}
    assert folds.unique_slugs(["Same"] * 60_000)[-1] == "same-60000"  # by search from 2 on: 1.8 billion steps


def calls_of_groups(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups")


def test_documents_are_read_one_after_the_other(spark):
    rows = [(d, n, f"# {d}.{n} Title\ntext of {d}" if d % 3 else f"only text {n}") for d in [None, *range(900)] for n in range(1, 4) if d is not None] + [(None, 2, None), (None, 1, "# 1 Null's\na"), (5000, 1, None)]
    found = trees.sectionize(spark.createDataFrame(rows, "doc_id int, page_no int, markdown string").repartition(7))
    assert not calls_of_groups(found)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = []
    for d in {r[0] for r in rows}:
        want += [(d, i, *s.values()) for i, s in enumerate(folds.sections([(n, t or "") for _, n, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1])]))]
    assert [(*r[:4], r[4], *r[5:]) for r in got] == sorted(want, key=str) and len(got) > 1500


def test_links_lead_to_the_shortest_section_over_a_page(spark):
    rnd = random.Random(8)
    rows, routes = [], []
    for d in range(40):
        for i in range(30):
            start = rnd.choice([None, 0, *range(1, 25)])
            rows.append((d, i, rnd.randint(0, 5), start, None if start is None else start + rnd.choice([0, 0, 1, 3, 9, 40]), 20, f"See page {rnd.randint(0, 30)}, page {i} and refer to p. {rnd.randint(1, 20)}"))
            if rnd.random() < 0.9:
                routes.append((d, i, rnd.choice(["", f"r/{d}/{i}", f"r/{d}/{i}", None])))
    sections = spark.createDataFrame(rows, "doc_id int, id int, ord int, page_start int, page_end int, page_count int, markdown string")
    found = references.with_links(sections, spark.createDataFrame(routes, "doc_id int, id int, route string"))
    assert not calls_of_groups(found)
    named, want = {(d, i): r for d, i, r in routes}, {}
    for d in range(40):
        some = sorted((r for r in rows if r[0] == d and (d, r[1]) in named), key=lambda r: (r[2], r[1]))
        fits = lambda page, some=some: min(((r[4] - r[3], k) for k, r in enumerate(some) if r[3] and r[4] and r[3] <= page <= r[4]), default=None)
        route_of = lambda page, some=some, d=d: named[d, some[fits(page)[1]][1]] if fits(page) else None
        want |= {(d, r[1]): folds.linked(r[6], 20, route_of, named[d, r[1]]) for r in some}
    assert {(r["doc_id"], r["id"]): (r["content"], r["links"]) for r in found.collect()} == want and any(n for _, n in want.values())
    whole = spark.range(1, 3001).selectExpr("1 AS doc_id", "id", "id AS ord", "1 AS page_start", "9999 AS page_end", "9999 AS page_count", "'See page 7' AS markdown")
    assert references.with_links(whole, whole.selectExpr("doc_id", "id", "concat('r', id) AS route")).where("links = 1 and content = '[See page 7](/r1)'").count() == 2999


def most_alive(monkeypatch, module, name):
    """The most results of a function of a module that live at once."""
    alive, most, plain = [0], [0], getattr(module, name)

    class Held(plain):
        def __init__(self, *given):
            super().__init__(*given)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    monkeypatch.setattr(module, name, Held)
    return most


def test_tokens_of_one_row_are_held_at_once(spark, monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(quality.F, "arrow_udf", lambda schema: lambda f: lambda *columns: made.append(f))
    most = most_alive(monkeypatch, quality, "Counter")
    quality.counts_in_row(F.lit(""), F.lit(""), tags=True)
    a, b = pa.array(["a b b <i> c", None, ""] * 1000), pa.array(["b b b c", "x", None] * 1000)
    got = [r for x in made[0](iter([(a, b), (a[:0], b[:0])])) for r in x.to_pylist()]
    assert got[:3] == [{"n_truth": 4, "n_md": 4, "common": 3}, {"n_truth": 0, "n_md": 1, "common": 0}, {"n_truth": 0, "n_md": 0, "common": 0}] and len(got) == 3000
    assert most[0] <= 6


def test_texts_are_worked_on_a_few_at_once(spark):
    many = spark.range(0, 5000, 1, 1).selectExpr("id", "if(id % 3 = 0, null, '| a |') AS t")

    def one(text, seen=[0]):  # noqa: B006
        seen[0] += 1
        return [(seen[0],)] if text else []

    # rows come out a few texts at a time: the reader that stops early has not had them all worked on
    found = references.per_text(many, ["id"], "t", "n int", one)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["n"] for r in found.orderBy("id").collect()] == [i + 1 for i in range(5000) if i % 3]
    assert references.TEXTS <= 256


SECTIONS = [
    (1, 1, "Alpha", 1, 2, "see page 5 and see page 5. Williams p. 820. page 3. see page 1. see page 99"),
    (1, 2, "Beta", 3, 4, "Refer Page No. 5"),
    (1, 3, "Gamma", 5, 6, ""),
    (1, 4, "Gamma Detail", 5, 5, None),
]


def test_references_and_degrees(spark):
    s = spark.createDataFrame([(d, i, i, t, a, b, m) for d, i, t, a, b, m in SECTIONS], "doc_id int, id int, ord int, title string, page_start int, page_end int, markdown string")
    counts = spark.createDataFrame([(1, 6)], "doc_id int, page_count int")
    found = references.extract(s, counts)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 4, 5, "see page 5", 2), (1, 2, 4, 5, "Refer Page No. 5", 1)}
    assert {tuple(r["anchors"]) for r in references.weighted_edges(found).collect()} == {("see page 5",), ("Refer Page No. 5",)}
    degree = {r["id"]: r["degree"] for r in references.degrees(references.weighted_edges(found), s).collect()}
    assert degree == {4: 3, 1: 2, 2: 1, 3: 0}
    again = references.extract(s.where("id <> 4"), counts)
    assert {(r["from_id"], r["to_id"]) for r in again.collect()} == {(1, 3), (2, 3)}
    nodes, edges = references.graph(s.withColumn("parent_id", F.when(F.col("id") == 4, 3)), found)
    assert {r["rel"]: r["count"] for r in edges.groupBy("rel").count().collect()} == {"HAS_SECTION": 3, "PART_OF": 1, "REFERENCES": 2}


def test_smallest_cover(spark):
    spans = spark.createDataFrame([(1, "wide", 0, 1, 10), (1, "tight", 1, 5, 6), (1, "tie", 2, 6, 7), (1, "open", 3, None, None)], "doc_id int, id string, ord int, page_start int, page_end int")
    points = spark.createDataFrame([(1, n) for n in (3, 5, 6, 11)], "doc_id int, page int")
    assert {r["page"]: r["id"] for r in references.smallest_covering(points, spans).collect()} == {3: "wide", 5: "tight", 6: "tight"}


def test_covers_and_overlaps_equal_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(d, i, i, rnd.choice([None, 0, *range(1, 12)]), rnd.choice([None, 0, *range(1, 12)]), rnd.randint(1, 9), rnd.randint(5, 14)) for d in range(30) for i in range(8)]
    spans = spark.createDataFrame(rows, "doc_id int, id int, ord int, page_start int, page_end int, lft int, rgt int")
    points = spark.createDataFrame([(d, n) for d in range(30) for n in range(13)] * 2, "doc_id int, page int")
    real = [r for r in rows if r[3] and r[4] and r[3] <= r[4]]
    covers = {(d, n): [r for r in real if r[0] == d and r[3] <= n <= r[4]] for d in range(30) for n in range(13)}
    assert {tuple(r) for r in references.smallest_covering(points, spans).collect()} == {(d, n, min(c, key=lambda r: (r[4] - r[3], r[2]))[1]) for (d, n), c in covers.items() if c}
    deepest = {(d, n, a[1]) for (d, n), c in covers.items() for a in c if not any(a[5] < b[5] and b[6] < a[6] for b in c)}
    assert {tuple(r) for r in references.deepest_covering(points, spans).collect()} == deepest
    inside = lambda a, b: a[5] < b[5] and b[6] < a[6]
    pairs = {(a[0], a[1], b[1]) for a in real for b in real if a[0] == b[0] and a[1] != b[1] and a[3] <= b[4] and b[3] <= a[4] and not inside(a, b) and not inside(b, a)}
    got = [tuple(r) for r in references.overlapping(spans).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


def test_summary_folds_null_and_empty(spark):
    sections = spark.createDataFrame([("a",), ("",), (None,), ("gone",)], "section_type string")
    taxonomy = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "ord int, type_name string, label string")
    assert [(r["type_name"], r["n"]) for r in records.type_summary(sections, taxonomy).orderBy("ord").collect()] == [("a", 1), ("b", 0), (None, 2)]
    docs = spark.createDataFrame([("d", "p")], "doc_id string, project_id string")
    assert records.scoped(spark.createDataFrame([("d",), ("e",)], "doc_id string"), docs, project="none").count() == 0


def test_upsert_keeps_creation_time(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, v string, created_at string")
    got = records.upsert(make([(1, "a", "t0"), (2, "b", "t0")]), make([(2, "B", "t1"), (3, "C", "t1")]), ["id"])
    assert {tuple(r) for r in got.collect()} == {(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")}


def test_costs_with_unknown(spark):
    got = records.costs(spark.createDataFrame([("x", "a", 0.0021), ("x", "judge", 0.0009), ("x", "a", None)], "k string, label string, cost double"), ["k"]).first()
    assert (got["calls"], round(got["cost"], 6), got["cost_known"], round(got["parse_cost"], 6)) == (3, 0.003, False, 0.0021)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"page one\fpage two\f")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"only")
    got = readers.read_pages(spark, str(tmp_path), pages="1-2").select("page_no", "markdown").collect()
    assert sorted((r["page_no"], r["markdown"]) for r in got) == [(1, "only"), (1, "page one"), (2, "page two")]
    with pytest.raises(LookupError):
        readers.read_pages(spark, str(tmp_path), parser="nothing")

    def broken(data):
        raise ValueError("can't read")

    readers.register("broken", broken)
    assert {r["error"] for r in readers.read_pages(spark, str(tmp_path), parser="broken").collect()} == {"can't read"}
    assert readers.available()["plain"] and readers.profile({"a": 1, "b": 2}, {"a": 0, "b": ""}) == {"a": 0, "b": 2}


def test_models_that_fail_are_values(spark):
    def model(text):
        if "bad" in text:
            raise RuntimeError("no credit")
        return {"text": f"```markdown\n{text.upper()}\n```", "cost": 0.5}

    got = readers.with_model(spark.createDataFrame([(1, "good"), (2, "bad")], "page_no int, markdown string"), model).orderBy("page_no").collect()
    assert (got[0]["reply"], got[0]["cost"]) == ("GOOD", 0.5) and got[1]["reply"] is None and got[1]["model_error"] == "no credit"


def test_canonical_documents(spark, tmp_path):
    import json

    doc = {
        "document": {"id": "d1", "title": "T"},
        "parse_run": {"id": "r1", "profile": "p", "started_at": "t"},
        "pages": [{"id": "p1", "page_number": 1, "blocks": [{"id": "b1", "type": "table", "text": "x", "markdown": "x", "reading_order": 0}]}],
        "sections": [{"id": "s1", "title": "S", "level": 1, "block_ids": ["b1", "dangling"]}],
        "warnings": [],
    }
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "canonical.json").write_text(json.dumps(doc))
    tables = readers.graph_tables(readers.read_canonical(spark, str(tmp_path)))
    assert {(r["type"], r["label"]) for r in tables["nodes"].collect()} == {("document", "T"), ("page", "Page 1"), ("block", "Table"), ("section", "S")}
    assert sorted(r["type"] for r in tables["edges"].collect()) == ["BLOCK_PART_OF_SECTION", "DOCUMENT_HAS_PAGE", "PAGE_HAS_BLOCK"]


def test_seeding_twice(spark):
    empty = spark.createDataFrame([], "name string, label string")
    seeds = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, label string")
    once = readers.seeded(empty, seeds, "name")
    assert readers.seeded(once, seeds, "name").count() == 2


EVENTS = "job long, seq long, status string, cost double"


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 0, "parsing", 0.5), (2, 0, "parsing", None), (1, 1, "done", 0.25)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(EVENTS).parquet(str(source))
    for name, df in (("last", jobs.last_status(stream)), ("cost", jobs.costs(stream))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["job"], r["status"]) for r in spark.table("last").collect()} == {(1, "done"), (2, "parsing")}
    assert {(r["job"], r["cost"]) for r in spark.table("cost").collect()} == {(1, 0.75), (2, 0.0)}
    jobs.into_snapshot(stream, str(tmp_path / "snap"), ["job"], str(tmp_path / "c1")).awaitTermination()
    assert {(r["job"], r["status"]) for r in spark.read.parquet(str(tmp_path / "snap" / "batch=0")).collect()} == {(1, "done"), (2, "parsing")}
    jobs.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.schema(EVENTS).parquet(str(tmp_path / "log")).count() == 3


def test_state_machine_and_order(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "b")], "job int, seq int, status string")
    bad = records.invalid_steps(df, spark.createDataFrame([("a", "b")], "src string, dst string"), ["job"], [F.col("seq")]).collect()
    assert [(r["src"], r["dst"]) for r in bad] == [("b", "a")]
    assert {r["job"]: r["layers"] for r in records.distinct_in_order(df, ["job"], "seq", "status").collect()} == {1: "a,b", 2: "b"}
    assert [tuple(r) for r in records.replaced(df, df.limit(0), df.where("job = 2"), "job").select("job").distinct().collect()] == [(1,)]


def test_references_and_faults_of_the_body_are_read(spark, tmp_path):
    body = "| a | b |\n| 1 | 2 |\n\nSee page 2 for more.\nx"
    text = "\n".join([body] + ["more"] * 10)
    spark.createDataFrame([(4, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    edges = {(r["from_id"], r["to_id"]): r["occurrences"] for r in catalog.reference_edges(spark, str(tmp_path)).collect()}
    found = {r["code"]: r["n"] for r in catalog.lint_counts(spark, str(tmp_path)).collect()}
    degrees = {r["id"]: r["degree"] for r in catalog.node_degree(spark, str(tmp_path)).collect()}
    weights = {r["rel"]: r["weight"] for r in catalog.document_graph(spark, str(tmp_path)).collect()}
    assert edges[(1, 2)] == 1 and found["missing_separator"] == 1
    assert sum(degrees.values()) == 2 * sum(edges.values()) and weights["REFERENCES"] == sum(edges.values())


def test_trees_deeper_than_the_limit_are_an_error(spark):
    chain = spark.createDataFrame([(0, i, i - 1 if i > 1 else None, i) for i in range(1, 6)], "doc_id long, id long, parent_id long, ord long")
    got = {r["id"]: (r["level"], r["lft"], r["rgt"]) for r in trees.nested_set(chain, depth=4).collect()}
    assert got == {i: (i, i, 11 - i) for i in range(1, 6)}
    with pytest.raises(ValueError):
        trees.nested_set(chain, depth=3)
