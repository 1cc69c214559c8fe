"""Raw parser output and replies with drifting JSON."""

from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.sources import canonical

RAW = [
    (1, '{"provider": "p", "pages": [{"page_number": 7, "width": 10.5, "blocks": [{"text": " T ", "type": "heading", "level": 3, "bbox": [1, 2]}, {"markdown": "**b** <i>c</i>", "reading_order": 9, "id": "x"}, {"type": "list"}]}, {"text": "# H\\n\\n- a\\n- b\\npara\\n| x | y |", "source_text": "s"}], "warnings": ["bare", {"code": "c", "page_number": 2, "message": "m"}]}'),
    (2, "not json"), (3, None), (4, '{"pages": []}'), (5, '{"pages": [{"markdown": "", "text": "only text"}, {"page_number": 0}]}'), (6, "[1]"),
]


def test_blocks_and_warnings(spark):
    raw = spark.createDataFrame(RAW, "doc_id int, raw string")
    pages = {(r["doc_id"], r["page_no"]): r for r in canonical.pages(raw).collect()}
    assert set(pages) == {(1, 7), (1, 2), (5, 1), (5, 2)} and pages[1, 7]["width"] == 10.5 and pages[1, 7]["page_id"] == "page_007" and pages[5, 1]["markdown"] == "only text"
    made = canonical.blocks(raw)
    got = [(r["block_id"], r["type"], r["text"], r["markdown"], r["level"], r["reading_order"]) for r in made.where("doc_id = 1").orderBy("block_id").collect()]
    assert got == [
        ("block_000001", "heading", "T", "### T", 3, 1), ("block_000002", "paragraph", "b c", "**b** <i>c</i>", None, 9), ("block_000003", "list", "", "", None, 3),
        ("block_000004", "heading", "H", "# H", 1, 1), ("block_000005", "list", "a b", "- a\n- b", None, 2), ("block_000006", "paragraph", "para", "para", None, 3), ("block_000007", "table", "x y", "| x | y |", None, 4),
    ]
    told = {(r["doc_id"], r["code"]): r["n"] for r in canonical.warnings(raw, made).groupBy("doc_id", "code").agg(F.count("*").alias("n")).collect()}
    assert told == {(1, "parser"): 1, (1, "c"): 1, (1, "missing_bbox"): 6, (2, "no_pages"): 1, (3, "no_pages"): 1, (4, "no_pages"): 1, (6, "no_pages"): 1, (5, "missing_bbox"): 1}
    assert canonical.blocks(raw.limit(0)).count() == 0


def test_replies(spark):
    rows = [(None, None), ("", "{}"), (" plain ", '{"usage": {"cost": 0.5}}'), ('{"markdown": null, "md": "x"}', '{"usage": {"cost": 0}, "cost": "2"}'), ('{"text": "t", "content": "c"}', '{"usage": {"total_cost": 3}, "cost_usd": 1}'), ('{"a": 1}', '{"cost": "dear"}'), ('"quoted"', "nonsense"), ("12", '{"usage": null, "cost_usd": 4}'), ("[1, 2]", '{"usage": {"cost": null}, "total_cost": 7}')]
    got = canonical.with_replies(spark.createDataFrame(rows, "reply string, response string"), "reply", "response").collect()
    assert [r["markdown"] for r in got] == ["", "", "plain", "", "t", "", "quoted", "12", "[1,2]"]
    assert [r["cost"] for r in got] == [0.0, 0.0, 0.5, 2.0, 3.0, 0.0, 0.0, 4.0, 7.0]
    assert [r["reply_warning"] is not None for r in got] == [True, True] + [False] * 7


def test_tolerant_lists(spark):
    df = spark.createDataFrame([('["a", "b"]',), (None,), ("",), ("{}",), ("[1]",), ("x",)], "t string")
    assert [r[0] for r in df.select(canonical.tolerant_list(F.col("t"))).collect()] == [["a", "b"], [], [], [], ["1"], []]


def test_headings_are_not_indented():
    assert [b["type"] for b in folds.blocks("  # x\n# y  \n####### z")] == ["paragraph", "heading", "paragraph"]
