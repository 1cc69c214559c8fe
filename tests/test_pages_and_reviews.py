"""Page reviews, images, warnings, hybrid runs, types present and recall of content, on small tables."""

from quirekit.operators import quality, records


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pages_without_review_are_unreviewed(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id int, page_no int")
    reviews = spark.createDataFrame([(1, 1, "approved", None), (1, 2, "", "blurred")], "doc_id int, page_no int, status string, notes string")
    found = records.reviewed(pages, reviews, ["doc_id", "page_no"])
    assert rows(found) == [(1, 1, "approved", ""), (1, 2, "unreviewed", "blurred"), (1, 3, "unreviewed", "")]


def test_an_image_counts_once_at_its_first_big_place(spark):
    images = spark.createDataFrame([(1, 7, 0, 10, 10), (1, 7, 1, 500, 400), (1, 7, 2, 900, 900), (1, 8, 3, 499, 400)], "doc_id int, xref int, ordinal int, width int, height int")
    assert rows(records.big_images(images, ["doc_id"])) == [(1, 7, 1)]


def test_warnings_of_the_document_show_on_each_page(spark):
    w = spark.createDataFrame([(1, "own"), (2, "other"), (None, "all")], "page_no int, code string")
    assert [r[1] for r in rows(records.of_page(w, 1))] == ["own", "all"]


def test_local_parts_of_replaced_pages_go(spark):
    schema = "doc_id int, page_no int, code string"
    local = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c")], schema)
    cloud = spark.createDataFrame([(1, 2, "d")], schema)
    own = spark.createDataFrame([(1, 2, "sent")], schema)
    found = records.hybrid_parts(local, cloud, cloud.select("doc_id", "page_no"), own)
    assert sorted(r["code"] for r in found.collect()) == ["a", "c", "d", "sent"]


def test_only_types_with_nodes(spark):
    nodes = spark.createDataFrame([("x",), ("x",), ("",), (None,), ("gone",)], "section_type string")
    taxonomy = spark.createDataFrame([(1, "x", "X"), (2, "y", "Y")], "ord int, type_name string, label string")
    assert rows(records.types_present(nodes, taxonomy)) == [(1, "x", "X", 2)]


def test_running_headers_do_not_count_as_lost(spark):
    lines = spark.createDataFrame([(1, p, i, t) for p in (1, 2, 3) for i, t in enumerate([f"Handbook edition {p}", ["red fox", "blue whale", "grey owl"][p - 1]])], "doc_id int, page_no int, line_no int, line string")
    markdown = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "whale")], "doc_id int, page_no int, markdown string")
    found = quality.content_overlap(lines, markdown).select("page_no", "n_truth", "n_md", "common")
    assert rows(found) == [(1, 2, 2, 2), (2, 2, 1, 1), (3, 2, 0, 0)]


def test_tokens_of_pages_are_not_exploded(spark):
    rows_ = [(1, "red fox red", None), (1, "red", "fox <b>red</b>"), (2, None, "x"), (3, None, None), (None, "lost", "lost")]
    found = quality.token_overlap(spark.createDataFrame(rows_, "page_no int, truth string, md string"), ["page_no"], "truth", "md", tags=True)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # a task would hold all tokens of its pages
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 4, 2, 2), (2, 0, 1, 0), (3, 0, 0, 0), (None, 0, 0, 0)]


def test_a_second_markdown_of_a_page_adds_no_truth(spark):
    lines = spark.createDataFrame([(1, 1, 0, "red fox"), (1, None, 0, "red")], "doc_id int, page_no int, line_no int, line string")
    markdown = spark.createDataFrame([(1, 1, "red"), (1, 1, "owl"), (9, 9, "none")], "doc_id int, page_no int, markdown string")
    found = quality.content_overlap(lines, markdown).select("page_no", "n_truth", "n_md", "common")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 2, 1), (None, 0, 0, 0)]
