"""Lint issues and references that follow texts as they are written; a batch that runs again changes nothing."""

import json

from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.operators import references
from quirekit.streaming import writes

TREE = [(1, 1, 1, 1, 2, "see page 5"), (1, 2, 2, 3, 4, "Refer Page No. 5"), (1, 3, 3, 5, 6, ""), (2, 1, 1, 1, 9, "see page 2")]


def tree(spark):
    return spark.createDataFrame(TREE, "doc_id int, id int, ord int, page_start int, page_end int, markdown string")


def counts(spark):
    return spark.createDataFrame([(1, 6), (2, 9)], "doc_id int, page_count int")


def changed(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, id int, markdown string, seq int")


def test_lint_never_stops_a_write(spark):
    assert writes.issues_json("| a |\n\ntext", lint=lambda t: 1 / 0) is None
    assert json.loads(writes.issues_json("| a |"))[0]["code"] == "lone_pipe_row" and writes.issues_json("fine") is None and writes.issues_json(None) is None
    df = spark.createDataFrame([("| a |\n\n| b |",), ("fine",), (None,), ("```",)], "t string").withColumn("x", writes.lint_column(F.col("t")))
    assert [r[0] for r in df.select(writes.lint_count(F.col("x"))).collect()] == [2, 0, 0, 1]
    assert [r[0] for r in spark.createDataFrame([("not json",), ("[1,2]",)], "x string").select(writes.lint_count(F.col("x"))).collect()] == [0, 2]


def test_table_functions_in_sql(spark):
    writes.register(spark)
    spark.createDataFrame([(1, "# T\n| a |\n\n- x\n- y"), (2, None)], "id int, t string").createOrReplaceTempView("texts_of_writes")
    got = spark.sql("SELECT id, code, line FROM texts_of_writes, LATERAL lint_markdown(t)").collect()
    assert [tuple(r) for r in got] == [(1, "lone_pipe_row", 2)]
    blocks = spark.sql("SELECT type, markdown FROM texts_of_writes, LATERAL markdown_blocks(t) ORDER BY block_no").collect()
    assert [(r[0], r[1]) for r in blocks] == [(b["type"], b["markdown"]) for b in folds.blocks("# T\n| a |\n\n- x\n- y")]


def test_what_follows_from_a_write(spark):
    changes = changed(spark, [(1, 1, "draft see page 3", 1), (1, 1, "Now see page 3 instead.\n| x |", 2), (1, 9, "no such section", 1), (2, 1, None, 1)])
    bodies, links = writes.on_write(changes, tree(spark), counts(spark))
    got = {(r["doc_id"], r["id"]): r for r in bodies.collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[2, 1]["markdown"] == "" and "lone_pipe_row" in got[1, 1]["lint_issues"]
    assert [tuple(r) for r in links.collect()] == [(1, 1, 2, 3, "see page 3", 1)]


def test_replays_change_nothing(spark, tmp_path):
    path, source = str(tmp_path / "t"), tmp_path / "in"
    source.mkdir()
    steps = [[(1, 1, "see page 3", 1)], [(1, 1, "none", 2), (1, 2, "| x |", 3)], [(1, 1, "see page 5", 4)]]
    schema = changed(spark, steps[0]).schema
    seen = []

    def now():
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        base = tree(spark).select("doc_id", "id", "markdown", F.lit(None).cast("string").alias("lint_issues"))
        bodies, links = writes.current(base, references.extract(tree(spark), counts(spark)), read("bodies"), read("references"))
        return sorted(map(str, bodies.collect())), sorted(map(str, links.collect()))

    for n, rows in enumerate(steps):
        changed(spark, rows).coalesce(1).write.parquet(str(source / f"step{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        query = writes.into_tables(stream, tree(spark), counts(spark), path, str(tmp_path / "c"))
        query.awaitTermination()
        seen.append(now())
    bodies, links = seen[1]
    assert any("lone_pipe_row" in b for b in bodies) and len(links) == 0 and len(seen[0][1]) == 2
    assert len(seen[2][1]) == 1 and "page=5" in seen[2][1][0]
    # the last batch again, as after a failure before its commit
    (tmp_path / "c" / "commits" / "2").unlink()
    (tmp_path / "c" / "commits" / ".2.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    writes.into_tables(stream, tree(spark), counts(spark), path, str(tmp_path / "c")).awaitTermination()
    assert now() == seen[2]
