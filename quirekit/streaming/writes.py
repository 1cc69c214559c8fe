"""What follows from writing a section's text: its lint issues and its outgoing references, always those of the text that is stored."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quirekit.functions import folds
from quirekit.operators import references

KEYS = ["doc_id", "id"]


class LintRows:
    """Table function lint_markdown(text): code, line and message of each structural issue."""

    def eval(self, markdown: str):
        for issue in folds.lint(markdown):
            yield issue["code"], issue["line"], issue["message"]


class BlockRows:
    """Table function markdown_blocks(text): number, type, level and markdown of each block."""

    def eval(self, markdown: str):
        for n, block in enumerate(folds.blocks(markdown or "")):
            yield n, block["type"], block["level"], block["markdown"]


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL, for ``LATERAL`` joins."""
    for name, function, schema in (("lint_markdown", LintRows, "code string, line int, message string"), ("markdown_blocks", BlockRows, "block_no int, type string, level int, markdown string")):
        spark.udtf.register(name, F.udtf(function, returnType=schema))


def issues_json(markdown: str | None, lint=folds.lint) -> str | None:
    """Lint issues as JSON, null if there are none. A lint that fails gives null too: it must never stop a write."""
    try:
        found = lint(markdown)
    except Exception:  # told by a null, see above
        return None
    return json.dumps(found, ensure_ascii=False) if found else None


def lint_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def linted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([issues_json(t) for t in some], dtype=object)

    return linted(text)


def lint_count(issues: Column) -> Column:
    """How many issues stored JSON tells of; null and unreadable JSON none."""
    return F.coalesce(F.json_array_length(issues), F.lit(0))


def on_write(changes: DataFrame, tree: DataFrame, page_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies, references) that follow from changes of sections' texts.

    ``changes``: doc_id, id, markdown, seq; of several changes of a section the last counts. ``tree``: doc_id, id, ord,
    page_start, page_end of all sections; changes of sections that it has not are left out. bodies: doc_id, id,
    markdown, lint_issues. references: the outgoing ones of the changed sections, resolved against the tree.
    """
    newest = changes.groupBy(*KEYS).agg(F.max_by(F.struct("markdown"), F.struct("seq", "markdown")).alias("r")).select(*KEYS, F.coalesce("r.markdown", F.lit("")).alias("markdown"))
    known = newest.join(tree.select(*KEYS), KEYS, "left_semi")
    bodies = known.withColumn("lint_issues", lint_column(F.col("markdown")))
    spans = tree.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    return bodies, references.extract(known, page_counts, spans=spans)


def current(bodies: DataFrame, links: DataFrame, written: DataFrame, written_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies, references) as they are now: base tables overlaid with what batches wrote (with a column ``batch``)."""
    last = written.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    newest = written.join(last, [*KEYS, "batch"], "left_semi").drop("batch")
    columns = newest.columns
    whole = bodies.select(*columns).join(last, KEYS, "left_anti").unionByName(newest.select(*columns))
    from_keys = last.withColumnRenamed("id", "from_id")
    kept = links.join(from_keys, ["doc_id", "from_id"], "left_anti")
    return whole, kept.unionByName(written_links.join(from_keys, ["doc_id", "from_id", "batch"], "left_semi").select(*links.columns))


def into_tables(changes: DataFrame, tree: DataFrame, page_counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of changes as path/bodies/batch=N and path/references/batch=N, both from the same rows.

    A batch writes only what it changed, and a batch that runs again writes the same folders, so replays change nothing.
    :func:`current` reads the tables with their base.
    """

    def write(batch: DataFrame, number: int) -> None:
        bodies, links = on_write(batch, tree, page_counts)
        bodies.write.mode("overwrite").parquet(f"{path}/bodies/batch={number}")
        links.write.mode("overwrite").parquet(f"{path}/references/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
