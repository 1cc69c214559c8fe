"""Sources: parsers by name, page text from binary files, outlines, canonical documents, profiles and seeds.

Parsers and models are functions passed in; the ones here work offline and give the same results
every time. A parser that needs a library which is not there is listed as unavailable.
"""

from __future__ import annotations

import hashlib
import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions import folds

PAGES = "doc_id string, path string, page_no int, width double, height double, source_text string, markdown string, error string"
CANONICAL = "document struct<id:string,title:string>, parse_run struct<id:string,profile:string,started_at:string>, pages array<struct<id:string,page_number:int,blocks:array<struct<id:string,type:string,text:string,markdown:string,reading_order:int>>>>, sections array<struct<id:string,title:string,level:int,block_ids:array<string>>>, warnings array<struct<code:string,page_number:int,message:string>>"


def plain_pages(data: bytes) -> list[dict]:
    """A text file as pages parted by form feeds; the markdown is the text."""
    texts = data.decode("utf-8", errors="replace").split("\f")
    return [{"width": 0.0, "height": 0.0, "source_text": t, "markdown": t} for t in texts]


def _pdf_pages(data: bytes) -> list[dict]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [{"width": p.rect.width, "height": p.rect.height, "source_text": p.get_text("text"), "markdown": p.get_text("text")} for p in pdf]


PARSERS: dict[str, tuple[Callable[[bytes], list[dict]], str | None]] = {"plain": (plain_pages, None), "pdf_text": (_pdf_pages, "fitz")}


def register(name: str, parser: Callable[[bytes], list[dict]], needs: str | None = None) -> None:
    PARSERS[name] = (parser, needs)


def available() -> dict[str, bool]:
    return {name: needs is None or importlib.util.find_spec(needs) is not None for name, (_, needs) in PARSERS.items()}


def read_pages(spark: SparkSession, path: str, parser: str = "plain", pages: str | None = None, glob: str | None = None) -> DataFrame:
    """One row per page of the files under ``path``: many files to a task, pages by an optional range such as '1-3,5'.

    A page's markdown falls back to its text where it is blank. A file that can't be parsed gives one
    row of page 0 with the error, and no other file suffers.
    """
    if not available().get(parser):
        raise LookupError(f"parser {parser!r} is not available; there are {sorted(n for n, ok in available().items() if ok)}")
    parse = PARSERS[parser][0]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                doc_id = f"doc_{hashlib.sha256(content).hexdigest()[:16]}"
                try:
                    parsed = parse(bytes(content))
                    keep = folds.page_range(pages, len(parsed))
                    out = [(doc_id, where, n, parsed[n - 1]["width"], parsed[n - 1]["height"], parsed[n - 1]["source_text"], parsed[n - 1]["markdown"] if (parsed[n - 1]["markdown"] or "").strip() else parsed[n - 1]["source_text"], None) for n in keep]
                except Exception as e:  # one bad file must not end the job
                    out = [(doc_id, where, 0, None, None, None, None, str(e))]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.mapInPandas(rows, PAGES)


def with_model(pages: DataFrame, model: Callable[[str], dict], column: str = "markdown", retries: int = 2) -> DataFrame:
    """Adds reply, cost and model_error from ``model(text) -> {'text', 'cost'}``, tried again after an error; a failure is a value."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.schema)}, reply string, cost double, model_error string"

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for text in frame[column]:
                error, got = None, {}
                for _ in range(retries + 1):
                    try:
                        got, error = model(text or ""), None
                        break
                    except Exception as e:  # told in the row
                        error = str(e)
                found.append((folds.unfenced(got["text"]) if got.get("text") else None, got.get("cost"), error))
            yield frame.assign(reply=[f[0] for f in found], cost=[f[1] for f in found], model_error=[f[2] for f in found])

    return pages.mapInPandas(rows, schema)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents (one JSON file each) anywhere under ``path``, with a fixed schema."""
    return spark.read.schema(CANONICAL).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "canonical.json").json(path)


def graph_tables(canonical: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges of canonical documents: documents, pages, blocks and sections; block ids that no page has make no edge."""
    run = F.col("parse_run.id")
    doc = F.col("document.id")
    page = canonical.select(doc.alias("doc_id"), run.alias("run_id"), F.explode("pages").alias("p"))
    block = page.select("doc_id", "run_id", F.col("p.id").alias("page_id"), F.explode("p.blocks").alias("b"))
    section = canonical.select(doc.alias("doc_id"), run.alias("run_id"), F.explode("sections").alias("s"))
    node = lambda df, id_, kind, label: df.select("doc_id", "run_id", id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    nodes = (
        node(canonical.select(doc.alias("doc_id"), run.alias("run_id"), F.col("document.title").alias("t")), F.col("doc_id"), "document", F.col("t"))
        .unionByName(node(page, F.col("p.id"), "page", F.concat(F.lit("Page "), F.col("p.page_number").cast("string"))))
        .unionByName(node(block, F.col("b.id"), "block", F.when(F.col("b.type") == "table", "Table").otherwise(F.left("b.text", F.lit(80)))))
        .unionByName(node(section, F.col("s.id"), "section", F.col("s.title")))
    )
    edge = lambda df, src, dst, kind: df.select("doc_id", "run_id", F.concat_ws(":", "run_id", F.lit("edge"), F.lit(kind), src, dst).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    member = section.select("doc_id", "run_id", F.col("s.id").alias("section_id"), F.explode("s.block_ids").alias("block_id"))
    member = member.join(block.select("run_id", F.col("b.id").alias("block_id")).distinct(), ["run_id", "block_id"], "left_semi")
    edges = (
        edge(page, F.col("doc_id"), F.col("p.id"), "DOCUMENT_HAS_PAGE")
        .unionByName(edge(block, F.col("page_id"), F.col("b.id"), "PAGE_HAS_BLOCK"))
        .unionByName(edge(member, F.col("block_id"), F.col("section_id"), "BLOCK_PART_OF_SECTION"))
    )
    return {"nodes": nodes, "edges": edges}


def profile(defaults: dict, *loaded: dict) -> dict:
    """Settings in layers: later ones win, blanks do not, a real 0 does."""
    out = dict(defaults)
    for layer in loaded:
        out |= {k: v for k, v in layer.items() if v is not None and v != ""}
    return out


def seeded(table: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The table with the seeds that it lacks; twice is as once."""
    return table.unionByName(seeds.join(table.select(key), key, "left_anti").select(*table.columns))
