"""Second attempts at parsed pages: several texts for a page, scored in one pass, and the best adopted.

A page is one row from its source to its adopted text: models are called and tokens are compared where the row is, so
no candidate costs a scan or a shuffle. Only furniture (which lines recur on a document's pages) and tables that cross
pages need other pages of the document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators import layout, quality, stitching

Model = Callable[[dict], dict]
CANDIDATES = ("base", "vlm", "cleanup")
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 512


def furniture_keys(pages: DataFrame, column: str) -> DataFrame:
    """(doc_id, recurs): 64-bit hashes of the running lines of documents that have any, by the rule of ``layout.furniture``."""
    return layout.recurring_hashes(pages, ["doc_id"], column, T.running_lines, lambda x: F.length(x) >= 6, lambda n: F.bround(n * 0.5), 2, 3)


def without_furniture(text: Column, recurs: Column) -> Column:
    """A text without its document's running lines; null ``recurs`` is none."""
    left = F.zip_with(T.lines(text), T.running_lines(text), lambda x, r: F.when(~F.array_contains(recurs, F.xxhash64(r)), x))
    return F.when(recurs.isNull(), text).otherwise(F.array_join(left, "\n"))  # nulls are left out


def _tokens(text: str | None) -> Counter:
    return Counter(folds.tokens(text))


def judged(judge: Callable[[dict, str], str], page: dict, text: str) -> tuple[float | None, str | None]:
    """(score, note) of a judge's reply, asked once more if it can't be read; an error gives no score."""
    for _ in range(2):
        try:
            found = folds.judgement(judge(page, text))
        except Exception as e:  # told in the note
            return None, f"judge failed: {e}"
        if found["score"] is not None:
            return found["score"], f"judge: {found['note']}" if found["note"] else None
    return None, "judge unparseable after retry"


def _tries(page: dict, models: dict[str, Model], forced: bool) -> tuple[dict, float, list[str]]:
    """Texts of the models by name, their cost, their errors. A model's error ends neither the page nor the job."""
    texts, cost, errors = {}, 0.0, []
    for name, model in models.items():
        if name == "cleanup" and page["kind"] == "visual" and not forced:
            continue
        if name == "cleanup" and not (page["markdown"] or "").strip():
            texts[name] = page["markdown"] or ""  # a blank page stays as it is, unasked
            continue
        try:
            reply = model(page)
            texts[name], cost = folds.unfenced(reply["text"] or ""), cost + (reply.get("cost") or 0.0)
        except Exception as e:  # told in the notes
            errors.append(f"{name} failed: {e}")
    return texts, cost, errors


def attempted(pages: DataFrame, vlm: Model, cleanup: Model, judge: Callable[[dict, str], str] | None = None, judge_all: bool = False, forced: str | None = None) -> DataFrame:
    """``pages`` with what the models make of every page that is a ``target``, and how each text compares.

    ``pages``: doc_id, page_no, kind, source, content (the source without furniture), markdown, target. Added: texts
    vlm_text and cleanup_text, cost, errors; n_source and n_content; and for base, vlm and cleanup the tokens (_n), those
    in common with the source and with its content, judge, note, and the table faults. All are null where a page is no
    target or a candidate is not there. Visual pages get no cleanup and are judged; others only with ``judge_all``.
    ``forced`` names the one model that is asked.
    """
    models = {k: m for k, m in (("vlm", vlm), ("cleanup", cleanup)) if forced in (None, k)}
    added = {"vlm_text": pa.string(), "cleanup_text": pa.string(), "cost": pa.float64(), "errors": pa.string(), "n_source": pa.int64(), "n_content": pa.int64()}
    for c in CANDIDATES:
        added |= {f"{c}_n": pa.int64(), f"{c}_common": pa.int64(), f"{c}_content": pa.int64(), f"{c}_judge": pa.float64(), f"{c}_note": pa.string(), f"{c}_faults": pa.list_(pa.string())}
    names = pages.columns
    needed = ["doc_id", "page_no", "kind", "source", "content", "markdown", "target"]

    def compare(page: dict) -> dict:
        if not page["target"]:
            return {}
        texts, cost, errors = _tries(page, models, forced is not None)
        source = _tokens(page["source"])
        content = source if page["content"] == page["source"] else _tokens(page["content"])
        out = {"vlm_text": texts.get("vlm"), "cleanup_text": texts.get("cleanup"), "cost": cost, "errors": "; ".join(errors) or None, "n_source": source.total(), "n_content": content.total()}
        for name, text in {"base": page["markdown"] or "", **texts}.items():
            tokens = _tokens(text)
            score, note = judged(judge, page, text) if judge and (judge_all or page["kind"] == "visual") else (None, None)
            values = (tokens.total(), folds.in_common(tokens, source), folds.in_common(tokens, content), score, note, folds.table_faults(text))
            out |= dict(zip((f"{name}_{x}" for x in ("n", "common", "content", "judge", "note", "faults")), values))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [compare(page) for page in batch.select(needed).to_pylist()]
                columns = [pa.array([f.get(c) for f in found], kind) for c, kind in added.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added])

    kinds = {pa.string(): "string", pa.float64(): "double", pa.int64(): "long", pa.list_(pa.string()): "array<string>"}
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema] + [f"{c} {kinds[t]}" for c, t in added.items()]
    return pages.mapInArrow(rows, ", ".join(schema))


def composite(kind: Column, recall: Column, extra: Column, table: Column, judge: Column, marred: Column) -> Column:
    """A text's score to three places: judge and tables on visual pages, else all terms, and less for what a parser left behind."""
    plain = quality.weighted({"recall": recall, "kept": 1.0 - extra, "table_score": table, "judge": judge}, quality.WEIGHTS)
    visual = quality.weighted({"judge": judge, "table_score": table}, quality.VISUAL_WEIGHTS)
    return T.thousandths(F.when(kind == "visual", visual).when(marred, plain * quality.FAULT_FACTOR).otherwise(plain))


def _read(tried: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """What is read off the texts, each once, in columns: whether the source has a table, and tables and faults of the candidates."""
    marked = tried.withColumn("has_table", F.col("target") & T.has_columns(F.col("source")))
    read = {}
    for name, text in texts.items():
        there = F.col(f"{name}_n").isNotNull()
        read[f"{name}_table"] = F.when(there & F.col("has_table"), F.when(T.table_cells(text) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        read[f"{name}_marks"] = F.when(there, F.concat(quality.leftovers(F.coalesce(text, F.lit(""))), F.coalesce(f"{name}_faults", F.array().cast("array<string>"))))
        read[f"{name}_recall"] = quality.recall(F.col(f"{name}_common"), F.col("n_source"))
        read[f"{name}_extra"] = quality.extra(F.col(f"{name}_common"), F.col(f"{name}_n"))
    return marked.withColumns(read)


def _scored(name: str) -> dict[str, Column]:
    """The composite and content recall of a candidate, null where it is not there, and its notes."""
    there, plain = F.col(f"{name}_n").isNotNull(), F.col("kind") != "visual"
    recall, extra, table, marks = (F.col(f"{name}_{x}") for x in ("recall", "extra", "table", "marks"))
    notes = F.array_compact(
        F.array(
            F.when(plain & (recall < quality.LOW_RECALL), F.lit("low text recall")),
            F.when(plain & (extra > quality.HIGH_EXTRA), F.lit("high extra ratio")),
            F.when(plain & (table == 0), F.lit("table present but not reproduced")),
            F.col(f"{name}_note"),
            F.when(plain & (F.size(marks) > 0), F.concat(F.lit("parser artifacts: "), F.array_join(marks, ", "))),
        )
    )
    score = composite(F.col("kind"), recall, extra, table, F.col(f"{name}_judge"), F.size(marks) > 0)
    return {name: F.when(there, score), f"{name}_kept": F.when(there, quality.recall(F.col(f"{name}_content"), F.col("n_content"))), f"{name}_notes": F.when(there, notes)}


def remediated(pages: DataFrame, vlm: Model, cleanup: Model, judge: Callable[[dict, str], str] | None = None, scope: str = "all", judge_all: bool = False, tolerance: float = 0.12, forced: str | None = None) -> DataFrame:
    """One row a page: what was tried, what was adopted, and the canonical text.

    ``pages``: doc_id, page_no, kind ('text' or 'visual'), source, markdown, composite, verdict. ``scope`` 'all' tries
    every page, 'flagged' those whose verdict is not 'pass'. A vlm text must beat the baseline's composite, a cleaned
    one must keep the content within ``tolerance``; of both, vlm wins ties. ``forced`` ('vlm' or 'cleanup') adopts that
    text whatever its score, as for pages that someone asked to be parsed again. Result: doc_id, page_no, target,
    recorded (the adopted method, or what was tried), adopted, base_composite, new_composite, canonical (with tables
    that cross pages stitched), canonical_composite, canonical_source, notes, cost. A page without source text has
    recall 1; null texts are ''; a null kind is text, a null verdict no pass. (doc_id, page_no) are unique, doc_id not null.
    """
    keys = ["doc_id", "page_no"]
    target = F.lit(True) if scope == "all" else ~F.col("verdict").eqNullSafe("pass")
    own = pages.select(*keys, F.coalesce("kind", F.lit("text")).alias("kind"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.col("composite").cast("double").alias("stored"), target.alias("target"))
    met = own.join(furniture_keys(own, "source"), "doc_id", "left").withColumn("content", without_furniture(F.col("source"), F.col("recurs"))).drop("recurs")
    tried = attempted(met, vlm, cleanup, judge, judge_all, forced)
    texts = {"base": F.col("markdown"), "vlm": F.col("vlm_text"), "cleanup": F.col("cleanup_text")}
    scores = {k: v for name in texts for k, v in _scored(name).items()}
    slim = [*keys, "target", "markdown", "stored", "vlm_text", "cleanup_text", "cost", "errors"]
    scored = _read(tried, texts).select(*slim, *[v.alias(k) for k, v in scores.items()]).withColumnsRenamed({"base_kept": "base_content", "cleanup_kept": "cleanup_content"})
    picked = quality.adopt(scored, scored.columns, tolerance).drop("composite")
    if forced:
        asked = F.col("target") & F.col(forced).isNotNull()
        picked = picked.withColumns({"method": F.when(asked, F.lit(forced)).otherwise(F.lit("baseline")), "recorded": F.lit(forced)})
    by_method = lambda of: F.when(F.col("recorded") == "vlm", F.col(of.format("vlm"))).when(F.col("recorded") == "cleanup", F.col(of.format("cleanup")))
    adopted = F.col("target") & (F.col("method") != "baseline")
    new = F.when(F.col("target"), F.coalesce(by_method("{}"), F.col("base")))
    notes = F.nullif(F.array_join(F.array_compact(F.concat(F.coalesce(by_method("{}_notes"), F.array().cast("array<string>")), F.array("errors"))), "; "), F.lit(""))
    done = picked.select(
        *keys, "target", F.when(F.col("target"), F.col("recorded")).alias("recorded"), adopted.alias("adopted"), F.col("base").alias("base_composite"), new.alias("new_composite"),
        F.when(adopted, by_method("{}_text")).otherwise(F.col("markdown")).alias("markdown"), F.when(adopted, new).otherwise(F.col("stored")).alias("canonical_composite"),
        F.when(adopted, F.col("recorded")).otherwise("baseline").alias("canonical_source"), notes.alias("notes"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
    )
    return stitching.stitched(done, carried=[c for c in done.columns if c not in (*keys, "markdown")]).withColumnRenamed("markdown", "canonical")


def summary(done: DataFrame) -> DataFrame:
    """(doc_id, targets, adopted, canonical_mean, cost) of remediated pages: the mean to three places over pages that have a score.

    Scores have three places, so they are added up as whole thousandths and the mean is rounded exactly, halves up.
    """
    total, n = F.sum(F.round(F.col("canonical_composite") * 1000).cast("long")), F.count("canonical_composite")
    sums = done.groupBy("doc_id").agg(F.count_if("target").alias("targets"), F.count_if("adopted").alias("adopted"), total.alias("total"), n.alias("n"), F.round(F.sum("cost"), 6).alias("cost"))
    mean = F.when(F.col("n") > 0, F.expr("(2 * total + n) div (2 * n)") / 1000)
    return sums.select("doc_id", "targets", "adopted", mean.alias("canonical_mean"), "cost")
