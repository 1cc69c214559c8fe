"""The pipeline against a brute-force version of every stage."""

import re

import corpus_pipeline
import pytest

from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_joins import brute_components, brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    rows = sorted((d, t) for d, _, _, t in brute_lines(rows) if words(t))
    rows = [(d, t) for (d, t), (e, _, c) in zip(rows, sorted(brute_components(rows))) if d == c]
    bad = {d for d, _, _, _, contaminated in brute_contamination(rows, items) if contaminated}
    expected = {d: len(words(t)) for d, t in rows if d not in bad}
    got: dict[int, int] = {}
    bins: dict[int, int] = {}
    filled: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["piece_len"]
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["piece_len"]
        filled[r["bin_id"]] = r["bin_filled"]
    assert got == expected
    assert bins == filled


@pytest.mark.parametrize("rows", [[], [(1, "only one text here of words", "en", "a", 5)], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "...", "en", "s", 3)]])
def test_stages_of_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == (1 if len(rows) == 1 else 0)


def test_near_copies_leave_one(spark, sf_dir):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["x"] + base[31:]
    rows = [(5, " ".join(base), "en", "s", 1), (3, " ".join(base), "en", "s", 1), (None, " ".join(base), "en", "s", 1), (9, " ".join(near), "en", "s", 1), (4, "quite another text", "en", "s", 1), (4, "and a third one", "en", "s", 1), (6, "", "en", "s", 1)]
    left = corpus_pipeline.ngram_dedup(spark, spark.createDataFrame(rows, COLUMNS), sf_dir).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in left) == sorted([(3, len(rows[1][1])), (4, 18), (4, 15), (6, 0)])
