"""A corpus pipeline of five stages over ``documents``.

Language ID keeps documents with a language, line dedup takes lines out that an earlier document has,
the n-gram Jaccard join keeps one document of each group of near copies, decontamination drops
documents with passages of the benchmark, and packing places what is left in training sequences. Each
stage gets all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm import decontaminate, language, line_dedup, ngram_join, packing
from quirekit.llm.common import store
from quirekit.llm.queries import table, word_lengths


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents for which no language is found: those without text or letters."""
    model = language.train(docs)
    found = language.identify(docs, model, keep=docs.columns)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; documents that have no word left go."""
    found = line_dedup.dedup_lines(docs).where(F.col("text").rlike(line_dedup.SOME_WORD))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents, by their words, in sequences."""
    return packing.pack(word_lengths(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_dedup", ngram_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The mixtures of the first stage and the packing of the last are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
