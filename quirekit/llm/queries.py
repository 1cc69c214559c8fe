"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm import conversations, decontaminate, hamming, html_text, importance, language, line_dedup, lm, mixing, ngram_join, packing, substrings, tokens
from quirekit.llm.common import SPACED_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_all(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where("vec_id % 50 = 0"), k=10)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_bytes", "n_chunks", "repeated_words", "removed_words", "removed_bytes", spans.alias("removed_spans"))


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens: words between white space; null text has none."""
    return docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(SPACED_WORDS)), F.lit(0)).cast("long").alias("n_tokens"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(word_lengths(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("kept", ",").alias("kept_lines"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_topk_search": op6_topk_search,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ),
        wins AS (
            SELECT DISTINCT item, w[i + 1 : i + least(13, len(w))] AS words
            FROM (SELECT item, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        spans AS (SELECT DISTINCT len(words) AS span FROM wins),
        runs AS (
            SELECT doc_id, i, span, w[i + 1 : i + span] AS words
            FROM (SELECT doc_id, w, span, unnest(range(0, len(w) - span + 1)) AS i FROM d JOIN spans ON len(w) >= span)
        ),
        hits AS (SELECT runs.doc_id, runs.i, runs.span, wins.item FROM runs JOIN wins ON runs.words = wins.words),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        sh AS (
            SELECT DISTINCT doc_id, w[i + 1 : i + least(5, len(w))] AS s
            FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
            SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)
        ),
        reach AS (
            SELECT DISTINCT a AS doc_id, a AS other FROM links
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
        ),
        least_id AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_id ON d.doc_id = least_id.doc_id
    """,
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line, len(x) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
        ),
        t AS (
            SELECT doc_id, i, n_lines, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l
        ),
        c AS MATERIALIZED (SELECT w, len(w) AS n, min({'d': doc_id, 'i': i}) AS place, row_number() OVER () AS c FROM t WHERE len(w) > 0 GROUP BY w),
        u AS (SELECT c, n, place, unnest(w) AS tok FROM c),
        df AS (SELECT tok, count(*) AS f FROM u GROUP BY tok),
        p AS (SELECT c, n, place, tok, row_number() OVER (PARTITION BY c ORDER BY f, tok) AS pos FROM u JOIN df USING (tok) QUALIFY pos <= n - ceil(0.8 * n) + 1),
        cand AS (
            SELECT DISTINCT x.c AS late, y.c AS early FROM p x JOIN p y ON x.tok = y.tok AND y.place < x.place AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
        ),
        gone AS (
            SELECT DISTINCT late FROM cand JOIN c x ON late = x.c JOIN c y ON early = y.c
            WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)
        ),
        stay AS (SELECT place.d AS doc_id, place.i AS i FROM c WHERE c NOT IN (SELECT late FROM gone) UNION ALL SELECT doc_id, i FROM t WHERE len(w) = 0),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS k FROM stay GROUP BY doc_id),
        n AS (SELECT doc_id, max(n_lines) AS n_lines FROM l GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(kept.n, 0) AS n_removed, coalesce(k, '') AS kept_lines
        FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN kept ON documents.doc_id = kept.doc_id
    """,
    "op6_topk_search": """
        WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings),
        d AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                   CAST(len(list_filter(list_zip(q.code, v.code), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
            FROM c q JOIN c v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
        FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
    """,
}
