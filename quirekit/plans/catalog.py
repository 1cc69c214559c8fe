"""The registered queries over the document tables, and the same as DuckDB SQL.

Results have primitive columns; lists are joined to strings in a defined order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators import edits, figures, layout, quality, rebuilding, records, references, remediation, runs, stitching, trees
from quirekit.plans import sql as S
from quirekit.sources import canonical
from quirekit.sources import fixtures as X
from quirekit.streaming import states, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _million(x):
    return F.floor(x * 1000000 + 0.5) / 1000000


@query(f"WITH {S.TYPED}, {S.TAXONOMY}, c AS (SELECT nullif(section_type, '') AS t, count(*) AS n FROM typed GROUP BY ALL) SELECT ord, type_name, label, coalesce(n, 0) AS n FROM tax LEFT JOIN c ON type_name = t UNION ALL SELECT 1000000, NULL, 'Untagged', n FROM c WHERE t IS NULL")
def type_summary(spark, d):
    return records.type_summary(X.typed(spark, d), X.taxonomy(spark))


@query(f"WITH {S.TYPED}, {S.SOURCES} SELECT coalesce(nullif(s.title, ''), t.doc_id) AS title, t.doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY lft, id) AS ids FROM typed t LEFT JOIN src s ON t.doc_id = s.doc_id WHERE section_type = 'en' GROUP BY ALL")
def sections_by_type(spark, d):
    return records.by_document(X.typed(spark, d), X.sources(spark, d), "en")


@query(f"WITH {S.TYPED}, {S.SOURCES} SELECT coalesce(nullif(s.title, ''), t.doc_id) AS title, t.doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY lft, id) AS ids FROM typed t LEFT JOIN src s ON t.doc_id = s.doc_id WHERE section_type IS NULL AND (lower(t.title) LIKE '%7%' OR lower(path) LIKE '%7%') GROUP BY ALL")
def untagged_search(spark, d):
    return records.by_document(X.typed(spark, d), X.sources(spark, d), None, "7")


@query(f"WITH {S.TYPED}, {S.SOURCES} SELECT nullif(section_type, '') AS section_type, count(*) AS n FROM typed WHERE doc_id IN (SELECT doc_id FROM src WHERE project_id = 'p0') GROUP BY ALL")
def doc_counts_scoped(spark, d):
    return records.type_counts(records.scoped(X.typed(spark, d), X.sources(spark, d), project="p0"))


@query(f"WITH {S.SOURCES}, c AS (SELECT project_id, count(*) AS n FROM src GROUP BY ALL), p AS (SELECT unnest(['p0', 'p1', 'p2', 'p9']) AS project_id) SELECT p.project_id, coalesce(n, 0) AS imports FROM p LEFT JOIN c ON p.project_id = c.project_id")
def project_import_counts(spark, d):
    projects = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p9",)], "project_id string")
    counts = X.sources(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))
    return projects.join(counts, "project_id", "left").select("project_id", F.coalesce("n", F.lit(0).cast("long")).alias("imports"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def token_counts(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"WITH {S.RECALL}, {S.OVERLAP} SELECT page_id, n_truth, n_md, common, floor(CASE WHEN n_truth = 0 THEN 1.0 ELSE common / n_truth END * 1000000 + 0.5) / 1000000 AS recall, floor(CASE WHEN n_md = 0 THEN 0.0 ELSE (n_md - common) / n_md END * 1000000 + 0.5) / 1000000 AS extra FROM overlap")
def text_recall_extra(spark, d):
    o = quality.token_overlap(X.recall_pages(spark, d), ["page_id"], "truth", "markdown")
    return o.select("page_id", "n_truth", "n_md", "common", _million(quality.recall(F.col("common"), F.col("n_truth"))).alias("recall"), _million(quality.extra(F.col("common"), F.col("n_md"))).alias("extra"))


_SCORED = f"""WITH {S.RECALL}, {S.OVERLAP},
rat AS (SELECT page_id, CASE WHEN n_truth = 0 THEN CAST(1 AS DOUBLE) ELSE common / n_truth END AS recall, CASE WHEN n_md = 0 THEN CAST(0 AS DOUBLE) ELSE (n_md - common) / n_md END AS extra FROM overlap),
ts AS (SELECT page_id, len(list_filter(string_split(truth, chr(10)), lambda x: len(regexp_extract_all(x, '\\S {{2,}}')) >= 2)) >= 3 AS tab FROM rp),
terms AS (SELECT page_id, recall, extra, CASE WHEN tab THEN CAST(0 AS DOUBLE) END AS table_score FROM rat JOIN ts USING (page_id)),
scored AS (SELECT page_id, recall, extra, table_score, floor((CAST(0.4 AS DOUBLE) * recall + CAST(0.15 AS DOUBLE) * (CAST(1 AS DOUBLE) - extra) + CASE WHEN table_score IS NOT NULL THEN CAST(0.15 AS DOUBLE) * table_score ELSE CAST(0 AS DOUBLE) END) / (CAST(0.4 AS DOUBLE) + CAST(0.15 AS DOUBLE) + CASE WHEN table_score IS NOT NULL THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 1000 + 0.5) / 1000 AS composite FROM terms),
v AS (SELECT *, CASE WHEN composite >= 0.9 THEN 'pass' WHEN composite >= 0.7 THEN 'escalate' ELSE 'review' END AS verdict FROM scored)"""


@query(_SCORED + " SELECT page_id, floor(recall * 1000000 + 0.5) / 1000000 AS recall, floor(extra * 1000000 + 0.5) / 1000000 AS extra, table_score, composite, verdict, (recall < 0.85)::INT + (extra > 0.25)::INT + coalesce((table_score = 0)::INT, 0) AS n_notes FROM v")
def page_scores(spark, d):
    s = quality.score_pages(X.recall_pages(spark, d), ["page_id"], "truth", "markdown")
    return s.select("page_id", _million(F.col("recall")).alias("recall"), _million(F.col("extra")).alias("extra"), "table_score", "composite", "verdict", F.size("notes").alias("n_notes"))


@query(_SCORED + " SELECT verdict, count(*) AS pages, floor(avg(composite) * 1000 + 0.5) / 1000 AS mean FROM v GROUP BY verdict")
def verdict_counts(spark, d):
    s = quality.score_pages(X.recall_pages(spark, d), ["page_id"], "truth", "markdown")
    return s.groupBy("verdict").agg(F.count("*").alias("pages"), T.thousandths(F.avg("composite")).alias("mean"))


@query(f"WITH {S.WEB}, {S.BOILER} SELECT doc_id, normal, n FROM boiler")
def boilerplate_lines(spark, d):
    return layout.boilerplate(X.web_lines(spark, d))


@query(f"WITH {S.WEB}, p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM web GROUP BY ALL), c AS (SELECT doc_id, {S.running('line')} AS normal, count(DISTINCT page_no) AS n FROM web GROUP BY ALL) SELECT doc_id, normal, n FROM c JOIN p USING (doc_id) WHERE pages >= 3 AND len(normal) >= 6 AND n >= greatest(2, round_even(0.5 * pages, 0))")
def furniture_lines(spark, d):
    return layout.furniture(X.web_lines(spark, d))


@query(f"WITH {S.WEB}, {S.BOILER} SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM web w WHERE NOT EXISTS (SELECT 1 FROM boiler b WHERE b.doc_id = w.doc_id AND b.normal = {S.plain('w.line')}) AND NOT {S.stamp('line')} GROUP BY ALL")
def clean_pages(spark, d):
    return layout.joined(layout.cleaned(X.web_lines(spark, d)), ["doc_id", "page_no"])


@query(f"WITH {S.PAGES}, l AS (SELECT doc_id, page_no, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, page_no, string_split(md, chr(10)) AS x FROM pg)), m AS (SELECT *, regexp_matches(line, '^(#{{1,6}})\\s+(.*\\S)\\s*$') AS h, sum(regexp_matches(line, '^(#{{1,6}})\\s+(.*\\S)\\s*$')::INT) OVER (PARTITION BY doc_id ORDER BY page_no, line_no) AS section_no FROM l), g AS (SELECT doc_id, section_no, max(CASE WHEN h THEN line END) AS heading, min(page_no) AS page_start, max(page_no) AS page_end, coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY page_no, line_no), '') AS body FROM m WHERE section_no > 0 GROUP BY ALL) SELECT doc_id, section_no, trim(regexp_extract(heading, '^(#{{1,6}})\\s+(.*\\S)\\s*$', 2)) AS title, 1 AS level, page_start, page_end, md5(body) AS body_md5 FROM g")
def section_bodies_windowed(spark, d):
    p = X.pages(spark, d)
    lines = p.select("doc_id", "page_no", F.posexplode(T.lines(F.col("md"))).alias("i", "line")).select("doc_id", "page_no", (F.col("i") + 1).alias("line_no"), "line")
    return trees.windowed_sections(lines).select("doc_id", "section_no", "title", "level", "page_start", "page_end", F.md5("body").alias("body_md5"))


@query(f"WITH {S.PAGES}, t AS (SELECT *, page_no || '. Part ' || ((doc_id + page_no) % 7) AS title FROM pg) SELECT doc_id, CAST(page_no - 1 AS INTEGER) AS ord, title, 1 AS level, title AS path, page_no AS page_start, page_no AS page_end, md5(regexp_replace(substr(md, length(title) + 5), '^\\s+|\\s+$', '', 'g')) AS body_md5 FROM t")
def sectionize_full(spark, d):
    found = trees.sectionize(X.pages(spark, d).select("doc_id", "page_no", F.col("md").alias("markdown")))
    return found.select("doc_id", "ord", "title", "level", F.array_join("path", " > ").alias("path"), "page_start", "page_end", F.md5("markdown").alias("body_md5"))


_TREE = f"WITH RECURSIVE {S.REGIONS}, walk AS (SELECT doc_id, id, parent_id, 1 AS level, [{{'o': ord, 'i': id}}] AS way FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.doc_id, t.id, t.parent_id, w.level + 1, list_append(w.way, {{'o': t.ord, 'i': t.id}}) FROM tree t JOIN walk w ON t.doc_id = w.doc_id AND t.parent_id = w.id), up AS (SELECT doc_id, id AS ancestor, id FROM tree UNION ALL SELECT u.doc_id, t.parent_id, u.id FROM up u JOIN tree t ON u.doc_id = t.doc_id AND u.ancestor = t.id WHERE t.parent_id IS NOT NULL), size AS (SELECT doc_id, ancestor AS id, count(*) AS n FROM up GROUP BY ALL), num AS (SELECT doc_id, id, parent_id, level, 2 * row_number() OVER (PARTITION BY doc_id ORDER BY way) - level AS lft FROM walk), ns AS (SELECT num.doc_id, num.id, parent_id, level, lft, lft + 2 * n - 1 AS rgt FROM num JOIN size ON num.doc_id = size.doc_id AND num.id = size.id)"


@query(_TREE + " SELECT doc_id, id, level, lft, rgt FROM ns")
def nested_set(spark, d):
    return trees.nested_set(X.regions(spark, d)).select("doc_id", "id", "level", "lft", "rgt")


@query(_TREE + " SELECT doc_id, ancestor AS root, count(*) AS n FROM up GROUP BY ALL")
def subtree_counts(spark, d):
    tree = trees.nested_set(X.regions(spark, d))
    return trees.closure(tree).groupBy("doc_id", F.col("ancestor").alias("root")).agg(F.count("*").alias("n"))


@query(_TREE + ", inc AS (SELECT ns.*, included FROM ns JOIN tree ON ns.doc_id = tree.doc_id AND ns.id = tree.id WHERE included) SELECT a.doc_id, a.id, max_by(b.id, b.lft) AS ancestor FROM inc a LEFT JOIN inc b ON a.doc_id = b.doc_id AND b.lft < a.lft AND a.rgt < b.rgt GROUP BY ALL")
def nearest_included_ancestor(spark, d):
    return trees.nearest_included(X.regions(spark, d))


@query(_TREE + " SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY lft) - 1 AS sort_order FROM ns")
def sibling_order(spark, d):
    return trees.sibling_order(trees.nested_set(X.regions(spark, d))).select("doc_id", "id", "sort_order")


@query(f"WITH {S.REGIONS} SELECT doc_id, id, {S.slug('title')} AS slug FROM tree")
def slugs(spark, d):
    return X.regions(spark, d).select("doc_id", "id", T.slug(F.col("title")).alias("slug"))


@query(_TREE + f", named AS (SELECT ns.doc_id, ns.id, ns.parent_id, ns.lft, {S.slug("CASE WHEN ns.id > 1000 THEN 'Customer ' || (ns.id % 7) ELSE title END")} AS base FROM ns JOIN tree ON ns.doc_id = tree.doc_id AND ns.id = tree.id), one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id, base ORDER BY lft) AS k FROM named), sl AS (SELECT *, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM one), rt AS (SELECT doc_id, id, slug, 'wiki/' || slug AS route FROM sl WHERE parent_id IS NULL UNION ALL SELECT sl.doc_id, sl.id, sl.slug, rt.route || '/' || sl.slug FROM sl JOIN rt ON rt.doc_id = sl.doc_id AND rt.id = sl.parent_id) SELECT doc_id, id, slug, route FROM rt")
def slug_routes(spark, d):
    return trees.slug_routes(trees.nested_set(X.regions(spark, d).withColumn("title", F.when(F.col("id") > 1000, F.concat(F.lit("Customer "), (F.col("id") % 7).cast("string"))).otherwise(F.col("title")))))


@query(_TREE + f", kids AS (SELECT ns.doc_id, ns.parent_id AS id, string_agg('- [' || title || '](/' || {S.slug('title')} || ')' || chr(10), '' ORDER BY lft) AS k FROM ns JOIN tree ON ns.doc_id = tree.doc_id AND ns.id = tree.id WHERE ns.parent_id IS NOT NULL GROUP BY ALL) SELECT doc_id, id, md5('## Contents' || chr(10) || chr(10) || k) AS content_md5 FROM kids")
def contents_rollup(spark, d):
    tree = trees.nested_set(X.regions(spark, d)).withColumn("markdown", F.lit(""))
    routes = tree.select("doc_id", "id", T.slug(F.col("title")).alias("route"))
    return trees.contents(tree, routes).select("doc_id", "id", F.md5("content").alias("content_md5"))


@query(f"WITH {S.SPANS}, {S.POINTS} SELECT doc_id, page, min_by(id, {{'s': page_end - page_start, 'o': ord}}) AS id FROM pts JOIN spans USING (doc_id) WHERE page BETWEEN page_start AND page_end GROUP BY ALL")
def smallest_covering(spark, d):
    return references.smallest_covering(X.points(spark, d), X.spans(spark, d))


@query(f"WITH {S.SPANS}, {S.POINTS}, c AS (SELECT doc_id, page, id, page_start, page_end FROM pts JOIN spans USING (doc_id) WHERE page BETWEEN page_start AND page_end) SELECT doc_id, page, id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.page_start * 100 < b.page_start * 100 AND b.page_end * 100 < a.page_end * 100)")
def deepest_covering(spark, d):
    tree = X.spans(spark, d).withColumn("lft", F.col("page_start") * 100).withColumn("rgt", F.col("page_end") * 100)
    return references.deepest_covering(X.points(spark, d), tree)


@query(f"WITH {S.SPANS} SELECT a.doc_id, a.id, b.id AS other FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.id <> b.id AND a.page_start <= b.page_end AND b.page_start <= a.page_end WHERE NOT (a.page_start < b.page_start AND b.page_end < a.page_end) AND NOT (b.page_start < a.page_start AND a.page_end < b.page_end)")
def overlaps(spark, d):
    return references.overlapping(X.spans(spark, d).withColumn("lft", F.col("page_start")).withColumn("rgt", F.col("page_end")))


_REFS = f"WITH {S.PAGES}, refs AS (SELECT doc_id, page_no AS from_id, n_pages, CAST(regexp_extract(md, 'See page (\\d+)', 1) AS INT) AS page FROM pg), tgt AS (SELECT doc_id, from_id, page, CASE WHEN page = 1 AND n_pages > 1 THEN 1 ELSE page END AS to_id FROM refs), body AS (SELECT * FROM tgt WHERE from_id <> to_id)"


@query(_REFS + " SELECT doc_id, from_id, to_id, page, 'See page ' || page AS anchor, count(*) AS occurrences FROM body GROUP BY ALL")
def reference_edges(spark, d):
    s = X.sections(spark, d)
    return references.extract(s, s.groupBy("doc_id").agg(F.max("n_pages").alias("page_count")))


@query(_REFS + ", e AS (SELECT doc_id, from_id, to_id, count(*) AS weight FROM body GROUP BY ALL) SELECT doc_id, id, sum(weight)::BIGINT AS degree FROM (SELECT doc_id, from_id AS id, weight FROM e UNION ALL SELECT doc_id, to_id, weight FROM e) GROUP BY ALL")
def node_degree(spark, d):
    s = X.sections(spark, d)
    found = references.extract(s, s.groupBy("doc_id").agg(F.max("n_pages").alias("page_count")))
    return references.degrees(references.weighted_edges(found))


@query(f"WITH {S.EDGES} SELECT doc_id, from_id, to_id, sum(coalesce(nullif(occurrences, 0), 1))::BIGINT AS weight FROM edges GROUP BY ALL")
def weighted_references(spark, d):
    return references.weighted_edges(X.part_edges(spark, d))


@query(f"WITH {S.EDGES}, n AS (SELECT 0 AS doc_id, s_suppkey AS id FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT 0, p_partkey + 1000000 FROM part WHERE p_size < 25), e AS (SELECT DISTINCT from_id, to_id FROM edges WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)), m AS (SELECT from_id AS id, to_id AS o FROM e UNION SELECT to_id, from_id FROM e UNION SELECT id, id FROM n) SELECT CAST(0 AS BIGINT) AS doc_id, id, count(*) AS neighbours FROM m GROUP BY id")
def neighborhood(spark, d):
    nodes = X.table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("id")).unionByName(X.table(spark, d, "part").where("p_size < 25").select((F.col("p_partkey") + 1_000_000).alias("id"))).withColumn("doc_id", F.lit(0).cast("long"))
    return references.neighbourhood(references.both_ends(X.part_edges(spark, d).select("doc_id", "from_id", "to_id"), nodes), nodes)


@query(_REFS + ", e AS (SELECT doc_id, from_id, to_id, count(*) AS weight FROM body GROUP BY ALL) SELECT doc_id, 'REFERENCES' AS rel, count(*) AS edges, sum(weight)::BIGINT AS weight FROM e GROUP BY ALL UNION ALL SELECT doc_id, CASE WHEN page_no = 1 THEN 'HAS_SECTION' ELSE 'PART_OF' END, count(*), count(*) FROM pg GROUP BY ALL")
def document_graph(spark, d):
    s = X.sections(spark, d).withColumn("parent_id", F.when(F.col("id") > 1, F.lit(1)))
    _, edges = references.graph(s, references.extract(s, s.groupBy("doc_id").agg(F.max("n_pages").alias("page_count"))))
    return edges.groupBy("doc_id", "rel").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query(f"WITH {S.SCORES} SELECT doc_id, page_no, concat_ws(',', CASE WHEN recall < 0.95 THEN 'text_recall' END, CASE WHEN extra > 0.15 THEN 'extra_text_ratio' END, CASE WHEN table_score < 1 THEN 'table_score' END) AS reasons FROM sa WHERE recall < 0.95 OR extra > 0.15 OR table_score < 1")
def escalation_reasons(spark, d):
    s = X.scores(spark, d, "a").withColumn("r", quality.escalation_reasons(F.col("recall"), F.col("extra"), F.col("table_score")))
    return s.where(F.size("r") > 0).select("doc_id", "page_no", F.array_join("r", ",").alias("reasons"))


@query(f"WITH {S.SCORES}, j AS (SELECT sa.doc_id, sa.page_no, coalesce(sa.recall, 1.0) AS lr, coalesce(sa.extra, 0.0) AS le, coalesce(sa.table_score, 1.0) AS lt, coalesce(sb.recall, 0.0) AS cr, coalesce(sb.extra, 1.0) AS ce, coalesce(sb.table_score, 1.0) AS ct FROM sa LEFT JOIN sb ON sa.doc_id = sb.doc_id AND sa.page_no = sb.page_no) SELECT doc_id, page_no, cr >= least(0.95, lr) AND ct >= lt AND ((cr > lr AND ce <= greatest(le, 0.15)) OR (ce < le AND cr >= 0.95)) AS accepted FROM j")
def hybrid_accept(spark, d):
    a, b = X.scores(spark, d, "a"), X.scores(spark, d, "b").select("doc_id", "page_no", *[F.col(c).alias(f"c_{c}") for c in ("recall", "extra", "table_score")])
    better = quality.cloud_is_better({"recall": F.col("recall"), "extra": F.col("extra"), "table": F.col("table_score")}, {"recall": F.col("c_recall"), "extra": F.col("c_extra"), "table": F.col("c_table_score")})
    return a.join(b, ["doc_id", "page_no"], "left").select("doc_id", "page_no", better.alias("accepted"))


_CAND = f"WITH {S.SCORES}, c AS (SELECT sa.doc_id, sa.page_no, sa.recall AS base, CASE WHEN sa.page_no % 5 <> 0 THEN sb.recall END AS vlm, CASE WHEN sa.page_no % 2 = 0 THEN 1.0 - sa.extra END AS cleanup, sa.recall AS bc, 1.0 - sa.extra AS cc FROM sa LEFT JOIN sb ON sa.doc_id = sb.doc_id AND sa.page_no = sb.page_no), k AS (SELECT *, coalesce(vlm > base, false) AS v, cleanup IS NOT NULL AND coalesce(cc >= bc - CAST(0.12 AS DOUBLE), false) AS u FROM c), m AS (SELECT *, CASE WHEN v AND (NOT u OR vlm >= cleanup) THEN 'vlm' WHEN u THEN 'cleanup' ELSE 'baseline' END AS method FROM k)"


@query(_CAND + " SELECT doc_id, page_no, method, CASE method WHEN 'vlm' THEN vlm WHEN 'cleanup' THEN cleanup ELSE base END AS composite, CASE WHEN method <> 'baseline' THEN method WHEN vlm IS NOT NULL THEN 'vlm' WHEN cleanup IS NOT NULL THEN 'cleanup' ELSE 'vlm' END AS recorded FROM m")
def adoption_winner(spark, d):
    return quality.adopt(_candidates(spark, d), ["doc_id", "page_no"])


def _candidates(spark, d):
    a, b = X.scores(spark, d, "a"), X.scores(spark, d, "b").select("doc_id", "page_no", F.col("recall").alias("b_recall"))
    j = a.join(b, ["doc_id", "page_no"], "left")
    return j.select("doc_id", "page_no", F.col("recall").alias("base"), F.when(F.col("page_no") % 5 != 0, F.col("b_recall")).alias("vlm"), F.when(F.col("page_no") % 2 == 0, 1.0 - F.col("extra")).alias("cleanup"), F.col("recall").alias("base_content"), (1.0 - F.col("extra")).alias("cleanup_content"))


@query(_CAND + ", n AS (SELECT doc_id, floor(sum(CAST(round(CASE method WHEN 'vlm' THEN vlm WHEN 'cleanup' THEN cleanup ELSE base END * 100) AS BIGINT))::BIGINT * 10 / count(*) + 0.5) / 1000 AS canonical_mean, count(*) FILTER (method <> 'baseline') AS adopted FROM m GROUP BY doc_id) SELECT doc_id, canonical_mean, adopted FROM n")
def canonical_mean(spark, d):
    w = quality.adopt(_candidates(spark, d), ["doc_id", "page_no"])
    return w.groupBy("doc_id").agg((F.floor(F.sum(F.round(F.col("composite") * 100).cast("long")) * 10 / F.count("*") + 0.5) / 1000).alias("canonical_mean"), F.count_if(F.col("method") != "baseline").alias("adopted"))


@query(f"WITH {S.SCORES}, v AS (SELECT *, recall >= 0.9 AS ok FROM sa) SELECT doc_id, count(*) AS pages, sum(CAST(round(recall * 100) AS BIGINT))::BIGINT / count(*) AS avg_recall, min(recall) AS min_recall, CASE WHEN count(table_score) = 0 THEN 1.0 ELSE count(*) FILTER (table_score = 1) / count(table_score) END AS table_coverage, count(*) FILTER (ok) / count(*) AS pass_share FROM v GROUP BY doc_id")
def scorecard(spark, d):
    s = X.scores(spark, d, "a").withColumn("verdict", quality.verdict(F.col("recall")))
    return quality.card(s, ["doc_id"]).select("doc_id", "pages", (F.round(F.col("avg_recall") * F.col("pages") * 100).cast("long") / F.col("pages")).alias("avg_recall"), "min_recall", "table_coverage", "pass_share")


@query(f"WITH {S.SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY recall, page_no) AS place FROM sa) SELECT doc_id, page_no, place, recall FROM r WHERE place <= 3")
def worst_pages(spark, d):
    """The three worst pages of every document: a bake-off's sample."""
    return records.per_owner_limit(X.scores(spark, d, "a"), ["doc_id"], [F.col("recall"), F.col("page_no")], 3).select("doc_id", "page_no", "place", "recall")


@query(f"WITH {S.PAGES} SELECT doc_id, page_no FROM pg WHERE (page_no - 1) % greatest(1, n_pages // 4) = 0")
def systematic_sample(spark, d):
    return records.systematic(X.pages(spark, d).select("doc_id", "page_no"), 4).select("doc_id", "page_no")


@query(f"WITH {S.SCORES}, j AS (SELECT sa.doc_id, sa.page_no, sa.recall AS a, sb.recall AS b FROM sa LEFT JOIN sb ON sa.doc_id = sb.doc_id AND sa.page_no = sb.page_no) SELECT page_no, sum(CAST(round(a * 100) AS BIGINT))::BIGINT AS a, sum(CAST(round(b * 100) AS BIGINT))::BIGINT AS b, count(*) FILTER (a >= coalesce(b, 0)) AS a_wins FROM j GROUP BY page_no")
def bake_off(spark, d):
    runs = X.scores(spark, d, "a").withColumn("model", F.lit("a")).unionByName(X.scores(spark, d, "b").withColumn("model", F.lit("b")))
    wide = runs.groupBy("doc_id", "page_no").pivot("model", ["a", "b"]).agg(F.first("recall"))
    return wide.groupBy("page_no").agg(F.sum(F.round(F.col("a") * 100).cast("long")).alias("a"), F.sum(F.round(F.col("b") * 100).cast("long")).alias("b"), F.count_if(F.col("a") >= F.coalesce("b", F.lit(0.0))).alias("a_wins"))


_SRC = f"WITH {S.PAGES}, src AS (SELECT doc_id, page_no AS id, md AS text FROM pg), {S.LINT}"


@query(_SRC + " SELECT doc_id, id AS page_no, code, CAST(line AS INTEGER) AS line, message FROM lint")
def lint_issues(spark, d):
    return references.lint(X.pages(spark, d), ["doc_id", "page_no"], "md")


@query(_SRC + " SELECT code, count(*) AS n FROM lint GROUP BY code")
def lint_counts(spark, d):
    return references.lint(X.pages(spark, d), ["doc_id"], "md").groupBy("code").agg(F.count("*").alias("n"))


@query(_SRC + f", {S.SEPARATED} SELECT doc_id, id AS page_no, md5(text) AS md_md5 FROM fixed")
def fix_separators(spark, d):
    return references.with_separators(X.pages(spark, d), ["doc_id", "page_no"], "md").select("doc_id", "page_no", F.md5("md").alias("md_md5"))


_WRITTEN = f"""WITH {S.PAGES}, src AS (SELECT doc_id, page_no AS id, n_pages AS n, CASE WHEN page_no % 2 = 0 THEN md || chr(10) || 'Refer to page ' || (page_no * 3 % n_pages + 1) || '.' || chr(10) || '| lone |' || chr(10) || '```' ELSE md END AS text FROM pg), {S.LINT},
rf AS (SELECT doc_id, id, unnest(regexp_extract_all(text, '(?:See|Refer to) page \\d+')) AS anchor FROM src),
rt AS (SELECT doc_id, id, anchor, CAST(regexp_extract(anchor, '(\\d+)', 1) AS INT) AS page FROM rf),
rn AS (SELECT doc_id, id, count(DISTINCT anchor) AS n_references FROM rt WHERE page <> id GROUP BY ALL),
lc AS (SELECT doc_id, id, count(*) AS n, string_agg(code, ',' ORDER BY place) AS codes FROM lint GROUP BY ALL)"""


@query(_WRITTEN + " SELECT src.doc_id, src.id, md5(text) AS markdown_md5, CAST(coalesce(lc.n, 0) AS INTEGER) AS lint_count, coalesce(codes, '') AS lint_codes, coalesce(n_references, 0) AS n_references FROM src LEFT JOIN lc ON lc.doc_id = src.doc_id AND lc.id = src.id LEFT JOIN rn ON rn.doc_id = src.doc_id AND rn.id = src.id")
def sections_on_write(spark, d):
    """Every second section's text is written again, first with a draft; lint issues and references follow the stored texts."""
    tree = X.outline(spark, d)
    counts = tree.groupBy("doc_id").agg(F.max("n_pages").alias("page_count"))
    some = tree.where("id % 2 = 0")
    final = F.concat("markdown", F.lit("\nRefer to page "), (F.col("id") * 3 % F.col("n_pages") + 1).cast("string"), F.lit(".\n| lone |\n```"))
    changes = some.select("doc_id", "id", F.lit("a draft").alias("markdown"), F.lit(1).alias("seq")).unionByName(some.select("doc_id", "id", final.alias("markdown"), F.lit(2).alias("seq")))
    bodies, links = writes.on_write(changes, tree, counts)
    base = tree.select("doc_id", "id", "markdown", writes.lint_column(F.col("markdown")).alias("lint_issues"))
    now, found = writes.current(base, references.extract(tree, counts), bodies.withColumn("batch", F.lit(0)), links.withColumn("batch", F.lit(0)))
    codes = F.array_join(F.transform(F.from_json("lint_issues", "array<struct<code:string>>"), lambda x: x["code"]), ",")
    n = found.groupBy("doc_id", F.col("from_id").alias("id")).agg(F.count("*").alias("n_references"))
    return now.join(n, ["doc_id", "id"], "left").select("doc_id", "id", F.md5("markdown").alias("markdown_md5"), writes.lint_count(F.col("lint_issues")).alias("lint_count"), F.coalesce(codes, F.lit("")).alias("lint_codes"), F.coalesce("n_references", F.lit(0).cast("long")).alias("n_references"))


_ROW, _SEP = "'^\\s*\\|.*\\|\\s*$'", "'^\\s*\\|[\\s:|-]+\\|\\s*$'"
_STITCHED = f"""WITH RECURSIVE {S.PAGES}, {S.TABLE_PAGES},
l AS (SELECT doc_id, page_no, place, markdown, string_split(markdown, chr(10)) AS x FROM tp),
h AS (SELECT *, list_transform(x, lambda r: regexp_matches(r, {_ROW})) AS is_row FROM l),
c AS (SELECT doc_id, page_no, place, x, coalesce(list_position(is_row, false) - 1, len(x)) AS head, coalesce(list_position(list_reverse(is_row), false) - 1, len(x)) AS tail FROM h),
walk AS (
    SELECT doc_id, page_no, place, x, tail, CAST(0 AS BIGINT) AS gone FROM c WHERE place = 1
    UNION ALL
    SELECT c.doc_id, c.page_no, c.place, c.x, CASE WHEN g AND c.head = len(c.x) THEN 0 ELSE c.tail END, CASE WHEN g THEN c.head ELSE 0 END
    FROM (SELECT c.*, c.head > 0 AND w.tail > 0 AND len(string_split(c.x[1], '|')) = len(string_split(w.x[len(w.x) - w.tail + 1], '|')) AS g FROM walk w JOIN c ON c.doc_id = w.doc_id AND c.place = w.place + 1) c
),
up AS (SELECT doc_id, place - 1 AS place, x[CASE WHEN gone >= 2 AND regexp_matches(x[2], {_SEP}) THEN 3 ELSE 1 END : gone] AS got FROM walk WHERE gone > 0)"""


@query(_STITCHED + " SELECT w.doc_id, w.page_no, md5(array_to_string(list_concat(w.x[w.gone + 1 : len(w.x)], coalesce(got, [])), chr(10))) AS md_md5 FROM walk w LEFT JOIN up ON up.doc_id = w.doc_id AND up.place = w.place")
def stitch_tables(spark, d):
    return stitching.stitched(X.table_pages(spark, d)).select("doc_id", "page_no", F.md5("markdown").alias("md_md5"))


_CANONICAL = f"""WITH {S.PAGES}, whole AS (SELECT *, doc_id + page_no AS k FROM pg WHERE doc_id % 10 <> 0), src AS (SELECT doc_id, page_no AS id, md AS text FROM whole WHERE k % 3 <> 0), {S.BLOCKS},
raws AS (SELECT doc_id, page_no AS id, unnest([1, 2, 3]) AS n, k, '**' || x[(page_no - 1) * 5 + 1] || '**' AS bold FROM whole JOIN pg1 USING (doc_id, page_no) WHERE k % 3 = 0),
al AS (
    SELECT doc_id, id, n, type, {S.plain_text('markdown')} AS text, markdown, level, true AS lost FROM blk
    UNION ALL SELECT doc_id, id, n, CASE n WHEN 1 THEN 'heading' WHEN 2 THEN 'paragraph' ELSE 'table' END, CASE n WHEN 1 THEN 'Part ' || k WHEN 2 THEN {S.plain_text('bold')} ELSE 'A B 1 2' END, CASE n WHEN 1 THEN '## Part ' || k WHEN 2 THEN bold ELSE '| A | B |' || chr(10) || '| 1 | 2 |' END, CASE n WHEN 1 THEN 2 END, n = 2 FROM raws
)"""


@query(_CANONICAL + " SELECT doc_id, 'block_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY id, n) AS VARCHAR), 6, '0') AS block_id, 'page_' || lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS page_id, type, md5(text) AS text_md5, md5(markdown) AS markdown_md5, CAST(level AS INTEGER) AS level, CAST(n AS INTEGER) AS reading_order FROM al")
def canonical_blocks(spark, d):
    """The blocks of all documents from a parser's JSON, with those that it gave and those cut from markdown."""
    found = canonical.blocks(X.raw_output(spark, d))
    return found.select("doc_id", "block_id", "page_id", "type", F.md5("text").alias("text_md5"), F.md5("markdown").alias("markdown_md5"), "level", "reading_order")


@query(_CANONICAL + ", w AS (SELECT doc_id, 'missing_bbox' AS code FROM al WHERE lost UNION ALL SELECT DISTINCT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no_pages' ELSE 'slow' END FROM pg) SELECT doc_id, code, count(*) AS n FROM w GROUP BY ALL")
def parser_warnings(spark, d):
    raw = X.raw_output(spark, d)
    return canonical.warnings(raw, canonical.blocks(raw)).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'text ' || event_type WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN '' ELSE props END AS markdown, CASE event_id % 4 WHEN 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) / 4 AS DOUBLE) WHEN 1 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) / 8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cost FROM events")
def model_replies(spark, d):
    """Events as replies of models: plain texts, JSON with the text under several names, JSON without it; costs in several places."""
    e = X.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.pmod(F.col("event_id"), F.lit(5))
    reply = F.when(n == 0, F.concat(F.lit(" text "), "event_type", F.lit(" "))).when(n == 1, F.to_json(F.struct(F.col("event_type").alias("md"), F.lit("x").alias("content")))).when(n == 2, F.to_json(F.struct(F.col("event_type").alias("content")))).when(n == 3, F.to_json(F.struct(F.lit(1).alias("other")))).otherwise(F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')))
    m = F.pmod(F.col("event_id"), F.lit(4))
    response = F.when(m == 0, F.to_json(F.struct(F.struct((k / 4).alias("total_cost")).alias("usage")))).when(m == 1, F.to_json(F.struct(F.struct(F.lit(0).alias("cost")).alias("usage"), (k / 8).alias("cost")))).when(m == 2, F.lit('{"cost": "dear"}')).otherwise(F.lit("not json"))
    found = canonical.with_replies(e.select("event_id", reply.alias("reply"), response.alias("response")), "reply", "response")
    return found.select("event_id", "markdown", "cost")


_FIGURES = f"""WITH {S.PAGES}, p AS (SELECT doc_id, page_no, doc_id + page_no AS k, array_to_string(x[(page_no - 1) * 5 + 1 : page_no * 5], chr(10)) AS body FROM pg1),
q AS (SELECT *, k % 3 AS n, 'f-' || doc_id || '-' || page_no || '-' AS f, '**==> picture [12 x 34] intentionally omitted <==**' AS m1, '==> picture [5 x 6] intentionally omitted <==' AS m2, chr(10) || repeat('x', 220) || chr(10) AS mid, CASE WHEN k % 3 = 0 THEN chr(10) || '---- Start of picture text ----' ELSE '' END AS read FROM p),
t AS (SELECT *, body || CASE WHEN k % 4 = 0 THEN '' ELSE chr(10) || m1 || mid || m2 || read END AS text, '![Figure ' || page_no || '.1](' || f || '1)' AS g1, '![Figure ' || page_no || '.2](' || f || '2)' AS g2 FROM q),
r AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN k % 4 <> 0 THEN n WHEN k % 7 <> 0 AND NOT contains(body, '![') AND length(body) < 700 THEN 1 ELSE 0 END AS placed FROM t)"""


@query(_FIGURES + " SELECT doc_id, page_no, md5(CASE WHEN placed = 0 THEN text WHEN k % 4 = 0 THEN regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || g1 || chr(10) ELSE body || chr(10) || g1 || mid || CASE WHEN n = 2 THEN g2 ELSE m2 END || read END) AS markdown_md5, CAST(placed AS INTEGER) AS n_placed FROM r")
def embedded_images(spark, d):
    pages, images = X.figure_pages(spark, d)
    return figures.embedded(pages, images).select("doc_id", "page_no", F.md5("markdown").alias("markdown_md5"), "n_placed")


_CAPITALS = f"""WITH b AS (SELECT doc_id, text, translate(array_to_string(string_split(text, ' ')[1:3], ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS f FROM documents WHERE text IS NOT NULL),
cp AS (SELECT doc_id, f || chr(10) || 'SECOND HEADING' || chr(10) || text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'aa  bb  cc' || chr(10) || 'dd  ee  ff' || chr(10) || 'gg  hh  ii' WHEN 1 THEN chr(10) || 'Revision Description Issue' || chr(10) || '1/2020' || chr(10) || '2/2021 3/2022' ELSE '' END AS src,
    CASE WHEN doc_id % 2 = 0 THEN '# ' || f ELSE f END || chr(10) || text || CASE WHEN doc_id % 8 = 0 THEN chr(10) || '| a | b |' ELSE '' END AS md FROM b),
l AS (SELECT doc_id, trim(unnest(string_split(src, chr(10)))) AS line FROM cp),
e AS (SELECT doc_id, count(*) FILTER (length(line) <= 100 AND length(regexp_replace(line, '\\P{{L}}', '', 'g')) >= 4 AND length(regexp_replace(line, '\\P{{Lu}}', '', 'g')) >= 0.75 * length(regexp_replace(line, '\\P{{L}}', '', 'g'))) AS expected, count(*) FILTER (regexp_matches(line, '^\\|.*\\|$') OR len(regexp_extract_all(line, '\\S\\s{{2,}}\\S')) >= 2) AS cells FROM l GROUP BY ALL),
h AS (SELECT doc_id, count(*) FILTER (regexp_matches(x, '^#{{1,6}}\\s+.*\\S\\s*$')) AS headings, count(*) FILTER (regexp_matches(x, '^\\s*\\|.*\\|\\s*$')) AS table_rows FROM (SELECT doc_id, unnest(string_split(md, chr(10))) AS x FROM cp) GROUP BY ALL),
tk AS (SELECT doc_id, unnest({S.tokens("regexp_replace(src, '<[^>]+>', ' ', 'g')")}) AS tok, 1 AS t, 0 AS m FROM cp UNION ALL SELECT doc_id, unnest({S.tokens("regexp_replace(md, '<[^>]+>', ' ', 'g')")}), 0, 1 FROM cp),
tc AS (SELECT doc_id, tok, sum(t) AS t, sum(m) AS m FROM tk GROUP BY ALL),
o AS (SELECT doc_id, sum(t) AS t, sum(m) AS m, sum(least(t, m)) AS c FROM tc GROUP BY ALL),
z AS (SELECT cp.doc_id, expected, headings, table_rows, coalesce(t, 0)::BIGINT AS t, coalesce(m, 0)::BIGINT AS m, coalesce(c, 0)::BIGINT AS c, cells >= 3 OR ((contains(lower(src), 'revision')::INT + contains(lower(src), 'description')::INT + contains(lower(src), 'initiated by')::INT + contains(lower(src), 'approved by')::INT + contains(lower(src), 'page')::INT + contains(lower(src), 'issue')::INT) >= 3 AND (len(regexp_extract_all(src, '\\b\\d{{1,2}}/\\d{{4}}\\b')) >= 3 OR len(regexp_extract_all(src, '(?m)^\\s*\\d+\\s*$')) >= 4)) AS has_table FROM cp JOIN e USING (doc_id) JOIN h USING (doc_id) LEFT JOIN o USING (doc_id))"""


@query(_CAPITALS + " SELECT doc_id, floor(CASE WHEN t = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(c AS DOUBLE) / CAST(t AS DOUBLE) END * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 1000 AS recall, floor(CASE WHEN m = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(m - c AS DOUBLE) / CAST(m AS DOUBLE) END * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 1000 AS extra, CASE WHEN has_table THEN CASE WHEN table_rows > 0 THEN 1.0 ELSE 0.0 END END AS table_score, CASE WHEN expected > 0 THEN floor(least(1.0, headings / expected) * 1000 + 0.5) / 1000 END AS heading_score, has_table, CAST(expected AS INTEGER) AS expected FROM z")
def page_quality(spark, d):
    found = quality.page_quality(X.capital_pages(spark, d), ["doc_id"], "source", "markdown")
    return found.select("doc_id", "recall", "extra", "table_score", "heading_score", "has_table", "expected")


_RUNS = f"""WITH {S.PAGES}, pr AS (SELECT doc_id, page_no, r, (doc_id + page_no) * r AS k FROM pg, (VALUES (1), (2), (3)) v(r)),
res AS (SELECT doc_id, 'run' || r AS profile, r, page_no, CASE WHEN k % 11 <> 0 THEN (k % 30) END AS cents, r = 3 AND doc_id % 7 = 0 AS failed FROM pr WHERE r <> 2 OR doc_id % 5 <> 0)"""


@query(_RUNS + ", q AS (SELECT DISTINCT doc_id, 'run' || r AS profile FROM pr), s AS (SELECT doc_id, profile, count(*) AS pages, sum(cents) AS total, count(cents) AS n, min(cents) AS low, bool_or(failed) AS failed FROM res GROUP BY ALL), t AS (SELECT q.*, CASE WHEN pages IS NULL THEN 'skipped' WHEN failed THEN 'error' ELSE 'ok' END AS status, pages, total, n, low FROM q LEFT JOIN s ON q.doc_id = s.doc_id AND q.profile = s.profile) SELECT doc_id, profile, status, CASE status WHEN 'skipped' THEN 'parser is not available' WHEN 'error' THEN 'timed out' END AS reason, CASE WHEN status = 'ok' THEN pages END AS pages, CASE WHEN status = 'ok' THEN floor(total * 10000 / n + 0.5) / 1000000 END AS avg_recall, CASE WHEN status = 'ok' THEN CAST(row_number() OVER (PARTITION BY doc_id, status ORDER BY floor(total * 10000 / n + 0.5) DESC NULLS LAST, profile) AS INTEGER) END AS place FROM t")
def run_compare(spark, d):
    requested, results, _ = X.parser_runs(spark, d)
    return runs.run_compare(requested, results).select("doc_id", "profile", "status", "reason", "pages", _million(F.col("avg_recall")).alias("avg_recall"), "place")


@query(_RUNS + ", o AS (SELECT *, CASE r WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END AS started FROM res WHERE cents IS NOT NULL) SELECT doc_id, page_no, CAST(count(*) AS INTEGER) AS n_runs, string_agg(profile, ',' ORDER BY started DESC) AS run_ids, min_by(profile, {'c': -cents, 'p': profile}) AS best_run, CAST(max(cents) - min(cents) AS BIGINT) AS spread FROM o GROUP BY ALL")
def page_compare(spark, d):
    _, results, started = X.parser_runs(spark, d)
    found = runs.page_compare(results.where("recall is not null").withColumnRenamed("profile", "run_id"), started)
    return found.select("doc_id", "page_no", "n_runs", F.array_join(F.transform("runs", lambda r: r["run_id"]), ",").alias("run_ids"), "best_run", F.round(F.col("spread") * 100).cast("long").alias("spread"))


#: Types that the edits of the queries may give.
_TYPES = [name for _, name, _ in X.TYPES]


@query(f"WITH {S.PAGES}, {S.EDITED} SELECT doc_id, id, parent_id, ord, title, section_type, included, page_start, page_end, md5(markdown) AS markdown_md5, level, lft, rgt, is_group, path FROM ed")
def section_edits(spark, d):
    """Sections of every third document after nine edits each."""
    found = edits.edited(X.outline(spark, d), X.edits(spark, d), _TYPES)
    return found.withColumn("markdown_md5", F.md5("markdown")).drop("markdown")


@query(f"WITH {S.PAGES}, m AS (SELECT DISTINCT doc_id, n_pages AS n FROM pg WHERE doc_id % 3 = 0) SELECT doc_id, CAST(seq AS BIGINT) AS seq, op, CASE WHEN seq = 4 THEN 'unknown type ' || chr(39) || 'zz' || chr(39) WHEN seq = 8 THEN 'a title can' || chr(39) || 't be empty' WHEN n < least THEN 'no such section' END AS error FROM m, (VALUES (1, 'rename', 1), (2, 'include', 3), (3, 'retype', 1), (4, 'retype', 2), (5, 'delete', 7), (6, 'create', 1), (7, 'split', 3), (8, 'rename', 2), (9, 'move', 3)) v(seq, op, least)")
def section_edit_log(spark, d):
    return edits.outcomes(X.outline(spark, d), X.edits(spark, d), _TYPES)


@query(f"WITH {S.PAGES}, {S.EDITED}, s AS (SELECT doc_id, id, n, markdown FROM ed UNION ALL SELECT doc_id, page_no, n_pages, md FROM pg WHERE doc_id % 3 <> 0), f AS (SELECT doc_id, id AS from_id, n, CAST(regexp_extract(markdown, 'See page (\\d+)', 1) AS INT) AS page FROM s WHERE markdown LIKE '%See page %'), t AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND page IN (7, 8) THEN 1 ELSE page END AS to_id FROM f WHERE page <= n) SELECT doc_id, from_id, to_id, page, 'See page ' || page AS anchor, count(*) AS occurrences FROM t WHERE from_id <> to_id GROUP BY ALL")
def edited_references(spark, d):
    """All references after the edits: those of edited documents found anew, the others as they were."""
    tree, log = X.outline(spark, d), X.edits(spark, d)
    counts = tree.groupBy("doc_id").agg(F.max("n_pages").alias("page_count"))
    return edits.with_references(references.extract(tree, counts), edits.edited(tree, log, _TYPES), log, counts)


_UNDER = "'| A | B |' || chr(10) || '| 1 | 2 |', '| A | B |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'"


@query(f"WITH {S.PAGES}, {S.OUTLINE}, {S.REBUILT} SELECT np.doc_id, np.id, CAST(pages AS INTEGER) AS pages, md5(replace(coalesce(t, ''), {_UNDER})) AS markdown_md5, coalesce(ovs.near, '') AS overlaps FROM np LEFT JOIN tx ON tx.doc_id = np.doc_id AND tx.id = np.id LEFT JOIN ovs ON ovs.doc_id = np.doc_id AND ovs.id = np.id")
def rebuilt_sections(spark, d):
    """The first section and every third of all documents, made again from their pages."""
    tree = X.numbered_outline(spark, d)
    pages = X.pages(spark, d).select("doc_id", "page_no", F.col("md").alias("markdown"))
    found = rebuilding.rebuilt(pages, tree, tree.where("id = 1 or id % 3 = 0"))
    return found.select("doc_id", "id", "pages", F.md5("markdown").alias("markdown_md5"), F.array_join(F.transform("overlaps", lambda x: x.cast("string")), ",").alias("overlaps"))


@query(f"WITH {S.PAGES}, {S.OUTLINE}, pts AS (SELECT doc_id, page_no AS page FROM pg WHERE page_no % 3 = 0 UNION SELECT doc_id, n_pages + 1 FROM pg), c AS (SELECT pts.doc_id, page, id, lft, rgt FROM pts JOIN ol ON pts.doc_id = ol.doc_id AND page BETWEEN page_start AND page_end), dp AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.lft < b.lft AND b.rgt < a.rgt)), n AS (SELECT pts.doc_id, pts.page, count(dp.id) AS n_owners, min(dp.id) AS one FROM pts LEFT JOIN dp ON dp.doc_id = pts.doc_id AND dp.page = pts.page GROUP BY ALL) SELECT doc_id, page, n_owners, CASE WHEN n_owners = 1 THEN one END AS owner, CASE n_owners WHEN 0 THEN 'no_owner' WHEN 1 THEN 'owned' ELSE 'shared' END AS state FROM n")
def page_owners(spark, d):
    """Which section a changed page goes to: every third page, and one past the end."""
    p = X.pages(spark, d)
    points = p.where("page_no % 3 = 0").select("doc_id", F.col("page_no").alias("page")).unionByName(p.select("doc_id", (F.col("n_pages") + 1).alias("page")))
    return rebuilding.owners(points, X.numbered_outline(spark, d))


def _remediated(spark, d):
    return remediation.remediated(X.drafts(spark, d), X.offline_vlm, X.offline_cleanup, X.offline_judge, scope="flagged")


@query(f"WITH {S.PAGES}, {S.REMEDIATED} SELECT doc_id, page_no, target, recorded, adopted, base_composite, canonical_composite, canonical_source, md5(canonical) AS canonical_md5, cost_units, failed FROM rem")
def remediated_pages(spark, d):
    """Flagged pages with two attempts each, the adopted texts, and what every page's text is in the end."""
    units = F.round(F.col("cost") / 0.0005).cast("int")
    return _remediated(spark, d).select("doc_id", "page_no", "target", "recorded", "adopted", "base_composite", "canonical_composite", "canonical_source", F.md5("canonical").alias("canonical_md5"), units.alias("cost_units"), F.coalesce(F.col("notes").contains("vlm failed"), F.lit(False)).alias("failed"))


@query(f"WITH {S.PAGES}, {S.REMEDIATED}, s AS (SELECT doc_id, count(*) FILTER (target) AS targets, count(*) FILTER (adopted) AS adopted, sum(CAST(round(canonical_composite * 1000) AS BIGINT))::BIGINT AS total, count(canonical_composite) AS n, sum(cost_units)::BIGINT AS cost_units FROM rem GROUP BY doc_id) SELECT doc_id, targets, adopted, ((2 * total + n) // (2 * n)) / CAST(1000 AS DOUBLE) AS canonical_mean, cost_units FROM s")
def remediation_summary(spark, d):
    sums = remediation.summary(_remediated(spark, d))
    return sums.select("doc_id", "targets", "adopted", "canonical_mean", F.round(F.col("cost") / 0.0005).cast("long").alias("cost_units"))


@query(f"WITH {S.PAGES}, src AS (SELECT doc_id, page_no AS id, md AS text FROM pg), {S.BLOCKS} SELECT doc_id, type, count(*) AS n FROM blk GROUP BY ALL")
def markdown_blocks(spark, d):
    return references.blocks(X.pages(spark, d), ["doc_id", "page_no"], "md").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(_REFS.replace("SELECT doc_id, page_no AS from_id,", "SELECT doc_id, page_no AS from_id, md,", 1).replace("SELECT doc_id, from_id, page,", "SELECT doc_id, from_id, md, page,", 1) + " SELECT doc_id, from_id AS id, md5(CASE WHEN from_id <> to_id THEN replace(md, 'See page ' || page || '. W', '[See page ' || page || '](/wiki/' || doc_id || '/' || to_id || '). W') ELSE md END) AS content_md5, CAST(from_id <> to_id AS INTEGER) AS links FROM tgt")
def linked_pages(spark, d):
    s = X.sections(spark, d).withColumn("page_count", F.col("n_pages"))
    routes = s.select("doc_id", "id", F.concat(F.lit("wiki/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("id").cast("string")).alias("route"))
    return references.with_links(s, routes).select("doc_id", "id", F.md5("content").alias("content_md5"), "links")


@query(f"WITH {S.CALLS} SELECT job, count(*) AS calls, sum(CAST(round(coalesce(cost, 0) * 100) AS BIGINT))::BIGINT AS cents, bool_and(cost IS NOT NULL) AS cost_known, sum(CASE WHEN label <> 'judge' THEN CAST(round(coalesce(cost, 0) * 100) AS BIGINT) ELSE 0 END)::BIGINT AS parse_cents FROM calls GROUP BY job")
def cost_by_job(spark, d):
    c = X.calls(spark, d).withColumn("cost", F.round(F.col("cost") * 100))
    long = lambda x: x.cast("long")
    return records.costs(c, ["job"]).select("job", "calls", long(F.col("cost")).alias("cents"), "cost_known", long(F.col("parse_cost")).alias("parse_cents"))


@query(f"WITH {S.CALLS} SELECT job, max_by(status, seq) AS status, max(seq) AS seq FROM calls GROUP BY job")
def last_status(spark, d):
    return records.latest(X.calls(spark, d), ["job"], [F.desc("seq")]).select("job", "status", "seq")


@query(f"WITH {S.CALLS} SELECT seq, job, row_number() OVER (PARTITION BY job ORDER BY ts, seq) - 1 AS log_seq FROM calls")
def log_sequence(spark, d):
    return records.per_owner_limit(X.calls(spark, d), ["job"], [F.col("ts"), F.col("seq")], 2**31 - 1).select("seq", "job", (F.col("place") - 1).alias("log_seq"))


@query(f"WITH {S.CALLS}, s AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY seq) AS src FROM calls) SELECT src, status AS dst, count(*) AS n FROM s WHERE src IS NOT NULL AND NOT ((src = 'signup') OR (src = 'view' AND status IN ('click', 'view')) OR (src = 'click' AND status = 'purchase')) GROUP BY ALL")
def invalid_transitions(spark, d):
    allowed = [("signup", s) for s in ("signup", "error", "click", "view", "purchase")] + [("view", "click"), ("view", "view"), ("click", "purchase")]
    wrong = records.invalid_steps(X.calls(spark, d), spark.createDataFrame(allowed, "src string, dst string"), ["job"], [F.col("seq")])
    return wrong.groupBy("src", "dst").agg(F.count("*").alias("n"))


#: Which event may follow which, as statuses of a user's job.
_ALLOWED = [("", "signup"), ("signup", "view"), ("signup", "click"), ("view", "click"), ("view", "error"), ("click", "purchase"), ("click", "error"), ("purchase", "view"), ("error", "signup")]


@query(f"""WITH RECURSIVE ok(src, dst) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED)}),
o AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
w AS (
    SELECT key, seq, r, CAST('' AS VARCHAR) AS source, ok.dst IS NOT NULL AS good, coalesce(ok.dst, '') AS value FROM o LEFT JOIN ok ON ok.src = '' AND ok.dst = kind WHERE r = 1
    UNION ALL
    SELECT o.key, o.seq, o.r, w.value, ok.dst IS NOT NULL, coalesce(ok.dst, w.value) FROM w JOIN o ON o.key = w.key AND o.r = w.r + 1 LEFT JOIN ok ON ok.src = w.value AND ok.dst = o.kind
)
SELECT key, seq, source, CASE WHEN good THEN 'accepted' ELSE 'refused' END AS outcome, value FROM w""")
def status_machine(spark, d):
    """Each event as a wish for a status: whether it was granted, and the status after it."""
    e = X.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return states.outcomes(e, states.Statuses(frozenset(_ALLOWED))).select("key", "seq", "source", "outcome", "value")


_KINDS = {"click": "start", "signup": "start", "purchase": "finish", "error": "cancel", "view": "look"}


@query(f"""WITH RECURSIVE k(event_type, kind) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _KINDS.items())}),
o AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS t, kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events JOIN k USING (event_type)),
w AS (
    SELECT key, seq, r, kind, t, CAST(NULL AS BIGINT) AS was, CASE WHEN kind = 'start' THEN t END AS since FROM o WHERE r = 1
    UNION ALL
    SELECT o.key, o.seq, o.r, o.kind, o.t, w.since, CASE WHEN w.since IS NOT NULL AND o.t < w.since + 172800000000 THEN CASE WHEN o.kind IN ('finish', 'cancel') THEN NULL ELSE w.since END WHEN o.kind = 'start' THEN o.t END
    FROM w JOIN o ON o.key = w.key AND o.r = w.r + 1
),
live AS (SELECT *, was IS NOT NULL AND t < was + 172800000000 AS running, was IS NOT NULL AND t >= was + 172800000000 AS over, lag(seq) OVER (PARTITION BY key ORDER BY r) AS before FROM w)
SELECT key, seq, CASE WHEN kind = 'start' THEN CASE WHEN running THEN 'refused' ELSE 'started' END WHEN kind IN ('finish', 'cancel') AND running THEN CASE kind WHEN 'finish' THEN 'finished' ELSE 'cancelled' END ELSE 'ignored' END AS outcome FROM live
UNION ALL SELECT key, before, 'expired' FROM live WHERE over""")
def running_turns(spark, d):
    """Clicks and signups as starts of turns, purchases and errors as their ends; a turn of two days expires."""
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    e = X.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"))
    return states.outcomes(e, states.Turns(2 * 86_400_000_000)).select("key", "seq", "outcome")


@query(f"WITH {S.CALLS}, f AS (SELECT job, status, min(seq) AS o FROM calls GROUP BY ALL) SELECT job, string_agg(status, ',' ORDER BY o, status) AS layers FROM f GROUP BY job")
def changed_layers(spark, d):
    return records.distinct_in_order(X.calls(spark, d), ["job"], "seq", "status")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS chunks FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def message_fold(spark, d):
    c = X.table(spark, d, "conversations").where("role <> 'system'").withColumnRenamed("turn", "seq")
    return records.folded_messages(c, ["conv_id"])


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role <> 'system') SELECT conv_id, turn, role, place FROM r WHERE place <= 40")
def history(spark, d):
    """The oldest 40 messages of every conversation, as the assistant replays them."""
    c = X.table(spark, d, "conversations").where("role <> 'system'")
    return records.per_owner_limit(c, ["conv_id"], [F.col("turn")], 40).select("conv_id", "turn", "role", "place")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def integrity_orphans(spark, d):
    have = X.table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.missing(X.table(spark, d, "lineitem"), have, ["l_orderkey"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return records.duplicates(X.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT DISTINCT ps.p_partkey AS part FROM part ps WHERE ps.p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def stale_pages(spark, d):
    """Descendants that are no longer kept: parts without a line item."""
    parts = X.table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    return records.missing(parts, X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part")), ["part"])


@query("SELECT o_orderpriority AS status, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM orders GROUP BY o_orderpriority")
def review_status_counts(spark, d):
    by = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"))
    return by.withColumn("total", by.agg(F.sum("n").alias("total")).scalar())


@query("WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 't_' ELSE '' END || p_brand || '/' || p_partkey AS name, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS k, p_partkey AS created FROM part), t AS (SELECT k, min_by(name, {'s': starts_with(name, 't_'), 'c': created}) AS survivor FROM n GROUP BY k) SELECT name, survivor FROM n JOIN t USING (k) WHERE name <> survivor")
def same_label_types(spark, d):
    """Parts as types: those whose label differs in case and spaces only go to one of them."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "t_").otherwise(""), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    return records.same_labels(X.table(spark, d, "part").select(name.alias("name"), F.col("p_type").alias("label"), F.col("p_partkey").alias("created")))


@query("SELECT c.c_custkey, c.c_name, c.c_acctbal AS value, false AS is_new FROM customer c WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name || '*', c_acctbal + 1, false FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal, true FROM supplier")
def upsert_snapshot(spark, d):
    c = X.table(spark, d, "customer")
    old = c.select("c_custkey", "c_name", F.col("c_acctbal").alias("value"), F.lit(False).alias("is_new"))
    fresh = X.table(spark, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("value"), F.lit(True).alias("is_new"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("value"), F.lit(True).alias("is_new")).unionByName(fresh)
    return records.upsert(old, new, ["c_custkey"], created="is_new")


@query(_TREE + ", gone AS (SELECT u.doc_id, u.id FROM up u WHERE u.ancestor BETWEEN 100 AND 110) SELECT doc_id, id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.id = t.id)")
def delete_subtrees(spark, d):
    tree = trees.nested_set(X.regions(spark, d))
    return trees.without_subtree(tree, tree.where(F.col("id").between(100, 110)).select("doc_id", "id")).select("doc_id", "id")


@query(f"WITH {S.PAGES} SELECT doc_id, page_no FROM pg WHERE page_no IN (2, 1, 3, 5)")
def page_range(spark, d):
    """Pages 3-1 and 5 of every document."""
    wanted = spark.createDataFrame([(n,) for n in folds.page_range("3-1,5", 5)], "page_no int")
    return X.pages(spark, d).select("doc_id", "page_no").join(F.broadcast(wanted), "page_no", "left_semi").select("doc_id", "page_no")


@query("SELECT source AS doc_id, lang AS run_id, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM documents GROUP BY ALL")
def run_overview(spark, d):
    return X.table(spark, d, "documents").groupBy(F.col("source").alias("doc_id"), F.col("lang").alias("run_id")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))


@query("SELECT doc_id, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 2147483648) % 12 AS color, floor(least(14.0, 4 + sqrt(n_chars) * 2 / 100) * 1000 + 0.5) / 1000 AS radius FROM documents WHERE n_chars > 0")
def node_style(spark, d):
    codes = F.transform(F.split(F.col("doc_id").cast("string"), ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % 2147483648)
    return X.table(spark, d, "documents").where("n_chars > 0").select("doc_id", (h % 12).alias("color"), T.thousandths(F.least(F.lit(14.0), 4 + F.sqrt("n_chars") * 2 / 100)).alias("radius"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """An addition of this library: tumbling windows over the event table."""
    return X.table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query(f"WITH {S.PAGES}, {S.EDITED} SELECT doc_id, md5(string_agg(repeat('  ', level - 1) || '- ' || title || CASE WHEN page_start IS NULL THEN '' WHEN page_end = page_start THEN ' [p.' || page_start || ']' ELSE ' [p.' || page_start || '-' || page_end || ']' END || ' <' || id || '>', chr(10) ORDER BY lft)) AS outline_md5 FROM ed GROUP BY doc_id")
def tree_outline(spark, d):
    """Outlines of edited documents, with pages and ids."""
    return trees.outlines(edits.edited(X.outline(spark, d), X.edits(spark, d), _TYPES)).select("doc_id", F.md5("outline").alias("outline_md5"))


@query(f"WITH RECURSIVE {S.REGIONS}, w AS (SELECT doc_id, id, title AS crumbs FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.doc_id, t.id, w.crumbs || ' > ' || t.title FROM tree t JOIN w ON t.doc_id = w.doc_id AND t.parent_id = w.id) SELECT doc_id, id, crumbs FROM w")
def breadcrumbs(spark, d):
    return trees.breadcrumbs(X.regions(spark, d))


@query(f"WITH {S.PAGES}, s AS (SELECT doc_id, page_no, n_pages, 'Part ' || ((doc_id + page_no) % 7) AS title FROM pg) SELECT doc_id, title, min(page_no) AS first_ord, min(page_no) AS page_start, max(CASE WHEN page_no = 1 THEN n_pages ELSE page_no END) AS page_end, count(*) AS parts FROM s GROUP BY ALL")
def chapter_pages(spark, d):
    return trees.chapters(X.sections(spark, d).withColumn("path", F.array("title")))


@query(f"WITH {S.PAGES}, l AS (SELECT doc_id, page_no, list_filter(string_split(md, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(x, '^\\s*\\|[\\s:|-]+\\|\\s*$')) AS x FROM pg), r AS (SELECT doc_id, page_no, unnest(range(0, len(x))) AS row, unnest(x) AS line FROM l), c AS (SELECT doc_id, page_no, row, string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|') AS q FROM r) SELECT doc_id, page_no, row, col, trim(cell) AS cell FROM (SELECT doc_id, page_no, row, unnest(range(0, len(q))) AS col, unnest(q) AS cell FROM c)")
def table_cells(spark, d):
    return references.table_cells(X.pages(spark, d), ["doc_id", "page_no"], "md")


@query("SELECT CASE WHEN lower(trim(event_type)) IN ('click', 'view', 'purchase') THEN lower(trim(event_type)) ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1")
def classified_counts(spark, d):
    """Labels of a classifier, those off the taxonomy as 'other'."""
    label = records.valid_label(F.col("event_type"), ["click", "view", "purchase"])
    return X.table(spark, d, "events").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'excluded' WHEN l.l_partkey IS NULL THEN 'no_page' WHEN p_size % 2 = 0 THEN 'needs_regenerate' END AS state FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1) l ON p_partkey = l_partkey")
def sync_states(spark, d):
    pages = X.table(spark, d, "lineitem").where("l_linenumber = 1").select("l_partkey").distinct()
    p = X.table(spark, d, "part").join(pages, F.col("p_partkey") == F.col("l_partkey"), "left")
    written = F.when(F.col("p_size") % 2 == 0, "old").otherwise("new")
    return p.select("p_partkey", records.sync_state(F.col("l_partkey"), F.col("p_size") % 5 != 0, F.lit("new"), written).alias("state"))


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 50")
def recent_sessions(spark, d):
    """A top-k report: the fifty sessions with the latest last event."""
    sessions = X.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"), F.max("ts").alias("last"))
    return records.top_recent(sessions, [F.desc("last"), F.col("user_id")], 50).drop("last")


_CONTENT = f"""WITH {S.WEB}, {S.RECALL}, p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM web GROUP BY ALL), c AS (SELECT doc_id, {S.running('line')} AS normal, count(DISTINCT page_no) AS n FROM web GROUP BY ALL),
fu AS (SELECT doc_id, normal FROM c JOIN p USING (doc_id) WHERE pages >= 3 AND len(normal) >= 6 AND n >= greatest(2, round_even(0.5 * pages, 0))),
pn AS (SELECT DISTINCT doc_id, page_no FROM web),
tk AS (SELECT doc_id, page_no, unnest({S.tokens('line')}) AS tok, 1 AS t, 0 AS m FROM web w WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.doc_id = w.doc_id AND fu.normal = {S.running('w.line')}) UNION ALL SELECT doc_id, page_no, unnest({S.tokens('markdown')}), 0, 1 FROM pn JOIN rp ON page_no = page_id),
tc AS (SELECT doc_id, page_no, tok, sum(t) AS t, sum(m) AS m FROM tk GROUP BY ALL),
ov AS (SELECT pn.doc_id, pn.page_no, coalesce(sum(t), 0)::BIGINT AS n_truth, coalesce(sum(least(t, m)), 0)::BIGINT AS common FROM pn LEFT JOIN tc ON pn.doc_id = tc.doc_id AND pn.page_no = tc.page_no GROUP BY ALL)"""


@query(_CONTENT + " SELECT doc_id, page_no, n_truth, common, floor(CASE WHEN n_truth = 0 THEN 1.0 ELSE common / n_truth END * 1000000 + 0.5) / 1000000 AS recall FROM ov")
def content_recall(spark, d):
    lines = X.web_lines(spark, d)
    articles = lines.select("doc_id", "page_no").distinct().join(X.recall_pages(spark, d).select(F.col("page_id").alias("page_no"), "markdown"), "page_no")
    o = quality.content_overlap(lines, articles)
    return o.select("doc_id", "page_no", "n_truth", "common", _million(quality.recall(F.col("common"), F.col("n_truth"))).alias("recall"))


@query(f"WITH {S.TYPED}, {S.TAXONOMY} SELECT ord, type_name, label, count(*) AS n FROM tax JOIN typed ON type_name = section_type GROUP BY ALL")
def types_present(spark, d):
    return records.types_present(X.typed(spark, d), X.taxonomy(spark))


@query(f"WITH {S.SCORES} SELECT sa.doc_id, sa.page_no, CASE WHEN sb.page_no % 2 = 0 THEN 'approved' ELSE 'unreviewed' END AS status, CASE WHEN sb.page_no % 3 = 0 THEN 'see table' ELSE '' END AS notes FROM sa LEFT JOIN sb ON sa.doc_id = sb.doc_id AND sa.page_no = sb.page_no")
def reviewed_pages(spark, d):
    own = X.scores(spark, d, "b").select("doc_id", "page_no", F.when(F.col("page_no") % 2 == 0, "approved").otherwise("").alias("status"), F.when(F.col("page_no") % 3 == 0, "see table").alias("notes"))
    return records.reviewed(X.scores(spark, d, "a").select("doc_id", "page_no"), own, ["doc_id", "page_no"])


@query("SELECT l_orderkey AS doc_id, l_suppkey % 3 AS xref, min(l_linenumber) AS ordinal FROM lineitem WHERE CAST(l_quantity AS BIGINT) * 20 * (l_partkey % 1000) >= 200000 GROUP BY ALL")
def big_images(spark, d):
    li = X.table(spark, d, "lineitem")
    images = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("xref"), F.col("l_linenumber").alias("ordinal"), (F.col("l_quantity").cast("long") * 20).alias("width"), (F.col("l_partkey") % 1000).alias("height"))
    return records.big_images(images, ["doc_id"])


@query(f"WITH {S.SCORES} SELECT doc_id, CASE WHEN extra >= 0.1 THEN page_no END AS page_no, extra FROM sa WHERE extra < 0.1 OR page_no = 2")
def page_warnings(spark, d):
    """Low scores stand in for warnings: those under 0.1 belong to the whole document."""
    w = X.scores(spark, d, "a").select("doc_id", F.when(F.col("extra") >= 0.1, F.col("page_no")).alias("page_no"), "extra")
    return records.of_page(w, 2)


@query(f"WITH {S.SCORES}, u AS (SELECT doc_id, page_no, 'local' AS origin FROM sa WHERE NOT EXISTS (SELECT 1 FROM sb WHERE sb.doc_id = sa.doc_id AND sb.page_no = sa.page_no AND sb.recall >= 0.9) UNION ALL SELECT doc_id, page_no, 'cloud' FROM sb UNION ALL SELECT doc_id, page_no, 'run' FROM sa WHERE recall < 0.75) SELECT doc_id, origin, count(*) AS n, sum(page_no)::BIGINT AS places FROM u GROUP BY ALL")
def hybrid_parts(spark, d):
    a, b = X.scores(spark, d, "a"), X.scores(spark, d, "b")
    of = lambda df, name: df.select("doc_id", "page_no", F.lit(name).alias("origin"))
    found = records.hybrid_parts(of(a, "local"), of(b, "cloud"), b.where("recall >= 0.9"), of(a.where("recall < 0.75"), "run"))
    return found.groupBy("doc_id", "origin").agg(F.count("*").alias("n"), F.sum("page_no").cast("long").alias("places"))
