"""The fixture tables and text functions as DuckDB SQL, for the oracles."""

from __future__ import annotations


def tokens(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '[#*_`>\\-|]', ' ', 'g'), '[a-z0-9]+')"


def running(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))"


def plain(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '[#*_`>\\-\\s]+', ' ', 'g')))"


def stamp(c: str) -> str:
    patterns = [r"(?i)\bpg\.?\s*\d+\s*of\s*\d+", r"(?i)\bpage\s*\d+\s*of\s*\d+", r"(?i)^man/[a-z0-9/]+", r"(?i)\bver\.?\s*:", r"(?i)\bissue\s*:\s*\d", r"(?i)^\s*date\s*:"]
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"


def slug(c: str) -> str:
    return f"coalesce(nullif(left(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), 60), ''), 'page')"


TAXONOMY = "tax AS (SELECT * FROM (VALUES (1, 'de', 'German'), (2, 'en', 'English'), (3, 'es', 'Spanish'), (4, 'fr', 'French'), (5, 'it', 'Italian'), (99, 'other', 'Other')) v(ord, type_name, label))"
TYPED = "typed AS (SELECT d.source AS doc_id, d.doc_id AS id, d.doc_id AS lft, 'Doc ' || d.doc_id AS title, d.source AS path, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN lang END AS section_type FROM documents d)"
SOURCES = "src AS (SELECT DISTINCT source AS doc_id, 'p' || (CAST(substr(source, 4) AS INT) % 3) AS project_id, CASE WHEN CAST(substr(source, 4) AS INT) % 5 <> 0 THEN 'Source ' || CAST(substr(source, 4) AS INT) END AS title FROM documents)"
RECALL = "rp AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS truth, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS markdown FROM pages WHERE html IS NOT NULL)"
OVERLAP = f"tk AS (SELECT page_id, unnest({tokens('truth')}) AS tok, 1 AS t, 0 AS m FROM rp UNION ALL SELECT page_id, unnest({tokens('markdown')}), 0, 1 FROM rp), tc AS (SELECT page_id, tok, sum(t) AS t, sum(m) AS m FROM tk GROUP BY ALL), overlap AS (SELECT rp.page_id, coalesce(sum(t), 0)::BIGINT AS n_truth, coalesce(sum(m), 0)::BIGINT AS n_md, coalesce(sum(least(t, m)), 0)::BIGINT AS common FROM rp LEFT JOIN tc ON rp.page_id = tc.page_id GROUP BY ALL)"
WEB = "web0 AS (SELECT regexp_extract(url, '://([^/:?#]+)', 1) AS doc_id, page_id AS page_no, list_concat(['**Site Banner**', 'Page ' || page_id || ' of 900'], regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '<>', 'g'), '[\\r\\n]+', ' ', 'g'), '<[^>]*>')) AS x FROM pages WHERE html IS NOT NULL AND url IS NOT NULL), web AS (SELECT * FROM (SELECT doc_id, page_no, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM web0) WHERE trim(line) <> '')"
BOILER = f"wp AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM web GROUP BY ALL), wc AS (SELECT doc_id, {plain('line')} AS normal, count(DISTINCT page_no) AS n FROM web GROUP BY ALL), boiler AS (SELECT doc_id, normal, n FROM wc JOIN wp USING (doc_id) WHERE len(normal) BETWEEN 1 AND 90 AND n >= greatest(3, floor(0.30 * pages)))"
PAGES = "pg0 AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), pg1 AS (SELECT doc_id, x, CAST((len(x) + 4) // 5 AS INT) AS n_pages, CAST(unnest(range(1, (len(x) + 4) // 5 + 1)) AS INT) AS page_no FROM pg0), pg AS (SELECT doc_id, page_no, n_pages, '## ' || page_no || '. Part ' || ((doc_id + page_no) % 7) || chr(10) || array_to_string(x[(page_no - 1) * 5 + 1 : page_no * 5], chr(10)) || chr(10) || CASE doc_id % 4 WHEN 0 THEN '| A | B |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' WHEN 1 THEN '| A | B |' || chr(10) || '| 1 | 2 |' WHEN 2 THEN '| A | B |' || chr(10) || '|---|---|' || chr(10) || '| 1 |' ELSE '| orphan |' END || chr(10) || 'See page ' || ((doc_id + page_no) % n_pages + 1) || '. Williams p. 820.' AS md FROM pg1)"
REGIONS = "tree AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(r_regionkey AS BIGINT) + 1 AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS ord, r_name AS title, true AS included FROM region UNION ALL SELECT n_regionkey, n_nationkey + 100, n_regionkey + 1, n_nationkey, n_name, n_nationkey % 3 <> 0 FROM nation UNION ALL SELECT n_regionkey, c_custkey + 1000, c_nationkey + 100, c_custkey, c_name, c_custkey % 5 <> 0 FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SPANS = "spans AS (SELECT CAST(s_nationkey AS BIGINT) AS doc_id, s_suppkey AS id, s_suppkey AS ord, s_suppkey % 40 + 1 AS page_start, s_suppkey % 40 + 1 + (s_suppkey * 7) % 12 AS page_end FROM supplier)"
POINTS = "pts AS (SELECT DISTINCT p_partkey % 25 AS doc_id, CAST(p_size AS BIGINT) AS page FROM part)"
EDGES = "edges AS (SELECT CAST(0 AS BIGINT) AS doc_id, l_suppkey AS from_id, l_partkey + 1000000 AS to_id, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber AS BIGINT) END AS occurrences FROM lineitem)"
CALLS = "calls AS (SELECT user_id AS job, event_id AS seq, event_type AS status, CASE WHEN event_type = 'view' THEN 'judge' ELSE 'parse' END AS label, CASE WHEN event_type <> 'error' THEN floor(value * 100) / 100 END AS cost, ts FROM events)"


TABLE_PAGES = """tp AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place,
    CASE WHEN k % 3 = 0 THEN 'Intro' || chr(10) ELSE '' END || CASE WHEN k % 4 = 0 THEN '' WHEN k % 5 = 0 THEN '| A | B | C |' || chr(10) || '|---|:-:|---|' || chr(10) ELSE '| A | B |' || chr(10) || '|---|---|' || chr(10) END
    || '| ' || page_no || CASE WHEN k % 5 = 0 THEN ' | x | y |' ELSE ' | x |' END || CASE WHEN k % 7 = 0 THEN chr(10) || 'End' ELSE '' END AS markdown FROM (SELECT doc_id, page_no, doc_id + page_no AS k FROM pg))"""
EDITED = """ed0 AS (SELECT doc_id, page_no AS id, n_pages AS n, md, (doc_id + page_no) % 7 AS k FROM pg WHERE doc_id % 3 = 0),
ed1 AS (
    SELECT doc_id, id, n, CASE WHEN id = 2 AND n >= 3 THEN 3 WHEN id % 4 = 0 THEN id - 1 WHEN id > 1 THEN 1 END AS parent_id, CASE WHEN id = 1 THEN 0 WHEN id = 2 AND n >= 3 THEN 45 ELSE id * 10 END AS place,
           CASE WHEN id = doc_id % n + 1 THEN 'Renamed ' || doc_id ELSE 'Part ' || k END AS title, CASE WHEN id = 1 THEN 'en' END AS section_type, id NOT IN (3, 4) AS included,
           id AS page_start, CASE WHEN id = 1 THEN n ELSE id END AS page_end, CASE WHEN id = 3 THEN '' ELSE md END AS markdown
    FROM ed0 WHERE id NOT IN (7, 8)
    UNION ALL SELECT doc_id, 1000, n, 1, 1, 'Glossary', 'fr', true, NULL, NULL, 'See page 2.' FROM ed0 WHERE id = 1
    UNION ALL SELECT doc_id, 2003, n, 1, 47, '3. Part ' || k, NULL, false, 3, 3, md FROM ed0 WHERE id = 3
),
ed2 AS (SELECT *, CASE WHEN id = 1 THEN 1 WHEN parent_id = 1 THEN 2 ELSE 3 END AS level, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY place) - 1 AS INTEGER) AS ord FROM ed1),
below AS (SELECT doc_id, parent_id, count(*) AS n_kids FROM ed2 GROUP BY ALL),
low AS (SELECT doc_id, count(*) AS n_low FROM ed2 WHERE level = 3 GROUP BY ALL),
ed AS (
    SELECT a.*, 2 * a.r - a.level AS lft, 2 * a.r - a.level + 2 * (1 + coalesce(n_kids, 0) + CASE WHEN a.id = 1 THEN coalesce(n_low, 0) ELSE 0 END) - 1 AS rgt, n_kids IS NOT NULL AS is_group,
           concat_ws(' > ', CASE WHEN a.level > 1 THEN top.title END, CASE WHEN a.level > 2 THEN up.title END, a.title) AS path
    FROM ed2 a LEFT JOIN below ON below.doc_id = a.doc_id AND below.parent_id = a.id LEFT JOIN low ON low.doc_id = a.doc_id
    LEFT JOIN ed2 top ON top.doc_id = a.doc_id AND top.id = 1 LEFT JOIN ed2 up ON up.doc_id = a.doc_id AND up.id = a.parent_id
)"""
OUTLINE = """ol0 AS (SELECT doc_id, page_no AS id, n_pages AS n, page_no % 4 = 3 AND page_no < n_pages AS over, CASE WHEN page_no = 1 THEN 1 WHEN page_no % 4 = 0 THEN 3 ELSE 2 END AS level FROM pg),
ol AS (SELECT doc_id, id, id AS page_start, CASE WHEN id = 1 THEN n WHEN over OR id % 5 = 0 THEN least(id + 1, n) ELSE id END AS page_end, 2 * id - level AS lft, 2 * id - level + 2 * CASE WHEN id = 1 THEN n WHEN over THEN 2 ELSE 1 END - 1 AS rgt FROM ol0)"""
REBUILT = f"""wt AS (SELECT * FROM ol WHERE id = 1 OR id % 3 = 0),
sp AS (SELECT w.doc_id, w.id, p.page_no, string_split(p.md, chr(10)) AS x FROM wt w JOIN pg p ON p.doc_id = w.doc_id AND p.page_no BETWEEN w.page_start AND w.page_end),
sl AS (SELECT doc_id, id, page_no, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM sp),
sn AS (SELECT *, {plain('line')} AS normal FROM sl),
np AS (SELECT doc_id, id, count(*) AS pages FROM sp GROUP BY ALL),
bo AS (SELECT doc_id, id, normal FROM (SELECT doc_id, id, normal, count(DISTINCT page_no) AS k FROM sn GROUP BY ALL) JOIN np USING (doc_id, id) WHERE len(normal) BETWEEN 1 AND 90 AND k >= greatest(3, floor(0.30 * pages))),
pt AS (SELECT doc_id, id, page_no, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS t FROM sn WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.doc_id = sn.doc_id AND bo.id = sn.id AND bo.normal = sn.normal) AND NOT {stamp('line')} GROUP BY ALL),
tx AS (SELECT doc_id, id, string_agg(t, chr(10) || chr(10) ORDER BY page_no) AS t FROM pt WHERE t <> '' GROUP BY ALL),
ovs AS (SELECT a.doc_id, a.id, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS near FROM wt a JOIN ol b ON a.doc_id = b.doc_id AND a.id <> b.id AND a.page_start <= b.page_end AND b.page_start <= a.page_end WHERE NOT (a.lft < b.lft AND b.rgt < a.rgt) AND NOT (b.lft < a.lft AND a.rgt < b.rgt) GROUP BY ALL)"""
_RULE = "'^\\s*\\|?[\\s:|-]*-[\\s:|-]*\\|?\\s*$'"


def _cells(row: str) -> str:
    """One more than the unescaped bars inside a row's outer ones."""
    plain_row = f"replace(regexp_replace({row}, '^\\s+|\\s+$', '', 'g'), '\\|', 'xx')"
    inner = f"substr({plain_row}, 2, greatest(length({plain_row}) - 2, 0))"
    return f"(1 + length({inner}) - length(replace({inner}, '|', '')))"


#: Lint of ``src`` (doc_id, id, text): rows of tables outside fences, and issues in order, eight at most.
LINT = f"""ln AS (SELECT doc_id, id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, id, string_split(text, chr(10)) AS x FROM src)),
lf AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM ln),
lg AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lf),
lp AS (SELECT *, NOT inside AND regexp_matches(line, '^\\s*\\|') AS is_row FROM lg),
li AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, id ORDER BY i) AS g FROM lp WHERE is_row),
lr AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id, id, g) AS n, first_value(line) OVER w AS header, lead(line) OVER w AS following, nth_value(line, 2) OVER (PARTITION BY doc_id, id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM li WINDOW w AS (PARTITION BY doc_id, id, g ORDER BY i)),
lx AS (
    SELECT doc_id, id, i AS place, 'lone_pipe_row' AS code, i AS line, 'orphaned table row (no surrounding table)' AS message FROM lr WHERE n = 1
    UNION ALL SELECT doc_id, id, i, 'missing_separator', i, 'table missing separator row' FROM lr WHERE n > 1 AND r = 1 AND NOT regexp_matches(second, {_RULE})
    UNION ALL SELECT doc_id, id, i, 'ragged_row', i, 'table row has ' || {_cells('line')} || ' cells, header has ' || {_cells('header')} FROM lr WHERE n > 1 AND r > 2 AND regexp_matches(second, {_RULE}) AND NOT regexp_matches(line, {_RULE}) AND {_cells('line')} <> {_cells('header')}
    UNION ALL SELECT doc_id, id, 1000000000, 'unclosed_fence', 0, 'unclosed code fence — content after it renders as code' FROM lf GROUP BY doc_id, id HAVING sum(fence::INT) % 2 = 1
),
lint AS (SELECT * FROM lx QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY place) <= 8)"""
#: ``src`` with separators under headers that lack one.
SEPARATED = f"""fixed AS (SELECT lp.doc_id, lp.id, string_agg(lp.line || CASE WHEN lr.r = 1 AND lr.n > 1 AND NOT regexp_matches(lr.second, {_RULE}) THEN chr(10) || '|' || repeat('---|', {_cells('lp.line')}) ELSE '' END, chr(10) ORDER BY lp.i) AS text FROM lp LEFT JOIN lr ON lr.doc_id = lp.doc_id AND lr.id = lp.id AND lr.i = lp.i GROUP BY ALL)"""
def plain_text(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[#*_`>|\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


#: Blocks of ``src`` (doc_id, id, text): kinds of lines, and runs of one kind.
BLOCKS = """bl AS (SELECT doc_id, id, unnest(range(1, len(x) + 1)) AS i, regexp_replace(unnest(x), '\\s+$', '') AS line FROM (SELECT doc_id, id, string_split(text, chr(10)) AS x FROM src)),
bk AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|$') THEN 'table' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+\\S') THEN 'list' WHEN regexp_matches(line, '\\S') THEN 'paragraph' ELSE '' END AS kind FROM bl),
bn AS (SELECT *, kind <> '' AND (kind = 'heading' OR kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id, id ORDER BY i), '')) AS begins FROM bk),
bg AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, id ORDER BY i) AS n FROM bn WHERE kind <> ''),
blk AS (SELECT doc_id, id, n, min(kind) AS type, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS markdown, min(CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) END) AS level FROM bg GROUP BY ALL)"""
_LEFT_OUT = "'==> picture intentionally omitted <=='"
DRAFTS = f"""dr0 AS (SELECT doc_id, page_no, doc_id + page_no AS k, 'Operations Manual ' || doc_id AS banner, 'Page ' || page_no || ' of ' || n_pages AS foot, x[(page_no - 1) * 5 + 1 : page_no * 5] AS b FROM pg1),
dr AS (SELECT doc_id, page_no, k, CASE WHEN k % 13 = 0 THEN 'visual' ELSE 'text' END AS kind, k % 4 <> 1 AS target, 0.5 + (k % 5) / CAST(10 AS DOUBLE) AS stored, list_concat(list_concat([banner], b), [foot]) AS source,
    list_concat(list_concat(list_concat([banner], CASE WHEN k % 3 = 0 THEN b[1 : len(b) - 1] ELSE b END), CASE WHEN k % 5 = 0 THEN [{_LEFT_OUT}] ELSE [] END), [foot]) AS lines,
    CASE WHEN k % 3 = 0 THEN b[1 : len(b) - 1] ELSE b END AS kept, b FROM dr0),
txt AS (SELECT doc_id, page_no, k, kind, target, stored, source, array_to_string(source, chr(10)) AS src, array_to_string(lines, chr(10)) AS base,
    CASE WHEN target AND k % 11 <> 0 THEN array_to_string(list_concat(['# Page ' || page_no], b), chr(10)) END AS vlm,
    CASE WHEN target AND kind <> 'visual' THEN array_to_string(CASE WHEN k % 7 = 0 THEN kept[1 : len(kept) // 2] ELSE kept END, chr(10)) END AS cleanup FROM dr),
sl AS (SELECT doc_id, page_no, unnest(source) AS line, generate_subscripts(source, 1) AS i FROM txt),
sn AS (SELECT *, {running('line')} AS normal FROM sl),
fp AS (SELECT doc_id, count(*) AS pages FROM txt GROUP BY ALL),
fu AS (SELECT doc_id, normal FROM (SELECT doc_id, normal, count(DISTINCT page_no) AS n FROM sn WHERE len(normal) >= 6 GROUP BY ALL) JOIN fp USING (doc_id) WHERE pages >= 3 AND n >= greatest(2, round_even(0.5 * pages, 0))),
sides AS (
    SELECT doc_id, page_no, unnest({tokens('src')}) AS tok, 's' AS side FROM txt WHERE target
    UNION ALL SELECT doc_id, page_no, unnest({tokens('line')}), 'c' FROM sn WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.doc_id = sn.doc_id AND fu.normal = sn.normal)
    UNION ALL SELECT doc_id, page_no, unnest({tokens('base')}), 'b' FROM txt WHERE target
    UNION ALL SELECT doc_id, page_no, unnest({tokens('vlm')}), 'v' FROM txt WHERE target
    UNION ALL SELECT doc_id, page_no, unnest({tokens('cleanup')}), 'u' FROM txt WHERE target),
tk AS (SELECT doc_id, page_no, tok, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'v') AS v, count(*) FILTER (side = 'u') AS u FROM sides GROUP BY ALL),
ov AS (SELECT doc_id, page_no, sum(s) AS s, sum(c) AS c, sum(b) AS b, sum(v) AS v, sum(u) AS u, sum(least(s, b)) AS sb, sum(least(s, v)) AS sv, sum(least(s, u)) AS su, sum(least(c, b)) AS cb, sum(least(c, u)) AS cu FROM tk GROUP BY ALL)"""


def composite(common: str, n: str, text: str) -> str:
    """The score of one candidate text of a page of ``txt`` joined to ``ov``."""
    one, zero = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"
    table = f"CASE WHEN len(list_filter(string_split(src, chr(10)), lambda l: len(regexp_extract_all(l, '\\S {{2,}}')) >= 2)) >= 3 THEN CASE WHEN len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(l, '^\\s*\\|[\\s:|-]+\\|\\s*$'))) > 0 THEN {one} ELSE {zero} END END"
    recall, kept = f"CASE WHEN coalesce(s, 0) = 0 THEN {one} ELSE {common} / s END", f"{one} - CASE WHEN coalesce({n}, 0) = 0 THEN {zero} ELSE ({n} - {common}) / {n} END"
    plain = f"(CAST(0.4 AS DOUBLE) * ({recall}) + CAST(0.15 AS DOUBLE) * ({kept}) + coalesce(CAST(0.15 AS DOUBLE) * ({table}), {zero})) / (CAST(0.4 AS DOUBLE) + CAST(0.15 AS DOUBLE) + CASE WHEN ({table}) IS NULL THEN {zero} ELSE CAST(0.15 AS DOUBLE) END)"
    judge = f"least(5, length({text}) // 50) / CAST(5 AS DOUBLE)"
    visual = f"(CAST(0.85 AS DOUBLE) * ({judge}) + coalesce(CAST(0.15 AS DOUBLE) * ({table}), {zero})) / (CAST(0.85 AS DOUBLE) + CASE WHEN ({table}) IS NULL THEN {zero} ELSE CAST(0.15 AS DOUBLE) END)"
    marred = f"CASE WHEN contains({text}, 'intentionally omitted') THEN CAST(0.7 AS DOUBLE) ELSE {one} END"
    return f"CASE WHEN {text} IS NOT NULL THEN floor(CASE WHEN kind = 'visual' THEN {visual} ELSE ({plain}) * {marred} END * 1000 + 0.5) / 1000 END"


REMEDIATED = f"""{DRAFTS},
scored AS (SELECT txt.*, {composite('sb', 'b', 'base')} AS base_c, {composite('sv', 'v', 'vlm')} AS vlm_c, {composite('su', 'u', 'cleanup')} AS cleanup_c,
    CASE WHEN coalesce(c, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE cb / c END AS base_kept, CASE WHEN coalesce(c, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE cu / c END AS cleanup_kept FROM txt LEFT JOIN ov ON txt.doc_id = ov.doc_id AND txt.page_no = ov.page_no),
ok AS (SELECT *, target AND coalesce(vlm_c > base_c, false) AS v_ok, target AND cleanup_c IS NOT NULL AND cleanup_kept >= base_kept - CAST(0.12 AS DOUBLE) AS u_ok FROM scored),
won AS (SELECT *, CASE WHEN v_ok AND (NOT u_ok OR vlm_c >= cleanup_c) THEN 'vlm' WHEN u_ok THEN 'cleanup' ELSE 'baseline' END AS method FROM ok),
rem AS (SELECT doc_id, page_no, target, CASE WHEN NOT target THEN NULL WHEN method <> 'baseline' THEN method WHEN vlm IS NULL AND cleanup IS NOT NULL THEN 'cleanup' ELSE 'vlm' END AS recorded, method <> 'baseline' AS adopted, CASE WHEN target THEN base_c END AS base_composite,
    CASE method WHEN 'vlm' THEN vlm_c WHEN 'cleanup' THEN cleanup_c ELSE stored END AS canonical_composite, method AS canonical_source, CASE method WHEN 'vlm' THEN vlm WHEN 'cleanup' THEN cleanup ELSE base END AS canonical,
    CASE WHEN target THEN (CASE WHEN vlm IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN cleanup IS NOT NULL THEN 1 ELSE 0 END) ELSE 0 END AS cost_units, target AND vlm IS NULL AS failed FROM won)"""


def _scores(k: int) -> str:
    n = f"(l_orderkey * {k} + l_linenumber * {k + 1})"
    return f"SELECT l_orderkey AS doc_id, l_linenumber AS page_no, (100 - {n} % 30) / CAST(100 AS DOUBLE) AS recall, ({n} % 40) / CAST(100 AS DOUBLE) AS extra, CASE {n} % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) END AS table_score FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber IS NOT NULL"


SCORES = f"sa AS ({_scores(1)}), sb AS ({_scores(3)} AND l_orderkey % 7 <> 0)"
