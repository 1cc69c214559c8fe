"""Stitching against a page-by-page version; second attempts at pages on literal pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirekit.functions import folds
from quirekit.functions import text as T
from quirekit.operators import remediation, stitching

IS_ROW, IS_RULE = re.compile(r"\s*\|.*\|\s*"), re.compile(r"\s*\|[\s:|-]+\|\s*")


def one_by_one(pages):
    """Page after page: takes the rows off a page's top if the page above ends in a table of as many columns."""
    done = []
    for number, text in sorted(pages):
        text = text or ""
        above = done[-1][1].rstrip().split("\n") if done else [""]
        below = text.lstrip("\n").split("\n")
        table = []
        while above and IS_ROW.fullmatch(above[-1]):
            table.insert(0, above.pop())
        rows = []
        while below and IS_ROW.fullmatch(below[0]):
            rows.append(below.pop(0))
        width = lambda r: len(r.strip().strip("|").split("|"))
        if table and rows and width(table[0]) == width(rows[0]):
            more = rows[2:] if len(rows) > 1 and IS_RULE.fullmatch(rows[1]) else rows
            done[-1] = (done[-1][0], "\n".join([*above, *table, *more]).strip())
            text = "\n".join(below).strip()
        done.append((number, text))
    return done


PIECES = ["| 1 | 2 |", "| 1 | 2 |", "|---|---|", "| A | B |\n|:-:|---|", "| x |", "text", "", "  | 5 | 6 |  ", "end \n"]


def test_stitching_equals_page_by_page(spark):
    rnd = random.Random(4)
    docs = {d: [(n + n // 3, None if rnd.random() < 0.05 else "\n".join(rnd.choice(PIECES) for _ in range(rnd.choice([1, 1, 2, 3])))) for n in range(rnd.randint(1, 9))] for d in range(200)}
    docs[500] = [(n, "| a | b |") for n in range(7)]
    docs[501] = [(1, "Intro\n| A | B |\n|---|---|\n| 1 | 2 |"), (2, "| A | B |\n|---|---|\n| 3 | 4 |\nRest"), (3, "| x |\nend")]
    df = spark.createDataFrame([(d, n, t, n * 10) for d, pages in docs.items() for n, t in pages], "doc_id int, page_no int, markdown string, more int")
    got = {}
    for r in stitching.stitched(df, ["more"]).orderBy("doc_id", "page_no").collect():
        assert r["more"] == r["page_no"] * 10
        got.setdefault(r["doc_id"], []).append((r["page_no"], r["markdown"]))
    for d, pages in docs.items():
        assert got[d] == one_by_one(pages), pages
    assert got[501][0][1] == "Intro\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |" and got[501][1][1] == "Rest"
    assert stitching.stitched(df.limit(0)).count() == 0


WORDS = "zero one two three four five six seven eight".split()


def body(n):
    return f"the quick brown fox number {WORDS[n]} jumps over the lazy dog near the river bank"


def vlm(page):
    if page["page_no"] == 4:
        raise RuntimeError("no reply")
    n = page["page_no"]
    return {"text": {2: f"```markdown\n{body(n)}\n```", 3: "fox"}.get(n, body(n)), "cost": 0.01}


def cleanup(page):
    if page["page_no"] == 4:
        raise RuntimeError("out of time")
    return {"text": "the quick" if page["page_no"] == 5 else page["markdown"].replace("Banner line 7\n", "").replace("leftover ", ""), "cost": None}


def judge(page, text):
    return {7: "not json", 8: '{"overall": 4, "note": "blurred"}'}.get(page["page_no"], '{"completeness": 5}')


def pages(spark):
    source = [f"Banner line 7\n{body(n)}" for n in range(9)]
    rows = [(1, 1, "text", source[1], f"Banner line 7\n{body(1)}", 0.9, "pass"), (1, 2, "text", source[2], "the quick", 0.2, "review"), (1, 3, "text", source[3], f"Banner line 7\n{body(3)}", 0.9, "review"), (1, 4, "text", source[4], "the quick", None, None), (1, 5, "text", source[5], body(5), 0.8, "escalate"), (1, 6, None, source[6], None, 0.0, "review"), (1, 7, "visual", "", "picture", 0.1, "review"), (1, 8, "visual", "", "picture", 0.1, "review"), (2, 1, "text", None, "", None, "review")]
    return spark.createDataFrame(rows, "doc_id int, page_no int, kind string, source string, markdown string, composite double, verdict string")


def test_second_attempts(spark):
    found = remediation.remediated(pages(spark), vlm, cleanup, judge, scope="flagged")
    got = {(r["doc_id"], r["page_no"]): r for r in found.collect()}
    assert len(got) == 9
    assert not got[1, 1]["target"] and got[1, 1]["recorded"] is None and got[1, 1]["canonical_composite"] == 0.9 and got[1, 1]["cost"] == 0
    assert (got[1, 2]["canonical_source"], got[1, 2]["canonical"], got[1, 2]["cost"]) == ("vlm", body(2), 0.01)  # the fence is gone
    assert (got[1, 3]["canonical_source"], got[1, 3]["canonical"]) == ("cleanup", body(3))  # only furniture was lost, so the content is whole
    four = got[1, 4]
    assert (four["canonical_source"], four["recorded"], four["adopted"]) == ("baseline", "vlm", False) and four["notes"] == "vlm failed: no reply; cleanup failed: out of time"
    assert four["new_composite"] == four["base_composite"] and four["canonical_composite"] is None
    assert got[1, 5]["canonical_source"] == "baseline" and got[1, 5]["recorded"] == "vlm" and got[1, 5]["canonical"] == body(5)  # cleanup lost content, vlm is no better
    assert got[1, 6]["canonical"] == body(6) and got[1, 6]["cost"] == 0.01  # a blank page is not cleaned
    assert got[1, 7]["canonical_source"] == "baseline" and "judge unparseable after retry" in got[1, 7]["notes"]
    assert got[1, 8]["base_composite"] == 0.8 and "judge: blurred" in got[1, 8]["notes"]
    assert (got[2, 1]["canonical_source"], got[2, 1]["canonical"]) == ("cleanup", "")
    sums = {r["doc_id"]: r for r in remediation.summary(found).collect()}
    assert (sums[1]["targets"], sums[1]["adopted"]) == (7, 3) and sums[1]["cost"] == pytest.approx(0.06)
    scored = [r["canonical_composite"] for k, r in got.items() if k[0] == 1 and r["canonical_composite"] is not None]
    assert sums[1]["canonical_mean"] == pytest.approx(sum(scored) / len(scored), abs=0.0006)


def test_a_page_parsed_again_on_request(spark):
    some = pages(spark).where("page_no = 5 or page_no = 4")
    got = {r["page_no"]: r for r in remediation.remediated(some, vlm, cleanup, judge, forced="cleanup").collect()}
    assert (got[5]["canonical"], got[5]["canonical_source"], got[5]["adopted"]) == ("the quick", "cleanup", True)
    assert (got[4]["adopted"], got[4]["notes"]) == (False, "cleanup failed: out of time")


def test_judges():
    assert remediation.judged(lambda p, t: 1 / 0, {}, "") == (None, "judge failed: division by zero")
    replies = iter(["?", '{"overall": 2.5}'])
    assert remediation.judged(lambda p, t: next(replies), {}, "") == (0.5, None)


def test_furniture_by_hashes(spark):
    df = spark.createDataFrame([(1, n, f"Report 4.{n}\nbody {'abc'[n]}\nshort") for n in range(3)] + [(2, n, "Report 4.1\nx") for n in range(2)], "doc_id int, page_no int, source string")
    keys = remediation.furniture_keys(df, "source")
    assert [r["doc_id"] for r in keys.collect()] == [1]
    left = df.join(keys, "doc_id", "left").select("doc_id", "page_no", remediation.without_furniture(F.col("source"), F.col("recurs")).alias("s")).collect()
    assert {(r["doc_id"], r["page_no"]): r["s"] for r in left}[1, 2] == "body c\nshort" and all(r["s"].startswith("Report") for r in left if r["doc_id"] == 2)
    assert folds.table_faults("| a | b |\n| 1 | 2 |") == ["table missing separator row"]


def test_running_lines_of_a_text_are_those_of_its_lines(spark):
    texts = ["Page 12  of 30\t x\n\n  A\x0b\x0c\r B \nİΣ\n12", "", None, " \n \n", "a b  c  d", "one  two   three\r\n4 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(T.running_lines(F.col("t")).alias("a"), F.transform(T.lines(F.col("t")), T.running_line).alias("b")).collect():
        assert r["a"] == r["b"]


def test_ends_are_stripped_of_all_white_space(spark):
    texts = ["", "a", " a", "a\n", " a b ", " a\u0085", "a\r\n", "  ", None, "a\x1cb "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda p: F.regexp_replace("t", p, "")
    for r in df.select(stitching._stripped(F.col("t")).alias("a"), plain(r"(?U)^\s+|\s+$").alias("b"), stitching._ended(F.col("t")).alias("c"), plain(r"(?U)\s+$").alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"])
