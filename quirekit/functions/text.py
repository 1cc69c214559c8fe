"""Column functions over text and markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of page stamps, sign-off phrases, parser leftovers and page references.
STAMPS = [r"(?iu)\bpg\.?\s*\d+\s*of\s*\d+", r"(?iu)\bpage\s*\d+\s*of\s*\d+", r"(?iu)^man/[a-z0-9/]+", r"(?iu)\bver\.?\s*:", r"(?iu)\bissue\s*:\s*\d", r"(?iu)^\s*date\s*:"]
SIGN_OFFS = ["prepared by", "issued by", "approved by", "reviewed by", "authorized by"]
PAGE_REFERENCE = r"(?i)((?:see|refer(?:\s+to)?)\s+)?(page\s*no\.?|page|pg\.?|p\.)\s*(\d{1,4})\b"
REVISION_HEADS = ["revision", "description", "initiated by", "approved by", "page", "issue"]
SEPARATOR_ROW = r"^\s*\|[\s:|-]+\|\s*$"
PIPE_ROW = r"^\s*\|.*\|\s*$"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+\S"


def lines(text: Column) -> Column:
    """Lines as lint counts them: split at \\n, an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def tokens(text: Column, tags: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9, markdown signs (and HTML tags, if ``tags``) being spaces. Null has none."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    if tags:
        plain = F.regexp_replace(plain, r"<[^>]+>", " ")
    return F.regexp_extract_all(F.regexp_replace(plain, r"[#*_`>\-|]", " "), F.lit("([a-z0-9]+)"), F.lit(1))


def running_line(line: Column) -> Column:
    """A line as it is compared across pages: lower case, digit runs as #, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "#"), r"\s+", " "))


def running_lines(text: Column) -> Column:
    """:func:`running_line` of all lines of a text, which is read as a whole: neither digit runs nor single spaces go beyond a line."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.regexp_replace(F.regexp_replace(low, r"\d+", "#"), r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")  # a single blank is one already
    return F.transform(F.split(spaced, "\n", -1), lambda x: F.trim(x))


def plain_line(line: Column) -> Column:
    """A line without markdown signs, in lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(line, r"[#*_`>\-\s]+", " ")))


def is_stamp(line: Column) -> Column:
    """Whether a line is a page, version, issue or date stamp."""
    found = F.lit(False)
    for pattern in STAMPS:
        found = found | line.rlike(pattern)
    return found


def is_sign_off(line: Column) -> Column:
    """A pipe row with at least two different sign-off phrases."""
    row, low = F.trim(line), F.lower(line)
    hits = sum((F.when(low.contains(p), 1).otherwise(0) for p in SIGN_OFFS), F.lit(0))
    return row.startswith("|") & row.endswith("|") & (hits >= 2)


def slug(title: Column) -> Column:
    """At most 60 characters of a-z, 0-9 and dashes; dashes are trimmed before the cut; 'page' if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(dashed, F.lit(60)), F.lit("")), F.lit("page"))


def file_slug(name: Column) -> Column:
    """A name safe for files."""
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "_")


def label_key(label: Column) -> Column:
    """A label as it is compared: lower case, single spaces."""
    return F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))


def cell_count(row: Column) -> Column:
    """Cells of a table row; an escaped pipe does not part cells."""
    s = F.regexp_replace(F.trim(row), r"^\|", "")
    s = F.regexp_replace(s, r"(?<!\\)\|$", "")
    return F.size(F.split(s, r"(?<!\\)\|", -1))


def table_cells(text: Column) -> Column:
    """Cells of all table rows of a text, without separator rows."""
    rows = F.filter(lines(text), lambda x: x.rlike(PIPE_ROW) & ~x.rlike(SEPARATOR_ROW))
    return F.aggregate(rows, F.lit(0), lambda a, x: a + F.size(F.split(x, r"\|", -1)) - 2)


def plain_text(markdown: Column) -> Column:
    """A markdown text without tags and signs, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(markdown, r"<[^>]+>", " "), r"[#*_`>|\-]+", " "), r"\s+", " "))


def has_columns(text: Column) -> Column:
    """Whether a plain text looks like a table: three lines with two wide gaps."""
    wide = F.filter(lines(text), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(\S {2,})"), F.lit(1))) >= 2)
    return F.size(wide) >= 3


def looks_tabular(text: Column) -> Column:
    """Whether a source text has a table: three lines of cells or of columns, or the head of a revision list over dates or numbers."""
    wide = lambda x: F.regexp_count(x, F.lit(r"\S\s{2,}\S")) >= 2
    cells = F.size(F.filter(lines(text), lambda x: x.rlike(PIPE_ROW) | wide(x)))
    heads = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in REVISION_HEADS), F.lit(0))
    dates, numbers = F.regexp_count(text, F.lit(r"\b\d{1,2}/\d{4}\b")), F.regexp_count(text, F.lit(r"(?m)^\s*\d+\s*$"))
    return F.coalesce((cells >= 3) | ((heads >= 3) & ((dates >= 3) | (numbers >= 4))), F.lit(False))


def expected_headings(text: Column) -> Column:
    """How many lines of a source text look like headings: up to 100 characters, four letters or more, three quarters of them capitals."""
    letters = lambda x: F.length(F.regexp_replace(x, r"\P{L}", ""))
    capitals = lambda x: F.length(F.regexp_replace(x, r"\P{Lu}", ""))
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    return F.size(F.filter(trimmed, lambda x: (F.length(x) <= 100) & (letters(x) >= 4) & (capitals(x) >= 0.75 * letters(x))))


def title_of(heading: Column) -> Column:
    """The plain title of a heading line, without emphasis signs around it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_extract(heading, HEADING, 2)), r"^[*_]+|[*_]+$", ""))


def level_of(heading: Column) -> Column:
    """A heading's level: by its numbering (6 at most), else by its signs."""
    number = F.regexp_extract(title_of(heading), NUMBERED, 1)
    by_number = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    return F.when(number != "", by_number).otherwise(F.length(F.regexp_extract(heading, HEADING, 1)))


def page_references(text: Column) -> Column:
    """array<struct<cue, kind, page, anchor>> of all page references of a text, which is searched once; their parts come from the matches."""
    part = lambda m, g: F.regexp_extract(m, PAGE_REFERENCE, g)
    found = F.regexp_extract_all(text, F.lit(PAGE_REFERENCE), F.lit(0))
    return F.transform(found, lambda m: F.struct(part(m, 1).alias("cue"), part(m, 2).alias("kind"), part(m, 3).cast("int").alias("page"), m.alias("anchor")))


def is_internal(reference: Column, page_count: Column) -> Column:
    """Whether a reference is to a page of the same document: it has a cue or says 'no', and the page exists."""
    return ((reference["cue"] != "") | F.lower(reference["kind"]).contains("no")) & reference["page"].between(F.lit(1), page_count)


def chosen_text(canonical: Column, baseline: Column) -> Column:
    """The canonical text if there is one, else the baseline, else ''."""
    return F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(baseline, F.lit("")), F.lit(""))


def thousandths(x: Column) -> Column:
    """Rounded to three places, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000
