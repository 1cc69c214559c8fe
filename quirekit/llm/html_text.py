"""Main text of web pages by site template removal.

Every page is parsed into elements. Subtrees are hashed (tags, structure and text, without
attributes) and counted per host over pages of different content; those that recur on many pages of
their host are its template and are deleted from each page. What stays of the article (else of the
main part, else of the body) is the text; elements that by name, role or class are menus, headers,
footers, sidebars, notices, adverts, forms, scripts or comments never belong to it.

Paragraphs and headings of an article are never taken for template: a passage that an author repeats
is still the article's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import slices, store

#: A subtree is template if at least so many different pages of a host, and this share of them, hold it.
MIN_PAGES = 4
SHARE = 0.2
#: Up to this many template subtrees in all travel to the workers as one table; more are joined by host.
BROADCAST = 200_000
SALTS = 16

# a tag ends at ">", at the next "<" outside quotes, or at the end; a quote without an end is a character like others
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo mrow msub msup mfrac msqrt mtext".split())
CELLS = frozenset("td th".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An end tag or an implied end never reaches beyond one of these.
SCOPES = frozenset("article main section aside nav body html table td th ul ol dl div blockquote".split())
DROPPED = frozenset("nav footer aside form button menu dialog script style noscript template textarea title iframe svg object select head".split())
MARKED = frozenset("div section ul ol dl p table figure details header center".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert banner ad ads adv advert adverts advertisement sponsor sponsored promo promotion "
    "comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay search pagination pager toolbar skip form".split()
)
#: Inside an article or main part a name says so only if it is the whole class or id, and one of these.
INNER_NAMES = frozenset("ad ads advert adverts advertisement sponsored cookie cookies consent comment comments disqus replies share sharing newsletter".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
PLACES = ("article", "main", "body")


class Page:
    """A parsed page: texts in order, and the elements that hold them."""

    __slots__ = ("parents", "tags", "dropped", "hashes", "rich", "texts", "holders", "breaks")

    def __init__(self, source: str):
        self.parents, self.tags, self.dropped, self.hashes, self.rich = [-1], ["#page"], [False], [0], [False]
        self.texts: list[str] = []  # in page order; "" is a break between blocks
        self.holders: list[int] = []
        self.parse(source)

    def parse(self, source: str) -> None:
        stack, parts = [0], [[]]  # open elements and what each has for its hash
        tags = self.tags

        def close(depth: int) -> None:
            while len(stack) > depth:
                e, inside = stack.pop(), parts.pop()
                if inside:
                    h = xxhash.xxh3_64_intdigest(f"{tags[e]}({' '.join(inside)})")
                    self.hashes[e] = h - (1 << 63)
                    parts[-1].append(str(h))
                    if self.rich[e] or tags[e] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                        self.rich[stack[-1]] = True
                if tags[e] not in INLINE:
                    self.add("" if tags[e] not in CELLS else " ", stack[-1])

        def implied(names: tuple[str, ...]) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] in names:
                    return close(depth)
                if tags[stack[depth]] in SCOPES:
                    return None

        at, skip_to = 0, None
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.text(source[at : m.start()], stack[-1], parts[-1])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name in VOID:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        close(depth)
                        break
                    if name in INLINE and tags[stack[depth]] not in INLINE:
                        break
                continue
            if name in VOID:
                self.add(" " if name != "hr" else "", stack[-1])
                continue
            if name not in INLINE:
                if name in CLOSED_BY:
                    implied(CLOSED_BY[name])
                implied(("p",))
                self.add("" if name not in CELLS else " ", stack[-1])
            e = len(tags)
            tags.append(name)
            self.parents.append(stack[-1])
            self.hashes.append(0)
            self.rich.append(False)
            self.dropped.append(self.dropped[stack[-1]] or self.unwanted(name, m[3], stack))
            if m[3].endswith("/") and name in RAW:
                continue
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}\\s*[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(e)
            parts.append([])
        if at < len(source):
            self.text(source[at:], stack[-1], parts[-1])
        close(1)

    def unwanted(self, name: str, attributes: str, stack: list[int]) -> bool:
        if name in DROPPED:
            return True
        if name == "header" and not any(self.tags[e] in ("article", "main") for e in stack):
            return True
        if not attributes or attributes.isspace():
            return False
        found = {}
        for a in ATTRIBUTE.finditer(attributes):
            found.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        if found.get("role", "").lower() in ROLES:
            return True
        if name not in MARKED:
            return False
        given = f"{found.get('class', '')} {found.get('id', '')}".lower()
        if any(self.tags[e] in ("article", "main") for e in stack):
            return not INNER_NAMES.isdisjoint(given.split())
        return not NAMES.isdisjoint(re.split(r"[\s_\-]+", given))

    def text(self, raw: str, holder: int, inside: list[str]) -> None:
        decoded = html.unescape(raw) if "&" in raw else raw
        if words := decoded.split():
            inside.append(" ".join(words))
        self.add(decoded, holder)

    def add(self, text: str, holder: int) -> None:
        self.texts.append(text)
        self.holders.append(holder)

    def candidates(self) -> set[int]:
        """Hashes of the subtrees with text that may be template."""
        inside = self.within(("article", "main"))
        return {h for e, h in enumerate(self.hashes) if h and self.tags[e] not in ("html", *PLACES) and self.tags[e] not in INLINE and not (inside[e] and (self.rich[e] or self.tags[e] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "figcaption", "dt", "dd")))}

    def within(self, names: tuple[str, ...]) -> list[bool]:
        out = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            out[e] = out[self.parents[e]] or self.tags[self.parents[e]] in names
        return out

    def content(self) -> int:
        """A digest of the page's whole text."""
        return xxhash.xxh3_64_intdigest(" ".join("".join(self.texts).split())) - (1 << 63)

    def main_text(self, template: frozenset[int] | set[int]) -> str:
        gone = list(self.dropped)
        maybe = self.candidates() & template if template else ()
        for e in range(1, len(gone)):
            gone[e] = gone[e] or gone[self.parents[e]] or bool(maybe) and self.hashes[e] in maybe
        for place in (*PLACES, None):
            if place and not any(t == place and not g for t, g in zip(self.tags, gone)):
                continue
            keep = [False] * len(gone)
            for e in range(len(gone)):
                keep[e] = not gone[e] and (place is None or self.tags[e] == place or e > 0 and keep[self.parents[e]])
            blocks, run = [], []
            for text, holder in zip(self.texts, self.holders):
                if text == "":
                    if run:
                        blocks.append(" ".join("".join(run).split()))
                        run = []
                elif keep[holder]:
                    run.append(text)
            if run:
                blocks.append(" ".join("".join(run).split()))
            if out := "\n".join(b for b in blocks if b):
                return out
        return ""


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def templates(pages: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, hashes): the template subtrees of each host that has any; at most as many as 1/share times a page's subtrees."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, contents, hashes = [], [], []
            for url, source in zip(*(c.to_pylist() for c in batch.columns)):
                if source:
                    page = Page(source)
                    hosts.append(host_of(url))
                    contents.append(page.content())
                    hashes.append(sorted(page.candidates()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "content", "hashes"])

    found = store(pages.mapInArrow(rows, "host string, content long, hashes array<long>"), "subtrees")
    totals = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counted = found.select("host", "content", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    many = counted.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") >= F.col("pages") * share)
    return store(many.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, broadcast: int = BROADCAST) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Blocks are in page order, joined by one \\n; white space inside a block is one space; character
    references are decoded; nothing else is cut or capped. A null or empty html gives an empty text.
    A null url, or one without a host, counts as a page of the host ''. Pages of equal content count
    once towards a template, so copies of an article do not make it one. Repeated rows give repeated
    rows; null ids stay; further columns are not read; an empty table gives no rows.
    """
    found = templates(pages.select(url_col, html_col), min_pages, share)
    total = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    names = [id_col, url_col, "text", "n_chars"]
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"

    def result(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        texts = [Page(source).main_text(known) if source else "" for source, known in zip(batch.column(2).to_pylist(), sets)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    wanted = pages.select(id_col, url_col, html_col)
    if total <= broadcast:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["hashes"]) for r in found.collect()})

        def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield result(batch, [sent.value.get(host_of(u), frozenset()) for u in batch.column(1).to_pylist()])

        return wanted.mapInArrow(with_table, schema)

    def with_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield result(batch, [frozenset(h or ()) for h in batch.column(3).to_pylist()])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    dealt = wanted.withColumn("_host", host).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    copies = found.select(F.col("host").alias("_host"), "hashes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return dealt.join(copies, ["_host", "_salt"], "left").select(id_col, url_col, html_col, "hashes").mapInArrow(with_column, schema)
