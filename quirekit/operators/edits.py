"""Edits of section trees as a table: an ordered log of edits is applied to many documents at once.

Only documents with edits are shuffled, numbered and written anew. What has to go edit after edit within a document is
a fold over its sections; the tables around it (unchanged documents, references) are joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirekit.functions import folds
from quirekit.operators import references

#: Up to so many changed documents, their ids are sent to every task, and unchanged documents stay where they are.
BROADCAST_IDS = 500_000
#: Edits that change texts, spans or the set of sections, after which references are found anew.
STRUCTURAL = ("delete", "create", "split", "merge")
#: Columns of an edit besides doc_id; those that an edit has no use for are null.
EDITS = ("seq", "op", "id", "parent_id", "place", "title", "heading", "section_type", "included", "markdown", "new_id", "others")
TREE = ("doc_id", "id", "parent_id", "ord", "title", "section_type", "included", "page_start", "page_end", "markdown")
#: Documents that are Python objects at once.
DOCUMENTS = 16


class Refused(Exception):
    """An edit that can't be done; the tree stays as it was."""


class Outline:
    """The sections of one document while edits are applied: rows by id, and the ordered children of each."""

    def __init__(self, rows: list[dict]):
        self.rows = {r["id"]: r for r in rows}
        self.children: dict = {None: []}
        for r in sorted(rows, key=lambda r: (r["ord"] or 0, r["id"])):
            parent = r["parent_id"] if r["parent_id"] in self.rows else None
            self.children.setdefault(parent, []).append(r["id"])
            r["parent_id"] = parent

    def find(self, key) -> dict:
        if key not in self.rows:
            raise Refused("no such section")
        return self.rows[key]

    def below(self, key) -> list:
        """The section and all under it, in tree order."""
        out, stack = [], [key]
        while stack:
            out.append(stack.pop())
            stack += reversed(self.children.get(out[-1], []))
        return out

    def put(self, key, parent, place: int | None) -> None:
        """Makes a section the child of ``parent`` at ``place`` (last if None)."""
        family = self.children.setdefault(parent, [])
        family.insert(len(family) if place is None else max(0, min(place, len(family))), key)
        self.rows[key]["parent_id"] = parent

    def take(self, key) -> None:
        self.children[self.rows[key]["parent_id"]].remove(key)

    def add(self, key, row: dict) -> None:
        if key is None or key in self.rows:
            raise Refused("the new id is missing or taken")
        self.rows[key] = {"id": key, "included": True, "section_type": None, "page_start": None, "page_end": None, **row}

    # the edits, by name

    def rename(self, e: dict, types) -> None:
        self.find(e["id"])["title"] = titled(e["title"])

    def retype(self, e: dict, types) -> None:
        self.find(e["id"])["section_type"] = known(e["section_type"], types)

    def include(self, e: dict, types) -> None:
        self.find(e["id"])
        for key in self.below(e["id"]):
            self.rows[key]["included"] = bool(e["included"])

    def delete(self, e: dict, types) -> None:
        self.find(e["id"])
        self.take(e["id"])
        for key in self.below(e["id"]):
            del self.rows[key]
            self.children.pop(key, None)

    def create(self, e: dict, types) -> None:
        title, kind = titled(e["title"]), known(e["section_type"], types)
        if e["parent_id"] is not None:
            self.find(e["parent_id"])
        self.add(e["new_id"], {"title": title, "section_type": kind, "markdown": e["markdown"] or ""})
        self.put(e["new_id"], e["parent_id"], e["place"])

    def move(self, e: dict, types) -> None:
        row, parent = self.find(e["id"]), e["parent_id"]
        if parent is not None and self.find(parent) and parent in self.below(row["id"]):
            raise Refused("a section can't move below itself")
        self.take(row["id"])
        self.put(row["id"], parent, e["place"])

    def split(self, e: dict, types) -> None:
        row = self.find(e["id"])
        try:
            head, tail = folds.split_at(row["markdown"] or "", e["heading"] or "")
        except ValueError as why:
            raise Refused(str(why)) from why
        title = (e["title"] or "").strip() or tail.split("\n")[0].strip().lstrip("#").strip()
        self.add(e["new_id"], {**row, "id": e["new_id"], "title": title, "markdown": tail})
        row["markdown"] = head
        self.put(e["new_id"], row["parent_id"], self.children[row["parent_id"]].index(row["id"]) + 1)

    def merge(self, e: dict, types) -> None:
        kept, keys = self.find(e["id"]), list(dict.fromkeys([e["id"], *(e["others"] if e["others"] is not None else [])]))
        rows = [self.find(k) for k in keys]
        if len(keys) < 2 or len({r["parent_id"] for r in rows}) > 1:
            raise Refused("only siblings can be merged")
        family = self.children[kept["parent_id"]]
        rows.sort(key=lambda r: family.index(r["id"]))
        kept["markdown"] = "\n\n".join(t for t in ((r["markdown"] or "").strip() for r in rows) if t)
        kept["page_start"] = min((r["page_start"] for r in rows if r["page_start"]), default=kept["page_start"])
        kept["page_end"] = max((r["page_end"] for r in rows if r["page_end"]), default=kept["page_end"])
        # children of all come together by their places, then ids
        children = sorted((n, c) for r in rows for n, c in enumerate(self.children.pop(r["id"], [])))
        self.children[kept["id"]] = [c for _, c in children]
        for _, c in children:
            self.rows[c]["parent_id"] = kept["id"]
        for r in rows:
            if r is not kept:
                family.remove(r["id"])
                del self.rows[r["id"]]

    def numbered(self) -> list[dict]:
        """All sections in tree order with ord, level, lft, rgt, is_group and path."""
        out, count = [], 0
        stack = [(k, 1, n, None) for n, k in reversed(list(enumerate(self.children[None])))]
        while stack:
            key, level, place, above = stack.pop()
            if level < 0:  # all below are done
                self.rows[key]["rgt"] = count = count + 1
                continue
            count += 1
            row, kids = self.rows[key], self.children.get(key, [])
            path = row["title"] or "" if above is None else f"{above} > {row['title'] or ''}"
            row |= {"ord": place, "level": level, "lft": count, "is_group": bool(kids), "path": path}
            out.append(row)
            stack.append((key, -1, 0, None))
            stack += [(k, level + 1, n, path) for n, k in reversed(list(enumerate(kids)))]
        return out


def titled(title: str | None) -> str:
    if not (title or "").strip():
        raise Refused("a title can't be empty")
    return title.strip()


def known(section_type: str | None, types) -> str | None:
    kind = (section_type or "").strip() or None
    if kind and types is not None and kind not in types:
        raise Refused(f"unknown type {kind!r}")
    return kind


def _after(sections: list[dict], log: list[dict], types) -> tuple[list[dict], list[dict]]:
    """The numbered sections of a document after its edits, and what became of each edit."""
    outline, told = Outline(sections), []
    for e in sorted(log, key=lambda e: e["seq"]):
        why = None
        try:
            if e["op"] not in ("rename", "retype", "include", "delete", "create", "move", "split", "merge"):
                raise Refused(f"unknown edit {e['op']!r}")
            getattr(outline, e["op"])(e, types)
        except Refused as refused:
            why = str(refused)
        told.append({"seq": e["seq"], "op": e["op"], "error": why})
    return outline.numbered(), told


def changed_documents(edits: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id) of documents with edits, and whether they are few enough to be sent to every task."""
    ids = edits.where("doc_id is not null").select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return (F.broadcast(ids) if few else ids), few


def _folded(tree: DataFrame, edits: DataFrame, types: Sequence[str] | None, want_log: bool) -> DataFrame:
    """One row a document, with its sections and edits as arrays, to rows of sections or of outcomes."""
    known_types = None if types is None else frozenset(types)
    ids, _ = changed_documents(edits)
    sections = tree.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct(*TREE[1:])).alias("sections"))
    logs = edits.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct(*EDITS)).alias("log"))
    kinds = {c: tree.schema[c].dataType for c in TREE}
    fields = [T.StructField(c, kinds[c]) for c in TREE]
    if want_log:
        fields = fields[:1] + [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("error", T.StringType())]
    else:
        fields += [T.StructField("level", T.IntegerType()), T.StructField("lft", T.LongType()), T.StructField("rgt", T.LongType()), T.StructField("is_group", T.BooleanType()), T.StructField("path", T.StringType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                out = []
                for row in whole.slice(at, DOCUMENTS).to_pylist():
                    found = _after(row["sections"] or [], row["log"], known_types)[want_log]
                    out += [{**r, "doc_id": row["doc_id"]} for r in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in arrow], schema=arrow)

    return logs.join(sections, "doc_id", "left").select("doc_id", "sections", "log").mapInArrow(fold, schema)


def edited(tree: DataFrame, edits: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The sections of all documents that have edits, after them: the columns of TREE, and level, lft, rgt, is_group, path.

    ``tree``: doc_id, id, parent_id, ord, title, section_type, included, page_start, page_end, markdown. ``edits``: doc_id and the
    columns of EDITS; ``seq`` orders a document's edits, each of which sees what earlier ones did. rename, retype (to one
    of ``types``, if given, or none), include (a section and all below), delete (likewise), create (new_id under
    parent_id at place, else last), move, split (at a heading of the text; new_id follows at once) and merge (others
    into id). An edit that can't be done changes nothing; :func:`outcomes` says why. Siblings are in the order of ord,
    then id, and ord counts from 0 afterwards; a parent that is not there counts as none. Documents of edits only, with
    no sections, begin empty. Edits without a document are left out. A document is folded in one task.
    """
    return _folded(tree, edits, types, False)


def outcomes(tree: DataFrame, edits: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, seq, op, error): what became of every edit; error is null where it was done."""
    return _folded(tree, edits, types, True)


def with_edits(tree: DataFrame, changed: DataFrame, edits: DataFrame) -> DataFrame:
    """All documents: ``changed`` (as :func:`edited` gives it) in place of those with edits, others as they were.

    Other documents stay in their tasks as long as the edited ones are few enough to be sent to each.
    """
    ids, _ = changed_documents(edits)
    columns = [c for c in tree.columns if c in changed.columns]
    return tree.select(*columns).join(ids, "doc_id", "left_anti").unionByName(changed.select(*columns))


def with_references(old: DataFrame, changed: DataFrame, edits: DataFrame, page_counts: DataFrame) -> DataFrame:
    """References (doc_id, from_id, to_id, page, anchor, occurrences) after edits: found anew in documents with structural ones.

    Incoming references are found anew with the outgoing ones, since those that named a deleted or split section may
    now lead to another that covers their page. Edits of titles, types, inclusion and places leave references alone.
    """
    ids, _ = changed_documents(edits.where(F.col("op").isin(*STRUCTURAL)))
    found = references.extract(changed.join(ids, "doc_id", "left_semi"), page_counts, "lft")
    return old.join(ids, "doc_id", "left_anti").unionByName(found.select(*old.columns))
