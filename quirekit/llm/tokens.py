"""Token counts by the whole-token shortcut.

A BPE model with word-start marks never merges across the place where a mark follows another
character, provided that no vocabulary string holds a mark after another character; this is
checked against the vocabulary when the model is loaded. A text is then a sequence of independent
units (a run of marks and the characters up to the next mark), and its count is the sum of theirs.
Before any text is read, every vocabulary string of one mark and a rest is encoded alone: those that
give back exactly themselves are whole tokens and count 1 without merging. Only other units are
merged, each distinct one once per batch of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirekit.llm.common import slices

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Merged units that a task remembers before it starts anew.
REMEMBERED = 400_000


class Counter:
    """Counts the tokens of texts as the model's own encoder does."""

    def __init__(self, model: bytes, whole: list[str] | None = None):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size())]
        self.independent = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.whole = self.prove(pieces) if whole is None else whole
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known = dict.fromkeys(self.whole, 1)

    def prove(self, pieces: list[str]) -> list[str]:
        """The words w for which 'mark + w' is a vocabulary string that encodes alone as that one token."""
        words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
        found = self.encoder.encode(words, num_threads=1)
        return [w for w, ids in zip(words, found) if len(ids) == 1 and self.encoder.id_to_piece(ids[0]) == MARK + w]

    def merge(self, units: list[str]) -> None:
        """Learn the counts of units (without their first mark, which the encoder puts back)."""
        if len(self.known) > REMEMBERED + len(self.whole):
            self.forget()
        for unit, ids in zip(units, self.encoder.encode([u.replace(MARK, " ") for u in units], num_threads=1)):
            self.known[unit] = len(ids)
        if "" in units:  # a lone mark: the encoder gives an empty text nothing
            self.known[""] = len(self.encoder.encode("a ")) - len(self.encoder.encode("a"))

    def units(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in UNIT.findall(MARK + text.replace(" ", MARK))]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.independent:
            return len(self.encoder.encode(text, num_threads=1))
        units = self.units(text)
        if fresh := set(units).difference(self.known):
            self.merge(list(fresh))
            if not all(map(self.known.__contains__, units)):
                self.merge(list(set(units).difference(self.known)))
        return sum(map(self.known.__getitem__, units))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle; rows stay where they are read. A null text counts as empty (0 bytes, 0 tokens). A
    null id stays null, repeated rows give repeated rows, an empty table gives an empty result, and
    other columns are not read. The model's bytes (half a megabyte) travel with the task.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    whole = Counter(model).whole

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, whole)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            counts = [counter.count(t) if t else 0 for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
