"""Language identification by multilingual mixture inference.

A language is a distribution over character n-grams (byte trigrams of the lower-cased text, hashed to
a fixed number of buckets), counted over all training documents. A document is a mixture of
languages: its proportions are found by expectation-maximisation. The set of languages grows from the
best single one by the one that helps most, as long as the log-likelihood gains more than a penalty
that grows with the logarithm of the document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import slices, training_row

BITS = 14
FOLDS = 5
#: A further language must raise the log-likelihood by this many times the logarithm of the n-grams.
PENALTY = 6.0
UNKNOWN = "und"
#: ASCII characters other than letters count as spaces; bytes beyond ASCII stay.
PLAIN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], dtype=np.uint32)


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text with a space before and after, without those of spaces only."""
    b = PLAIN[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.intp)


class Model:
    """languages and their n-gram probabilities, one column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts.astype(np.float64) + 0.5
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T) if languages else np.zeros((1 << BITS, 0))
        self.log_p = np.log(self.p)

    def mixture(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The selected languages and their proportions; none for a text without letters."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return [], np.zeros(0)
        g, n = np.unique(grams(text), return_counts=True)  # as many rows as buckets at most, however long the text
        single = n @ self.log_p[g]
        chosen = [int(single.argmax())]
        now, share = float(single[chosen[0]]), np.ones(1)
        p = self.p[g]
        penalty = PENALTY * np.log(n.sum() + 1)
        while len(chosen) < len(self.languages):
            mixed = p[:, chosen] @ share
            # the log-likelihood is concave: adding a language can't gain more than its slope
            slope = n @ (p / mixed[:, None]) - n.sum()
            slope[chosen] = -np.inf
            best = int(slope.argmax())
            if slope[best] <= penalty:
                break
            tried = [*chosen, best]
            weights, value = self.maximise(p[:, tried], n, np.append(share * 0.9, 0.1))
            if value - now <= penalty:
                break
            chosen, share, now = tried, weights, value
        return chosen, share

    @staticmethod
    def maximise(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int = 60, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and their log-likelihood, of n-grams met n times."""
        before = -np.inf
        for _ in range(rounds):
            weighted = p * share
            total = weighted.sum(axis=1)
            value = float(n @ np.log(total))
            if value - before < tolerance:
                break
            before, share = value, n @ (weighted / total[:, None]) / n.sum()
        return share, value

    def predict(self, text: str | None) -> tuple[str, float]:
        chosen, share = self.mixture(text)
        if not chosen:
            return UNKNOWN, 0.0
        best = int(share.argmax())
        return self.languages[chosen[best]], float(min(1.0, max(0.0, share[best])))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Model:
    """Count the n-grams of every text with a language: a table of languages times 2^bits numbers, whatever the input's size."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in total:
                    total[lang] = np.zeros(1 << bits, dtype=np.int64)
                total[lang] += np.bincount(grams(text, bits), minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    met = some.mapInArrow(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(met["lang"].unique())
    table = np.zeros((len(languages), 1 << bits), dtype=np.int64)
    table[met["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.intp), met["bucket"].to_numpy(dtype=np.intp)] = met["n"].to_numpy()
    return Model(languages, table)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id by default), lang_pred and score, one row per row of ``docs``; only the text is looked at.

    score is the share of the predicted language in the document. A text that is null or has no
    letter, or a model without languages, gives lang_pred 'und' and score 0. Ties go to the language
    first in alphabet. Repeated rows and null ids stay as they are; an empty table gives no rows.
    """
    keep = [id_col] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.p.astype(np.float64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model.__new__(Model)
        held.languages, held.p = sent.value
        held.log_p = np.log(held.p)
        for batch in slices(batches):
            found = [held.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(rows, f"{fields}, lang_pred string, score double")


def predict_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """id, held_out, lang_pred, score: trained on the rows outside the held-out fold, predicted for all."""
    model = train(docs.where(training_row(F.col(id_col), folds)), text_col, lang_col)
    rows = docs.select(id_col, text_col).withColumn("held_out", ~training_row(F.col(id_col), folds))
    return identify(rows, model, id_col, text_col, keep=[id_col, "held_out"])
