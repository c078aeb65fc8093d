"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presences: how many n-grams of 1 to ``GRAMS`` letters both
hold, over the whole texts, divided by the geometric mean of how many each holds. N-grams are hashed to ``WIDTH``
slots; runs of anything but letters count as one space. ``LANDMARKS`` texts of a bounded, documented sample (the
``TRAIN_ROWS`` smallest by a hash of the id among the rows that may be learnt from) are the landmarks of a Nyström
approximation, and ridge regression on its features gives one score a language (one against the rest, each class
weighted alike). A batch of texts is scored by matrix products with the landmarks' presence matrix.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text if there is
nothing to learn from; null languages and null ids are not learnt from; repeated rows are repeated; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH = 1 << 15
GRAMS = 4
TRAIN_ROWS = 2048
LANDMARKS = 96
RIDGE = 1e-3
SHARP = 6.0

_SPACE = 32


def _letters() -> np.ndarray:
    table = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            table[i] = i
    return table


_LETTERS = _letters()


def presence(text: str | None) -> np.ndarray | None:
    """Which slots the text's n-grams take; None without a letter."""
    if not text:
        return None
    codes = _LETTERS[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == _SPACE
    codes = codes[~(gap & np.concatenate([[True], gap[:-1]]))]
    if len(codes) == 0:
        return None
    if codes[-1] != _SPACE:
        codes = np.append(codes, np.uint32(_SPACE))
    codes = np.concatenate([np.array([_SPACE], np.uint32), codes])
    flags, h = np.zeros(WIDTH, bool), np.zeros(len(codes), np.uint32)
    for n in range(1, GRAMS + 1):
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        flags[h >> np.uint32(17)] = True
    return flags


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray
    """Packed presences of the landmarks."""
    sizes: np.ndarray
    weights: np.ndarray
    """From kernels with the landmarks to one score a language."""


def kernels(x: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Normalised kernels of presences (rows, WIDTH) with the landmarks (LANDMARKS, WIDTH)."""
    own = np.maximum(x.sum(1, dtype=np.float32), 1)
    return (x.astype(np.float32) @ marks.T) / np.sqrt(own[:, None] * sizes[None, :])


def fit(packed: list[bytes], languages: list[str]) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, WIDTH // 8), np.uint8), np.zeros(0, np.float32), np.zeros((0, 0)))
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    label = np.array([names.index(x) for x in languages])
    turn = np.zeros(len(label), np.int64)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    marks = np.sort(np.lexsort((label, turn))[:LANDMARKS])  # the languages by turns
    dense = np.unpackbits(rows[marks], axis=1).astype(np.float32)
    sizes = np.maximum(dense.sum(1), 1)
    k = np.concatenate([kernels(np.unpackbits(rows[i : i + 64], axis=1), dense, sizes) for i in range(0, len(rows), 64)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernels(dense, dense, sizes).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    feature = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
    weight = 1 / np.bincount(label)[label]
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = feature.T @ (feature * weight[:, None]) + RIDGE * np.eye(feature.shape[1])
    solved = np.linalg.solve(gram, feature.T @ (target * weight[:, None]))
    return Model(names, rows[marks], sizes.astype(np.float32), np.concatenate([root @ solved[:-1], solved[-1:]]))


class Scorer:
    """A model made ready on a worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        flags = [presence(t) for t in texts] if self.model.languages else []
        some = [i for i, x in enumerate(flags) if x is not None]
        if some:
            k = kernels(np.stack([flags[i] for i in some]), self.marks, self.model.sizes)
            margin = SHARP * (k @ self.model.weights[:-1] + self.model.weights[-1])
            p = np.exp(margin - margin.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, b, row in zip(some, best, p, strict=True):
                names[i], scores[i] = self.model.languages[b], row[b]
        return names, scores


def train(docs: DataFrame, may_learn: Column) -> Model:
    """docs: doc_id, text, lang."""
    known = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sample = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [presence(t) for t in batch.column(2).to_pylist()]
            bits = pa.array([None if x is None else np.packbits(x).tobytes() for x in flags], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits], names=["doc_id", "lang", "bits"])

    # At most TRAIN_ROWS ids, so the broadcast is bounded; each row comes back as WIDTH bits.
    texts = known.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")
    rows = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, bits binary").filter("bits is not null")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bits").limit(TRAIN_ROWS).collect()
    return fit([r["bits"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(docs, may_learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            names, scores = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
