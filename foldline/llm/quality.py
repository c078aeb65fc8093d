"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, by byte histograms and word counts. Trees are fitted here on a bounded,
documented sample of labelled rows: the ``TRAIN_ROWS`` smallest by a hash of the id among the rows that may be
learnt from. A feature is binned at quantiles of the sample; each level of a tree adds up gradients by bin. A
fitted model is flat arrays (feature, threshold, children, value) that numpy walks for a whole batch at once.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; a null label or id is
not learnt from; conflicting labels of one id all count; without labelled rows every score is 0.5, and with
labels of one kind only it is that kind's; repeated rows are repeated; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled rows fitted on, at most.
TRAIN_ROWS = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAF = 60, 4, 64, 0.2, 1.0, 10

_PUNCTUATION = np.array([chr(i) in string.punctuation for i in range(256)])
_SENTENCE = np.array([chr(i) in ".,;:'\"?-()" for i in range(256)])
_UPPER, _LOWER = (np.array([chr(i) in x for i in range(256)]) for x in (string.ascii_uppercase, string.ascii_lowercase))
_DIGIT, _SPACE = (np.array([chr(i) in x for i in range(256)]) for x in (string.digits, string.whitespace))
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeats", "short_words", "lines", "distinct_lines", "line_length",
    "upper", "digits", "symbols", "punctuation", "bars", "bangs", "hashes", "spaces", "high_bytes", "byte_entropy", "capitals",
)


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n, words, lines = len(raw), text.split(), text.split("\n")
    k = max(1, len(words))
    seen = set(words)
    share = count / n
    letters = count[_UPPER].sum() + count[_LOWER].sum()
    some = share[share > 0]
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / k, len(seen) / k, repeats / k,
        sum(len(w) <= 2 for w in seen) / max(1, len(seen)), len(lines) / k, len(set(lines)) / len(lines), len(text) / len(lines),
        count[_UPPER].sum() / max(1.0, letters), share[_DIGIT].sum(), share[_PUNCTUATION & ~_SENTENCE].sum(), share[_SENTENCE].sum(),
        share[ord("|")], share[ord("!")], share[ord("#")] + share[ord("%")] + share[ord("&")] + share[ord("$")] + share[ord("*")],
        share[_SPACE].sum(), share[128:].sum(), float(-(some * np.log(some)).sum()), sum(map(str.istitle, seen)) / max(1, len(seen)),
    ]


class Forest(NamedTuple):
    """Trees as flat arrays; a leaf has itself as both children."""

    start: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows (n, features), walked level by level through all trees at once."""
        node = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[node].sum(1), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts trees by the logistic loss."""
    none = np.zeros(0, np.int64)
    if not len(y):
        return Forest(0.0, none, none, np.zeros(0), none, none, np.zeros(0))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw = np.full(len(y), np.log(mean / (1 - mean)))
    start, root, feature, threshold, left, right, value = float(raw[0]), [], [], [], [], [], []

    def node() -> int:
        for column, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            column.append(v)
        return len(left) - 1

    for _ in range(TREES if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        top = node()
        root.append(top)
        leaves = [(top, np.arange(len(y)))]
        for _ in range(DEPTH):
            deeper = []
            for at, rows in leaves:
                best = None
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    size = len(edge) + 1
                    c = code[rows, j]
                    sum_g, sum_h = np.cumsum(np.bincount(c, g[rows], size))[:-1], np.cumsum(np.bincount(c, h[rows], size))[:-1]
                    n = np.cumsum(np.bincount(c, minlength=size))[:-1]
                    gain = sum_g**2 / (sum_h + RIDGE) + (total_g - sum_g) ** 2 / (total_h - sum_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = gain[k], j, k
                if best is None:
                    continue
                _, j, k = best
                a, b = node(), node()
                feature[at], threshold[at], left[at], right[at] = j, edges[j][k], a, b
                goes = code[rows, j] <= k
                deeper += [(a, rows[goes]), (b, rows[~goes])]
                for child, own in deeper[-2:]:
                    value[child] = RATE * g[own].sum() / (h[own].sum() + RIDGE)
            leaves = deeper
        ends = [(at, rows) for at, rows in _ends(top, np.arange(len(y)), code, edges, feature, threshold, left, right)]
        for at, rows in ends:
            raw[rows] += value[at]
    integers = [np.array(v, np.int64) for v in (root, feature, left, right)]
    return Forest(start, integers[0], integers[1], np.array(threshold, np.float64), integers[2], integers[3], np.array(value, np.float64))


def _ends(top: int, rows: np.ndarray, code: np.ndarray, edges: list, feature: list, threshold: list, left: list, right: list) -> Iterator[tuple[int, np.ndarray]]:
    if left[top] == top:
        yield top, rows
        return
    goes = code[rows, feature[top]] <= np.searchsorted(edges[feature[top]], threshold[top])
    yield from _ends(left[top], rows[goes], code, edges, feature, threshold, left, right)
    yield from _ends(right[top], rows[~goes], code, edges, feature, threshold, left, right)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Forest:
    """Fits on the bounded sample. docs: doc_id, text; labels: doc_id, y; may_learn: a condition on doc_id."""
    order = [F.xxhash64("doc_id"), "doc_id", "y"]
    sample = labels.filter(may_learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).orderBy(*order).limit(TRAIN_ROWS)
    # At most TRAIN_ROWS narrow rows, so the broadcast is bounded.
    ids = F.broadcast(sample.select("doc_id").distinct())
    x = measured(docs.join(ids, "doc_id", "left_semi")).join(F.broadcast(sample), "doc_id")
    rows = x.orderBy(*order, "x").limit(TRAIN_ROWS).select("x", "y").collect()
    return fit(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([float(r["y"]) for r in rows]))


def scored(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: label 1 likelier)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    forest = train(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")), may_learn)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], names=["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality") -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns."""
    small_batches(docs.sparkSession)
    forest = train(docs.select("doc_id", "text"), labels.select("doc_id", F.col(label_col).alias("y")), may_learn)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(forest.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
