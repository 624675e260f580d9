"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a text into a fixed vector: byte-class shares, word and
line shapes, repetition. Trees are grown on binned statistics (quantile bins,
logistic loss, perfect binary trees of ``depth``) and flattened into arrays:
``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf. A
batch of documents goes down all trees at once by ``node = 2 * node + 1 +
(bin > cut)``, a few numpy operations whatever the number of rows.

The model is fitted on the ``train_bound`` labelled rows of least hash whose
``crc32(doc_id as text) mod folds`` is not 0: a bounded sample, as documented.
Only texts are read for a score; labels, lang, source and doc_id are not.

A null text is scored as an empty one. Without labels of both kinds the score is
the share of label 1 (0.5 without any). Rows that repeat a doc_id are each
scored; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import bounded_ids, crc_of_id, slices
from footgrid.shipping import map_arrow

#: Byte classes: their shares of a text are statistics. Bytes of 0x80 and more belong to letters beyond ASCII.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": bytes(range(97, 123)), "digit": b"0123456789", "blank": b" ", "line": b"\n",
    "stop": b".?", "comma": b",;:", "shout": b"!", "hash": b"#", "star": b"*", "money": b"$", "percent": b"%", "amp": b"&", "bar": b"|",
    "angle": b"<>", "brace": b"{}[]()", "slash": b"/\\@", "dash": b"-_=+~^", "quote": b"\"'`", "beyond": bytes(range(128, 256)),
}
NAMES = [
    *(f"share_{k}" for k in CLASSES), "log_words", "word_bytes", "distinct_words", "top_word", "repeats_previous",
    "upper_words", "lines_per_word", "distinct_lines", "marked_words",
]


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES.values()):
        out[np.frombuffer(members, np.uint8), k] = 1
    return out


MATRIX = _class_matrix()
_ENDS = tuple(bytes([b]) for b in b"#*$%&|!<>")


def statistics(text: str | None) -> np.ndarray:
    """The text's statistics in the order of NAMES."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ MATRIX / max(1, len(data))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    return np.concatenate([shares, [
        np.log1p(len(words)), len(data) / n, len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n, len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(w.endswith(_ENDS) for w in words) / n,
    ]])


@dataclass(frozen=True)
class QualityClassifier:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    min_rows: int = 10
    train_bound: int = 20_000
    folds: int = 5
    threshold: float = 0.3


@dataclass
class Trees:
    """Boosted trees as arrays."""

    edges: np.ndarray  # statistics x (bins - 1)
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes: the last bin that goes left
    leaf: np.ndarray  # trees x leaves
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], "left")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        bins, inner = self.binned(x), self.feature.shape[1]
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (bins[rows, self.feature[trees, node]] > self.cut[trees, node])
        raw = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, config: QualityClassifier) -> Trees:
    """Grow the trees; ties go to the first statistic and the lowest cut."""
    m, d, inner, leaves = len(y), len(NAMES), 2**config.depth - 1, 2**config.depth
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if m else 0.5
    base = float(np.log(share / (1 - share)))
    if not m or y.min() == y.max():
        return Trees(np.zeros((d, 1)), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), base)
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, config.bins + 1)[1:-1]) for j in range(d)])
    model = Trees(edges, np.zeros((config.trees, inner), np.int64), np.full((config.trees, inner), config.bins), np.zeros((config.trees, leaves)), base)
    bins, raw = model.binned(x), np.full(m, base)
    for t in range(config.trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess, node = p - y, p * (1 - p), np.zeros(m, np.int64)
        for level in range(config.depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * d + np.arange(d)) * config.bins + bins
            shape, size = (width, d, config.bins), width * d * config.bins
            gl, hl, nl = (
                np.cumsum(np.bincount(key.ravel(), None if w is None else np.repeat(w, d), size).reshape(shape), axis=2) for w in (grad, hess, None)
            )
            g, h, n = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + config.l2) + (g - gl) ** 2 / (h - hl + config.l2) - g**2 / (h + config.l2)
            gain = np.where((nl >= config.min_rows) & (n - nl >= config.min_rows), gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(width), best] > 1e-9
            at = np.arange(first, first + width)
            model.feature[t, at], model.cut[t, at] = np.where(good, best // config.bins, 0), np.where(good, best % config.bins, config.bins)
            node = 2 * node + 1 + (bins[np.arange(m), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        step = -np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + config.l2) * config.rate
        model.leaf[t] = step
        raw += step[leaf]
    return model


def train(documents: DataFrame, labels: DataFrame, config: QualityClassifier = QualityClassifier()) -> Trees:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isNotNull() & (crc_of_id(F.col("doc_id")) % config.folds != 0))
    # At most train_bound ids, so the broadcast and what comes back to the driver have that size whatever the input.
    chosen = bounded_ids(usable, config.train_bound)
    marks = F.broadcast(usable.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rows = documents.select("doc_id", "text").join(marks, "doc_id").select("text", "quality")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [statistics(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), part.column(1).cast(pa.int32())], ["x", "y"])

    found = map_arrow(rows, run, "x array<double>, y int").orderBy(F.xxhash64("x"), "x", "y").limit(config.train_bound).toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(NAMES)))
    return fit(x, found["y"].to_numpy(np.float64), config)


def score(documents: DataFrame, model: Trees, config: QualityClassifier = QualityClassifier()) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = np.stack([statistics(t) for t in part.column(1).to_pylist()])
                p = shared.value.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= config.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(rows, run, f"doc_id {kind}, score double, predicted int")


def accepted(documents: DataFrame, model: Trees, config: QualityClassifier = QualityClassifier()) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are not rejected; no shuffle."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                p = shared.value.score(np.stack([statistics(t) for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(p >= config.threshold))

    return map_arrow(documents, run, documents.schema)


def apply(documents: DataFrame, labels: DataFrame, config: QualityClassifier = QualityClassifier()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null doc_id is not held out."""
    scored = score(documents, train(documents, labels, config), config)
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % config.folds == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
