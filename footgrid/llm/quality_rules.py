"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio.

Words are the runs of bytes other than \\x20 and \\x09-\\x0D. A word's crc32
hashes it into one of ``buckets`` unigram buckets; neighbouring words' hashes
mix into as many bigram buckets. Two multinomials over the buckets are counted:
the raw one over every n-gram of the whole corpus, the target one over the
trusted documents (labels.quality = 1). A document's score is the mean over its
n-grams of ``log(p_target / p_raw)``, both smoothed by ``alpha``; the mean makes
it independent of length. A document is kept if it passes the base rules and
scores at least ``threshold``: no sampling and no noise, the same document
always gets the same verdict against the same counts.

The raw counts cover all rows, the target ones all trusted rows; labels meet
documents in a sort-merge join by doc_id at every size, which shuffles the texts
once. Each task adds its documents' counts in numpy and emits one row a bucket,
so hot sources or copies cost nothing extra.

The threshold is a documented choice: a document goes if its n-grams are, in the
geometric mean, less than exp(-0.25) = 0.78 times as likely under the target as
under the whole corpus.

Null texts have no words and fail the base rules; without any trusted document
the score is 0 and only the base rules decide. Repeated rows count as often as
they come, and each is judged; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import SPACES, slices
from footgrid.shipping import map_arrow

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 14
    alpha: float = 1.0
    #: Mean log-likelihood ratio from which a document is kept.
    threshold: float = -0.25
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word's number in order of first appearance."""
    seen: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), seen


def repeated_words(ids: np.ndarray, distinct: int, window: int = 5) -> int:
    """Words within windows of ``window`` words that are found twice or more; exact, as windows become numbers."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys, size = ids[:n], distinct
    for k in range(1, window):
        if size * distinct >= 1 << 62:
            found, keys = np.unique(keys, return_inverse=True)
            size = len(found)
        keys, size = keys * distinct + ids[k : k + n], size * distinct
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    starts = np.isin(keys, twice)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += starts
    edge[window : window + n] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def features(ids: np.ndarray, seen: dict[bytes, int], buckets: int) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams; bigram buckets follow the unigrams'."""
    if not len(ids):
        return ids
    hashes = np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen))[ids]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    return np.concatenate([hashes % np.uint64(buckets), pairs % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)


def target_ids(labels: DataFrame, config: QualityRules) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def bucket_counts(documents: DataFrame, trusted: DataFrame, config: QualityRules) -> np.ndarray:
    """Raw and target counts of every bucket, as two rows of 2 * buckets numbers."""
    rows, good = documents.select("doc_id", "text"), trusted.select("doc_id").distinct().withColumn("trusted", F.lit(True))
    # Rows without an id are never trusted; in a shuffled join they would all meet in one task.
    marked = (
        rows.where("doc_id IS NOT NULL").join(good.hint("merge"), "doc_id", "left").select("text", "trusted")
        .unionByName(rows.where("doc_id IS NULL").select("text", F.lit(None).cast("boolean").alias("trusted")))
    )

    def run(batches):
        found = np.zeros((2, 2 * config.buckets), np.int64)
        for batch in batches:
            for part in slices(batch):
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    used, n = np.unique(features(*word_ids((text or "").encode().split()), config.buckets), return_counts=True)
                    found[0][used] += n
                    if good:
                        found[1][used] += n
        used = np.flatnonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(found[0][used]), pa.array(found[1][used])], ["bucket", "raw", "target"])

    sums = (
        map_arrow(marked, run, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    out = np.zeros((2, 2 * config.buckets), np.int64)
    for row in sums.collect():  # 2 * buckets rows at most
        out[:, row["bucket"]] = row["raw"], row["target"]
    return out


def log_ratios(counts: np.ndarray, config: QualityRules) -> np.ndarray:
    """log(p_target / p_raw) of every bucket; unigrams and bigrams are two multinomials each."""
    if not counts[1].any():
        return np.zeros(2 * config.buckets)
    parts = []
    for part in (slice(0, config.buckets), slice(config.buckets, None)):
        raw, target = counts[0][part] + config.alpha, counts[1][part] + config.alpha
        parts.append(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    return np.concatenate(parts)


def judged(text: str | None, ratios: np.ndarray, config: QualityRules) -> tuple:
    """A text's statistics, whether it fails the base rules, its score and verdict."""
    text = text or ""
    words = text.encode().split()
    ids, seen = word_ids(words)
    found = features(ids, seen, config.buckets)
    n, repeats = len(words), repeated_words(ids, len(seen), config.window)
    failed = n < config.min_words or 100 * repeats > config.max_repeat_percent * n
    llr = float(ratios[found].mean()) if n else 0.0
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        duplicate_lines(text), repeats, failed, llr, not failed and llr >= config.threshold,
    )


def accepted(documents: DataFrame, labels: DataFrame, config: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``documents``, with all their columns, that are kept."""
    ratios = log_ratios(bucket_counts(documents, target_ids(labels, config), config), config)
    shared, at = documents.sparkSession.sparkContext.broadcast(ratios), documents.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([judged(t, shared.value, config)[-1] for t in part.column(at).to_pylist()], pa.bool_()))

    return map_arrow(documents, run, documents.schema)


def apply(documents: DataFrame, labels: DataFrame, config: QualityRules = QualityRules()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) of every row."""
    ratios = log_ratios(bucket_counts(documents, target_ids(labels, config), config), config)
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(ratios)  # 2 * buckets numbers

    def run(batches):
        ratios = shared.value
        for batch in batches:
            for part in slices(batch):
                stats = [judged(t, ratios, config) for t in part.column(1).to_pylist()]
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
                columns = [pa.array(x, k) for x, k in zip(zip(*stats), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    return map_arrow(
        rows,
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean",
    )
