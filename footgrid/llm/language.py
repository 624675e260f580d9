"""Language identification of mixed-language text.

A word's script (by ranges of code points) narrows the candidates to the
languages that write a notable share of their letters in it. Among them each
word has a score per language, the sum of its character trigrams' log
probabilities; Viterbi over a text's words, with a penalty for each switch,
labels them, and runs of one label are the spans. A document's language is the
one whose spans hold most letters (the first by name of equal ones); its score
is that share of the letters.

Trigrams are hashed, counted per language over the ``train_bound`` documents of
least hash outside the held-out fold (a documented bound on the fit), and
smoothed. Viterbi runs over all texts of a slice at once, longest first, a step
a word; each step is a few numpy operations.

Only texts are read for a prediction. Null texts and those without letters are
``und`` with score 0, as are all if nothing was learned. Repeated rows are each
labelled; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import bounded_ids, crc_of_id, slices
from footgrid.shipping import map_arrow

#: Scripts by their ranges' first code points, ascending; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x31A0, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
)
STARTS = np.array([x[0] for x in SCRIPTS])
NAMES = sorted({x[1] for x in SCRIPTS})
SCRIPT_OF_RANGE = np.array([NAMES.index(x[1]) for x in SCRIPTS])

_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
UND = "und"


@dataclass(frozen=True)
class Language:
    buckets: int = 1 << 15
    alpha: float = 0.5
    switch: float = 12.0
    #: A script is a language's if it holds at least this share of its letters.
    script_share: float = 0.01
    train_bound: int = 20_000
    folds: int = 4
    fold: int = 2
    #: Distinct words whose scores a worker remembers at most.
    remembered: int = 200_000


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: log probabilities
    scripts: np.ndarray  # scripts x languages: whether the language writes it


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_OF_RANGE[np.searchsorted(STARTS, first, "right") - 1]


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' trigrams of bytes, edges marked, and where each word's begin."""
    marked = [b"\x02%b\x03" % w.lower().encode() for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    ends = np.cumsum(length)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    return bucket[inside[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(length - 2)[:-1]])


class WordScores:
    """A worker's memory of words' scores by language."""

    def __init__(self, model: Model, config: Language):
        self.model, self.config, self.number = model, config, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words of all texts (words x languages), and their letters."""
        if len(self.number) > self.config.remembered:
            self.number, self.table = {}, self.table[:0]
        number, new = self.number, []
        ids = []
        for words in texts:
            for w in words:
                k = number.get(w)
                if k is None:
                    k = number[w] = len(number)
                    new.append(w)
                ids.append(k)
        if new:
            bucket, start = grams(new, self.config.buckets)
            found = np.add.reduceat(self.model.scores[bucket], start, axis=0)
            allowed = self.model.scripts[scripts_of(new)]
            found = np.where(allowed, found, -1e4)
            found[~allowed.any(axis=1)] = 0  # a script of no language says nothing
            self.table = np.concatenate([self.table, found.astype(np.float32)])
        letters = np.fromiter((len(w) for words in texts for w in words), np.int64, len(ids))
        return self.table[np.array(ids, np.int64)], letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; texts lie one after the other in ``scores``, ``lengths`` are their words."""
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, left = offsets[order], lengths[order]
    kind = np.min_scalar_type(scores.shape[1])  # holds every label, however many languages there are
    label = np.zeros(len(scores), kind)
    steps = int(left[0]) if len(left) else 0
    if not steps:
        return label
    active = len(left) - np.searchsorted(left[::-1], np.arange(steps), "right")  # texts with a word at each step
    back = np.zeros((len(scores), scores.shape[1]), kind)
    value = scores[at[: active[0]]].astype(np.float64)
    last = np.zeros((len(left), scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=kind)
    for t in range(1, steps):
        n = active[t]
        if n < len(value):
            last[n : len(value)] = value[n:]
            value = value[:n]
        best = value.argmax(axis=1).astype(kind)
        jump = value.max(axis=1)[:, None] - switch
        stay = value >= jump
        back[at[:n] + t] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, jump) + scores[at[:n] + t]
    last[: len(value)] = value
    now = last.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        where = at[:n] + t
        label[where] = now[:n]
        if t:
            now[:n] = back[where, now[:n]]
    return label


def train(documents: DataFrame, config: Language = Language()) -> Model:
    """Count trigrams and scripts per language over the bounded sample outside the held-out fold."""
    usable = documents.where(F.col("lang").isNotNull() & F.coalesce(crc_of_id(F.col("doc_id")) % config.folds != config.fold, F.lit(False)))
    # At most train_bound ids: the broadcast has that size whatever the input.
    rows = usable.join(F.broadcast(bounded_ids(usable, config.train_bound)), "doc_id", "left_semi").select("lang", "text")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = counts.setdefault(lang, np.zeros(config.buckets + len(NAMES), np.int64))
                    if words := _words(text or ""):
                        found += np.concatenate([np.bincount(grams(words, config.buckets)[0], minlength=config.buckets), np.bincount(scripts_of(words), minlength=len(NAMES))])
        for lang, found in counts.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(found[used])], ["lang", "bucket", "n"])

    # Languages times (buckets + scripts) rows at most: as many numbers as the model itself has.
    found = map_arrow(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((config.buckets + len(NAMES), len(languages)))
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)] = found["n"].to_numpy()
    seen, scripts = counts[: config.buckets] + config.alpha, counts[config.buckets :]
    return Model(languages, np.log(seen / seen.sum(axis=0)), scripts >= config.script_share * np.maximum(1, scripts.sum(axis=0)))


def _labelled(texts: list[str | None], memory: WordScores, config: Language):
    words = [_words(t or "") for t in texts]
    scores, letters = memory.of(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return words, letters, lengths, viterbi(scores, lengths, config.switch)


def identify(documents: DataFrame, model: Model, config: Language = Language()) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, memory = shared.value, WordScores(shared.value, config)
        for batch in batches:
            for part in slices(batch, 16 << 20):
                texts = part.column(1).to_pylist()
                if not model.languages:
                    pred, share = [UND] * len(texts), [0.0] * len(texts)
                else:
                    words, letters, lengths, label = _labelled(texts, memory, config)
                    held = np.zeros((len(texts), len(model.languages)))
                    np.add.at(held, (np.repeat(np.arange(len(texts)), lengths), label), letters)
                    best, total = held.argmax(axis=1), held.sum(axis=1)
                    pred = [model.languages[b] if n else UND for b, n in zip(best, total)]
                    share = held.max(axis=1) / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double")


def spans(documents: DataFrame, model: Model, config: Language = Language()) -> DataFrame:
    """(doc_id, start, end, lang) of each run of words of one language; start and end count words."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, memory = shared.value, WordScores(shared.value, config)
        for batch in batches:
            for part in slices(batch, 16 << 20):
                if not model.languages:
                    continue
                _, _, lengths, label = _labelled(part.column(1).to_pylist(), memory, config)
                text = np.repeat(np.arange(len(lengths)), lengths)
                first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])])) if len(text) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(text)))
                place = first - (np.cumsum(lengths) - lengths)[text[first]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text[first])), pa.array(place), pa.array(place + size), pa.array([model.languages[k] for k in label[first]], pa.string())],
                    ["doc_id", "start", "end", "lang"],
                )

    return map_arrow(rows, run, f"doc_id {kind}, start long, end long, lang string")


def apply(documents: DataFrame, config: Language = Language()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; a null doc_id is not held out."""
    found = identify(documents, train(documents, config), config)
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % config.folds == config.fold, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
