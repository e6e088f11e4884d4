"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are single words, pairs of neighbouring words, and the same of word shapes (letters folded
to case, digits and marks kept by kind), all hashed into one table of 2**20 weights. A
feature counts its occurrences over the square root of the text's length. The model is fitted on at
most ``TRAIN_ROWS`` labelled ids, those with the smallest hash, one row per id and ``TRAIN_CHARS`` characters in all, in one task; the
weights (4 MB, whatever the corpus) go to the executors as a broadcast variable and a text's score is
one sparse dot product. Scoring is row-local over whole texts.

Defined cases: null and empty texts score the bias alone; rows without a label, or whose label is
null, don't train; without any labelled row every score is 0.5; repeated rows score alike; of rows with one id the one whose text
has the least hash trains; what would take the training texts over that is left out. Words are
what lies between white space; a longer one than ``PIECE`` characters is cut into consecutive pieces of that length that
each count as a word, in training and in scoring, so all of a text without white space counts.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, free_name, pa_schema, slices, text_or_empty

BITS = 20
TRAIN_ROWS, EPOCHS = 6000, 3
#: Characters of text that train, in all.
TRAIN_CHARS = 64 << 20
ALPHA, BETA, L1, L2 = 0.2, 0.5, 0.02, 0.05
THRESHOLD = 0.3
#: Characters of a word's piece.
PIECE = 64
#: Distinct words whose hashes a worker remembers.
WORDS = 100_000

_RUN = regex.compile(r"\p{Lu}+|\p{L}+|\p{N}+|(.)\1*", regex.DOTALL)


def _shape(word: str) -> str:
    """Case, digits and marks of a word, runs folded: ``The,`` is ``Aa,`` and ``on%%%`` ``a%%``."""
    out = []
    for m in _RUN.finditer(word):
        s = m.group()
        if s[0].isalpha():
            out.append("A" if s.isupper() else "a")
        elif s[0].isnumeric():
            out.append("0")
        else:
            out.append(s[:2])
    return "".join(out)


def words_of(text: str) -> list[str]:
    words = text.split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
    return words


class WordHashes(dict):
    """Word to its two 32-bit hashes in one integer: of itself low, of its shape high."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) | xxhash.xxh32_intdigest(_shape(word), 7) << 32
        if len(word) <= 40:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> np.ndarray:
    """Table places of all n-grams of a text: words, shapes, word pairs, shape pairs."""
    both = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    pair = word[:-1] * np.uint64(0x100000001B3) + word[1:]
    shapes = shape[:-1] * np.uint64(0x100000001B3) + shape[1:]
    return np.concatenate([_mix(word, 1), _mix(shape, 2), _mix(pair, 3), _mix(shapes, 4)])


class Ftrl:
    """Follow the regularised leader, per coordinate, with a weight for each label."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(v: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def fit(rows: Iterator[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, of the given (text, label) rows in their order; rows that would take the texts over ``TRAIN_CHARS`` are left out."""
    seen, room = [], TRAIN_CHARS
    for text, y in rows:
        if len(text or "") > room:
            continue
        room -= len(text or "")
        words = words_of(text or "")
        at, count = np.unique(features(words), return_counts=True) if words else (np.zeros(0, np.int64), np.zeros(0))
        seen.append((np.append(at, 1 << BITS).astype(np.int32), np.append(count / max(1.0, np.sqrt(len(words))), 1.0).astype(np.float32), int(y)))
    model = Ftrl()
    for _ in range(epochs):
        for at, x, y in seen:
            model.learn(at, x, y)
    return model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def _dump(w: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, w=w)
    return held.getvalue()


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = TRAIN_ROWS) -> bytes:
    """A fitted model as bytes. ``usable`` says, of ``labels``, which rows may be learned from."""
    chosen = (
        labels.where(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    # of an id that many rows have, each task passes one on
    sample = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_label").alias("_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fit((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("_label").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([_dump(w)], pa.binary())], names=["model"])

    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "_label")
    made = one.mapInArrow(run, "model binary").first()
    return bytes(made["model"]) if made else _dump(fit(iter(())))


def scorer(model: bytes) -> Callable[[list[str]], np.ndarray]:
    w = np.load(io.BytesIO(model))["w"]

    def score(texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            words = words_of(text)
            out[k] = w[-1] + (float(w[features(words)].sum(dtype=np.float64)) / np.sqrt(len(words)) if words else 0.0)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))

    return score


def add_score(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold). Row-local; any columns pass through."""
    docs = clear_of(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        tail = pa_schema("score double, predicted int")
        for batch in batches:
            for part in slices(batch, "text"):
                p = score([t or "" for t in part.column("text").to_pylist()])
                new = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *tail.names])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    names, own = docs.columns, free_name(docs, "_quality_text")
    marked = docs.withColumn(own, text_or_empty())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            for part in slices(batch, own):
                good = pa.array(score(part.column(own).to_pylist()) >= threshold)
                yield part.filter(good).select(names)

    return marked.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
