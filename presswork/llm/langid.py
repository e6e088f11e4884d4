"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier over hashed byte 2-, 3- and
4-grams of the lower-cased text says which side of it the text is on. Decoding weighs
each bit's logistic loss by how reliable the bit was on rows left out of its fit, and takes the
language whose codeword loses least; the softmax of the losses is the score. A small margin to the
second language flags the text as ambiguous.

Up to five languages get the exhaustive code (all ways to part them), more get the best of some
random codes by least distance. The fit takes at most ``TRAIN_ROWS`` ids, the same number per
language, those with the smallest hash, one row of each and ``TRAIN_CHARS`` characters in all; the weights (2**16 rows of one float per bit)
are broadcast. Prediction is row-local over whole texts, in blocks of bounded size.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with null lang don't
train; of rows with one id and language the one whose text has the least hash trains; without any training row all are ``und``; with one language that one is the answer, score 1;
ties go to the language first in the alphabet.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clear_of, slices

BITS, ORDERS = 16, (2, 3, 4)
TRAIN_ROWS, EPOCHS, RATE = 4000, 4, 0.6
#: Characters of text that train, in all.
TRAIN_CHARS = 64 << 20
#: A sum over n-grams is divided by their number to this power, times SCALE.
SCALE = 12.0
#: Share of probability below which the margin to the second language is called ambiguous.
MARGIN = 0.2
#: Bytes of text that are hashed together, and of a text that trains.
BLOCK = 1 << 18
UNKNOWN = "und"


def codebook(languages: int, seed: int = 5) -> np.ndarray:
    """languages x bits of -1 and 1, no column all alike and none another's opposite."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        cols = [[1] + [1 if b >> k & 1 else -1 for k in range(languages - 1)] for b in range(2 ** (languages - 1) - 1)]
        return np.array(cols, np.int8).T
    rng, best, bits = np.random.default_rng(seed), None, max(15, int(np.ceil(10 * np.log2(languages))))
    for _ in range(200 if languages <= 200 else 10):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        apart = bits - (code.astype(np.int32) @ code.T.astype(np.int32) + bits) // 2
        least = int(apart[~np.eye(languages, dtype=bool)].min())
        mixed = bool((np.abs(code.sum(0)) < languages).all())
        if mixed and (best is None or least > best[0]):
            best = (least, code)
    return best[1]


def gram_places(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the table place of the n-gram that begins at each byte."""
    wide = data.astype(np.uint32)
    h = wide * np.uint32(0x85EBCA6B)
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + wide[n - 1 :] * np.uint32(0x27D4EB2F)
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def raw(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def bit_scores(text: str, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Raw score of each bit, blockwise; a block overlaps the next by the longest n-gram less one."""
    data, total, count = raw(text), np.zeros(w.shape[1]), 0
    for at in range(0, max(1, len(data) - 1), BLOCK):
        for n, places in zip(ORDERS, gram_places(data[at : at + BLOCK + max(ORDERS) - 1]), strict=False):
            places = places[: min(BLOCK, len(data) - at - n + 1)]
            total += w[places].sum(0, dtype=np.float64)
            count += len(places)
    return total / max(1, count) * SCALE + bias


def fit(rows: Iterator[tuple[str, str]], epochs: int = EPOCHS) -> bytes:
    """The model of the given (text, language) rows, as bytes; rows that would take the texts over ``TRAIN_CHARS`` are left out."""
    seen, names, room = [], [], TRAIN_CHARS
    for text, lang in rows:
        if len(text) > room:
            continue
        room -= len(text)
        data = raw(text)
        parts = [p for at in range(0, max(1, len(data) - 1), BLOCK) for p in gram_places(data[at : at + BLOCK + max(ORDERS) - 1])]
        at, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0))
        seen.append((at, (count / max(1, count.sum()) * SCALE).astype(np.float32)))
        names.append(lang)
    languages = sorted(set(names))
    code = codebook(len(languages))
    want = code[[languages.index(x) for x in names]] if names else code
    left_out = np.arange(len(seen)) % 5 == 4
    if len(seen) < 50:
        left_out[:] = False

    def descend(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1])
        grown = np.full((1 << BITS, 1), 1e-3, np.float32)
        for epoch in range(epochs):
            for k in use:
                at, x = seen[k]
                f = x @ w[at] + bias
                g = -want[k] / (1.0 + np.exp(np.clip(want[k] * f, -30, 30)))
                step = np.outer(x, g).astype(np.float32)
                grown[at] += (step * step).sum(1, keepdims=True)
                w[at] -= RATE * step / np.sqrt(grown[at])
                bias -= 0.02 / (1 + epoch) * g
        return w, bias

    trust = np.ones(code.shape[1])
    if code.shape[1]:
        if left_out.any():
            w, bias = descend(np.flatnonzero(~left_out))
            hit = np.zeros(code.shape[1])
            for k in np.flatnonzero(left_out):
                at, x = seen[k]
                hit += want[k] * (x @ w[at] + bias) > 0
            trust = np.maximum(1e-3, 2 * hit / left_out.sum() - 1)
            trust *= len(trust) / trust.sum()
        w, bias = descend(np.arange(len(seen)))
    else:
        w, bias = np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
    held = io.BytesIO()
    np.savez_compressed(held, w=w.astype(np.float32), bias=bias, code=code, trust=trust, names=np.array(languages, object).astype(str))
    return held.getvalue()


def predictor(model: bytes) -> Callable[[str | None], tuple[str, float, str | None, bool]]:
    """Text to (language, score, second language, whether it is ambiguous)."""
    m = np.load(io.BytesIO(model))
    w, bias, code, trust, names = m["w"], m["bias"], m["code"].astype(np.float64), m["trust"], [str(x) for x in m["names"]]

    def predict(text: str | None) -> tuple[str, float, str | None, bool]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, None, False
        if len(names) == 1:
            return names[0], 1.0, None, False
        loss = (np.logaddexp(0.0, -code * bit_scores(text, w, bias)) * trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return names[first], float(p[first]), names[second], bool(p[first] - p[second] < MARGIN)

    return predict


def train(docs: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> bytes:
    """A fitted model. Languages are counted first, so that each gets the same share of ``rows``. Ids are told apart by a partial
    aggregate, so one that many rows have counts once, and the row number's limit applies before its shuffle (Spark's group
    limit), so a language that most rows have isn't gathered."""
    learnable = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    narrow = learnable.where(F.col("text").rlike("\\p{L}"))
    kinds = narrow.select("lang").distinct().count()
    each = max(4, rows // max(1, kinds))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = (
        learnable.select("lang", "doc_id").distinct().withColumn("_h", F.xxhash64("doc_id"))
        .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each)
        .select("doc_id", F.col("lang").alias("_lang"), "_h")
    )
    ids = chosen.collect() if kinds * each <= 50_000 else None
    if ids is not None:  # a checked bound, so the ids may be broadcast
        chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, chosen.schema))
    found = docs.select("doc_id", "lang", "text").join(chosen, "doc_id").where("lang = _lang and text is not null")
    sample = found.groupBy("_lang", "_h", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str]]:
            for b in batches:
                for t, lang in zip(b.column("text").to_pylist(), b.column("_lang").to_pylist(), strict=True):
                    if any(map(str.isalpha, t)):
                        yield t, lang

        yield pa.RecordBatch.from_arrays([pa.array([fit(rows())], pa.binary())], names=["model"])

    one = sample.repartition(1).sortWithinPartitions("_h", "doc_id", "text").select("text", "_lang")
    made = one.mapInArrow(run, "model binary").first()
    return bytes(made["model"]) if made else fit(iter(()))


def add_language(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with lang_pred, score, lang_second and ambiguous. Row-local; any columns pass through."""
    docs = clear_of(docs, "lang_pred", "score", "lang_second", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "lang_pred", "score", "lang_second", "ambiguous"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double, lang_second string, ambiguous boolean"
    kinds = [pa.string(), pa.float64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                said = [predict(t) for t in part.column("text").to_pylist()]
                new = [pa.array([s[k] for s in said], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return docs.mapInArrow(run, schema)
