"""Toxicity of whole texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, pairs of neighbours, pairs with one or two words between, and the
words' stems (their first letters, so that endings do not hide a word), each counted once. Every coordinate has its own learning rate, and the L1 term keeps most weights at zero, so the
model is a short list that goes to every task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.llm import chars

#: Distances between the words of a feature: single words, neighbours, and skips.
GRAMS = ((0,), (0, 1), (0, 2), (0, 3))
STEM = 5


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are learnt from, and so the learner's memory."""

    bits: int = 20
    sample: int = 16_384
    epochs: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1


@dataclass
class Model:
    """Slots with weights other than zero, and the constant."""

    slots: np.ndarray
    weights: np.ndarray
    constant: float
    bits: int


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of all features, with repetitions."""
    w = chars.words(texts, STEM)
    text, slot = [w.text], [chars.mixed(w.stem) >> np.uint64(64 - bits)]
    for steps in GRAMS:
        hashed, at = chars.windows_hash(w.hash, w.text, steps)
        text.append(w.text[at])
        slot.append(hashed >> np.uint64(64 - bits))
    return np.concatenate(text), np.concatenate(slot).astype(np.int64)


def learn(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Each row: the slots of one text, each once. The last slot of the state is the constant, without L1."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, s.l1)
    l1[size] = 0

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for slots, label in zip(rows, labels):
            at = np.append(slots, size)
            w = weights(at)
            gradient = _sigmoid(w.sum()) - label
            rate = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / s.alpha
            z[at] += gradient - rate * w
            n[at] += gradient**2
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:size])
    return Model(kept, w[kept], float(w[size]), s.bits)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def score(texts, model: Model) -> np.ndarray:
    dense = np.zeros(1 << model.bits)
    dense[model.slots] = model.weights
    out = []
    for _, some in chars.chunks(texts):
        text, slot = features(some, model.bits)
        weighty = np.flatnonzero(dense[slot])
        pairs = np.unique(text[weighty] << model.bits | slot[weighty])
        sums = np.bincount(pairs >> model.bits, dense[pairs & ((1 << model.bits) - 1)], len(some))
        out.append(_sigmoid(model.constant + sums))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Of the labelled ids the ``settings.sample`` with the least hash are learnt from, in that order, in one
    task. Ids or labels that are null are left out; of several labels of one id the greatest holds. A null
    text counts as empty. Without any label all scores are one half.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    chosen = usable.orderBy("turn", "doc_id").limit(settings.sample)  # its bound allows the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("turn", "doc_id", "text", "toxic")

    def slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, some in chars.chunks(part.column(2)):
                text, slot = features(some, settings.bits)
                pairs = np.unique(text << settings.bits | slot)
                cuts = np.searchsorted(pairs >> settings.bits, np.arange(len(some) + 1))
                found = (pairs & ((1 << settings.bits) - 1)).astype("<u4")
                packed = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                keep = [part.column(i).slice(at, len(some)) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(packed, pa.binary())], names=["turn", "doc_id", "toxic", "slots"])

    def fitted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, rows, labels = [], [], []
        for part in parts:
            order += zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            labels += part.column(2).to_pylist()
            rows += [np.frombuffer(x, "<u4") for x in chars.values(part.column(3))]
        by_turn = sorted(range(len(rows)), key=lambda i: (order[i], labels[i], zlib.crc32(rows[i])))
        model = learn([rows[i] for i in by_turn], np.array([labels[i] for i in by_turn], float), settings)
        columns = [pa.array([model.slots.astype("<i8").tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.constant])]
        yield pa.RecordBatch.from_arrays(columns, names=["slots", "weights", "constant"])

    made = rows.mapInArrow(slots, "turn long, doc_id long, toxic int, slots binary")
    found = made.repartition(1).mapInArrow(fitted, "slots binary, weights binary, constant double").first()
    if found is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, settings.bits)
    return Model(np.frombuffer(found.slots, "<i8"), np.frombuffer(found.weights, "<f8"), found.constant, settings.bits)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1; a null text counts as empty. A column of that name is replaced."""
    kept = df.drop("score")
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = score(part.column(place), model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[f.name for f in schema])

    return kept.mapInArrow(batches, schema)
