"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased letter runs split at white space and stripped of punctuation (Arrow's rules, in training and scoring
alike); features are words, word pairs and pairs with one word between, hashed into 2 ** BITS weights. Training is follow-the-regularised-leader with a rate of its
own for every coordinate and L1, so most weights are exactly 0 and the rest are a small broadcast. It runs on the driver
over at most `rows` labelled documents (those of least hashed id, half of them toxic where there are enough), whose
features executors compute; scoring covers every document.

Defined cases: a null text scores as an empty one, by the bias alone; a text's score depends on its words only, so
repeated rows get equal scores; a null doc_id is held out of training; contradictory labels of an id count as toxic; of
rows that share a labelled id the one of least text is learned from, so the sample is bounded in rows; without labels every
score is 0.5 by the zero weights; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm.common import GOLDEN, U64, WordIds, documents, kept, map_arrow, mix, text_blocks, text_or_empty

BITS = 20
#: Labelled documents that training may use, each with all its features.
ROWS = 4000
#: Bytes of text scored at once.
BLOCK = 2 << 20
_STRIP = " .,;:!?\"'()[]{}<>|*#$%&-_/\\+=~`@^"
_words = kept(WordIds())


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts one after another, and the row of each; only distinct words become Python strings."""
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words = pc.utf8_trim(split.flatten(), characters=_STRIP)
    parents = pc.list_parent_indices(split).to_numpy()
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known = _words.hashes(distinct)[coded.indices.to_numpy()] if distinct else np.zeros(0, U64)
    some = pc.not_equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)
    flat, rows = known[some], parents[some].astype(np.int64)
    near, far = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    pair = mix(flat[:-1] * GOLDEN + flat[1:])[near]
    skip = mix(flat[:-2] * GOLDEN + flat[2:] + U64(1))[far]
    every = np.concatenate([mix(flat), pair, skip]) >> U64(64 - BITS)
    return every.astype(np.int64), np.concatenate([rows, rows[:-1][near], rows[:-2][far]])


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013), for binary features."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        error = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        self.z[at] += error - (np.sqrt(self.n[at] + error * error) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += error * error
        self.bias_z += error - ((self.bias_n + error * error) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += error * error


@dataclass(frozen=True)
class Model:
    """The non-zero weights."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        every, rows = features(texts)
        held = dense[every] != 0  # most features weigh nothing
        pairs = np.unique(rows[held] * (1 << BITS) + every[held])  # a feature counts once
        rows, every = pairs >> BITS, pairs & ((1 << BITS) - 1)
        total = np.bincount(rows, dense[every], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> list[tuple[int, np.ndarray]]:
    """(label, distinct features) of at most `rows` documents, one for each id: half of each label at most, of least hashed id."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = known.where("label = 1").orderBy(*order).limit(rows // 2).unionByName(known.where("label = 0").orderBy(*order).limit(rows // 2))
    held = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")
    chosen = held.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, row = features(batch.column("text"))
        pairs = np.unique(row * (1 << BITS) + every)
        bounds = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
        out = [(pairs[a:b] & ((1 << BITS) - 1)).astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "label", "at"])

    got = map_arrow(chosen, of_batch, "doc_id long, label int, at binary").collect()
    got.sort(key=lambda r: (int(mix(np.array([r["doc_id"] & (2**63 - 1)], U64))[0]), r["at"]))
    return [(r["label"], np.frombuffer(r["at"], "<i4")) for r in got]


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, epochs: int = 25, l1_of_root: float = 0.32, **how: float) -> Model:
    """Weights learned from at most `rows` labelled documents (a bounded sample, with all features of each).

    L1 grows with the root of the sample, as the noise of the sums that it bounds does.
    """
    sample = training_rows(docs, labels, rows)
    model = Ftrl(l1=l1_of_root * len(sample) ** 0.5, **how)
    for _ in range(epochs):
        for label, at in sample:
            model.learn(at, label)
    if not sample:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return Model(at, w[at], model.bias())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of every document; the broadcast is at most 2 ** BITS weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        if not dense:
            dense.append(np.zeros(1 << BITS))
            dense[0][model.at] = model.weight
        out = [model.scores(texts, dense[0]) for _, texts in text_blocks(batch.column("text"), BLOCK)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(np.concatenate(out))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", text_or_empty().alias("text"), held_out().alias("held_out"))
    return map_arrow(rows, of_batch, "doc_id long, held_out boolean, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
