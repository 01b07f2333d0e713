"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are the relative frequencies of its hashed n-grams in four views: lower-cased words, pairs of them,
and single, paired and triple shapes of words (runs of small letters, capitals, digits, and each other sign); a word
equal to the one before it, or two or three before, counts as an n-gram of its own. A score is one sparse dot product
with a weight vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._bytes import LOWER, NOT_SPACE, mixed, slices, word_hashes, words
from tallyline.llm._frames import short_batches, table, written

#: Slots of the weight vector; 1 MB.
SLOTS = 1 << 18
#: Labelled rows that training takes at most, by a hash of their id: a bounded sample.
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and owners (texts) of all n-grams; a text's values of one view sum to 1."""
    s, e, o = words(buf, offsets, NOT_SPACE)
    n = len(s)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(o))
    low = word_hashes(LOWER[buf], s, e)
    shape = _SHAPE[buf]
    new = np.ones(len(buf), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[s] = True
    at = np.concatenate([[0], np.cumsum(new)])
    forms = word_hashes(shape[new], at[s], at[e])
    size = np.maximum(np.diff(o), 1)
    slots, owners = [], []

    def view(k: int, h: np.ndarray, width: int) -> None:
        ok = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
        x = np.full(len(ok), k, np.uint64)
        for j in range(width):
            x = mixed(x ^ h[ok + j])
        slots.append((x % np.uint64(SLOTS)).astype(np.int32))
        owners.append(doc[ok])

    view(1, low, 1)
    view(2, low, 2)
    for k in (1, 2, 3):
        view(2 + k, forms, k)
    for back in (1, 2, 3):
        ok = np.flatnonzero((doc[: n - back] == doc[back:]) & (low[: n - back] == low[back:])) if n > back else np.zeros(0, np.int64)
        slots.append(np.full(len(ok), back, np.int32))
        owners.append(doc[ok])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    return slots, 1 / size[owners], owners


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last slot holds the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z, buf, offsets in slices(batch.column("text")):
            slots, values, owners = features(buf, offsets)
            key, back = np.unique(owners.astype(np.int64) * SLOTS + slots, return_inverse=True)
            x = np.bincount(back, values, len(key)).astype("<f4")
            i = (key % SLOTS).astype("<i4")
            at = np.searchsorted(key, np.arange(z - a + 1) * SLOTS).tolist()
            rows = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("h").slice(a, z - a), batch.column("y").slice(a, z - a), pa.array([i[p:q].tobytes() for p, q in rows], pa.binary()), pa.array([x[p:q].tobytes() for p, q in rows], pa.binary())], ["h", "y", "i", "x"])


def train(labelled: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from labelled rows (h: a hash that orders them, y: 0 or 1, text); the bias is the last.

    Examples stream to the learner one partition at a time, in the order of their hash; reruns agree.
    """
    rows = written(labelled.mapInArrow(_examples, "h long, y double, i binary, x binary"))
    model = Ftrl()
    for _ in range(epochs):
        for r in rows.orderBy("h", "y", "i").toLocalIterator():
            i = np.append(np.frombuffer(r["i"], "<i4"), SLOTS)
            model.learn(i, np.append(np.frombuffer(r["x"], "<f4"), 1.0).astype(np.float64), r["y"])
    return model.weights(slice(None)).astype(np.float32)


def scorer(weights: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for a, z, buf, offsets in slices(batch.column("text")):
                slots, values, owners = features(buf, offsets)
                dot = np.bincount(owners, w[slots] * values, z - a) + float(w[-1])
                score = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("held_out").slice(a, z - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted.

    Learns from the labels of rows that are not held out, at most `sample` of them, chosen by a hash of their id.
    Several labels of an id count by their mean, null labels and ids not at all; without any label every score is
    0.5. Null and empty texts are scored by the bias. Repeated rows are scored alike; an empty table gives an empty
    result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("k")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    ids = docs.filter(~F.col("held_out")).select("doc_id").join(known, F.col("doc_id") == F.col("k")).select("k", "y", F.xxhash64("k").alias("h"))
    chosen = ids.orderBy("h", "k").limit(sample)  # at most `sample` short rows
    weights = spark.sparkContext.broadcast(train(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("h", "y", "text")))
    return docs.mapInArrow(scorer(weights), "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
