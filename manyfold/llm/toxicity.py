"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence flags of words, word pairs and pairs that skip a word, hashed to
2 ** BITS coordinates. Learning is one online pass per epoch with per-coordinate rates; the L1
term keeps coordinates at zero until their evidence exceeds it, so that the weights that remain
are few: they are collected, their number is checked, and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import quoted, ship, stage, with_batch_column
from ._words import PUNCTUATION, Words, chunks, pair

BITS = 22
#: At most so many labelled rows are learned from: those with the smallest hash of their identifier.
TRAIN_ROWS = 20_000
#: More weights than this aren't broadcast; then the L1 term is too small.
MOST_WEIGHTS = 500_000
#: The rate and the L1 term, chosen on an inner fold of the training rows (see the README).
ALPHA, L1 = 3.0, 8.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of each n-gram, repeats included."""
    h, t = words.hash, words.text
    two, skip = t[1:] == t[:-1], t[2:] == t[:-2]
    with np.errstate(over="ignore"):
        grams = np.concatenate((h, pair(h[:-1], h[1:], 2)[two], pair(h[:-2], h[2:], 3)[skip]))
    return np.concatenate((t, t[:-1][two], t[:-2][skip])), (grams >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """McMahan's FTRL-proximal, one example at a time, for presence features and a bias at 2 ** BITS."""

    def __init__(self, alpha: float = ALPHA, beta: float = 1.0, l1: float = L1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most: int = TRAIN_ROWS, epochs: int = 3, seed: int = 11, alpha: float = ALPHA, l1: float = L1
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates (ascending), their weights, and the bias, from the labelled rows of ``docs``.

    Of the labelled rows, ``most`` with the smallest hash of their identifier are used: a sample
    of bounded size. Rows without text, label or identifier teach nothing. With no labelled row at
    all, there are no weights and the bias is 0.
    """
    spark = docs.sparkSession
    ship(spark)
    some = labels.select(quoted(id_col).cast("long").alias("i"), quoted(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    some = some.groupBy("i").agg(F.max("y").alias("y")).withColumn("r", F.xxhash64("i", F.lit(seed))).orderBy("r", "i").limit(most)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, r, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for s in chunks(texts):
                w = Words(texts[s], PUNCTUATION)
                t, c = features(w)
                both = np.unique(t << (BITS + 1) | c)
                t, c = both >> (BITS + 1), (both & ((2 << BITS) - 1)).astype("<u4")
                cut = np.searchsorted(t, np.arange(s.stop - s.start + 1))
                yield pa.RecordBatch.from_pydict({"y": y.slice(s.start, s.stop - s.start), "r": r.slice(s.start, s.stop - s.start), "c": pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(alpha, l1=l1), []
        for batch in batches:
            for y, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((y, np.frombuffer(c, dtype="<u4")))
        for _ in range(epochs):
            for y, c in rows:
                model.learn(c.astype(np.int64), y)
        at = np.append(np.flatnonzero(np.abs(model.z[:-1]) > model.l1), 1 << BITS)
        yield pa.RecordBatch.from_pydict({"c": pa.array(at, pa.int64()), "w": pa.array(model.weights(at), pa.float64())})

    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("t")).where("t is not null")
    # the sample's size is bounded by ``most``
    rows = texts.join(F.broadcast(some), F.col("doc_id") == F.col("i")).select("y", "r", "t")
    rows = stage(spark, rows.mapInArrow(featured, "y int, r long, c binary"), "toxic-features")
    got = rows.repartition(1).sortWithinPartitions("r", F.xxhash64("c")).select("y", "c").mapInArrow(learned, "c long, w double")
    got = got.orderBy("c").limit(MOST_WEIGHTS + 2).toPandas()
    if len(got) > MOST_WEIGHTS + 1:
        raise ValueError("too many weights to broadcast; raise the L1 term")
    bias = got.loc[got["c"] == 1 << BITS, "w"].sum()
    got = got[got["c"] < 1 << BITS]
    return got["c"].to_numpy(), got["w"].to_numpy(), float(bias)


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability of toxicity from the whole text. A null
    text scores as an empty one. A column of that name that is there already is replaced."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.select(*(quoted(c) for c in docs.columns if c != name))
    at = docs.columns.index(text_col)

    def make() -> Callable[[pa.RecordBatch], pa.Array]:
        coords, weights, bias = sent.value
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[coords] = weights

        def scores(batch: pa.RecordBatch) -> pa.Array:
            texts = batch.column(at).to_pylist()
            logit = np.full(len(texts), bias)
            for s in chunks(texts):
                t, c = features(Words(texts[s], PUNCTUATION))
                hit = dense[c] != 0
                both = np.unique(t[hit] << (BITS + 1) | c[hit])
                np.add.at(logit, s.start + (both >> (BITS + 1)), dense[both & ((2 << BITS) - 1)])
            return pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))

        return scores

    return with_batch_column(docs, name, T.DoubleType(), make)
