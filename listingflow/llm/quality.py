"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features of a text are its words, word pairs, word shapes (letter case, digits and
punctuation with repeated signs collapsed), shape pairs and shape triples, hashed into
``DIMENSIONS`` weights; each family is averaged over the text, so length does not count.
Labelled texts are dealt to ``SHARDS`` tasks, each of which makes ``EPOCHS`` passes of
follow-the-regularised-leader updates; the weights are averaged and scoring is a sparse
dot product over whole texts.

Bound: the fit uses about ``sample`` labelled rows, chosen by a hash of their id.  Every
row is scored.  Defined results: null and empty texts score by the bias alone; labels
that are null or belong to no document are ignored, of several labels of a document the
smallest counts; without labels all scores are 0.5; equal texts score equally.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BITS = 18
DIMENSIONS = 1 << BITS
SHARDS, EPOCHS, SAMPLE = 6, 3, 12_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
SCALE = 8.0
THRESHOLD = 0.3

_SHAPES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
                for b in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _shapes(text: bytes) -> list[bytes]:
    mapped = np.frombuffer(text.translate(_SHAPES), np.uint8)
    keep = np.ones(len(mapped), bool)
    keep[1:] = mapped[1:] != mapped[:-1]
    return mapped[keep].tobytes().split()


def _grams(codes: np.ndarray, n: int, family: int) -> np.ndarray:
    """Weight indices of all runs of n words."""
    mixed = codes[: max(0, len(codes) - n + 1)] + np.uint64(family * 0x51ED27)
    for k in range(1, n):
        mixed = mixed * _STEP + codes[k: len(codes) - n + 1 + k]
    return ((mixed * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def families(text: bytes) -> list[np.ndarray]:
    words, shapes = _codes(text.split()), _codes(_shapes(text))
    return [_grams(words, 1, 1), _grams(words, 2, 2), _grams(shapes, 1, 3), _grams(shapes, 2, 4), _grams(shapes, 3, 5)]


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct weight indices of a text and their values."""
    found = [g for g in families(text) if len(g)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    index, at = np.unique(np.concatenate(found), return_inverse=True)
    return index, np.bincount(at, np.concatenate([np.full(len(g), SCALE / len(g)) for g in found]), len(index))


def margin(text: bytes, weights: np.ndarray) -> float:
    """Sparse dot product: the mean weight of each family of a text, and the bias."""
    return weights[-1] + SCALE * sum(weights[g].mean() for g in families(text) if len(g))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after ``epochs`` passes over the rows in their order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for (index, value), label in zip(rows, labels):
            index, value = np.append(index, DIMENSIONS), np.append(value, 1.0)
            w = weights(index)
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            old = n[index]
            new = old + gradient * gradient
            z[index] += gradient - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[index] = new
    return weights(np.arange(DIMENSIONS + 1))


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["place", "doc_id"])
    w = ftrl([sparse(t or b"") for t in rows.text], rows.quality.to_numpy(float))
    used = np.flatnonzero(w)
    return pd.DataFrame({"feature": used, "weight": w[used]})


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS) -> np.ndarray:
    """Averaged weights; at most DIMENSIONS + 1 numbers come to the driver."""
    marked = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    total = marked.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = (marked.withColumn("place", place).where(F.col("place") < int(min(1.0, sample / max(total, 1)) * (1 << 20)))
              .withColumn("shard", F.col("place") % shards))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    fitted = (rows.groupBy("shard").applyInPandas(_train_shard, "feature long, weight double")
              .groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))).toPandas()
    weights = np.zeros(DIMENSIONS + 1)
    weights[fitted.feature.to_numpy(np.int64)] = fitted.weight
    return weights


def scorer(spark, weights: np.ndarray):
    """A column function: score of a text column; the weights are a bounded broadcast."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in texts:
            z = np.array([margin(t or b"", w) for t in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return lambda text: score(text.cast("binary"))


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    score = scorer(docs.sparkSession, weights)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns as they were."""
    score = scorer(docs.sparkSession, weights)
    return (docs.select(F.struct("*").alias("row"), score(F.col("text")).alias("score"))
            .where(F.col("score") >= threshold).select("row.*"))
