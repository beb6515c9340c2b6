"""Toxicity scores: FTRL-proximal logistic regression over hashed words, n-grams and skip-grams.

A text's features are the hashes of its words, of their first four and five letters, of pairs of
neighbours and of pairs one word apart, each counted once. Weights are learned with a rate of its
own for each coordinate; the L1 term leaves most at exactly zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, share_of

BITS = 20
TRAINING_ROWS = 16_000  # expected number of labelled rows that the weights are fitted on
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 8.0, 0.1, 4
CACHED_WORDS = 200_000
STRIPPED = ".,;:!?\"'()[]{}<>*#$%&-_/\\|+=~`"


class Features:
    """Hashed features of texts; keeps the hashes of recent words."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}
        self.hashes = np.zeros((CACHED_WORDS, 3), dtype=np.uint64)

    def add(self, raw: str) -> int:
        if len(self.known) >= CACHED_WORDS:
            raise OverflowError
        word = raw.strip(STRIPPED) or raw
        k = self.known[raw] = len(self.known)
        self.hashes[k] = [zlib.crc32(part.encode("utf-8", "replace")) for part in (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}")]
        return k

    def part(self, words: list[str]) -> np.ndarray:
        known, add = self.known, self.add
        try:
            ids = [known[w] if w in known else add(w) for w in words]
        except OverflowError:
            known.clear()
            ids = [known[w] if w in known else add(w) for w in words]
        return self.hashes[ids]

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        step = CACHED_WORDS // 2  # a long text goes through the cache in parts
        rows = [self.part(words[k : k + step]) for k in range(0, len(words), step)]
        if not rows:
            return np.zeros(0, dtype=np.int64)
        h = np.concatenate(rows)
        w = h[:, 0]
        mix = np.uint64(0x9E3779B97F4A7C15)
        pairs = [(w[:-gap] * mix + w[gap:] * np.uint64(2 * gap + 1)) * mix >> np.uint64(32) for gap in (1, 2)]
        return np.unique((np.concatenate([h.ravel(), *pairs]) & self.mask).astype(np.int64))


def learn(rows: list[tuple[int, np.ndarray]], bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias after PASSES over (label, features); the bias is a coordinate without L1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    penalty = np.full((1 << bits) + 1, L1)
    penalty[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0, (np.sign(zi) * penalty[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for label, features in rows:
            i = np.append(features, 1 << bits)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / ALPHA * w
            n[i] += g * g
    final = weights(np.arange((1 << bits) + 1))
    return final[:-1], float(final[-1])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights (2^bits) and bias from about `rows` labelled documents that are not held out.

    The rows are chosen by a hash of doc_id, their features are made where the texts are, and these
    bounded rows go to one task that learns from them in the order of that hash. Without labelled rows all weights are zero.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.filter(share_of(["doc_id"], rows, labels.count()))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", F.lit("order")).alias("place"), "toxic", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in batches:
            features = pa.array([make.of(t).astype(np.int32) for t in batch.column(2).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], names=["place", "toxic", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            found += [(p, y, flat[a:b].copy()) for p, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True)]
        found.sort(key=lambda row: (row[0], row[1], row[2].tobytes()))
        weights, bias = learn([(y, f.astype(np.int64)) for _, y, f in found], bits) if found else (np.zeros(1 << bits), 0.0)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(weights[at], bias))], names=["at", "weight"])

    bounded_batches(docs.sparkSession)
    made = joined.mapInArrow(featurize, "place long, toxic int, features array<int>")
    kept = made.repartition(1).mapInArrow(fit, "at long, weight double").collect()  # nonzero weights only, 2^bits at most
    weights, bias = np.zeros(1 << bits), 0.0
    for at, weight in kept:
        if at < 0:
            bias = weight
        else:
            weights[at] = weight
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """The columns of `docs` and `toxicity`, 0 to 1, from `text` alone.

    A null or empty text has the score of the bias. The broadcast weights are bounded by `bits`.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        make = Features(bits)
        for batch in batches:
            sums = [float(weights[make.of(t)].sum(dtype=np.float64)) + bias for t in batch.column(at).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "toxicity"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(apply, docs.drop("toxicity").schema.add("toxicity", "double"))
