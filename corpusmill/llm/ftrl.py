"""Logistic regression over hashed features, trained with follow-the-regularised-leader (proximal) updates.

Each coordinate keeps its own accumulated gradient ``z`` and squared gradient ``n``; its weight is zero while ``|z|`` is at
most ``l1``, so that most coordinates never enter the model. One task trains on a bounded sample of the labelled rows; the
weights that are not zero (``2 ** bits`` at most) are broadcast, and every document is scored as a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common

#: A text as hashed features: an array of 32-bit hashes, repeats allowed, and their values' common scale.
Features = Callable[[bytes], np.ndarray]


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that the classifier learns from (a sample by hash of the id, one row an id)."""

    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    train_rows: int = 8000
    presence: bool = True


@dataclass(frozen=True)
class Model:
    """Weights by coordinate, in increasing order of coordinate; ``bias`` besides."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.settings.bits, np.float32)
        out[self.coordinates] = self.weights
        return out


def vector(hashes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values: presence, or the square root of the share of all features, times ten."""
    at, counts = np.unique(hashes & np.uint32((1 << s.bits) - 1), return_counts=True)
    return at, np.ones(len(at), np.float32) if s.presence else (10 * np.sqrt(counts / max(1, len(hashes)))).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> Model:
    """FTRL-proximal over ``rows`` in the order given. No rows give a model that scores 0.5."""
    z, n = np.zeros(1 << s.bits, np.float64), np.zeros(1 << s.bits, np.float64)
    bias, bias_n = 0.0, 0.0
    for _ in range(s.epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - y) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / s.alpha * w
            n[at] = grown
            bias_n += (p - y) ** 2
            bias -= (p - y) * s.alpha / (s.beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    at = np.flatnonzero(w)
    return Model(at, w[at].astype(np.float32), float(bias), s)


def sampled(labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """At most about ``rows`` labelled ids (doc_id, label), by hash of the id; several labels of one id count as their largest."""
    known = (
        common.plain(labels, "doc_id", label).filter(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    total = known.count()
    share = int(min(1.0, rows / max(1, total)) * 1_000_000)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, features: Features, s: Settings) -> Model:
    """Learn ``label`` (0 or 1) from the documents whose id meets ``keep``; texts alone are looked at."""
    chosen = sampled(labels, label, keep, s.train_rows)

    def vectors(it):
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])
        for ids, own, texts in common.column_batches(it, "doc_id", "label", "text"):
            rows = [vector(features(t or b""), s) for t in common.raw(texts)]
            yield pa.RecordBatch.from_arrays([ids, own, pa.array([a.astype(np.uint32).tobytes() for a, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], schema=schema)

    def fitted(it):
        got = []
        for columns in common.column_batches(it, "doc_id", "label", "at", "x"):
            got += zip(*(c.to_pylist() for c in columns), strict=True)
        got.sort(key=lambda r: (int(common.mixed(np.array([r[0]], np.int64).astype(np.uint64))[0]), r[1], r[2]))
        rows = [(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(x, np.float32)) for _, _, a, x in got]
        m = fit(rows, np.array([r[1] for r in got], np.float64), s)
        yield pa.RecordBatch.from_arrays([pa.array([m.coordinates.astype(np.uint32).tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], names=["at", "w", "bias"])

    # the sample is bounded by train_rows, so it may be broadcast, and one task may learn from it
    known = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = known.join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    # rows that share an id count as the one whose text has the least hash, so that train_rows bounds rows as well
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text", "label")).alias("row"))
    found = rows.select("doc_id", "row.label", "row.text").mapInArrow(vectors, "doc_id long, label int, at binary, x binary").repartition(1).mapInArrow(fitted, "at binary, w binary, bias double").first()
    return Model(np.frombuffer(bytes(found["at"]), np.uint32).astype(np.int64), np.frombuffer(bytes(found["w"]), np.float32), found["bias"], s)


def scored(docs: DataFrame, model: Model, features: Features) -> DataFrame:
    """doc_id, score (0 to 1) for every row; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        w = m.dense()
        mask = np.uint32((1 << m.settings.bits) - 1)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for ids, texts in common.column_batches(it, "doc_id", "text"):
            margins = []
            for text in common.raw(texts):
                at = features(text or b"") & mask
                hit = at[w[at] != 0]
                place, counts = np.unique(hit, return_counts=True)
                x = 1.0 if m.settings.presence else 10 * np.sqrt(counts / max(1, len(at)))
                margins.append(float((w[place] * x).sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(np.array(margins) + m.bias, -35, 35))))], schema=schema)

    known = common.plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return known.mapInArrow(run, "doc_id long, score double")
