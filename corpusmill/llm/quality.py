"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: its words and pairs of neighbouring words, and the same for the words' shapes (letters as ``a`` or
``A``, digits as ``0``, runs as one, other characters as they are), so that a habit of writing counts in words never seen.
Values are square roots of shares, which makes texts of any length comparable.

Edge cases (tested): null and empty texts have no feature and score by the bias alone; a null doc_id is scored, is not
held out and is never learnt from; rows that repeat are each scored; without labelled rows all scores are 0.5; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, ftrl

SETTINGS = ftrl.Settings(bits=20, alpha=0.3, l1=0.3, l2=0.1, epochs=3, train_rows=8000, presence=False)

_SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def _shapes(text: bytes) -> list[bytes]:
    out = text.translate(_SHAPES)
    for c in (b"a", b"A", b"0"):
        for n in (16, 4, 2, 2):
            while c * n in out and n > 2:
                out = out.replace(c * n, c)
            out = out.replace(c * 2, c)
        while c * 2 in out:
            out = out.replace(c * 2, c)
    return out.split()


def _grams(words: list[bytes], seed: int) -> list[np.ndarray]:
    h = np.fromiter(map(crc32, words), np.uint32, len(words)) * np.uint32(2 * seed + 1)
    h ^= h >> np.uint32(15)
    return [h, (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA6B) + np.uint32(seed))]


def features(text: bytes) -> np.ndarray:
    out = np.concatenate(_grams(text.split(), 1) + _grams(_shapes(text), 2))
    return out ^ (out >> np.uint32(13))


def learn_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, settings: ftrl.Settings = SETTINGS) -> ftrl.Model:
    """Learn from the rows of ``docs`` that ``labels`` marks; ids with crc32 mod ``folds`` = ``held_out`` are not learnt from."""
    return ftrl.train(docs, labels, "quality", common.crc_remainder("doc_id", folds) != held_out, features, settings)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, settings: ftrl.Settings = SETTINGS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, by a model that learns from the rows not held out."""
    return ftrl.scored(docs, learn_quality(docs, labels, folds, held_out, settings), features).select(
        "doc_id",
        F.coalesce(common.crc_remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
