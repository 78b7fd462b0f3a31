"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, with A-Z lowered. Features are words, their stems (the first 4 to 8 bytes of longer
words, so that inflected forms count that were never seen), pairs of neighbours, and pairs with one or two words between; each
counts once a text. Per-coordinate rates and the L1 term leave few weights, which are broadcast.

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

SETTINGS = ftrl.Settings(bits=22, alpha=1.0, l1=4.0, l2=0.1, epochs=5, train_rows=12_000, presence=True)

#: Bytes of the stems.
STEMS = (4, 5, 6, 7, 8)

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    words = text.translate(_WORDS).split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    out = [h]
    for gap in (1, 2, 3):
        a, b = h[:-gap], h[gap:]
        out.append((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(gap)))
    distinct = set(words)
    for n in STEMS:
        stems = {w[:n] for w in distinct if len(w) > n}
        out.append(np.fromiter((crc32(w, n) for w in stems), np.uint32, len(stems)))
    out = np.concatenate(out)
    return out ^ (out >> np.uint32(13))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, settings: ftrl.Settings = SETTINGS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; ids with crc32 mod ``folds`` = ``held_out`` are not learnt from."""
    model = ftrl.train(docs, labels, "toxic", common.crc_remainder("doc_id", folds) != held_out, features, settings)
    return ftrl.scored(docs, model, features).select(
        "doc_id",
        F.coalesce(common.crc_remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
