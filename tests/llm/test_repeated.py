"""Repeated tokens in sorted rows, however the rows are cut into batches."""

import random
from collections import Counter

import pyarrow as pa

from corpusmill.llm import jaccard_join


def test_repeated_tokens_across_batches():
    rng = random.Random(4)
    for _ in range(200):
        tokens = sorted(rng.randrange(12) for _ in range(rng.randrange(14)))
        rows = [(t, i, -t) for i, t in enumerate(tokens)]
        batches, at = [], 0
        while at < len(rows) or rng.random() < 0.2:
            n = rng.randrange(4)
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + n]], pa.int64()) for k in range(3)], names=["token", "doc_id", "both"]))
            at += n
        got = [(r["token"], r["doc_id"], r["both"]) for b in jaccard_join._repeated(batches) for r in b.to_pylist()]
        n = Counter(tokens)
        assert got == [r for r in rows if n[r[0]] > 1]
