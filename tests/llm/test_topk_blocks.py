"""Top-k over several blocks of candidates and of queries, what is read of the lists, and values that don't fit."""

import numpy as np
import pytest

from corpusmill.llm import topk


def brute(ids, x, owns, k):
    out = {}
    for own in owns:
        scores = sorted((-int(x[j] @ x[np.flatnonzero(ids == own)[0]]), int(i)) for j, i in enumerate(ids) if i != own)
        out[own] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize(("block", "queries"), [(64, 3), (1000, 2), (7, 4096)])
def test_several_blocks(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 12))
    x[100:140] = x[99] + rng.normal(size=(40, 12)) / 50
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    found = topk.top_k(vectors, vectors.filter("vec_id % 70 = 0")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(x * 1024).astype(np.int64)
    assert got == brute(np.arange(700), whole, range(0, 700, 70), 10)


@pytest.mark.parametrize(("skew", "share"), [(True, 0.2), (False, 0.9)])
def test_reads_less_than_all(skew, share):
    """On vectors with a few large coordinates a query is done near the top of the lists, on even ones later."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    if skew:
        x *= 0.02
        x[np.arange(4000), rng.integers(0, 32, 4000)] += rng.choice([-1, 1], 4000)
    x = np.floor(1024 * x).astype(np.int64)
    block, own = topk.Block(np.arange(4000), x), np.arange(0, 4000, 100)
    found = block.search(own, x[own], 10, np.full(len(own), -np.inf))
    assert {int(q): list(zip(near.tolist(), score.tolist(), strict=True)) for q, (near, score) in zip(own, found, strict=True)} == brute(np.arange(4000), x, own, 10)
    assert 0 < block.read < share * x.size * len(own)


def test_values_that_pass_64_bits_are_an_error():
    x = np.full((3, 4), 1 << 31, np.int64)
    with pytest.raises(OverflowError):
        topk.Block(np.arange(3), x).search(np.array([0]), x[:1], 2, np.full(1, -np.inf))
    with pytest.raises(OverflowError):
        topk.whole([[1e18, 0.0]], 1024)
    assert topk.whole([[1e15, -0.5]], 1024)[0].tolist() == [1024 * 10**15, -512]
