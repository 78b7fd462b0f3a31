"""How texts become chunks of symbols: words cut in bulk, each different one hashed once, and packed without planes of zeros."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import common, suffix_tree_lm

ODD = [b" Ab\x0b c\xff\xc3D  e\n", b"", None, b" \t\n ", b"x\x00Y \xc2\xa0z", b"\xe2\x80\xa8q \x85 \x1f\x1c \x1e", b"one", b"\x0d\x0cTwo \xc3\x89\x09", None, b"a\x0ba A"]


class Task:
    """Stands for TaskContext outside Spark."""

    @staticmethod
    def get():
        return Task()

    def partitionId(self):
        return 3


def text_array(texts):
    """As Spark gives it: a string column, whose bytes nobody has checked."""
    return pa.array(texts, pa.binary()).view(pa.string())


def symbols(text):
    words = text.lower().split() if text else []
    return [*(common.hashed(words) << np.uint64(1)).tolist(), 1]


def chunks(texts, most, rows=4):
    """(ids, train, sizes, symbols) of the chunks, from batches of so many rows."""
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": text_array(texts), "train": pa.array([i % 3 > 0 for i in range(len(texts))])})
    out = []
    for batch in suffix_tree_lm._chunked(most, 1)(table.to_batches(max_chunksize=rows)):
        for data in batch.column("data").to_pylist():
            ids, own = pickle.loads(data)
            train, sizes, every, number = suffix_tree_lm._unpacked(own)
            out.append((ids, train.tolist(), sizes.tolist(), np.cumsum(every)[number].tolist()))
    return out


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_string(), pa.large_binary()])
def test_words_are_those_of_bytes_split(kind):
    made = pa.array(ODD, pa.large_binary() if kind in (pa.large_string(), pa.large_binary()) else pa.binary()).view(kind)
    for begin in range(len(ODD)):
        n, words = suffix_tree_lm.words_of(made.slice(begin))
        expected = [t.lower().split() if t else [] for t in ODD[begin:]]
        assert n.tolist() == [len(w) for w in expected]
        assert common.raw(words) == [w for e in expected for w in e]


@pytest.mark.parametrize(("most", "cut"), [(1, 1), (5, 1), (5, 30), (12, 7), (40, 1_000_000), (10_000, 50)])
def test_chunks_end_with_the_text_that_fills_them(monkeypatch, most, cut):
    monkeypatch.setattr(suffix_tree_lm, "TaskContext", Task)
    monkeypatch.setattr(suffix_tree_lm, "CUT_BYTES", cut, raising=False)
    rng = random.Random(most)
    texts = [*ODD, *(b" ".join(rng.choices([b"a", b"B", b"b", b"cc", b"\xff"], k=rng.randrange(9))) for _ in range(30)), b"w " * 90, None, b""]
    expected, full = [[]], 0
    for i, t in enumerate(texts):
        if full >= most:
            expected.append([])
            full = 0
        expected[-1].append(i)
        full += len(symbols(t))
    for rows in (1, 4, 100):
        found = chunks(texts, most, rows)
        assert [c[0] for c in found] == expected
        for ids, train, sizes, own in found:
            assert train == [i % 3 > 0 for i in ids]
            assert sizes == [len(symbols(texts[i])) for i in ids]
            assert own == [x for i in ids for x in symbols(texts[i])]


def test_a_word_is_hashed_once_in_texts_that_are_cut_together(monkeypatch):
    asked, hashed = [], common.hashed
    monkeypatch.setattr(suffix_tree_lm, "TaskContext", Task)
    monkeypatch.setattr(common, "hashed", lambda words: asked.append(len(words)) or hashed(words))
    found = suffix_tree_lm._chunked(1000, 1)(pa.table({"doc_id": list(range(60)), "text": ["the same five words again"] * 60, "train": [True] * 60}).to_batches())
    assert len(list(found)) == 1
    assert sum(asked) == 5


def test_planes_of_zeros_are_left_out():
    arrays = [np.arange(256, dtype=np.uint64), np.array([0, 1 << 63], np.uint64), np.array([70_000, 3], np.uint32), np.array([-5, 7], np.int16), np.array([0.5, np.inf]), np.array([True, False]), np.zeros(0, np.uint64), np.zeros(3, np.uint64), np.arange(10)[::2]]
    packed = suffix_tree_lm._packed(*arrays)
    assert [(a.dtype, a.tolist()) for a in suffix_tree_lm._unpacked(packed)] == [(a.dtype, a.tolist()) for a in arrays]
    few = pickle.loads(suffix_tree_lm._packed(arrays[0]))[1]
    assert len(suffix_tree_lm.zstandard.ZstdDecompressor().decompress(few)) == 256


def test_cuts_are_ranges_of_hashes():
    keys = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 5000, np.uint64))
    for buckets in (1, 3, 20, 777, 20_000):
        of = [(int(k) >> 32) * buckets >> 32 for k in keys]
        assert suffix_tree_lm._cuts(keys, buckets) == [(b, of.index(b), of.index(b) + of.count(b)) for b in sorted(set(of))]
    assert suffix_tree_lm._cuts(keys[:0], 4) == []
