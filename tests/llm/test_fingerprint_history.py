"""The index over several batches: what it keeps, what it writes, and what a second try of a batch gives."""

import os
import shutil

import numpy as np
import pytest

from corpusmill.llm import substring_dedup

TEXTS = ["a b c d e f g h", "x a b c d y", "f g h i j k l", "g h i j x a b c", "new words only in here"]


@pytest.fixture
def index(spark, tmp_path):
    return substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", window=4, buckets=3)


def batch(spark, *numbers):
    return spark.createDataFrame([(i, TEXTS[i]) for i in numbers], "doc_id long, text string")


def removed(df):
    return {r.doc_id: r.n_removed for r in df.collect()}


def files(index):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(index.store.path.removeprefix("file://")) for f in names}


def test_history_is_required(spark, index):
    assert removed(index.add(batch(spark, 0), "a")) == {0: 0}
    with pytest.raises(ValueError, match="history"):
        index.add(batch(spark, 1), "b")
    assert removed(index.add(batch(spark, 1), "b", batch(spark, 0))) == {1: 4}


def test_a_second_try_replaces_its_run(spark, index):
    first = index.add(batch(spark, 0, 1), "a")  # never read: the job dies here
    again = index.add(batch(spark, 0, 1), "a")
    assert removed(again) == removed(first) == {0: 0, 1: 4}
    index.add(batch(spark, 2), "b", batch(spark, 0, 1))
    assert removed(index.add(batch(spark, 3, 4), "b", batch(spark, 0, 1))) == {3: 4, 4: 0}, "the run of the first try is gone"
    with pytest.raises(ValueError, match="later"):
        index.add(batch(spark, 0, 1), "a", batch(spark, 3, 4))


def test_a_run_that_was_not_finished_does_not_count(spark, index):
    index.add(batch(spark, 0), "a")
    index.match(batch(spark, 1), "b")
    os.remove(f"{index.store.folder(index.runs()[-1][2]).removeprefix('file://')}/_SUCCESS")
    assert [r[:2] for r in index.runs()] == [(0, 0)]
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, index.path, window=5, buckets=3)


def test_runs_are_sorted_and_a_batch_writes_its_own_alone(spark, index):
    index.match(batch(spark, 0, 1), "a")
    before = files(index)
    index.match(batch(spark, 2, 3), "b")
    after = files(index)
    assert before.items() <= after.items() and all("part=000001" in f for f in after.keys() - before.keys())
    seen = []
    with index.store.read([r[2] for r in index.runs()]) as lists:
        lists = lists.filter("kind = 0").collect()
    for r in lists:
        f = substring_dedup._fingerprints(r.fingerprints)
        assert (f[1:] > f[:-1]).all()
        doc, start = substring_dedup._places_of(r.places, substring_dedup._spots(r.spots))
        seen += zip(f.tolist(), doc.tolist(), start.tolist(), strict=True)
    assert len({f for f, _, _ in seen}) == len(seen), "one place a fingerprint in all runs"
    assert sorted((d, s) for _, d, s in seen) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]


def test_the_history_is_not_shuffled(spark, index):
    index.match(batch(spark, 0), "a")
    with index.store.read([index.runs()[0][2]]) as lists:
        plan = lists.groupBy("bucket").applyInArrow(substring_dedup._compact, substring_dedup._RUNS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", window=4, buckets=3, fanout=2)
    index.match(batch(spark, 0), "a")
    index.match(batch(spark, 1), "b")
    copy = f"{tmp_path}/copy"
    shutil.copytree(index.store.path.removeprefix("file://"), copy)
    index.match(batch(spark, 2), "c")
    assert [r[:2] for r in index.runs()] == [(0, 1), (2, 2)]
    shutil.copytree(copy, index.store.path.removeprefix("file://"), dirs_exist_ok=True)  # the old runs, not deleted yet
    assert [r[:2] for r in index.runs()] == [(0, 1), (2, 2)]
    history = batch(spark, 0, 1, 2)
    assert removed(index.add(batch(spark, 3), "d", history)) == {3: 8}
    assert np.all([r[0] <= r[1] for r in index.runs()])
