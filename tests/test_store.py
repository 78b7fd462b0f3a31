"""The keyed store: inserts, updates, streams, and writers that are killed."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import store as st

SCHEMA = "k long, j string, v string, n long"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_inserts_and_updates(spark, tmp_path):
    """Null keys are equal, rows that come again are one, and a change without its row is passed over."""
    s = st.Store(spark, f"file://{tmp_path}/s", ["k", "j"], 8)
    with pytest.raises(ValueError, match="no version"):
        s.read()
    s.insert(frame(spark, [(1, "a", "x", 1), (1, "a", "x", 1), (2, None, "y", 2), (None, None, "z", 3)]))
    s.insert(frame(spark, [(1, "a", "other", 9), (2, None, "other", 9), (None, None, "other", 9), (3, "a", "w", 4)]))
    assert rows(s.read()) == sorted([(1, "a", "x", 1), (2, None, "y", 2), (None, None, "z", 3), (3, "a", "w", 4)], key=repr)
    s.update(spark.createDataFrame([(1, "a", "new", None), (None, None, None, 30), (7, "q", "none", 1)], SCHEMA), ["v", "n"])
    assert rows(s.read()) == sorted([(1, "a", "new", 1), (2, None, "y", 2), (None, None, "z", 30), (3, "a", "w", 4)], key=repr)
    assert len(rows(s.read(version=1))) == 3 and s.versions() == [1, 2, 3]
    s.vacuum(1)
    assert s.versions() == [3] and len(rows(s.read())) == 4
    with pytest.raises(ValueError, match="columns"):
        s.insert(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(ValueError, match="key"):
        st.Store(spark, s.path, ["k"], 8).read()
    s.insert(frame(spark, []))
    assert len(rows(s.read())) == 4


def test_a_writer_that_is_killed(spark, tmp_path, monkeypatch):
    """Before its version is named, nothing of it is seen; the same insert then goes through, and orphans are cleaned away."""
    s = st.Store(spark, f"file://{tmp_path}/s", ["k"], 4)
    s.insert(frame(spark, [(1, "a", "x", 1)]))
    with monkeypatch.context() as m:
        m.setattr(st.Store, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        for work in (lambda: s.insert(frame(spark, [(2, "b", "y", 2)])), lambda: s.update(frame(spark, [(1, "a", "lost", 5)]), ["v"])):
            with pytest.raises(KeyboardInterrupt):
                work()
    assert rows(s.read()) == [(1, "a", "x", 1)]
    s.insert(frame(spark, [(2, "b", "y", 2)]))
    assert rows(s.read()) == [(1, "a", "x", 1), (2, "b", "y", 2)]
    folders = len(list((tmp_path / "s" / "data").iterdir()))
    s.vacuum()
    assert len(list((tmp_path / "s" / "data").iterdir())) == folders - 2 and len(rows(s.read())) == 2


def test_of_two_writers_one_fails(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s", ["k"], 4)
    s.insert(frame(spark, [(1, "a", "x", 1)]))
    last = s._version()
    s.insert(frame(spark, [(2, "a", "x", 1)]))
    with pytest.raises(Exception, match="exist"):
        s._commit(last, s.read().schema, last["parts"], {})
    assert len(rows(s.read())) == 2


def test_a_batch_reads_the_parts_of_its_keys(spark, tmp_path):
    """However much is stored, a row's insert looks at one part."""
    s = st.Store(spark, f"file://{tmp_path}/s", ["k"], 32)
    s.insert(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("j"), F.lit("v").alias("v"), F.col("id").alias("n")))
    one = frame(spark, [(5, "a", "b", 1)])
    touched = s._touched(one)
    assert len(touched) == 1 and len(s.read(buckets=touched).inputFiles()) == 1 and len(s.read().inputFiles()) == 32
    for i in range(2):
        key = next(k for k in range(3000 + 1000 * i, 4000 + 1000 * i) if s._touched(frame(spark, [(k, "a", "b", 1)])) == touched)
        s.insert(frame(spark, [(key, "a", "b", 1)]))
    assert s.read().count() == 2002 and len(s._version()["parts"][str(touched[0])]) == 3


def test_parts_of_many_folders_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "FOLDERS", 2)
    s = st.Store(spark, f"file://{tmp_path}/s", ["k"], 1)
    for i in range(4):
        s.insert(frame(spark, [(i, "a", "b", 1), (0, "a", "c", 1)]))
    assert rows(s.read().select("k", "v")) == [(i, "b") for i in range(4)] and len(s._version()["parts"]["0"]) == 2


def test_streamed_batches_are_put_in_once(spark, tmp_path):
    for part in ([(1, "a", "x", 1), (2, "a", "x", 1)], [(2, "a", "later", 2), (3, "a", "x", 1)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = st.Store(spark, f"file://{tmp_path}/s", ["k"], 4)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s.insert_stream(stream(), "feed", f"{tmp_path}/c").awaitTermination()
    assert rows(s.read().select("k")) == [(1,), (2,), (3,)]
    before = s.versions()
    s.insert(frame(spark, [(9, "a", "again", 1)]), "feed", 1)  # a batch that is run again
    s.insert_stream(stream(), "feed", f"{tmp_path}/c").awaitTermination()
    assert s.versions() == before and rows(s.read().select("k")) == [(1,), (2,), (3,)]
