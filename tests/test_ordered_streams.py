"""Streams whose rows come out of order, against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import windows
from corpusmill.streaming import scans

SCHEMA = "g string, ts timestamp, i long, d double"


@pytest.fixture
def rocks(spark):
    spark.conf.set(scans._STORE, scans._ROCKS)
    yield spark
    spark.conf.unset(scans._STORE)


def written(spark, folder, batches):
    """One file a micro-batch; a file's time of change gives the order."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n}")
    (folder / "in").mkdir()
    for n in range(len(batches)):
        part = next((folder / f"b{n}").glob("part-*.parquet"))
        target = folder / "in" / f"{n:03d}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + 10 * n, 1_700_000_000 + 10 * n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def shuffled(n, groups, seed):
    """Rows in order of time but for shifts of up to five minutes; a last row far ahead in each group lets all others out."""
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(f"g{i % groups}", start + datetime.timedelta(seconds=20 * (i // 2)), i, float(rng.randint(1, 9))) for i in range(n)]
    order = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 290)))
    batches = [order[i : i + 25] for i in range(0, n, 25)]
    last = [(f"g{k}", start + datetime.timedelta(days=2), 10_000 + k, 1.0) for k in range(groups)]
    return rows, [*batches, last, [(g, t + datetime.timedelta(days=1), i, d) for g, t, i, d in last]]


def test_rows_out_of_order_give_the_batch_operators_rows(rocks, tmp_path):
    rows, batches = shuffled(150, 3, 1)
    stream = written(rocks, tmp_path, batches)
    whole = rocks.createDataFrame(rows, SCHEMA)
    offsets = run(scans.running_offset_stream(stream, "g", "i", "d", "ts"), "held_offsets", tmp_path).filter("i < 10000").select("g", "i", "offset").collect()
    wanted = windows.running_offset(whole, "g", ["ts", "i"], "d").select("g", "i", F.col("offset").cast("double")).collect()
    assert sorted(map(tuple, offsets)) == sorted(map(tuple, wanted)) and len(offsets) == 150
    buckets = run(scans.threshold_bucket_stream(stream, "g", "i", "d", 30.0, "ts"), "held_buckets", tmp_path).filter("i < 10000").select("g", "i", "bucket").collect()
    wanted = windows.threshold_buckets(whole, "g", ["ts", "i"], "d", 30.0).select("g", "i", F.col("bucket").cast("double")).collect()
    assert sorted(map(tuple, buckets)) == sorted(map(tuple, wanted))


def test_rows_past_the_watermark_are_left_out(rocks, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda minutes, i, d: ("g", start + datetime.timedelta(minutes=minutes), i, d)
    batches = [[at(0, 1, 1.0), at(30, 3, 4.0)], [at(25, 2, 2.0)], [at(5, 9, 100.0)], [at(600, 4, 8.0)], [at(700, 5, 1.0)]]
    stream = written(rocks, tmp_path, batches)
    found = run(scans.running_offset_stream(stream, "g", "i", "d", "ts"), "late_offsets", tmp_path).filter("i < 4").orderBy("i").collect()
    assert [(r.i, r.offset) for r in found] == [(1, 0.0), (2, 1.0), (3, 3.0)]


def test_another_state_store_is_refused(spark, tmp_path):
    stream = written(spark, tmp_path, [[("g", datetime.datetime(2024, 1, 1), 1, 1.0)]])
    with pytest.raises(ValueError, match="state store"):
        scans.running_offset_stream(stream, "g", "i", "d", "ts")


def test_chunks_parted_by_silence(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [("g", start + datetime.timedelta(seconds=s), i, 1.0) for i, s in enumerate((0, 10, 20, 100, 110, 9000))]
    stream = written(spark, tmp_path, [rows, [("g", start + datetime.timedelta(days=1), 9, 1.0)], [("g", start + datetime.timedelta(days=2), 9, 1.0)]])
    found = run(scans.silence_chunks(stream, "g", "ts", "30 seconds"), "chunks", tmp_path).orderBy("start").collect()
    assert [r.n for r in found][:3] == [3, 2, 1]
    assert found[0].start.replace(tzinfo=datetime.timezone.utc).timestamp() == start.timestamp()


def test_buckets_in_order_of_arrival(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("g", start, i, 2.0) for i in range(10)]
    found = run(scans.threshold_bucket_stream(written(spark, tmp_path, [rows[:5], rows[5:]]), "g", "i", "d", 5.0), "plain_buckets", tmp_path).orderBy("i").collect()
    assert [r.bucket for r in found] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]
