"""Speakers of recordings, meetings, tables and files, and the frames of speech."""

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import cluster, diarize, windows


def test_meetings_by_divides(spark):
    """A meeting's recordings add up to divides, each with speakers of its own; without divides it is clustered whole."""
    rng = np.random.default_rng(1)
    rows = [(m, f"w{i // 4}", i, 40.0, [float(v) for v in rng.normal(5 * (i % 2 + m), 0.1, 3)]) for m in (0, 1) for i in range(16)]
    df = spark.createDataFrame(rows, "m int, wav string, at int, seconds double, v array<double>").repartition(3)
    found = {(r.m, r["at"]): (r.divide, r.speaker) for r in diarize.meetings(df, "m", "wav", "at", "seconds", "v", 4, 70.0).collect()}
    assert {k: d for k, (d, _) in found.items()} == {(m, i): f"divide_{1 + i // 8}" for m in (0, 1) for i in range(16)}
    for m in (0, 1):
        for part in (range(8), range(8, 16)):
            x = np.array([r[4] for r in rows if r[0] == m and r[2] in part])
            assert [found[m, i][1] for i in part] == list(cluster.speakers(x, 4 if len(x) >= 10 else min(4, len(x))))
    whole = {(r.m, r["at"]): (r.divide, r.speaker) for r in diarize.meetings(df, "m", "wav", "at", "seconds", "v", 4).collect()}
    assert whole == {(m, i): (None, i % 2) for m in (0, 1) for i in range(16)}
    single = diarize.recordings(df.filter("wav = 'w0' and at < 4 and m = 0").withColumn("wav", F.concat("wav", F.col("at").cast("string"))), "wav", "at", "v").collect()
    assert [r.speaker for r in single] == [0] * 4


def test_tables(spark):
    rows = [("t", i, s, [x, 0.0]) for i, (s, x) in enumerate([("a", 0.0), ("BACKGROUND", 5.0), ("b", 9.0), ("UNKNOWN", 9.1), ("a", 0.2), ("COMMENT", 1.0), ("b", 9.3), ("a", 0.1)])]
    df = spark.createDataFrame(rows, "t string, i int, s string, v array<double>")
    assert {r.i: r.predicted for r in diarize.tables(df, "t", "s", "i", "v", 4).collect()} == {0: 0, 2: 1, 3: 1, 4: 0, 6: 1, 7: 0}
    assert {r.i for r in diarize.tables(df, "t", "s", "i", "v", 4, unknown=False).collect()} == {0, 2, 4, 6, 7}


def plain_activity(x, size, hop):
    """Frame by frame, with the smoothing spelt out."""
    crossed = [0] + [int(np.signbit(a) != np.signbit(b)) for a, b in zip(x, x[1:])]
    crossed[0] = int(np.signbit(x[0]))
    rate = [float(np.mean(crossed[i : i + size])) for i in range(0, max(1, len(x) - size + 1), hop)]
    weight = {k: np.exp(-0.5 * (k / 3.0) ** 2) for k in range(-12, 13)}
    n, out = len(rate), []
    for i in range(n):
        at = [i + k for k in range(-12, 13)]
        if n > 12:
            at = [abs(j) if j < n else 2 * (n - 1) - j for j in at]
        else:
            at = [min(max(j, 0), n - 1) for j in at]
        out.append(sum(weight[k] * rate[j] for k, j in zip(range(-12, 13), at)) / sum(weight.values()))
    return [bool(v < np.mean(out) - 1e-9) for v in out]


def test_speech_frames_as_spelt_out(spark):
    rng = np.random.default_rng(2)
    waves = [rng.normal(size=n) for n in (5, 40, 300)] + [np.concatenate([np.sin(np.arange(400) / 30), rng.normal(size=400), np.sin(np.arange(300) / 40)]), np.ones(64)]
    df = spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(waves)] + [(9, None), (10, [])], "k int, w array<double>")
    found = {r.k: r.a for r in df.select("k", windows.zero_crossing_activity(F.col("w"), 32, 8).alias("a")).collect()}
    assert found == {i: plain_activity(list(w), 32, 8) for i, w in enumerate(waves)} | {9: None, 10: None}
    spans = [(r.start, r.end) for r in diarize.speech(df.filter("k = 3"), "k", "w", 32, 8).orderBy("span").collect()]
    assert len(spans) == 2 and spans[0][0] == 0 and abs(spans[0][1] - 400) < 80 and abs(spans[1][0] - 800) < 80


def test_files(spark):
    """Two hums of the same kind and one of another, between noise."""
    rng = np.random.default_rng(3)
    hum = lambda step, level: level * np.sin(np.arange(600) / step)
    wave = np.concatenate([hum(40, 1.0), rng.normal(size=600), hum(45, 9.0), rng.normal(size=600), hum(40, 1.0)])
    df = spark.createDataFrame([(1, [float(v) for v in wave])], "k int, w array<double>")
    loud = F.array(F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.size("samples")))
    found = diarize.files(df, "k", "w", loud, 4, 64, 16).orderBy("span").collect()
    assert [r.speaker for r in found] == [0, 1, 0]
