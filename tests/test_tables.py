"""Readers, writers, joins, windows, splits and models on small tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import aggregates as ag
from corpusmill.operators import cluster, langid, ngramlm, relational, splits, windows
from corpusmill.sources import readers, sinks
from corpusmill.streaming import scans


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return f"file://{folder}/{name}"


def test_readers(spark, tmp_path):
    good, bad = readers.council_labels(spark, put(tmp_path, "labels.txt", "f1\tw1\tfrl\t0.5\t2.0\tgoeie\nf2\tw2\tnl\tx\t3\tdag\nshort\n"))
    assert [(r.file_id, r.duration) for r in good.collect()] == [("f1", 1.5)] and bad.count() == 2
    ok, background, rejected = readers.annotation_tables(spark, put(tmp_path, "a.Table", "tmin\ttier\ttext\ttmax\n0\tspk1/male/fr\thoi\t1\n1\tbackground\t-\t2\n2\tspk1/x9\tfoo\t3\nbad\n"))
    assert (ok.count(), background.count(), rejected.count()) == (1, 1, 2) and ok.first().gender == "male"
    rows, bad = readers.spoken_tables(spark, put(tmp_path, "t.tsv", "0.0\tN1\thoi\t1.5\nx\tN1\thoi\t1\n"), sample=1)
    assert rows.first().duration == 1.5 and bad.count() == 1
    info, bad = readers.audio_info(spark, put(tmp_path, "info.txt", "a\tp.wav,2,16000,16-bit,00:01=32000,1M,256k,PCM\nb\tq.wav,x,16000\n"))
    assert [r.line for r in bad.collect()] == ["b\tq.wav,x,16000"]
    info = info.first()
    assert (info.channels, info.samples, info.seconds) == (2, 32000, 2.0)
    words, reject = readers.pronunciations(spark, put(tmp_path, "lex.txt", "dag\td a g\nlone\n"))
    assert words.first().pron == "d a g" and reject.count() == 1
    assert readers.lexicon(spark, put(tmp_path, "lex2.txt", "dag  d a g\n")).first().pron == "d a g"
    assert {(r.word, r.language) for r in readers.bilingual_words(spark, put(tmp_path, "bi.txt", "dag-nl\ndei-fr\nplain\n")).collect()} == {("dag", "Dutch"), ("dei", "Frisian"), ("plain", None)}
    numbers, rejected = readers.number_table(spark, put(tmp_path, "n.txt", "1 ien\n2 twa\nx y\n3\n"))
    assert {r.number: r.word for r in numbers.collect()} == {1: "ien", 2: "twa"} and {r.line for r in rejected.collect()} == {"x y", "3"}
    said = readers.written_numbers(spark.createDataFrame([(2,), (7,)], "n int"), "n", numbers).collect()
    assert {r.n: r.word for r in said} == {2: "twa", 7: None}
    score, bad = readers.scores(spark, put(tmp_path, "s.txt", "a_pk-7 ref a b\na_pk-7 hyp a c\na_pk-7 op C S\na_pk-7 #csid 1 1 0 0\nno id here\n"))
    assert [r.line for r in bad.collect()] == ["no id here"]
    score = score.first()
    assert (score.pk, score.ref, score.hyp, score.codes, score.counts) == (7, "a b", "a c", "C S", "1 1 0 0")
    assert {r.word: r.idx for r in readers.word_list(spark, put(tmp_path, "v.txt", "b x\na\nb\n\nc\n")).collect()} == {"b": 0, "a": 1, "c": 2}
    found = readers.manifest(spark, put(tmp_path, "m.json", '{"data": [{"sentence": "hoi", "audiofilename": "a.wav", "sampling_rate": 16000, "start_time": 0.0, "end_time": 1.5}]}'))
    assert found.first().end_time == 1.5
    pages = readers.wiki_pages(spark, put(tmp_path, "w.xml", "<mediawiki><page><title>T</title><id>4</id><revision><text>body</text></revision></page></mediawiki>"))
    assert tuple(pages.first()) == ("T", "4", "body")
    pairs = readers.ground_truth(spark, put(tmp_path, "gt.txt", "a\nb\n"), put(tmp_path, "pr.txt", "x\ny\n")).orderBy("line_no").collect()
    assert [(r.ref, r.hyp) for r in pairs] == [("a", "x"), ("b", "y")]
    (tmp_path / "d" / "frl").mkdir(parents=True)
    put(tmp_path / "d" / "frl", "x.txt", "hoi")
    put(tmp_path / "d" / "frl", "x.pdf", "%PDF")
    docs = readers.documents(spark, f"file://{tmp_path}/d")
    assert {(r.kind, r.text, r.error) for r in docs.collect()} == {("txt", "hoi", False), ("pdf", None, True)}
    assert docs.select(readers.path_language(F.col("path")).alias("l")).first().l == "Frisian"
    wave = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(10)]).alias("w"))
    assert wave.select(readers.wave_section(F.col("w"), F.lit(0.2), F.lit(0.5), 10).alias("s")).first().s == [2.0, 3.0, 4.0]
    assert wave.select(readers.mono(F.array("w", F.transform("w", lambda x: x + 2))).alias("m")).first().m[0] == 1.0


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/texts"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    sinks.insert_if_absent(rows, path, ["k", "v"])
    sinks.insert_if_absent(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, ["k", "v"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    changed = sinks.updated(spark.read.parquet(path), spark.createDataFrame([(3, "z")], rows.schema), "k", "v")
    assert {r.k: r.v for r in changed.collect()} == {1: "a", 2: None, 3: "z"}
    sinks.seed_dimension(spark, f"file://{tmp_path}/dim", [("Dutch", "nl")])
    sinks.seed_dimension(spark, f"file://{tmp_path}/dim", [("Dutch", "nl"), ("unknown", "")])
    assert spark.read.parquet(f"file://{tmp_path}/dim").count() == 2
    segments = spark.createDataFrame([("u1", "hoi", "w", "p.wav", 2, 0.0, 1.0, "s", "nl"), ("u2", "dei", "w", "p.wav", 2, 1.0, 2.0, "s", "fr")], "utterance_id string, text string, wav string, path string, channels int, start double, end double, speaker string, route string")
    sinks.write_kaldi(segments, f"file://{tmp_path}/kaldi")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/kaldi/wav.scp").collect()] == ["w sox -t wav p.wav -b 16 -t wav - remix - |"]
    sinks.write_kaldi(segments, f"file://{tmp_path}/routes", by="route")
    assert spark.read.text(f"file://{tmp_path}/routes/text").filter("route = 'nl'").first().value == "u1 hoi"
    sinks.write_integer_vocabulary(spark.createDataFrame([("a", 1), ("b", 5)], "word string, n long"), f"file://{tmp_path}/vocab")
    assert {r.word: r.idx for r in readers.integer_vocabulary(spark, f"file://{tmp_path}/vocab").collect()} == {"</s>": 0, "b": 1, "a": 2}
    sinks.write_manifest_document(segments.select("text"), f"file://{tmp_path}/man")
    assert spark.read.json(f"file://{tmp_path}/man").select(F.size("data")).first()[0] == 2


def test_joins(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "n int")
    assert sorted((r.n for r in rows.filter(relational.exclude_below("n", 2)).collect()), key=str) == [2, None]
    left, right = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "k string, a int"), spark.createDataFrame([("t", 10), ("u", 11), ("u", 12)], "k string, b int")
    assert {(r.a, r.b) for r in relational.occurrence_join(left, right, ["k"], ["a"], ["b"]).collect()} == {(1, 10), (3, 11)}
    texts, parts = spark.createDataFrame([("abc",), ("xyz",)], "t string"), spark.createDataFrame([("b",), ("c",)], "p string")
    assert relational.contains_join(texts, parts, "t", "p").count() == 2
    assert [r.t for r in relational.contains_rest(texts, parts, "t", "p").collect()] == ["xyz"]
    a, b = spark.createDataFrame([(i,) for i in range(5)], "w int"), spark.createDataFrame([(i,) for i in range(3, 8)], "w int")
    assert {r.w for r in relational.symmetric_unique(a, b).collect()} == {0, 1, 2, 5, 6, 7}
    ids = relational.encoded(spark.createDataFrame([(1, ["b", "q", "a"])], "k long, w array<string>"), "k", F.col("w"), spark.createDataFrame([("a", 0), ("b", 1)], "word string, idx int"), 9)
    assert ids.first().ids == [1, 9, 0]


def test_windows(spark):
    df = spark.createDataFrame([("m", i, d) for i, d in enumerate([2.0, 3.0, 4.0])], "m string, i int, d double")
    assert [r.offset for r in windows.running_offset(df, "m", ["i"], "d").orderBy("i").collect()] == [0.0, 2.0, 5.0]
    assert [r.selected for r in windows.contiguous_slice(df, "m", ["i"], "d", F.lit(2.5), F.lit(3.0)).orderBy("i").collect()] == [False, True, False]
    rng = random.Random(1)
    rows = [("g", i, float(rng.randint(1, 90))) for i in range(50)]
    expected, bucket, total = [], 1, 0.0
    for _, _, d in rows:
        expected.append(bucket)
        total += d
        if total > 100:
            bucket, total = bucket + 1, 0.0
    found = windows.threshold_buckets(spark.createDataFrame(rows, "m string, i int, d double"), "m", ["i"], "d", 100.0).orderBy("i").collect()
    assert [r.bucket for r in found] == expected
    mask = spark.createDataFrame([("g", i, a) for i, a in enumerate([0, 1, 1, 0, 0, 1])], "g string, i int, a int")
    assert [(r.active, r.n) for r in windows.islands(mask, "g", ["i"], F.col("a") == 1).orderBy("island").collect()] == [(False, 1), (True, 2), (False, 2), (True, 1)]
    ranked = windows.global_rank(spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 7]], "x int").repartition(3), ["x"]).collect()
    assert {r.x: r["rank"] for r in ranked} == {1: 0, 3: 1, 5: 2, 7: 3, 9: 4}
    wave = np.r_[np.zeros(8000), np.sin(np.arange(8000) / 5), np.zeros(8000), np.sin(np.arange(8000) / 5)]
    df = spark.createDataFrame([([float(x) for x in wave], 16000)], "w array<double>, r int")
    spans = df.select(windows.sound_spans(F.col("w"), F.col("r")).alias("s"), windows.zero_crossing_activity(F.col("w")).alias("z")).first()
    assert len(spans.s) == 2 and abs(spans.s[0].start - 8000) < 1024 and len(spans.z) > 100


def test_splits(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    parts = splits.ratio_split(df, "k", {"train": 0.8, "dev": 0.1, "test": 0.1}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 160, "dev": 20, "test": 20}
    assert splits.sample(df, "k", 7).count() == 7
    rows = spark.createDataFrame([(m, i, 50.0) for m in range(8) for i in range(20)], "m int, i int, d double")
    found = splits.meeting_split(rows, "m", ["i"], "d", 2, seconds=200.0)
    assert found.count() == 160 and {r["split"] for r in found.select("split").distinct().collect()} == {"train", "dev", "test"}
    assert found.filter("split != 'train'").select("m").distinct().count() == 4
    triples = splits.triplets(spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "k int, s string"), "k", "s", 10).collect()
    assert len(triples) == 10 and all(t.anchor % 3 == t.positive % 3 != t.negative % 3 for t in triples)


def test_aggregates(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "t int, p int")
    report = {r.label: r for r in ag.class_report(df, "t", "p").collect()}
    assert report["1"].precision == pytest.approx(2 / 3) and report["accuracy"].recall == pytest.approx(0.6)
    assert report["macro"].recall == pytest.approx((0.5 + 2 / 3) / 2)
    rows = spark.createDataFrame([("a", 3, 1, 0, 0, 4), ("a", 4, 0, 0, 0, 4), ("b", 0, 0, 0, 0, 0)], "g string, c int, s int, i int, d int, n_ref int")
    total = {r.g: r for r in ag.error_totals(rows, "g").collect()}
    assert total["a"].wer == 12.5 and total["a"].ser == 50.0 and total["b"].wer is None and total[None].n_ref == 8
    wer = ag.corpus_wer(spark.createDataFrame([("a b c", "a x c"), ("d", "d")], "r string, h string"), F.col("r"), F.col("h")).first()
    assert (wer.edits, wer.n_ref, wer.wer) == (1, 4, 0.25)
    mapping = ag.majority_mapping(spark.createDataFrame([("s", 2), ("s", 1), ("s", 1), ("t", 3), ("t", 2)], "s string, c int"), "s", "c")
    assert {r.s: r.c for r in mapping.collect()} == {"s": 1, "t": 2}
    labelled = ag.labelled_words(spark.createDataFrame([(1, 0, "nl", ["de", "dei"])], "k int, no int, l string, w array<string>"), "k", "no", F.col("w"), "l", spark.createDataFrame([("dei", "fr"), ("de", "fr")], "word string, label string"), spark.createDataFrame([("de",)], "word string"))
    assert labelled.first().labelled == "de-nl dei-fr"


def test_naive_bayes(spark):
    rng = random.Random(0)
    texts = [(i, "".join(rng.choice("abcab " if i % 2 else "bcdcd ") for _ in range(40)), "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(texts, "k long, t string, l string")
    model = langid.train(df.filter("k < 30"), F.col("t"), "l", 2, 3)
    found = {r.k: (r.l, r.score) for r in langid.predict(df.filter("k >= 30"), "k", F.col("t"), model, "l", 2, 3).collect()}
    grams = lambda t: [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
    squeeze = lambda t: re.sub(" +", " ", t)
    counts = {c: Counter(g for _, t, label in texts[:30] if label == c for g in grams(squeeze(t))) for c in "xy"}
    v = len(set(counts["x"]) | set(counts["y"]))
    for k, t, _ in texts[30:]:
        scores = {c: math.log(0.5) + sum(math.log((counts[c][g] + 1) / (sum(counts[c].values()) + v)) for g in grams(squeeze(t)) if g in counts["x"] or g in counts["y"]) for c in "xy"}
        best = max(sorted(scores), key=scores.get)
        assert found[k][0] == best and found[k][1] == pytest.approx(scores[best])


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (12, 3)) for c in (0, 3, 6)])
    found = cluster.speakers(x, 6)
    assert len(set(found)) == 3 and all(len(set(found[i : i + 12])) == 1 for i in (0, 12, 24))
    # each merge is the pair of clusters with the least growth of the sum of squares
    groups = {i: [i] for i in range(len(x))}
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
    for i, j in cluster.ward(x):
        assert cost(groups[i], groups[j]) == pytest.approx(min(cost(groups[a], groups[b]) for a, b in itertools.combinations(groups, 2)))
        groups[i] += groups.pop(j)
    assert list(cluster.speakers(x[:2])) == [0, 0] and len(cluster.speakers(x[:0])) == 0
    df = spark.createDataFrame([("g", i, [float(c) for c in v]) for i, v in enumerate(x)], "g string, k int, v array<double>")
    assert cluster.cluster_groups(df, "g", "k", "v", 6).select("cluster").distinct().count() == 3


def test_perplexity_grid(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), (["b", "a"],)], "w array<string>")
    base = ngramlm.model(docs, F.col("w"))
    found = ngramlm.perplexity_grid(docs, F.col("w"), base, base, grid=(0.1, 0.4)).collect()
    assert len(found) == 2 and found[0].perplexity == pytest.approx(found[1].perplexity) and found[0].n == 7


def test_streams(spark, tmp_path):
    rows = [(i % 2, i, float(10 + i)) for i in range(12)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, "g long, i long, d double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("g long, i long, d double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = scans.running_offset_stream(stream, "g", "i", "d").writeStream.format("memory").queryName("offsets").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for g in (0, 1):
        got = [r.offset for r in spark.sql(f"SELECT * FROM offsets WHERE g = {g} ORDER BY i").collect()]
        assert got == list(itertools.accumulate([d for x, _, d in rows if x == g][:-1], initial=0.0))
    q = scans.insert_stream(stream, f"file://{tmp_path}/out", ["g"], f"file://{tmp_path}/c2")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_files_lexicons_and_recordings(spark, tmp_path):
    import io
    import wave
    import zipfile

    import numpy as np

    folder = tmp_path / "in"
    (folder / "a/b").mkdir(parents=True)
    (folder / "a/b/x.txt").write_text("tekst")
    (folder / "y.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(folder / "a/z.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Goeie &amp; </w:t></w:r><w:r><w:t xml:space='preserve'>dei</w:t></w:r></w:p><w:p w:x='1'><w:r><w:t>twa</w:t></w:r></w:p></w:document>")
    (folder / "bad.docx").write_bytes(b"no zip")
    found = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.documents(spark, str(folder)).collect()}
    assert found == {"x.txt": ("tekst", False), "y.pdf": (None, True), "z.docx": ("Goeie & dei\ntwa", False), "bad.docx": (None, True)}
    assert {(r.name, r.kind) for r in readers.listed(spark, str(folder)).collect()} == {("x.txt", "txt"), ("y.pdf", "pdf"), ("z.docx", "docx"), ("bad.docx", "docx")}
    assert {r.folder.removeprefix(str(folder)) for r in readers.folders(spark, str(folder)).collect()} == {"/a", "/a/b"}

    lexicons = tmp_path / "lex"
    lexicons.mkdir()
    (lexicons / "council").write_text("dei-fr d-fr a-nl i-fr\ndag-nl d-nl a-nl x-nl\n<spn> spn\n")
    (lexicons / "twente").write_text("dag d a x\n")
    (lexicons / "overlap_wordlist").write_text("de\nen\nde\n")
    assert {tuple(r) for r in readers.named_lexicon(spark, str(lexicons), "council").collect()} == {("dei", "d a i", "Frisian"), ("dag", "d a x", "Dutch"), ("<spn>", "spn", None)}
    assert [tuple(r) for r in readers.named_lexicon(spark, str(lexicons), "twente").collect()] == [("dag", "d a x", "Dutch")]
    assert {r.word for r in readers.overlap_words(spark, str(lexicons)).collect()} == {"de", "en"}

    sounds = tmp_path / "wav"
    sounds.mkdir()
    t = np.arange(8000) / 8000
    left, right = np.sin(2 * np.pi * 200 * t), np.zeros(8000)
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((np.c_[left, right] * 32000).astype("<i2").tobytes())
    (sounds / "a.wav").write_bytes(data.getvalue())
    (sounds / "b.wav").write_bytes(b"RIFF")
    good, bad = readers.recordings(spark, str(sounds))
    assert bad.count() == 1
    row = good.select("rate", "samples", readers.resampled(F.col("samples"), F.col("rate"), 16000).alias("up"), readers.resampled(F.col("samples"), F.col("rate"), 4000).alias("down")).first()
    assert row.rate == 8000 and np.allclose(row.samples, left * 32000 / 32768 / 2, atol=1e-4)
    for name, rate in (("up", 16000), ("down", 4000)):
        wanted = np.sin(2 * np.pi * 200 * np.arange(rate) / rate) * 32000 / 32768 / 2
        assert np.abs(np.array(getattr(row, name)) - wanted)[100:-100].max() < 5e-3
