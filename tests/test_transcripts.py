"""Operators on lines, splits, labels and manifests against plain versions and small invented rows."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import numbers, similarity
from corpusmill.functions import text as tx
from corpusmill.operators import langid, ngramlm, transcripts
from corpusmill.sources import sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_selections(spark):
    lines = spark.createDataFrame([(1, "a", 0.0, 0.5), (2, "BACKGROUND", 0.0, 9.0), (3, "UNKNOWN", 1.0, 2.0), (4, "a", 1.0, 1.49), (5, None, 2.0, 3.0), (6, "COMMENT", 0.0, 3.0)], "f int, speaker string, s double, e double")
    assert [(r[0], r[4], r[5]) for r in rows(transcripts.speech_spans(lines, "speaker", "s", "e").orderBy("f"))] == [(1, 0, 8000), (5, 32000, 48000)]
    assert {r[0] for r in rows(transcripts.speech_spans(lines, "speaker", "s", "e", unknown=True))} == {1, 3, 5}
    audio = spark.createDataFrame([(1, 16000), (2, 48000), (3, 8000), (4, None), (5, 44100)], "f int, sample_rate int")
    assert {r[0] for r in rows(transcripts.usable_lines(lines, audio, "f", "speaker"))} == {1, 5}
    assert {r[0] for r in rows(transcripts.speaker_lines(lines, "speaker", "a"))} == {1, 4}
    arrays = spark.createDataFrame([(1, [0] * 32), (2, [0] * 31), (3, []), (4, None)], "i int, x array<int>")
    assert {r[0] for r in rows(transcripts.shorter_inputs(arrays, "x", 2.0, 16))} == {2, 3}
    frames = spark.createDataFrame([(1, 32000, 40000), (2, 31999, 40000), (3, None, 40000)], "i int, a int, b int").withColumn("rate", F.lit(16000))
    assert {r[0] for r in rows(transcripts.long_enough(frames, ["a", "b"], "rate"))} == {1, 3}
    flags = spark.createDataFrame([(1, None, True), (2, 5, True), (3, None, False), (4, None, None)], "i int, x int, ok boolean")
    assert {r[0] for r in rows(transcripts.flagged(flags, "x", "ok"))} == {1}


def test_partition_assignment_is_one_pass_with_removal(spark):
    keys = [k for k in "aabbbccdde" for _ in range(2)]
    texts = [(i, k) for i, k in enumerate(keys)]
    lines = {"test": ["a", "b", "x"], "dev": ["a", "a", "c"], "train": ["b", "c", "d", "d", "d", "d", "d"]}
    left, expected = {n: list(v) for n, v in lines.items()}, {}
    for i, k in texts:
        expected[i] = next((n for n in lines if k in left[n]), None)
        if expected[i]:
            left[expected[i]].remove(k)
    made = {n: spark.createDataFrame([(j, k) for j, k in enumerate(v)], "line int, k string") for n, v in lines.items()}
    found = transcripts.assign_partition(spark.createDataFrame(texts, "i int, k string"), made, ["k"], ["i"], ["line"])
    assert {r.i: r.partition for r in found.collect()} == expected
    again = transcripts.assign_partition(found.withColumn("partition", F.lit("old")), {"test": made["test"]}, ["k"], ["i"], ["line"])
    assert Counter(r.partition for r in again.collect()) == {"old": 18, "test": 2}


def test_subtitles_and_reports(spark):
    said = spark.createDataFrame([(1, "hallo", "C x S D", "mix"), (2, "", "C", "nl"), (3, None, "C", "nl")], "pk long, hyp string, codes string, language string")
    texts = spark.createDataFrame([(1, "m1", "w1", 0.5, 2.0), (2, "m1", "w2", 0.0, 1.0)], "pk long, meeting string, wav string, start double, end double")
    hyp, codes = transcripts.subtitles(said, texts)
    assert rows(hyp) == [(1, "m1", "w1", "mix", "0.5", "2.0", "hallo")] and rows(codes)[0][-1] == "C S D"
    bad = spark.createDataFrame([("b",), ("a",), ("b",)], "w string")
    assert rows(transcripts.rejected_report(bad, "w")) == [(3, 2, "a &&& b")]
    vocabulary = spark.createDataFrame([("B", 0), ("a", 1), ("b", 2)], "char string, id int")
    assert rows(transcripts.sorted_vocabulary(vocabulary)) == [("b", 2), ("a", 1)]
    assert transcripts.meetings_for_share(36_000, 0.1, 300) == 12
    frisian, dutch = transcripts.bilingual_split(spark.createDataFrame([("a", "Dutch"), ("b", "Frisian"), ("<s>", None)], "word string, language string"), names=("Frisian", "Dutch"))
    assert rows(frisian) == [("b", "Frisian")] and rows(dutch) == [("a", "Dutch")]


@pytest.mark.parametrize(("given", "wanted"), [({"male": 0}, (0, 1)), ({"female": 0}, (1, 0)), ({"male": 1, "female": 1}, (1, 0)), ({"male": 0, "female": 1}, (0, 1))])
def test_gender_mapping(spark, given, wanted):
    found = spark.createDataFrame([(given,)], "m map<string,int>").select(transcripts.gender_mapping(F.col("m")).alias("g")).first().g
    assert (found["male"], found["female"]) == wanted


def test_records_and_marks(spark):
    df = spark.createDataFrame([("{'tmin': 1.5, 'label': 'a b', 'ok': True, 'x': None}",), ('{"tmin": 2, "label": "c"}',), ("nothing",), (None,)], "t string")
    found = [r.r for r in df.select(tx.record(F.col("t"), "tmin double, label string, ok boolean").alias("r")).collect()]
    assert [f and (f.tmin, f.label, f.ok) for f in found] == [(1.5, "a b", True), (2.0, "c", None), (None, None, None), None]
    marks = lambda *a: spark.createDataFrame([("a b\nc",)], "t string").select(tx.with_sentence_marks(F.col("t"), *a).alias("m")).first().m
    assert marks() == "a b </s> c </s>" and marks(True, True) == "<s> a b </s> <s> c </s>" and marks(False, True) == "<s> a b <s> c"


def test_word_edits_beyond_the_alphabet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_ALPHABET", similarity._ALPHABET[:3])
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, list("abcd"), list("axcd")), (3, [], ["a"]), (4, None, ["a"])], "i int, a array<string>, b array<string>")
    assert {r.i: r.edits for r in similarity.with_word_edits(df, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: None}


def test_string_ratio(spark):
    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abcab" * 30, "bca" * 50), ("same", "same"), ("ûtfier", "utfier")]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in found:
        assert r.r == pytest.approx(2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 1.0)


def test_predict_text_against_plain_bayes(spark, tmp_path):
    train = [("nl", "de kat zit op de mat"), ("nl", "het is mooi weer"), ("fr", "it is moai waar hjoed"), ("fr", "de kat sit op it mat")]
    texts = [(1, "mooi weer\n\nmoai waar"), (2, ""), (3, "de mat")]
    norm = lambda t: re.sub(r"[ \t\r\n]+", " ", t.lower())
    grams = lambda t: [norm(t)[i : i + n] for n in range(2, 6) for i in range(len(norm(t)) - n + 1)]
    counts = defaultdict(Counter)
    for lang, t in train:
        counts[lang].update(grams(t))
    every = {g for c in counts.values() for g in c}

    def best(t):
        score = {lang: math.log(0.5) + sum(math.log((c[g] + 1) / (sum(c.values()) + len(every))) for g in grams(t) if g in every) for lang, c in counts.items()}
        return min(score, key=lambda x: (-score[x], x))

    model = langid.train(spark.createDataFrame(train, "lang string, t string"), F.col("t"), "lang")
    langid.save(model, str(tmp_path / "model"))
    found = transcripts.predict_text(spark.createDataFrame(texts, "i int, t string"), "i", F.col("t"), langid.load(spark, str(tmp_path / "model")), "lang")
    for i, main, sentences in rows(found):
        t = dict(texts)[i]
        expected = defaultdict(list)
        for line in t.split("\n"):
            if line:
                expected[best(line)].append(line)
        assert main == best(t) and sentences == dict(expected)
    assert found.count() == 3


def test_clean_corpus_against_plain_loop(spark):
    lexicon = {"ta-dy", "e-mail"}
    texts = [(1, "Op 12 maaie, de Ta-dy kaam: 3-4 e-mail's - (sa) | en-sa!", "Dutch"), (2, "1999999999 dagen. It is 7.", "Frisian"), (3, "", "Dutch"), (4, None, "Dutch"), (5, "x-y -a- 5", "German")]
    token = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|\S")

    def plain(t, language):
        out = []
        for w in token.findall(re.sub(r"(\d+)-(\d+)", r"\1 \2", t)):
            if w[0].isdigit():
                out.append(numbers.spoken(w, language) or w)
            elif w[0].isalpha():
                w = w.lower()
                out.append(w if w in lexicon else w.replace("-", " "))
            elif w in ",.?:;!":
                out.append("\n")
        return re.sub(r"[|()+]", "", re.sub(r"\s*\n\s*", "\n", re.sub(r"\s*\n[\s\n]*", "\n", " ".join(out))))

    df = spark.createDataFrame(texts, "i int, t string, language string")
    found = transcripts.clean_corpus(df, "i", "t", F.col("language"), spark.createDataFrame([(w,) for w in lexicon], "word string"))
    assert {r.i: r.clean for r in found.collect()} == {i: None if t is None else plain(t, x) for i, t, x in texts}


def test_trigram_grid_against_plain_counts(spark):
    a, b, test = ["a b c", "a b d", "c"], ["a c b", "b b b"], ["a b c d", "", "z"]

    def model(texts):
        out = []
        for k in (1, 2, 3):
            n = Counter()
            for t in texts:
                w = ["<s>"] * (k - 1) + [x for x in t.split(" ") if x] + ["</s>"]
                n.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            before = Counter()
            for g, c in n.items():
                before[g[:-1]] += c
            out.append({g: (c + 1) / (sum(n.values()) + len(n) + 1) if k == 1 else c / before[g[:-1]] for g, c in n.items()})
        return out

    def share(m, g):
        return 0.5 * m[2].get(g, 0) + 0.3 * m[1].get(g[1:], 0) + 0.2 * m[0].get(g[2:], min(m[0].values()))

    ma, mb = model(a), model(b)
    loss, n = Counter(), 0
    for t in test:
        w = ["<s>"] * 2 + [x for x in t.split(" ") if x] + ["</s>"]
        for i in range(len(w) - 2):
            n += 1
            for x in ngramlm.GRID:
                loss[x] -= math.log((1 - x) * share(ma, tuple(w[i : i + 3])) + x * share(mb, tuple(w[i : i + 3])))
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.split("t", " ")
    found = ngramlm.grid(frame(test), words, *(ngramlm.models(frame(t), words, 3) for t in (a, b))).collect()
    assert {r["lambda"]: (r.n, round(r.perplexity, 9)) for r in found} == {x: (n, round(math.exp(loss[x] / n), 9)) for x in ngramlm.GRID}


def test_links_splits_and_variants_on_disk(spark, tmp_path):
    texts, links = str(tmp_path / "texts"), str(tmp_path / "links")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    bridge = spark.createDataFrame([(1, "nl"), (1, "fr"), (2, "nl"), (3, "fr")], "k long, language string")
    sinks.insert_with_links(first, bridge, texts, links, ["k"])
    sinks.insert_with_links(spark.createDataFrame([(2, "again"), (3, "c")], "k long, t string"), bridge, texts, links, ["k"])
    assert sorted(rows(spark.read.parquet(texts))) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(rows(spark.read.parquet(links))) == [(1, "fr"), (1, "nl"), (2, "nl"), (3, "fr")]
    lines = spark.createDataFrame([("train", "x y", "id1"), ("train", "", "id2"), ("dev", None, "id3")], "split string, line string, id string")
    sinks.write_split(lines, F.col("line"), F.col("id"), str(tmp_path / "set"), "split")
    read = lambda name: sorted(rows(spark.read.text(str(tmp_path / "set" / name)).select("value", "split")))
    assert read("used") == [("x y", "train")] and read("id") == [("id1", "train")] and read("not_used") == [("id2", "train"), ("id3", "dev")]
    council, radio = transcripts.COUNCIL, transcripts.RADIO
    made = [(f"u{i}", "t", f"w{i}", "p", 1, 0.0, 1.0, "s", s, p, lang) for i, (s, p, lang) in enumerate([(council, "train", "nl"), (radio, "train", "fr"), ("cgn", "train", "nl"), (council, "dev", "mx"), (radio, "test", "fr")])]
    df = spark.createDataFrame(made, "utterance_id string, text string, wav string, path string, channels int, start double, end double, speaker string, source string, partition string, lang string")
    sinks.write_variants(df, F.col("lang"), str(tmp_path / "kaldi"))
    found = spark.read.text(str(tmp_path / "kaldi" / "utt2spk")).groupBy("place").count()
    assert dict(rows(found)) == {"normal_train": 2, "normal_dev": 1, "cgn_train": 3, "cgn_dev": 1, "fame_train": 2, "fame_test": 1, "fame_ls_train": 2, "fame_ls_test_fr": 1, "normal_ls_train": 2, "normal_ls_dev_mx": 1}


def test_triplets_with_one_dominant_speaker(spark):
    from corpusmill.operators import splits

    df = spark.createDataFrame([(i, "a") for i in range(400)] + [(400, "b"), (401, "b")], "k int, s string")
    speaker = {**dict.fromkeys(range(400), "a"), 400: "b", 401: "b"}
    found = splits.triplets(df, "k", "s", 300).collect()
    assert len(found) == 300 and all(speaker[r.anchor] == speaker[r.positive] != speaker[r.negative] and r.anchor != r.positive for r in found)


def test_wiki_pipeline_on_pages_against_plain_text(spark):
    """The whole pipeline on real pages, against string operations line by line."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")

    def plain(t):
        t = tx._outside(t.lower(), tx.SECTIONS)
        t = re.sub(r"\d\.", "0", t)
        for m in tx.WIKI_MARKS:
            t = t.replace(m, "." if "=" in m else " ")
        t = re.sub(" +", " ", t.replace(",", " ").replace('"', " "))
        t = "\n".join(" ".join(w for w in line.split(" ") if not (len(w.strip(". ")) > 2 and "." in w.strip(". "))) for line in t.split("\n"))
        t = re.sub("\n+", "\n", re.sub(" +\n", "\n", re.sub("\n +", "\n", re.sub(" +", " ", t).replace(".", "\n"))))
        stops = {*tx.LINE_STOPS, *tx.ENGLISH_STOPS}
        lines = [x for x in t.split("\n") if x and not stops & set(x.split(" "))]
        lines = [" ".join(w for w in x.split(" ") if w not in tx.WORD_STOPS and not re.search(tx.BAD_WORD_CHARACTERS, w)) for x in lines]
        return "\n".join(x for x in lines if len(x) >= 4)

    found = pages.withColumn("clean", tx.clean_wiki(F.col("html"))).collect()
    assert len(found) > 20 and all(r.clean == plain(r.html) for r in found)


def test_numbered_lines_of_large_files(spark, tmp_path):
    """Files that are read in several blocks, with empty lines and both line ends."""
    from corpusmill.sources import readers

    texts = {"a.txt": [f"line {i} " + "x" * (i % 90) if i % 7 else "" for i in range(3000)], "b.txt": ["", "one", "", "two"]}
    for name, own in texts.items():
        (tmp_path / name).write_bytes(("\r\n" if name == "b.txt" else "\n").join(own).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.filename, r.line_no, r.line) for r in found) == sorted((n, i + 1, x) for n, own in texts.items() for i, x in enumerate(own) if x)
