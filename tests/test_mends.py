"""Cases that once went wrong: sections, records, mixed recordings, paired files, reports as rows."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import aggregates as ag
from corpusmill.operators import relational, transcripts, windows
from corpusmill.sources import readers, sinks


@pytest.mark.parametrize(("text", "wanted"), [
    ("a [b] c [d] e", "a  c  e"), ("a [b [c] d] e", "a  e"), ("] a [b] c", "] a  c"), ("[]", ""), ("a ] b [ c", "a ] b [ c"), ("a [b] c ] [d] e", "a  c ] [d] e"), ("", ""),
])
def test_sections(spark, text, wanted):
    """The n-th opening and the n-th closing make a section; from the first pair out of order on the text stays."""
    assert spark.createDataFrame([(text,)], "t string").select(tx.remove_sections(F.col("t"), ("[", "]")).alias("r")).first().r == wanted


def test_sections_of_marks_that_overlap(spark):
    assert spark.createDataFrame([("x{{{a}}} y",)], "t string").select(tx.remove_sections(F.col("t"), ("{{", "}}")).alias("r")).first().r == "x y"


def test_words_of_a_dictionary_inside_its_strings(spark):
    rows = [("{'t': 'None of us, True story', 'u': None, 'v': True}",), ('{"t": "it\'s False", "v": False}',), ("{'t': 'don\\'t None', 'u': 'x'}",), ("{'t': 'open None",)]
    found = [r.r for r in spark.createDataFrame(rows, "t string").select(tx.record(F.col("t"), "t string, u string, v boolean").alias("r")).collect()]
    assert [(f.t, f.u, f.v) for f in found] == [("None of us, True story", None, True), ("it's False", None, False), ("don't None", "x", None), (None, None, None)]


def test_a_long_record_is_read(spark):
    long = json.dumps({"t": "None, True " * 20_000, "u": "x"})
    assert spark.createDataFrame([(long,)], "t string").select(tx.record(F.col("t"), "t string, u string").alias("r")).first().r.t == "None, True " * 20_000


def test_two_channels_are_mixed(spark, tmp_path):
    """All channels, to 16 bits, and of recordings with a source those of spoken Dutch alone."""
    rows = [("u1", "a", "w1", "p1.wav", 2, 0.0, 1.0, "s", sinks.SPOKEN), ("u2", "b", "w2", "p2.wav", 2, 0.0, 1.0, "s", sinks.RADIO), ("u3", "c", "w3", "p3.wav", 1, 0.0, 1.0, "s", sinks.SPOKEN)]
    df = spark.createDataFrame(rows, "utterance_id string, text string, wav string, path string, channels int, start double, end double, speaker string, source string")
    lines = lambda x: [r[0] for r in x.select(sinks.kaldi_lines(x)["wav.scp"]).collect()]
    assert lines(df) == ["w1 sox -t wav p1.wav -b 16 -t wav - remix - |", "w2 p2.wav", "w3 p3.wav"]
    assert lines(df.drop("source"))[1] == "w2 sox -t wav p2.wav -b 16 -t wav - remix - |"


def test_lines_of_several_files_are_paired_by_file(spark, tmp_path):
    for folder, texts in (("truth", ("a\nb\n", "c\n")), ("said", ("x\ny\n", "z\n"))):
        (tmp_path / folder).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / folder / f"{i}.txt").write_text(t)
    found = readers.ground_truth(spark, f"file://{tmp_path}/truth", f"file://{tmp_path}/said").collect()
    assert sorted(map(tuple, found)) == [("0.txt", 1, "a", "x"), ("0.txt", 2, "b", "y"), ("1.txt", 1, "c", "z")]


def test_reports_are_rows(spark):
    counts = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "word string, n long")
    assert [tuple(r) for r in ag.words_by_count(counts).collect()] == [(1, "a"), (1, "b"), (2, "c")]
    df = spark.createDataFrame([(0, 0, 5), (0, 0, 4), (0, 1, 3), (1, 1, 2)], "t int, p int, i int")
    assert [tuple(r) for r in ag.correctness_items(df, "t", "p", "i").collect()] == [(0, False, 3), (0, True, 4), (0, True, 5), (1, True, 2)]
    bad = spark.createDataFrame([("b",), ("a",), ("b",)], "w string")
    assert [tuple(r) for r in transcripts.rejected_items(bad, "w").collect()] == [("a", 1), ("b", 2)]
    assert tuple(transcripts.rejected_report(bad, "w", None).first()) == (3, 2)


def test_first_seen_with_repeats(spark):
    df = spark.createDataFrame([("g", 3, "a"), ("g", 1, "b"), ("g", 2, "a"), ("g", 4, "b"), ("g", 5, None)], "g string, i int, v string")
    assert windows.first_seen(df, "g", ["i"], "v").first()["values"] == ["b", "a", None]


def test_error_rate_of_short_and_long_pairs(spark, monkeypatch):
    df = spark.createDataFrame([("a b c", "a c"), ("w " * 300, "w " * 299 + "x"), (None, "a"), ("a", None), ("", "")], "r string, h string")
    found = ag.corpus_wer(df, F.col("r"), F.col("h")).first()
    assert found.edits == 2
    monkeypatch.setattr(ag, "LONG", 0)
    assert tuple(ag.corpus_wer(df, F.col("r"), F.col("h")).first()) == tuple(found)


def test_labels_of_words_in_either_plan(spark, monkeypatch):
    words = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("c", "x"), ("d", "x"), ("d", "x")], "word string, l string")
    own = ag.word_labels(words, "l")
    assert sorted(map(tuple, own.collect())) == [("a", "x", True), ("b", "y", False), ("c", "x", False), ("d", "x", False)]
    df = spark.createDataFrame([(1, 0, "z", ["b", "a", "b", "", "e", "c"]), (2, 0, "z", [])], "k int, no int, l string, w array<string>")
    found = ag.labelled_words(df, "k", "no", F.col("w"), "l", own).collect()
    assert [tuple(r) for r in found] == [(1, 0, "b-y a-z b-y e-z c-x")]
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 0)
    assert ag.labelled_words(df, "k", "no", F.col("w"), "l", own).collect() == found


def test_labels_by_chunk(spark, monkeypatch):
    """Sentences in several chunks, with rows of one sentence, nulls and repeats; no word is a row of its own on its way to the labels."""
    own = spark.createDataFrame([("a", "x", False), ("b", "y", True), ("c", None, False)], "word string, label string, shared boolean")
    rows = [(i, 0, "z", ["a", "b", "", None, "c", "a"]) for i in range(50)] + [(None, 1, None, ["b", "a"]), (60, 0, "z", None), (7, 0, "w", ["q", "", "b"])]
    df = spark.createDataFrame(rows, "k int, no int, l string, w array<string>")
    monkeypatch.setattr(ag, "CHUNK_WORDS", 20)
    found = ag.labelled_words(df, "k", "no", F.col("w"), "l", own)
    got = {(r.k, r.no): r.labelled for r in found.collect()}
    assert len(got) == 51 and got[3, 0] == "a-x b-z c-z a-x" and got[None, 1] == "b a-x" and got[7, 0] == "a-x q-w b-z b-w c-z a-x"
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_taken_out_is_told(spark):
    """Kept text is that of the steps one after the other, and each thing taken out stands under the rule that struck it."""
    text = "de cest la\nyou there\nin htm moai wurd|x\nab\n\nhtm ab\nhtm\nlange rigel"
    found = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    kept, out = transcripts.sifted(found, "k", F.col("t"))
    plain = tx.drop_short_lines(tx.drop_words(tx.drop_lines_with(F.col("t"), [*tx.LINE_STOPS, *tx.ENGLISH_STOPS]), tx.WORD_STOPS))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, found.select("k", plain).collect()))
    wanted = [(1, "stop line", "de cest la"), (1, "foreign line", "you there"), (1, "word", "htm"), (1, "word", "wurd|x"), (1, "word", "htm"), (1, "word", "htm"), (1, "short line", "ab"), (1, "short line", "ab")]
    assert sorted(map(tuple, out.collect())) == sorted(wanted)


def test_children_that_count(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    children = spark.createDataFrame([(1, 5), (1, 6), (1, None), (2, 5), (2, 1), (9, 7), (9, 8)], "p int, v int")
    assert [tuple(r) for r in relational.kept_children(parents, children, "k", "p", F.col("v") > 4).collect()] == [(1, 2, 1)]
    tables, audio = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "f string, n int"), spark.createDataFrame([("a", 16000), ("a", 16000), (None, 1)], "id string, rate int")
    met, missing = relational.with_audio(tables, audio, "f", "id")
    assert [tuple(r) for r in met.collect()] == [("a", 1, 16000)] and sorted(r.n for r in missing.collect()) == [2, 3]
