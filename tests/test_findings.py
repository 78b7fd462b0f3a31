"""Tables on which queries once differed from their SQL."""

import json
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import numbers, similarity
from corpusmill.functions import text as tx
from corpusmill.operators import cluster, relational, transcripts, windows
from corpusmill.plans import catalog
from corpusmill.sources import readers, sinks


def same_as_sql(spark, folder, name, **tables):
    """Rows of a query, which must be those of its SQL, over tables given as (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = con.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)
    return got


def test_id_lines_of_a_hundred_hours(spark, tmp_path):
    rows = [(0, 1, "view"), (3725, 2, "click"), (359_999, 3, "error"), (360_000, 4, "view"), (5_999_999, 5, "error")]
    got = dict(same_as_sql(spark, tmp_path, "id_lines", events=(rows, "event_id long, user_id long, event_type string")))
    assert got[360_000].split("\t")[7] == "10:00:00"


def test_vocabulary_without_line_ends(spark, tmp_path):
    """A word with a line end after it is another word, and has no place in the vocabulary."""
    rows = [(0, "der mann\nund der\n die der\n", "de", "src0"), (1, "der\n und", "de", "src0")]
    got = same_as_sql(spark, tmp_path, "vocabulary_files", documents=(rows, "doc_id long, text string, lang string, source string"))
    assert [w for w, _ in got].count("der") == 1


def test_wave_sections_in_single_precision(spark, tmp_path):
    rows = [(0, [0.053, 0.052, -0.053] * 8), (3, [0.001 * i for i in range(40)])]
    got = dict(same_as_sql(spark, tmp_path, "wave_sections", embeddings=(rows, "vec_id long, embedding array<float>")))
    assert got[0].startswith("53 52")


def test_manifest_of_several_documents(spark, tmp_path, monkeypatch):
    """No task gets all records: a large manifest is several documents, each whole; a small or empty one is one."""
    rows = spark.range(1000).selectExpr("concat('s ', id) AS sentence", "'a' AS audiofilename", "1 AS sampling_rate", "double(id) AS start_time", "double(id) AS end_time")
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 300)
    for n, documents in ((1000, 4), (200, 1), (0, 1)):
        path = f"{tmp_path}/{n}"
        sinks.write_manifest_document(rows.limit(n).filter(f"start_time < {n}"), path)
        texts = [json.loads(p.read_text()) for p in Path(path).glob("*.txt")]
        assert len(texts) == documents and sum(len(t["data"]) for t in texts) == n and max(len(t["data"]) for t in texts) <= 300
        assert {tuple(r) for r in readers.manifest(spark, path).collect()} == {tuple(r) for r in rows.limit(n).collect()}


def test_first_three_words_of_odd_texts(spark, tmp_path):
    """Junk around and inside words, texts of two words, and long tails: cleaned up to the third word alone."""
    texts = ["a b c", " 1 a-B  2 ?\n c3c .. Dd e f", "a b", "a\nb c d", "...", "", None, "1 2 3", "a 1 2 b", "  x y  z ", "é a é b é ç c1", "a b c" + " tail!" * 5000, "1" * 20_000 + " a b 2", "1 " * 50_000 + "a" + " 2" * 50_000 + " b c d", "a b \tc"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = same_as_sql(spark, tmp_path, "bracket_parse", documents=(rows, "doc_id long, text string"))
    assert dict((r[0], r[2]) for r in got)[1] == "ab cc dd" and len(got) == 8
    plan = catalog.QUERIES["lexicon_labels"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(text" not in plan and "regexp_extract(text" in plan


def test_error_rate_in_one_map(spark, tmp_path):
    """Bounds decide what they can, and leave the distance as it is; the words are taken apart once, in the task."""
    rng = random.Random(3)
    for n in (3, 20, 90):
        for _ in range(40):
            a = [rng.choice("abcdeF") for _ in range(n)]
            b = [w.lower() for w in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice("abcdef") for _ in range(rng.randint(0, n))]
            assert similarity._edits(a, b) == similarity._edits(a, b, bounds=False) <= similarity._aligned(a, b)
    rows = [(0, "Een 12 Twee\ndrie,  vier " * 40), (1, None), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["corpus_word_error_rate"](spark, str(tmp_path))
    assert (found.first().edits, found.first().n_ref) == (120, 160)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "lambdafunction" not in plan


def test_next_words_are_counted_in_tasks(spark, tmp_path, monkeypatch):
    """A pair that recurs in a task leaves it once; pairs end with their text, whatever the batch, and empty words are none."""
    rows = [(i, t) for i, t in enumerate(["a b  a b", "b", "", None, " a 1 b ", "Ä b\na c", *["a b a"] * 50])]
    monkeypatch.setattr(windows, "PAIR_WORDS", 7)
    got = same_as_sql(spark, tmp_path, "next_word_pairs", documents=(rows, "doc_id long, text string"))
    assert ("a", "b", 53) in got
    texts = spark.createDataFrame([("a b a b a b",)] * 200, "t string").coalesce(1)
    monkeypatch.undo()
    assert windows.next_word_counts(texts, F.col("t"))._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
    batch = pa.record_batch([pa.array(["a b a b a b"] * 200)], names=["t"])
    assert sum(b.num_rows for b in windows._counted_pairs([batch])) == 2


def test_words_take_numbers_where_they_lie(spark, tmp_path, monkeypatch):
    """Rows are not taken apart into words; a vocabulary too large for that gives the same, also where rows share a key."""
    rows = [(i or None, t, "de", "src0") for i, t in enumerate(["a b b  c", "", None, "Ä d a", " c", "a\nb a"] * 11)]
    same_as_sql(spark, tmp_path, "encode_words", documents=([r for r in rows if r[1] is not None], "doc_id long, text string, lang string, source string"))
    plan = catalog.QUERIES["encode_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
    df = spark.createDataFrame([(1, ["b", "q", "a"]), (1, ["a", None]), (2, []), (3, None), (None, ["b"])], "k long, w array<string>")
    words = spark.createDataFrame([("a", 0), ("b", 1)], "word string, idx int")
    found = lambda: {r.k: r.ids for r in relational.encoded(df, "k", F.col("w"), words, 9).collect()}
    got = found()
    assert got == {1: [0, 1, 9, 9, 0], None: [1]}
    monkeypatch.setattr(relational, "VOCABULARY_ROWS", 1)
    assert found() == got


def test_each_word_is_cleaned_once(spark):
    """Texts put together from cleaned words are those that the functions make of whole texts, white space and marks of all kinds in them."""
    texts = ["Ta-dy is 3.5, of 12-13-14!", " . a\t\x0b-b- .\n\n.c ;", "", None, "é-É Ta-dy?!x (y)|z+ “q” 1-2-3-4 007", "a b c d - -- .", "3 \n 3", "ΑΣ. ΑΣ, İx", "\n\n", "A-b " * 30]
    languages = ["Dutch", "Frisian", None, "English"]
    df = spark.createDataFrame([(i, t, x) for i, t in enumerate(texts) for x in languages], "i int, t string, language string")
    lexicon = ["ta-dy", "x-y"]
    whole = df.withColumn("said", numbers.number_map(tx.number_tokens(F.col("t")), F.col("language"))).withColumn("c", tx.clean_tokens(F.col("t"), F.array(*map(F.lit, lexicon)), F.col("said")))
    wanted = sorted(((r.i, r.language, r.c) for r in whole.collect()), key=repr)
    found = transcripts.clean_corpus(df, "i", "t", F.col("language"), spark.createDataFrame([(w,) for w in lexicon], "word string"))
    assert sorted(((r.i, r.language, r.clean) for r in found.collect()), key=repr) == wanted
    assert found.columns == ["i", "t", "language", "clean"]
    assert "regexp_extract_all(t#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [sorted(r[0]) for r in df.filter("i = 4 and language is null").select(tx.dashed_words(F.col("t"))).collect()] == [["ta-dy", "é-é"]]


def test_vectors_of_a_cell():
    """Vectors reach a cell as one matrix; missing entries are no numbers, and missing or uneven vectors an error."""
    column = lambda *parts: pa.chunked_array([pa.array(p, pa.list_(pa.float64())) for p in parts], pa.list_(pa.float64()))
    got = cluster._vectors(column([[1.0, 2.0], [3.0, None]], [[0.5, 0.0]]))
    assert got.shape == (3, 2) and got[2].tolist() == [0.5, 0.0] and got[1, 0] == 3 and got[1, 1] != got[1, 1]
    assert cluster._vectors(column([])).shape[0] == 0
    for odd in ([[1.0], [1.0, 2.0]], [[1.0, 2.0], None]):
        with pytest.raises(ValueError):
            cluster._vectors(column(odd))
