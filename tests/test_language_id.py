"""Language identification over n-grams of 2 to 5."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import langid, splits
from corpusmill.plans import catalog


def test_language_id_takes_two_to_five(spark, tmp_path):
    """nb_predict scores with n-grams of 2 to 5 characters; it gives two places."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcab " if i % 2 else "bcdcd ") for _ in range(30)), "x" if i % 2 else "y") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.lang, r.score) for r in catalog.QUERIES["nb_predict"](spark, str(tmp_path)).collect()}
    split = splits.hash_split(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id")
    model = langid.train(split.filter("split = 'train'"), F.col("text"), "lang")
    best = langid.predict(split.filter("split = 'test'"), "doc_id", F.col("text"), model, "lang").collect()
    assert got and {r.doc_id: (r.lang, pytest.approx(r.score, abs=0.006)) for r in best} == got


def test_grams_of_any_letters(spark):
    """Grams of long, short, null and empty texts, of many letters and of those beyond 16 bits, as plain slices give them."""
    rng = random.Random(3)
    wide = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(3000))
    rows = [(wide, "x"), ("a\0b\0\0", "x"), ("\U0001F600ab\U0001F600", None), ("", "y"), (None, "y"), ("a", "y"), ("ab  AB\n", "y")]
    plain = Counter()
    for t, label in rows:
        t = re.sub("[ \t\r\n]+", " ", (t or "").lower())
        plain.update((t[i : i + n], label) for n in range(2, 6) for i in range(len(t) - n + 1))
    found = langid.gram_counts(spark.createDataFrame(rows, "t string, lang string"), F.col("t"), "lang").collect()
    assert Counter({(r.gram, r.lang): r.n for r in found}) == plain and len(found) == len(plain)


def test_texts_meet_the_model_by_chunk(spark):
    """A text's grams are not rows of their own: what meets the model is a row a chunk and gram."""
    rows = spark.range(400).selectExpr("id AS k", "repeat('abcde', 20) AS t", "if(id % 2 = 0, 'x', 'y') AS lang")
    model = langid.train(rows, F.col("t"), "lang")
    found = langid.predict(rows.drop("lang"), "k", F.col("t"), model, "lang")
    assert found.count() == 400 and "chunk" in found._jdf.queryExecution().toString()
    assert "explode(" not in found._jdf.queryExecution().optimizedPlan().toString()
