"""Word error rates over whole texts."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import similarity
from corpusmill.functions import text as tx
from corpusmill.plans import catalog


def plain_edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_edits_of_any_length():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 63, 64, 65, 150):
        for _ in range(20):
            a = [rng.choice("abcd") for _ in range(rng.randint(0, n))]
            b = [x for w in a for x in rng.choice(([w], [w], [w], [], [w, "x"], ["y"]))] if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(n)]
            assert similarity._edits(a, b) == plain_edits(a, b)


def test_corpus_word_error_rate(spark, tmp_path):
    """What stands after the 400th character counts too."""
    texts = ["word " * 100 + "Late WORDS, here.", "Één  " + "Twa trije " * 60, "a b", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["corpus_word_error_rate"](spark, str(tmp_path)).first()
    pairs = spark.createDataFrame([(t,) for t in texts if t is not None], "t string").select("t", tx.normalise(F.col("t")).alias("n")).collect()
    edits = sum(plain_edits(r.t.split(), r.n.split()) for r in pairs)
    assert (got.edits, got.n_ref) == (edits, sum(len(r.t.split()) for r in pairs)) and edits > 60
