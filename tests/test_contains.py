"""Texts that contain parts, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import relational


@pytest.mark.parametrize("most", [relational.PART_BYTES, 200])
def test_as_plain_search(spark, most):
    """In one block or many: overlapping, repeated, empty and null parts, null texts, and further columns of both sides."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randint(1, n)))
    texts = [(i, None if i % 9 == 0 else word(30), 1) for i in range(120)] + [(500, "", 1), (501, "ab" * 50_000, 1)]
    parts = [(word(4), i) for i in range(60)] + [("ab", 60), ("ab", 61), (None, 62), ("zz", 63)]
    rows, found = spark.createDataFrame(texts, "k int, t string, _x int").repartition(3), spark.createDataFrame(parts, "p string, q int")
    got = relational.contains_join(rows, found, "t", "p", most).select("k", "p", "q").collect()
    assert sorted(map(tuple, got)) == sorted((k, p, q) for k, t, _ in texts for p, q in parts if t is not None and p is not None and p in t)
    few = found.filter("q in (5, 60, 62)")
    rest = relational.contains_rest(rows, few, "t", "p", most).select("k").collect()
    assert sorted(r.k for r in rest) == sorted(k for k, t, _ in texts if t is None or not any(p in t for p, q in parts if q in (5, 60)))


def test_an_empty_part_and_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "k int, t string")
    parts = spark.createDataFrame([("",), ("a",)], "p string")
    assert sorted(map(tuple, relational.contains_join(rows, parts, "t", "p").select("k", "p").collect())) == [(1, ""), (1, "a"), (2, "")]
    assert relational.contains_join(rows, parts.limit(0), "t", "p").count() == 0
    assert relational.contains_rest(rows, parts.limit(0), "t", "p").count() == 3


def test_one_pass_over_the_rows(spark):
    """A hundred thousand parts make no nested loop."""
    parts = spark.range(100_000).select(F.concat(F.lit("part"), F.col("id").cast("string"), F.lit(".")).alias("p"))
    rows = spark.range(200).select("id", F.concat(F.lit("x part"), (F.col("id") * 501).cast("string"), F.lit(". part7. part")).alias("t"))
    met = relational.contains_join(rows, parts, "t", "p")
    assert tuple(met.groupBy("id").count().agg(F.min("count"), F.max("count")).first()) == (2, 2)
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "CartesianProduct" not in met._jdf.queryExecution().toString()
