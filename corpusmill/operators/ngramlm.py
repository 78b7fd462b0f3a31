"""Word n-gram language models of two corpora mixed over a grid of weights, and their perplexity (Jelinek-Mercer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid of mixing weights.
GRID = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45)


def bigrams(df: DataFrame, words: Column) -> DataFrame:
    """first and second of each pair in a text, sentence marks included; repeats included."""
    w = F.concat(F.array(F.lit("<s>")), F.filter(words, lambda x: x != ""), F.array(F.lit("</s>")))
    rows = df.select(w.alias("w"))  # a column of its own, so that it is built once a row
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return rows.select(F.explode(pairs).alias("p")).select("p.*")


def model(df: DataFrame, words: Column) -> tuple[DataFrame, DataFrame]:
    """(second, p) and (first, second, p): relative frequencies of words and of pairs given the first."""
    pairs = bigrams(df, words).groupBy("first", "second").agg(F.count("*").alias("n"))
    single = pairs.groupBy("second").agg(F.sum("n").alias("n"))
    total = single.agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    unigrams = single.crossJoin(F.broadcast(total)).select("second", ((F.col("n") + 1) / (F.col("total") + F.col("v") + 1)).alias("p1"))  # one row of totals
    firsts = pairs.groupBy("first").agg(F.sum("n").alias("all"))
    return unigrams, pairs.join(firsts, "first").select("first", "second", (F.col("n") / F.col("all")).alias("p2"))


def perplexity_grid(test: DataFrame, words: Column, base: tuple, other: tuple, weight: float = 0.5, grid: tuple[float, ...] = GRID) -> DataFrame:
    """lambda, n, perplexity: p = (1 - lambda) p_base + lambda p_other, each a mixture of pairs and words by ``weight``."""
    rows = bigrams(test, words).groupBy("first", "second").agg(F.count("*").alias("n"))
    for i, (unigrams, pairs) in enumerate((base, other)):
        floor = unigrams.agg(F.min("p1").alias(f"floor{i}"))
        rows = rows.join(unigrams.withColumnRenamed("p1", f"u{i}"), "second", "left").join(pairs.withColumnRenamed("p2", f"b{i}"), ["first", "second"], "left").crossJoin(F.broadcast(floor))  # one row
        p = weight * F.coalesce(f"b{i}", F.lit(0.0)) + (1 - weight) * F.coalesce(f"u{i}", f"floor{i}")
        rows = rows.withColumn(f"p{i}", p).drop(f"u{i}", f"b{i}", f"floor{i}")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lambda"), (F.col("n") * -F.log((1 - x) * F.col("p0") + x * F.col("p1"))).alias("loss")) for x in grid]))
    return rows.select("n", each.alias("x")).groupBy("x.lambda").agg(F.sum("n").alias("n"), F.exp(F.sum("x.loss") / F.sum("n")).alias("perplexity"))


def _grams(df: DataFrame, words: Column, order: int) -> DataFrame:
    """w1 ... w<order>, n: the grams of texts between sentence marks, of which there are order - 1 before; each ends in its word."""
    marked = F.concat(F.array_repeat(F.lit("<s>"), order - 1), F.filter(words, lambda x: x != ""), F.array(F.lit("</s>")))
    rows = df.select(marked.alias("w"))  # a column of its own, so that it is built once a row
    parts = [F.slice("w", F.lit(k + 1), F.size("w") - order + 1) for k in range(order)]
    names = [f"w{k + 1}" for k in range(order)]
    zipped = rows.select(*[p.alias(n) for p, n in zip(parts, names, strict=True)])
    return zipped.select(F.inline(F.arrays_zip(*names))).groupBy(*names).agg(F.count("*").alias("n"))


def models(df: DataFrame, words: Column, order: int = 3) -> list[DataFrame]:
    """For each length up to ``order``: (w1 ..., p), the share of the last word among what follows the others; single words have one added."""
    single = _grams(df, words, 1)
    total = single.agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    out = [single.crossJoin(F.broadcast(total)).select("w1", ((F.col("n") + 1) / (F.col("total") + F.col("v") + 1)).alias("p"))]  # one row of totals
    for k in range(2, order + 1):
        grams, before = _grams(df, words, k), [f"w{i}" for i in range(1, k)]
        out.append(grams.join(grams.groupBy(*before).agg(F.sum("n").alias("all")), before).select(*before, f"w{k}", (F.col("n") / F.col("all")).alias("p")))
    return out


def grid(test: DataFrame, words: Column, base: list[DataFrame], other: list[DataFrame], weights: tuple[float, ...] = (0.5, 0.3, 0.2), lambdas: tuple[float, ...] = GRID) -> DataFrame:
    """lambda, n, perplexity: p = (1 - lambda) p_base + lambda p_other, each the sum of the models' shares by ``weights``, longest first.

    A word that a model has never seen has the least share of its single words.
    """
    order = len(base)
    names = [f"w{k + 1}" for k in range(order)]
    rows = _grams(test, words, order)
    for i, model in enumerate((base, other)):
        floor = model[0].agg(F.min("p").alias("floor"))
        p = F.lit(0.0)
        for k, table in enumerate(model, 1):
            own = table.toDF(*names[order - k :], "_p")
            rows = rows.join(own, names[order - k :], "left").withColumnRenamed("_p", f"_p{k}")
        rows = rows.crossJoin(F.broadcast(floor))  # one row
        for k, weight in zip(range(order, 0, -1), weights, strict=True):
            p = p + weight * F.coalesce(f"_p{k}", F.col("floor") if k == 1 else F.lit(0.0))
        rows = rows.withColumn(f"p{i}", p).drop("floor", *[f"_p{k}" for k in range(1, order + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lambda"), (F.col("n") * -F.log((1 - x) * F.col("p0") + x * F.col("p1"))).alias("loss")) for x in lambdas]))
    return rows.select("n", each.alias("x")).groupBy("x.lambda").agg(F.sum("n").alias("n"), F.exp(F.sum("x.loss") / F.sum("n")).alias("perplexity"))
