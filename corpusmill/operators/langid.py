"""Language identification: multinomial naive Bayes over character n-grams, as tables.

The model is two tables: (label, prior) and (gram, label, logp). Counting, smoothing and scoring are joins and sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.relational import small_side
from corpusmill.sources.scratch import checkpointed

#: Characters that are counted at once, and bytes of text that meet the model together.
BATCH, CHUNK_BYTES = 4_000_000, 16_000_000


def prepared(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " ")


def _numbered(x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, all under ``span``, and the number of each entry's value among them."""
    if span > max(1 << 20, 16 * len(x)):
        return np.unique(x, return_inverse=True)
    present = np.zeros(span, bool)
    present[x] = True
    return np.flatnonzero(present), (np.cumsum(present) - 1)[x]


def _windows(texts: list[str], low: int, high: int):
    """For each n: the grams of the texts, the number of the gram at each place, and the place's text.

    A gram is a shorter one and a letter: both have numbers, and their pair gets the next one.
    """
    codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    letters, letter = _numbered(codes, 0x110000)
    at = np.flatnonzero(inside)
    grams, gram = letters[:, None].astype("<u4"), letter[at]
    for n in range(1, high + 1):
        if n > 1:
            stays = inside[at + n - 1]
            at, gram = at[stays], gram[stays]
            values, gram = _numbered(gram * len(letters) + letter[at + n - 1], len(grams) * len(letters))
            grams = np.column_stack([grams[values // len(letters)], letters[values % len(letters)].astype("<u4")])
        if n >= low:
            joined = grams.tobytes().decode("utf-32-le")
            yield [joined[i : i + n] for i in range(0, len(joined), n)], gram, owner[at]


def _batches(texts: list[str | None]):
    """Numbers of the texts, in runs of about ``BATCH`` characters."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= BATCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def _counting(low: int, high: int):
    def run(it):
        kept: dict = {}
        size = 0

        def out(kind):
            for label, texts in kept.items():
                for grams, gram, _ in _windows(texts, low, high):
                    if len(gram):
                        n = np.bincount(gram, minlength=len(grams))
                        some = np.flatnonzero(n)
                        yield pa.RecordBatch.from_arrays([pa.array([grams[i] for i in some], pa.string()), pa.array([label] * len(some), kind), pa.array(n[some], pa.int64())], names=["gram", "label", "n"])
            kept.clear()

        kind = None
        for batch in it:
            kind = batch.schema.field("label").type
            for label, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if t:
                    kept.setdefault(label, []).append(t)
                    size += len(t)
                    if size >= BATCH:
                        yield from out(kind)
                        size = 0
        yield from out(kind)

    return run


def gram_counts(df: DataFrame, text: Column, label: str, low: int = 2, high: int = 5) -> DataFrame:
    """gram, label, n: all character n-grams of the prepared texts, counted in a task before they meet."""
    rows = df.select(F.col(label).alias("label"), prepared(text).alias("text"))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_counting(low, high), f"gram string, label {kind}, n long").groupBy("gram", F.col("label").alias(label)).agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: Column, label: str, low: int = 2, high: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(label, prior), (gram, label, logp) and (label, unseen): log((c + 1) / (N + V)) with V distinct grams over all."""
    counts = checkpointed(gram_counts(df, text, label, low, high))  # read four times
    v = counts.agg(F.countDistinct("gram").alias("v"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("total")).crossJoin(F.broadcast(v))  # one row of v
    docs = df.groupBy(label).agg(F.count("*").alias("docs"))
    priors = docs.crossJoin(F.broadcast(docs.agg(F.sum("docs").alias("all")))).select(label, F.log(F.col("docs") / F.col("all")).alias("prior"))
    joined = counts.join(small_side(totals), label)
    logp = joined.select("gram", label, F.log((F.col("n") + 1) / (F.col("total") + F.col("v"))).alias("logp"))
    return priors, logp, totals.select(label, F.log(1 / (F.col("total") + F.col("v"))).alias("unseen"))


def save(model: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """A model as three Parquet tables in a folder."""
    for name, table in zip(("priors", "logp", "unseen"), model, strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model that ``save`` wrote."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("priors", "logp", "unseen"))


def predict(df: DataFrame, key: str, text: Column, model: tuple[DataFrame, DataFrame, DataFrame], label: str, low: int = 2, high: int = 5) -> DataFrame:
    """key, label, score: the likeliest label; grams that no class has seen are left out; of equals the first by name.

    Texts are dealt into chunks. A chunk asks for its different grams, and not for those of each text: a gram's classes come
    as one row, once a chunk, and its texts are summed where they lie.
    """
    priors, logp, unseen = model
    labels = small_side(priors.join(unseen, label))
    by_gram = logp.groupBy("gram").agg(F.collect_list(F.struct(F.col(label).alias("label"), "logp")).alias("seen"))
    rows = df.select(F.col(key).alias("key"), prepared(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(size // CHUNK_BYTES + 1)))
    asked = rows.groupBy("chunk").applyInArrow(_asking(low, high), "chunk long, gram string")
    answers = asked.join(small_side(by_gram), "gram").select("chunk", "gram", "seen")
    sums = T.ArrayType(T.StructType([T.StructField("label", logp.schema[label].dataType), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())]))
    kinds = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("known", T.LongType()), T.StructField("sums", sums)])
    summed = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_summing(low, high), kinds)
    own = F.try_element_at(F.filter("sums", lambda x: x["label"].eqNullSafe(F.col(label))), F.lit(1))
    part = F.coalesce(own["s"], F.lit(0.0)) + F.col("unseen") * (F.col("known") - F.coalesce(own["n"], F.lit(0)))
    scores = summed.crossJoin(labels).groupBy("key", label).agg((F.first("prior") + F.sum(part)).alias("score"))  # a row a class
    best = scores.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(label).alias("l"))).alias("m"))
    return best.select(F.col("key").alias(key), F.col("m.l").alias(label), (-F.col("m.s")).alias("score"))


def _asking(low: int, high: int):
    """The different grams of a chunk."""

    def run(chunk: pa.Table) -> pa.Table:
        texts, found = chunk["text"].to_pylist(), set()
        for some in _batches(texts):
            for grams, gram, _ in _windows([texts[i] or "" for i in some], low, high):
                if len(gram):
                    found.update(grams)
        return pa.table([pa.array([chunk["chunk"][0].as_py()] * len(found), pa.int64()), pa.array(list(found), pa.string())], names=["chunk", "gram"])

    return run


def _summing(low: int, high: int):
    """For each text of a chunk: places with a gram that some class has seen, and by class those that it has seen and the sum of their logs."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        texts, seen = chunk["text"].to_pylist(), answers["seen"].combine_chunks()
        place = {g: i for i, g in enumerate(answers["gram"].to_pylist())}
        of = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
        each = seen.flatten()
        classes: dict = {}
        number = np.array([classes.setdefault(x, len(classes)) for x in each.field("label").to_pylist()], np.int64)
        # the last row stands for grams that no class has seen
        has, logs = np.zeros((len(seen) + 1, len(classes))), np.zeros((len(seen) + 1, len(classes)))
        has[of, number], logs[of, number] = 1, each.field("logp").to_numpy(zero_copy_only=False)
        known, n, s = np.zeros(len(texts)), np.zeros((len(texts), len(classes))), np.zeros((len(texts), len(classes)))
        for some in _batches(texts):
            for grams, gram, owner in _windows([texts[i] or "" for i in some], low, high):
                row = np.array([place.get(g, len(seen)) for g in grams], np.int64)[gram]
                add = lambda w: np.bincount(owner, w, len(some))  # noqa: B023, E731
                known[some] += add(row < len(seen))
                for c in range(len(classes)):
                    n[some, c] += add(has[row, c])
                    s[some, c] += add(logs[row, c])
        sums = [[{"label": x, "n": int(n[i, c]), "s": s[i, c]} for x, c in classes.items()] for i in range(len(texts))]
        kind = pa.list_(pa.struct([("label", each.type.field("label").type), ("n", pa.int64()), ("s", pa.float64())]))
        return pa.table([chunk["key"], pa.array(known.astype(np.int64)), pa.array(sums, kind)], names=["key", "known", "sums"])

    return run
