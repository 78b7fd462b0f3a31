"""Counting, scoring and reporting. Integer counts are kept beside each rounded ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions.similarity import text_edits
from corpusmill.operators import relational

#: Words from which bounds of an edit distance are tried before its table.
LONG = 64
#: Words of the sentences that meet a dictionary together.
CHUNK_WORDS = 2_000_000


def counted_words(df: DataFrame, text: Column) -> DataFrame:
    """word, n: how often each word of the texts occurs, counted in tasks before it meets. Single spaces part words; empty ones are left out."""

    def run(it):
        for batch in it:
            found = pc.value_counts(pc.list_flatten(pc.split_pattern(batch.column(0), " ")))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    counted = df.select(text.alias("text")).mapInArrow(run, "word string, n long")
    return counted.filter("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, words: Column, *by: str) -> DataFrame:
    """Number of each word (by group); empty items don't count."""
    return df.select(*by, F.explode(words).alias("word")).filter("word != ''").groupBy(*by, "word").agg(F.count("*").alias("n"))


def top_words(counts: DataFrame, k: int, *by: str) -> DataFrame:
    """The k most frequent words of each group; of equals the first by code point."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def letter_counts(df: DataFrame, text: Column) -> DataFrame:
    """Number of each character; a space between rows counts as well, as the texts are one running text."""
    rows = df.select(F.explode(F.split(F.concat(F.lit(" "), text), "")).alias("letter")).filter("letter != ''")
    counts = rows.groupBy("letter").agg(F.count("*").alias("n"))
    return counts.withColumn("n", F.when(F.col("letter") == " ", F.col("n") - 1).otherwise(F.col("n")))


def inverted_counts(counts: DataFrame) -> DataFrame:
    """How many words have each frequency, and the first few of them by name."""
    return counts.groupBy("n").agg(F.count("*").alias("n_words"), F.min("word").alias("first_word"))


def words_by_count(counts: DataFrame) -> DataFrame:
    """n, word: the words of each frequency, the rarest first, by name; as rows, for words seen once are half of any vocabulary."""
    return counts.select("n", "word").sort("n", "word")


def char_vocabulary(df: DataFrame, text: Column) -> DataFrame:
    """Distinct characters with numbers by code point, the space as |, then [UNK] and [PAD]."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).filter("char != ''").distinct()
    # as many rows as a script has characters
    rows = chars.withColumn("id", F.row_number().over(Window.orderBy("char")) - 1).withColumn("char", F.when(F.col("char") == " ", "|").otherwise(F.col("char")))
    n = chars.agg(F.count("*").alias("n"))
    extra = n.select(F.explode(F.array(F.struct(F.lit("[UNK]").alias("char"), F.col("n").cast("int").alias("id")), F.struct(F.lit("[PAD]").alias("char"), (F.col("n") + 1).cast("int").alias("id")))).alias("x")).select("x.*")
    return rows.unionByName(extra)


def segment_totals(df: DataFrame, group: str, duration: str, words: Column | None = None) -> DataFrame:
    """Segments, seconds (two places) and words of each group."""
    return df.groupBy(group).agg(F.count("*").alias("n_segments"), F.round(F.sum(duration), 2).alias("duration"), F.sum(words if words is not None else F.lit(0)).alias("n_words"))


def meeting_totals(df: DataFrame, group: str, duration: str, wav: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(duration).alias("duration"), F.countDistinct(wav).alias("n_wavs"), F.count("*").alias("n_lines"))


def multimap(df: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
    """The values of each key, sorted; with duplicates or without."""
    collect = F.collect_set if distinct else F.collect_list
    return df.groupBy(key).agg(F.array_sort(collect(value)).alias(f"{value}s"))


def doubles(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; of equals the first by name."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(group, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def majority(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """The value with most rows; of equals the one first in ``order``; '' where no row has one of them."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(value))
    counts = df.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("_p", place)
    best = F.min(F.when(F.col("_p") > 0, F.struct((-F.col("n")).alias("n"), F.col("_p").alias("p"), F.col(value).alias("v"))))
    return counts.groupBy(group).agg(best.alias("m")).select(group, F.coalesce("m.v", F.lit("")).alias(value))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """For each class: support, predicted, correct, precision, recall and F1; then the rows accuracy, macro and weighted."""
    pairs = confusion(df, truth, predicted)
    rows = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted")))).alias("x"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    own = rows.groupBy(F.col("x.label").cast("string").alias("label")).agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("correct"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    own = own.withColumn("precision", share(F.col("correct"), F.col("predicted"))).withColumn("recall", share(F.col("correct"), F.col("support")))
    own = own.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    sums = [F.sum(c).alias(c) for c in ("support", "predicted", "correct")]
    macro = own.agg(F.lit("macro").alias("label"), *sums, *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    weighted = own.agg(F.lit("weighted").alias("label"), *sums, *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])
    hit = F.sum("correct") / F.sum("support")
    accuracy = own.agg(F.lit("accuracy").alias("label"), *sums, hit.alias("precision"), hit.alias("recall"), hit.alias("f1"))
    return own.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def correctness(df: DataFrame, truth: str, predicted: str, item: str) -> DataFrame:
    """Number and first items of the right and the wrong in each class."""
    right = (F.col(truth) == F.col(predicted)).alias("correct")
    return df.groupBy(truth, right).agg(F.count("*").alias("n"), F.min(item).alias("first_item"))


def correctness_items(df: DataFrame, truth: str, predicted: str, item: str) -> DataFrame:
    """The items that were right and wrong in each class, as rows in order."""
    right = (F.col(truth) == F.col(predicted)).alias("correct")
    return df.select(truth, right, item).sort(truth, "correct", item)


def error_totals(df: DataFrame, group: str) -> DataFrame:
    """Sums of c, s, i, d and reference words, WER and SER in percent, by group and for all (group null)."""
    errors = F.col("s") + F.col("i") + F.col("d")
    out = df.rollup(group).agg(
        *[F.sum(x).alias(x) for x in "csid"], F.sum("n_ref").alias("n_ref"), F.count("*").alias("n_utterances"), F.sum(F.when(errors > 0, 1).otherwise(0)).alias("n_wrong")
    )
    wer = F.when(F.col("n_ref") > 0, F.round(100.0 * (F.col("s") + F.col("i") + F.col("d")) / F.col("n_ref"), 2))
    return out.withColumn("wer", wer).withColumn("ser", F.round(100.0 * F.col("n_wrong") / F.col("n_utterances"), 2))


def corpus_wer(df: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """Edits and reference words over all pairs, and their quotient. A pair with a null has no edits.

    One map over the texts: they are taken apart in the task, where each batch leaves its sums alone.
    """
    sums = df.select(reference.alias("r"), hypothesis.alias("h")).mapInArrow(text_edits(LONG), "e long, n long")
    return sums.agg(F.sum("e").alias("edits"), F.sum("n").alias("n_ref")).withColumn("wer", F.col("edits") / F.col("n_ref"))


def majority_mapping(df: DataFrame, speaker: str, cluster: str) -> DataFrame:
    """The cluster that holds most of each speaker's rows; of equals the smallest."""
    counts = df.groupBy(speaker, cluster).agg(F.count("*").alias("n"))
    w = Window.partitionBy(speaker).orderBy(F.desc("n"), cluster)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def relabelled(df: DataFrame, mapping: DataFrame, speaker: str, cluster: str) -> DataFrame:
    """Each row's cluster as a speaker: the largest speaker mapped to it, or unk."""
    names = mapping.groupBy(F.col(cluster).alias("_c")).agg(F.max(speaker).alias("hypothesis"))
    return df.join(names, F.col(cluster) == F.col("_c"), "left").withColumn("hypothesis", F.coalesce(F.col("hypothesis").cast("string"), F.lit("unk"))).drop("_c")


def oov(df: DataFrame, vocabulary: DataFrame, *by: str) -> DataFrame:
    """Words, words out of the vocabulary and their share, for rows (word, n)."""
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(True))
    rows = df.join(known, "word", "left").withColumn("_out", F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    return rows.groupBy(*by).agg(F.sum("n").alias("n_words"), F.sum("_out").alias("n_oov")).withColumn("share", F.col("n_oov") / F.col("n_words"))


def word_labels(words: DataFrame, label: str) -> DataFrame:
    """word, label (that of most of its rows, of equals the first) and shared (more than one label has it), in one pass."""
    counts = words.groupBy("word", label).agg(F.count("*").alias("_n"))
    return counts.groupBy("word").agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("label"), (F.count("*") > 1).alias("shared"))


def labelled_words(df: DataFrame, key: str, sentence_no: str, words: Column, sentence_label: str, word_labels: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Each sentence's words with labels: the sentence's own for words of both languages, else the word's.

    The words of both are those of ``shared``, or those flagged so in ``word_labels``. Sentences are dealt into chunks; a
    chunk asks for the labels of its different words, and its sentences take them where they lie.
    """
    own = word_labels if shared is None else word_labels.join(shared.select("word").distinct().withColumn("shared", F.lit(True)), "word", "left")
    own = own.filter(~F.coalesce("shared", F.lit(False))).select("word", F.col("label").cast("string").alias("own"))
    rows = df.select(F.col(key).alias("key"), F.col(sentence_no).alias("no"), F.col(sentence_label).cast("string").alias("label"), words.alias("words"))
    n = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "no"), F.lit(max(n, 0) // CHUNK_WORDS + 1)))
    asked = rows.groupBy("chunk").applyInArrow(_asked_words, "chunk long, word string")
    answers = asked.join(relational.small_side(own), "word").select("chunk", "word", "own")
    kinds = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("no", rows.schema["no"].dataType), T.StructField("labelled", T.StringType())])
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_labelled, kinds).select(F.col("key").alias(key), F.col("no").alias(sentence_no), "labelled")


def _asked_words(chunk: pa.Table) -> pa.Table:
    words = pc.unique(pc.list_flatten(chunk["words"].combine_chunks())).cast(pa.string())
    return pa.table([pa.repeat(pa.scalar(chunk["chunk"][0].as_py(), pa.int64()), len(words)), words], names=["chunk", "word"])


def _labelled(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The sentences of a chunk; rows of one sentence are put together by the places of their words."""
    chunk, answers = chunk.combine_chunks(), answers.combine_chunks()
    words = chunk["words"].combine_chunks()
    word, row = pc.list_flatten(words).cast(pa.string()), pc.list_parent_indices(words).to_numpy()
    keep = pc.fill_null(pc.not_equal(word, ""), False)
    sizes = np.bincount(row, minlength=len(chunk))
    pos = (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row])[keep.to_numpy(zero_copy_only=False)]
    word, row = word.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
    own = answers["own"].combine_chunks().take(pc.index_in(word, answers["word"].combine_chunks()))
    label = pc.coalesce(own, chunk["label"].combine_chunks().take(pa.array(row)))
    item = pc.binary_join_element_wise(word, label, "-", null_handling="skip")
    sentences: dict = {}
    of = np.array([sentences.setdefault(repr(x), i) for i, x in enumerate(zip(chunk["key"].to_pylist(), chunk["no"].to_pylist(), strict=True))], np.int64)
    row = of[row]
    if len(sentences) < len(of):
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], pos[i], item[i].as_py())), np.int64)
        row, item = row[order], item.take(pa.array(order))
    sizes = np.bincount(row, minlength=len(chunk))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), item)
    found = pa.array(np.flatnonzero(sizes))
    return pa.table([chunk["key"].take(found), chunk["no"].take(found), pc.binary_join(lists, " ").take(found)], names=["key", "no", "labelled"])
