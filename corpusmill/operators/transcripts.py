"""Lines, spans and splits of transcribed speech: selections, partition assignment, subtitles, reports and models of labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions import labels, numbers
from corpusmill.functions import text as tx
from corpusmill.operators import aggregates, langid, relational
from corpusmill.operators.windows import global_rank
from corpusmill.sources.scratch import checkpointed

# Speakers that are no speakers, and the sources by the part they take in training and testing.
NO_SPEAKER = ("BACKGROUND", "COMMENT")
UNKNOWN = "UNKNOWN"
COUNCIL, RADIO, SPOKEN = "frisian council transcripts", "frisian radio broadcasts", "cgn"


# Selections


def flagged(df: DataFrame, missing: str, flag: str, value: bool = True) -> DataFrame:
    """Rows without a value in ``missing`` whose boolean ``flag`` is ``value``; a null flag is neither."""
    return df.filter(F.col(missing).isNull() & (F.col(flag) == value))


def usable_lines(lines: DataFrame, audio: DataFrame, key: str, speaker: str, rate: str = "sample_rate", least: int = 16_000) -> DataFrame:
    """Lines of recordings with a sample rate of ``least`` or more, without background and comments; a null speaker stays."""
    good = audio.filter(F.col(rate) >= least).select(key).distinct()
    return lines.filter(F.col(speaker).isNull() | ~F.col(speaker).isin(*NO_SPEAKER)).join(good, key, "left_semi")


def speech_spans(lines: DataFrame, speaker: str, start: str, end: str, rate: int = 16_000, least: int = 8_000, unknown: bool = False) -> DataFrame:
    """``span_start`` and ``span_end`` in samples, truncated, of ``least`` or more; without background, comments and (but for ``unknown``) unknown speakers."""
    dropped = NO_SPEAKER if unknown else (*NO_SPEAKER, UNKNOWN)
    rows = lines.filter(F.col(speaker).isNull() | ~F.col(speaker).isin(*dropped))
    rows = rows.withColumn("span_start", tx.samples(F.col(start), rate)).withColumn("span_end", tx.samples(F.col(end), rate))
    return rows.filter(F.col("span_end") - F.col("span_start") >= least)


def shorter_inputs(df: DataFrame, values: str, seconds: float, rate: int = 16_000) -> DataFrame:
    """Rows whose array is strictly shorter than ``seconds``; a null array goes."""
    return df.filter(F.size(values).between(0, F.lit(seconds * rate)) & (F.size(values) < seconds * rate))


def speaker_lines(lines: DataFrame, speaker: str, name) -> DataFrame:
    return lines.filter(F.col(speaker) == name)


def long_enough(df: DataFrame, samples: Iterable[str], rate: str, least: float = 2.0) -> DataFrame:
    """Rows whose recordings, given by their numbers of samples, all last ``least`` seconds or more."""
    return df.filter(F.least(*[F.col(c) for c in samples], F.lit(1 << 62)) / F.col(rate) >= least)


def mapped(df: DataFrame, **columns: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """Each row with columns made from it."""
    return df.withColumns({name: make(df) if callable(make) else make for name, make in columns.items()})


def split_rows(df: DataFrame, split: str, source: str = "source", partition: str = "partition", spoken: bool = False, radio_test: bool = False) -> DataFrame:
    """Rows of train, dev or test: train takes council and radio (and spoken Dutch), the others council alone, or radio alone."""
    inside = F.col(partition) == split
    if split == "train":
        sources = F.col(source).isin(COUNCIL, RADIO)
        return df.filter((sources & inside) | (F.col(source) == SPOKEN) if spoken else sources & inside)
    return df.filter((F.col(source) == (RADIO if radio_test else COUNCIL)) & inside)


def manifest_records(df: DataFrame, sentence: str, wav: Column, rate: Column, start: str, end: str) -> DataFrame:
    """One struct a row, ``record``, with the fields of a training manifest."""
    fields = (F.col(sentence).alias("sentence"), wav.alias("audiofilename"), rate.alias("sampling_rate"), F.col(start).alias("start_time"), F.col(end).alias("end_time"))
    return df.select(F.struct(*fields).alias("record"))


# Matching


def assign_partition(texts: DataFrame, lines: dict[str, DataFrame], key: list[str], order: list[str], line_order: list[str]) -> DataFrame:
    """``partition`` of each text: that of the first line with its key, looked for in the parts as given, each line used once.

    The n-th text of a key, by ``order``, meets the n-th of its lines, by part and ``line_order``: what one pass over the
    texts that takes matched lines out would give, as texts of one key are alike. Texts without a line keep the partition
    that they have, or null.
    """
    parts = relational.by_priority({name: df.select(*key, *line_order) for name, df in lines.items()}, "partition")
    lined = parts.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy("priority", *line_order))).select(*key, "occurrence", "partition")
    numbered = texts.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    found = numbered.withColumnRenamed("partition", "_old").join(lined, [*key, "occurrence"], "left").drop("occurrence")
    return found.withColumn("partition", F.coalesce("partition", "_old")).drop("_old") if "partition" in texts.columns else found


def language_by_id(rows: DataFrame, tagged: DataFrame, key: str, language: str) -> DataFrame:
    """Rows of one run with the language that another run's utterance of the same id has."""
    return rows.drop(language).join(tagged.select(key, language), key)


def zipped(a: DataFrame, b: DataFrame, a_order: list[str], b_order: list[str]) -> DataFrame:
    """The n-th row of ``a`` with the n-th of ``b``; what is left of the longer goes."""
    return global_rank(a, a_order, "position").join(global_rank(b, b_order, "position"), "position")


def bilingual_split(lexicon: DataFrame, language: str = "language", names: tuple[str, str] = ("Dutch", "Frisian")) -> tuple[DataFrame, DataFrame]:
    """A lexicon's two languages; entries of another language or of none are in neither."""
    return tuple(lexicon.filter(F.col(language) == n) for n in names)


def subtitles(utterances: DataFrame, texts: DataFrame, key: str = "pk") -> tuple[DataFrame, DataFrame]:
    """Rows of subtitles and of their scores, for utterances with a hypothesis: key, meeting, wav, language, start, end, and hyp or codes."""
    met = utterances.filter(F.col("hyp") != "").join(texts, key)
    own = [F.col(key), F.col("meeting"), F.col("wav"), F.col("language"), F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end")]
    return met.select(*own, "hyp"), met.select(*own, F.regexp_replace(F.array_join(F.filter(F.split("codes", " "), lambda c: c.isin(*"CISD")), " "), " +", " ").alias("codes"))


# Reports


def split_durations(df: DataFrame, split: str, duration: str) -> DataFrame:
    """Segments, seconds and HH:MM:SS of each split."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(duration).alias("seconds")).withColumn("time", tx.hms(F.col("seconds")))


def sifted(df: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Texts cleaned of foreign lines, bad words and short lines (key, kept), and what was taken out (key, rule, item)."""
    found = df.select(key, tx.sifted(text).alias("s"))
    return found.select(key, "s.kept"), found.select(key, F.inline("s.rejected"))


def rejected_items(rejected: DataFrame, item: str) -> DataFrame:
    """The different items that were rejected, with their number, in order."""
    return rejected.groupBy(item).agg(F.count("*").alias("n")).sort(item)


def rejected_report(rejected: DataFrame, item: str, joint: str | None = " &&& ") -> DataFrame:
    """How many were rejected and how many different ones; with ``joint`` also these, in order, as one text.

    That text is one row whatever its length: a report to be read. ``rejected_items`` has them as rows.
    """
    counts = rejected.groupBy(item).agg(F.count("*").alias("n"))
    text = [F.array_join(F.array_sort(F.collect_list(item)), joint).alias("items")] if joint is not None else []
    return counts.agg(F.sum("n").alias("n_rejected"), F.count("*").alias("n_distinct"), *text)


def unknown_words(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words (word, n) that the vocabulary lacks, the most frequent first."""
    return global_rank(relational.absent(counts.select((-F.col("n")).alias("order"), "word", "n"), vocabulary.select("word").distinct(), ["word"]), ["order", "word"], "rank", 1).drop("order")


def sorted_vocabulary(vocabulary: DataFrame, word: str = "char", number: str = "id") -> DataFrame:
    """Lower-case words by number; of those that become one word the last number counts, at the first one's place."""
    rows = vocabulary.groupBy(F.lower(word).alias(word)).agg(F.min(number).alias("place"), F.max(number).alias(number))
    return rows.orderBy("place").select(word, number)


def meetings_for_share(total: float, share: float, duration: float) -> int:
    """How many meetings of ``duration`` make up a share of all speech."""
    return round(total * share / duration)


# Labels


def label_pairs(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """truth and predicted, item by item, of two arrays; rows whose arrays differ in length are left out."""
    rows = df.select(*by, truth.alias("t"), predicted.alias("p")).filter(F.size("t") == F.size("p"))
    return rows.select(*by, F.explode(F.arrays_zip("t", "p")).alias("x")).select(*by, F.col("x.t").alias("truth"), F.col("x.p").alias("predicted"))


def labeller_evaluation(df: DataFrame, truth: Column, predicted: Column) -> tuple[DataFrame, DataFrame]:
    """Confusion and class report of a labeller over the words of all sentences."""
    pairs = label_pairs(df, truth, predicted)
    return aggregates.confusion(pairs, "truth", "predicted"), aggregates.class_report(pairs, "truth", "predicted")


def evaluation_without(df: DataFrame, item: str, truth: str, predicted: str, overlap: DataFrame) -> DataFrame:
    """Confusion before and after items of ``overlap`` are taken out (scope all, rest), and of those (scope removed)."""
    both = overlap.select(F.col(item).alias("_item")).distinct().withColumn("_both", F.lit(True))
    rows = df.join(both, F.col(item) == F.col("_item"), "left")
    scopes = F.when(F.col("_both"), F.array(F.lit("all"), F.lit("removed"))).otherwise(F.array(F.lit("all"), F.lit("rest")))
    return rows.select(F.explode(scopes).alias("scope"), truth, predicted).groupBy("scope", truth, predicted).agg(F.count("*").alias("n"))


def gender_mapping(mapping: Column) -> Column:
    """A cluster (0 or 1) for both genders, from a map of genders to clusters: the one not given, or given like male, is the other."""
    male, female = F.try_element_at(mapping, F.lit("male")), F.try_element_at(mapping, F.lit("female"))
    her = F.when(female.isNull() | (female == male), F.when(male == 0, 1).otherwise(0)).otherwise(female)
    return F.create_map(F.lit("male"), F.coalesce(male, F.when(female == 0, 1).otherwise(0)), F.lit("female"), her)


def predict_text(df: DataFrame, key: str, text: Column, model: tuple[DataFrame, DataFrame, DataFrame], label: str, low: int = 2, high: int = 5) -> DataFrame:
    """key, ``main`` (the label of the whole text), and ``sentences``: for each label found its lines, in order; empty lines are left out."""
    rows = df.select(F.col(key).alias("_key"), text.alias("_text"))
    lines = rows.select("_key", F.posexplode(tx.sentences(F.col("_text"))).alias("_no", "_text")).filter("_text != ''")
    items = lines.unionByName(rows.withColumn("_no", F.lit(-1))).withColumn("_id", F.struct("_key", "_no"))
    found = langid.predict(items, "_id", F.col("_text"), model, label, low, high).select(F.col("_id._key").alias("_key"), F.col("_id._no").alias("_no"), F.col(label).alias("_label"))
    main = found.filter("_no < 0").select(F.col("_key").alias(key), F.col("_label").alias("main"))
    told = lines.join(found, ["_key", "_no"])
    by_label = told.groupBy("_key", "_label").agg(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_text"))), lambda x: x["_text"]).alias("_lines"))
    grouped = by_label.groupBy(F.col("_key").alias(key)).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_label", "_lines")))).alias("sentences"))
    return main.join(grouped, key, "left").withColumn("sentences", F.coalesce("sentences", F.create_map().cast("map<string,array<string>>")))


#: Bytes of text that meet the cleaned words together.
CHUNK_BYTES = 16_000_000


def clean_corpus(df: DataFrame, key: str, text: str, language: Column, lexicon: DataFrame) -> DataFrame:
    """``clean`` for each row: numbers in words of the row's language, stops as lines, dashes by the lexicon (word).

    White space parts tokens, so that what stands between two spaces is cleaned by itself: each different word once, for all
    texts. Texts are dealt into chunks; a chunk asks for its different words, and its texts are put together where they lie.
    """
    rows = df.withColumn("_text", F.col(text)).withColumn("_language", F.coalesce(language.cast("string"), F.lit("")))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(key, text), F.lit(size // CHUNK_BYTES + 1)))
    told = rows.select("_chunk", "_text", "_language")
    asked = checkpointed(told.groupBy("_chunk").applyInArrow(_asked_words, "chunk long, word string, language string"))
    words = _clean_words(asked.select("word", "language").distinct(), lexicon)
    answers = asked.join(words, ["word", "language"]).select("chunk", "word", "language", "clean")
    kinds = T.StructType([*df.schema.fields, T.StructField("clean", T.StringType())])
    return rows.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_put_together, kinds)


def _clean_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, language, clean. Only words with a dash meet the lexicon, and only those with a digit go to Python."""
    dashed = words.filter(F.col("word").contains("-")).select("word", "language", F.explode(tx.dashed_words(F.col("word"))).alias("token"))
    known = dashed.join(lexicon.select(F.col("word").alias("token")).distinct(), "token", "left_semi").groupBy("word", "language").agg(F.collect_set("token").alias("known"))
    digit = F.col("word").rlike("[0-9]")
    said = words.filter(digit).withColumn("numbers", numbers.number_map(tx.number_tokens(F.col("word")), F.col("language")))
    rows = said.unionByName(words.filter(~digit).withColumn("numbers", F.lit(None).cast("map<string,string>"))).join(known, ["word", "language"], "left")
    return rows.select("word", "language", tx.clean_tokens(F.col("word"), F.coalesce("known", F.array().cast("array<string>")), F.col("numbers")).alias("clean"))


def _parted(text: str | None) -> list[bytes]:
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


def _plain(word: bytes) -> bool:
    """Letters from a to z are one token, whose clean form is in lower case."""
    return word.isalpha() and word.isascii()


def _asked_words(chunk: pa.Table) -> pa.Table:
    """The different words of a chunk, by language."""
    found: dict[str, set[bytes]] = {}
    for t, name in zip(chunk["_text"], chunk["_language"].to_pylist(), strict=True):
        found.setdefault(name, set()).update(_parted(t))
    asked = [(w.decode(), name) for name, words in found.items() for w in words if not _plain(w)]
    return pa.table([pa.array([chunk["_chunk"][0].as_py()] * len(asked), pa.int64()), *(pa.array([a[i] for a in asked], pa.string()) for i in range(2))], names=["chunk", "word", "language"])


def _put_together(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The rows of a chunk with their clean texts."""
    clean: dict[str, dict[bytes, str]] = {}
    for name, word, form in zip(*(answers[c].to_pylist() for c in ("language", "word", "clean")), strict=True):
        clean.setdefault(name, {})[word.encode()] = form
    out = []
    for t, name in zip(chunk["_text"], chunk["_language"].to_pylist(), strict=True):
        if not t.is_valid:
            out.append(None)
            continue
        forms, line = clean.setdefault(name, {}), []
        for w in _parted(t):
            if (form := forms.get(w)) is None:
                form = forms[w] = w.decode().lower()  # a plain one
            if form:
                line.append(form)
        line = " ".join(line)
        out.append(re.sub("\n+", "\n", re.sub(" ?\n ?", "\n", line)) if "\n" in line else line)
    rows = chunk.drop_columns(["_text", "_language", "_chunk"])
    return rows.append_column("clean", pa.array(out, pa.string()))


def word_flags(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Each word pair with its languages and the direction of a mix-up."""
    return df.select("*", labels.language_flags(F.col(reference), F.col(hypothesis)).alias("flags")).select(*df.columns, "flags.*")
