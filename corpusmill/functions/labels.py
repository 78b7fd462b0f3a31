"""Language labels on words and phonemes (``word-nl``), lexicon entries, and scoring codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_language(word: Column) -> Column:
    """Dutch for -nl, Frisian for -fr, else unknown."""
    return F.when(word.endswith("-nl"), "Dutch").when(word.endswith("-fr"), "Frisian").otherwise("unknown")


def language_flags(reference: Column, hypothesis: Column) -> Column:
    """Struct of both words' languages, whether they agree, and the direction in which Frisian and Dutch were taken for one another."""
    ref, hyp = word_language(reference), word_language(hypothesis)
    return F.struct(
        ref.alias("ref_language"), hyp.alias("hyp_language"), (ref == hyp).alias("match"),
        ((ref == "Frisian") & (hyp == "Dutch")).alias("frisian2dutch"), ((ref == "Dutch") & (hyp == "Frisian")).alias("dutch2frisian"),
    )


def utterance_language(words: Column) -> Column:
    """mix, Dutch, Frisian or unknown, by the labels that occur."""
    nl, fr = F.exists(words, lambda w: w.endswith("-nl")), F.exists(words, lambda w: w.endswith("-fr"))
    return F.when(nl & fr, "mix").when(nl, "Dutch").when(fr, "Frisian").otherwise("unknown")


def text_route(text: Column) -> Column:
    """mx, nl, fr or unk, by the labels in a text."""
    nl, fr = text.contains("-nl"), text.contains("-fr")
    return F.when(nl & fr, "mx").when(nl, "nl").when(fr, "fr").otherwise("unk")


def strip_labels(text: Column) -> Column:
    return F.regexp_replace(text, "-[a-zA-Z]+", "")


def label_counts(text: Column) -> Column:
    """Number of words with each label, as struct nl, fr."""
    return F.struct(F.regexp_count(text, F.lit(r"-nl\b")).alias("nl"), F.regexp_count(text, F.lit(r"-fr\b")).alias("fr"))


def split_label(entry: Column) -> Column:
    """name and language at the last dash; language special if there is none."""
    has = entry.contains("-")
    return F.struct(F.when(has, F.regexp_extract(entry, "^(.*)-[^-]*$", 1)).otherwise(entry).alias("name"), F.when(has, F.regexp_extract(entry, "-([^-]*)$", 1)).otherwise("special").alias("language"))


def phonemes(pronunciation: Column) -> Column:
    """name and language of each phoneme."""
    return F.transform(F.filter(F.split(pronunciation, " "), lambda p: p != ""), split_label)


def unlabelled(pronunciation: Column) -> Column:
    return F.array_join(F.transform(phonemes(pronunciation), lambda p: p["name"]), " ")


def dominant_language(pronunciation: Column) -> Column:
    """The most frequent language of the phonemes; of equals the first by name."""
    own = F.transform(phonemes(pronunciation), lambda p: p["language"])
    counted = F.transform(F.array_distinct(own), lambda x: F.struct((-F.size(F.filter(own, lambda y: y == x))).alias("n"), x.alias("language")))
    return F.array_min(counted)["language"]


def language_set(pronunciation: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(phonemes(pronunciation), lambda p: p["language"]))), ",")


def language_error(language: Column, pronunciation_languages: Column) -> Column:
    """Whether the word's language differs from that of any pronunciation (an array)."""
    return F.exists(pronunciation_languages, lambda x: x != language)


def add_label(word: Column, pronunciation: Column, label: Column) -> Column:
    """The entry with the label on the word and on each phoneme."""
    own = F.transform(F.filter(F.split(pronunciation, " "), lambda p: p != ""), lambda p: F.concat(p, F.lit("-"), label))
    return F.concat_ws("\t", F.concat(word, F.lit("-"), label), F.array_join(own, " "))


def lexicon_entry(word: Column, pronunciation: Column, keep_language: bool = True) -> Column:
    bare = lambda x: split_label(x)["name"]
    return F.concat_ws("\t", word, pronunciation) if keep_language else F.concat_ws("\t", bare(word), unlabelled(pronunciation))


def csid(counts: Column) -> Column:
    """Four whole numbers C S I D; null where they can't be read."""
    part = lambda i: F.try_element_at(F.split(F.btrim(counts), " +"), F.lit(i)).try_cast("int")
    return F.struct(part(1).alias("c"), part(2).alias("s"), part(3).alias("i"), part(4).alias("d"))


def eval_codes(line: Column) -> Column:
    return F.filter(F.split(line, " +"), lambda x: x.isin("C", "S", "I", "D"))


def utterance_wer(reference: Column, s: Column, i: Column, d: Column) -> Column:
    """100 * errors / reference words (*** is no word), to two places; 0 without reference words."""
    n = F.size(F.filter(F.split(reference, " +"), lambda w: (w != "***") & (w != "")))
    return F.when(n == 0, 0.0).otherwise(F.round(100.0 * (s + i + d) / n, 2))
