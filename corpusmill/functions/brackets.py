"""Annotated transcripts: text with ``[tag: words]`` brackets and ``<noise>`` marks, parsed by array expressions.

A parsed utterance is a struct: ``brackets`` and ``words`` (arrays of structs) and ``error`` (brackets nested or unbalanced).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and the languages and noises they stand for.
LANGUAGES = {
    "FRL": "Frisian", "NL": "Dutch", "frl": "Frisian", "fr": "Frisian", "nl": "Dutch", "nl-frl": "Dutch_frisianized", "frl-sw": "Frisian",
    "en": "English", "frl-??": "frl-??", "frl-nl": "Frisian_dutchized", "frl_??": "frl-??",
}
CODE_SWITCH = "frl,nl,frl-??,frl_??,frl-nl,nl-frl,frl-sw,nl-overlap,overlap-nl,en".split(",")
TAGS = {t: "code_switch" for t in CODE_SWITCH} | {"++": "enrich", "--": "cleaning", "eh": "eh", "he": "eh", "hè": "eh"}
NOISES = "nsn,geluid,oversturing,ruis,klok,hamer,foto,applaus,microfoon,klop,tafel,koffie,stoel,water,typen,pen,papier,geklap,telefoon".split(",")
SPEECH_NOISES = "spn,spraak,kuch,lach,zucht,za,slikken,geroezemoes,ademhaling,lipsmack,he,hè,eh,nies,hoest".split(",")
SUFFIXES = {"Dutch": "nl", "Dutch_frisianized": "nl", "Frisian": "fr", "Frisian_dutchized": "fr", "English": "eng"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def spaced_noises(text: Column) -> Column:
    """A <noise> mark stands apart from its neighbours."""
    return F.regexp_replace(text, "(<[^<>]*>)", " $1 ")


def bracket_error(text: Column) -> Column:
    """Brackets that nest or don't pair."""
    left = F.regexp_replace(text, r"\[[^\[\]]*\]", "")
    return left.contains("[") | left.contains("]")


def bracket_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]*\])"))


def chunks(text: Column) -> Column:
    """What stands between brackets, trimmed; empty pieces are dropped."""
    return F.filter(F.transform(F.split(text, r"\[[^\[\]]*\]"), lambda x: F.btrim(x)), lambda x: x != "")


def _items(text: Column) -> Column:
    return F.filter(F.split(spaced_noises(text), " +"), lambda w: w != "")


def noise_word(tag: Column) -> Column:
    """<nsn> for a noise, <spn> for a noise of speech and for any other tag."""
    found = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: tag.contains(n))
    return F.when(found(NOISES), "<nsn>").when(found(SPEECH_NOISES), "<spn>").otherwise("<spn>")


def _resolved(raw: Column, tag: Column, body: Column, error: Column) -> Column:
    known = F.try_element_at(_map(TAGS), tag)
    noise = F.exists(F.array(*map(F.lit, [*NOISES, *SPEECH_NOISES])), lambda n: tag.contains(n))
    return F.struct(
        raw.alias("raw"), tag.alias("tag"), body.alias("text"),
        F.coalesce(known, F.when(noise, "noise")).alias("kind"),
        (F.coalesce(known, F.lit("")) == "code_switch").alias("code_switched"),
        F.try_element_at(_map(LANGUAGES), tag).alias("language"),
        error.alias("error"), (known.isNull() & ~noise).alias("tag_error"),
    )


def council_bracket(raw: Column) -> Column:
    """[tag: text]; runs of colons count as one, more than two colons or none are an error."""
    inner = F.regexp_replace(F.regexp_replace(raw, r"^\[|\]$", ""), ":+", ":")
    colons = F.length(inner) - F.length(F.replace(inner, F.lit(":"), F.lit("")))
    tag, body = F.btrim(F.split_part(inner, F.lit(":"), F.lit(1))), F.btrim(F.regexp_replace(inner, "^[^:]*:?", ""))
    return _resolved(raw, tag, F.btrim(F.replace(body, F.lit(":"), F.lit(" "))), (colons < 1) | (colons > 2))


def radio_bracket(raw: Column) -> Column:
    """[nl text]: a prefix of two letters is the language; spn and nsn are noises."""
    inner = F.btrim(F.regexp_replace(raw, r"^\[|\]$", ""))
    tag = F.when(inner.isin("spn", "nsn"), inner).otherwise(F.substring(inner, 1, 2))
    ok = tag.isin("nl", "fr", "en", "spn", "nsn")
    return _resolved(raw, tag, F.when(inner.isin("spn", "nsn"), F.lit("")).otherwise(F.btrim(F.substring(inner, 3, 1_000_000))), ~ok)


def _word(text: Column, language: Column, switched: Column, tag: Column) -> Column:
    broken = text.rlike(r"[\[\]{}:]")
    noise = text.rlike("^<.*>$")
    return F.struct(
        F.when(broken, "<nsn>").when(text == "<eh>", "<spn>").otherwise(text).alias("word"),
        F.when(~(broken | noise), language).alias("language"),
        switched.alias("code_switched"), tag.alias("tag"), (~(broken | noise)).alias("is_word"),
    )


def parse(text: Column, main_language: Column, kind: str = "council") -> Column:
    """brackets, words and error of an utterance; words outside brackets are in ``main_language``.

    A bracket without text gives one noise word. A bad bracket gives its words without a language, and never hides others.
    """
    read = council_bracket if kind == "council" else radio_bracket
    pieces, found = F.split(text, r"\[[^\[\]]*\]", -1), bracket_texts(text)
    none, no = F.lit(None).cast("string"), F.lit(False)

    def inside(raw: Column) -> Column:
        b = read(raw)
        own = F.transform(_items(b["text"]), lambda w: _word(w, F.when(~b["error"], b["language"]), b["code_switched"], b["tag"]))
        return F.when(F.size(own) > 0, own).otherwise(F.array(_word(noise_word(b["tag"]), none, no, b["tag"])))

    outside = lambda p: F.transform(_items(p), lambda w: _word(w, main_language, no, none))
    # n brackets part the text into n + 1 pieces: each piece is followed by its bracket
    both = F.transform(pieces, lambda p, i: F.concat(outside(p), F.coalesce(F.when(i < F.size(found), inside(F.try_element_at(found, i + 1))), F.slice(outside(p), 1, 0))))
    return F.struct(F.transform(found, read).alias("brackets"), F.flatten(both).alias("words"), bracket_error(text).alias("error"))


def suffix(language: Column) -> Column:
    return F.try_element_at(_map(SUFFIXES), language)


def text_with_tags(words: Column) -> Column:
    """word-nl, word-fr, word-eng; <spn> for words of unknown language; noises as they are; words with $$ dropped; lower."""
    one = lambda w: F.when(~w["is_word"], w["word"]).when(suffix(w["language"]).isNull(), "<spn>").otherwise(F.concat(w["word"], F.lit("-"), suffix(w["language"])))
    return F.lower(F.array_join(F.transform(F.filter(words, lambda w: ~w["word"].contains("$$")), one), " "))


def text_without_tags(words: Column) -> Column:
    """The words that have a language, lower."""
    return F.lower(F.array_join(F.transform(F.filter(words, lambda w: w["language"].isNotNull()), lambda w: w["word"]), " "))


def tag_list(words: Column) -> Column:
    """nl, fr or eng for each word with a known language."""
    return F.filter(F.transform(words, lambda w: suffix(w["language"])), lambda x: x.isNotNull())


def line_with_tags(wav: Column, start: Column, end: Column, words: Column) -> Column:
    """wav, start, end and tagged text by tabs; null where no text is left."""
    text = text_with_tags(words)
    return F.when(text != "", F.concat_ws("\t", wav, start.cast("string"), end.cast("string"), text))


def words_of(words: Column, group: str) -> Column:
    """Words whose language has the suffix ``group``: nl, fr or eng."""
    return F.transform(F.filter(words, lambda w: suffix(w["language"]) == group), lambda w: w["word"])


def languages(words: Column) -> Column:
    """Distinct languages in order of first use; unknown ones are left out."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: w["language"]), lambda x: x.isNotNull() & (x != "frl-??")))


def any_switch(words: Column) -> Column:
    return F.exists(words, lambda w: w["code_switched"])


def any_bracket(brackets: Column, what: str = "error") -> Column:
    """Whether a bracket has ``error`` or ``tag_error``."""
    return F.exists(brackets, lambda b: b[what])


def tier(label: Column) -> Column:
    """``spk1/female/fr`` as struct: kind (ok, background, rejected), speaker, gender, language."""
    parts = F.transform(F.split(label, "/"), lambda x: F.btrim(x))
    one = lambda test: F.try_element_at(F.filter(parts, test), F.lit(1))
    speaker, gender, language = one(lambda p: p.startswith("spk")), one(lambda p: p.isin("male", "female")), one(lambda p: p.isin("fr", "nl"))
    known = F.forall(parts, lambda p: p.startswith("spk") | p.isin("male", "female", "fr", "nl"))
    kind = F.when(F.lower(label).contains("background"), "background").when(known & speaker.isNotNull(), "ok").otherwise("rejected")
    return F.struct(kind.alias("kind"), speaker.alias("speaker"), gender.alias("gender"), language.alias("language"))


def transcription(source: Column, raw: Column, main_language: Column) -> Column:
    """Parse by the source's own rules; null for other sources."""
    return F.when(source == "frisian council transcripts", parse(raw, main_language, "council")).when(source == "frisian radio broadcasts", parse(raw, main_language, "radio"))
