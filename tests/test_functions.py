"""Golden rows for the text functions and parsers; the inputs are made up."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmill.functions import brackets, labels, numbers, similarity
from corpusmill.functions import text as tx


def value(spark, make, *inputs):
    """The function's result for one row of strings (or other values)."""
    df = spark.createDataFrame([Row(**{f"c{i}": x for i, x in enumerate(inputs)})])
    return df.select(make(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("v")).first().v


@pytest.mark.parametrize(("make", "given", "wanted"), [
    (tx.normalise, "Één, twa-3: ‘Fûgel’!", "een twa fûgel"),
    (tx.strip_punctuation, "a.b,c?d!e:f;g-h", "abcdefg-h"),
    (tx.plain_circumflex, "âîôûê", "aiouê"),
    (tx.fix_nbsp, "a\u00a0b", "a b"),
    (tx.split_number_compounds, "2013-2301 en 01-02-2013", "2013 2301 en 01 02 2013"),
    (tx.drop_abbreviations, "b.v.d and end.", "and end."),
    (lambda c: tx.drop_short_lines(c), "abc\nabcd", "abcd"),
    (lambda c: tx.drop_lines_with(c, ["cet"]), "a cet b\n\nkeep cetera", "keep cetera"),
    (lambda c: tx.drop_words(c, ["www"]), "a www b/c d\ne $x f", "a d\ne f"),
    (tx.stops_to_lines, "one.  two \n\n three.", "one\ntwo\nthree\n"),
    (lambda c: tx.remove_sections(c, ("{{", "}}")), "a {{b {{c}} d}} e", "a  e"),
    (lambda c: tx.remove_sections(c, ("{{", "}}")), "a {{b}} c {{d", "a  c {{d"),
    (lambda c: tx.remove_sections(c, ("__", "__")), "a __toc__ b", "a __toc__ b"),
    (lambda c: tx.remove_sections(c, ("__", "__")), "__toc__ b", " b"),
    (lambda c: tx.remove_sections(c, ("{{", "}}"), ("<", ">")), "a {{b <c}} d> e", "a  d> e"),
    (tx.clean_wiki, "x<ref name=a>cited text</ref> yes there", ""),
    (tx.clean_wiki, "Dizze tekst<ref name=a>cited text</ref> bliuwt stean. 5= goed neist b.v.d", "dizze tekst bliuwt stean\ngoed neist"),
    (tx.drop_abbreviations, "Hello end.\nNext b.v.d word here", "Hello end.\nNext word here"),
    (tx.replace_marks, "5= good 7. x", "5. good 0 x"),
    (tx.replace_marks, "x == y &nbsp 1.", "x .y 0"),
    (tx.stem, "/a/b.c/file.wav", "file"),
    (labels.strip_labels, "wurd-fr en-nl", "wurd en"),
    (labels.text_route, "a-nl b-fr", "mx"),
    (labels.dominant_language, "a-nl b-fr c-fr", "fr"),
    (labels.dominant_language, "a-nl b-fr", "fr"),
    (labels.word_language, "dag-nl", "Dutch"),
    (brackets.bracket_error, "a [nl: b [frl: c] d", True),
    (brackets.bracket_error, "goeie [nl: dag] allegear", False),
    (brackets.chunks, "goeie [nl: dag] allegear", ["goeie", "allegear"]),
    (lambda c: tx.words(brackets.spaced_noises(c)), "foo<eh>bar", ["foo", "<eh>", "bar"]),
    (tx.hms, 3725.9, "01:02:05"),
    (tx.hms, 360000.0, "100:00:00"),
    (tx.to_int, " 12x", None),
    (tx.to_int, " 12 ", 12),
    (tx.age, "1970", 30),
    (tx.age, "unknown", None),
    (tx.sex_name, "sex2", "female"),
])
def test_one_text(spark, make, given, wanted):
    assert value(spark, make, given) == wanted


def test_counts_and_contexts(spark):
    assert value(spark, tx.collapsed_word_count, "a  b") == 2
    assert value(spark, tx.collapsed_word_count, " a b ") == 4
    assert value(spark, lambda c: tx.context(tx.words(c), 11, 10), " ".join(map(str, range(40)))) == [str(i) for i in range(1, 21)]
    assert value(spark, lambda c: tx.context(tx.words(c), 2, 10), "a b c d") == ["a", "b", "c", "d"]
    assert value(spark, tx.collapse_repeats, [1, 1, 0, 1, 2, 2, 0]) == [1, 1, 2]
    assert value(spark, tx.argmax, [1.0, 5.0, 5.0]) == 1


def test_ids(spark):
    assert value(spark, tx.utterance_id, "s1", "m.wav", 7) == "s1@-@m_pk-000007"
    assert value(spark, tx.utterance_id, "s1", "x/m.wav", 12345678) == "s1@-@m_pk-12345678"
    assert tx.speaker_names(12)[0] == "speaker_01"


@pytest.mark.parametrize(("raw", "tag", "text", "error"), [("[nl: dag]", "nl", "dag", False), ("[nl::dag]", "nl", "dag", False), ("[a:b:c:d]", "a", "b c d", True), ("[dag]", "dag", "", True)])
def test_council_bracket(spark, raw, tag, text, error):
    found = value(spark, brackets.council_bracket, raw)
    assert (found.tag, found.text, found.error) == (tag, text, error)


def test_radio_bracket(spark):
    found = value(spark, brackets.radio_bracket, "[nl goede dag]")
    assert (found.tag, found.text, found.language, found.error) == ("nl", "goede dag", "Dutch", False)
    assert value(spark, brackets.radio_bracket, "[zz foo]").error


def test_parsed_utterance(spark):
    parse = lambda c: brackets.parse(c, F.lit("Frisian"))
    found = value(spark, parse, "goeie [nl: dag] allegear<eh> [x] [en: hi] {oh} [kuch:]")
    assert [w.word for w in found.words] == ["goeie", "dag", "allegear", "<spn>", "<spn>", "hi", "<nsn>", "<spn>"]
    assert [w.language for w in found.words] == ["Frisian", "Dutch", "Frisian", None, None, "English", None, None]
    assert value(spark, lambda c: brackets.text_with_tags(parse(c)["words"]), "Goeie [nl: dag] $$x") == "goeie-fr dag-nl"
    assert value(spark, lambda c: brackets.text_without_tags(parse(c)["words"]), "Goeie [nl: dag] <eh>") == "goeie dag"
    assert value(spark, lambda c: brackets.languages(parse(c)["words"]), "a [nl: b] [frl-??: c] d") == ["Frisian", "Dutch"]
    assert value(spark, lambda c: brackets.tag_list(parse(c)["words"]), "a [nl: b] [en: c]") == ["fr", "nl", "eng"]
    assert value(spark, lambda c: brackets.any_bracket(parse(c)["brackets"], "tag_error"), "a [what: b]")
    assert value(spark, lambda c: brackets.line_with_tags(F.lit("w"), F.lit(1.0), F.lit(2.0), parse(c)["words"]), "") is None


@pytest.mark.parametrize(("label", "kind"), [("spk1/female/fr", "ok"), ("background", "background"), ("spk1/x9", "rejected"), ("", "rejected")])
def test_tier(spark, label, kind):
    assert value(spark, brackets.tier, label).kind == kind


@pytest.mark.parametrize(("text", "language", "wanted"), [
    ("22", "Dutch", "tweeëntwintig"), ("25", "Dutch", "vijfentwintig"), ("32", "Frisian", "twaentritich"), ("1100", "Dutch", "elf honderd"), ("2000", "Dutch", "twee duizend"), ("2013", "Dutch", "twee duizend dertien"),
    ("1999", "Dutch", "negentien honderd negenennegentig"), ("123456789", "Dutch", "een honderd drieëntwintig miljoen vier honderd zesenvijftig duizend zeven honderd negenentachtig".replace("een honderd drie", "honderd drie")),
    ("-3", "Dutch", "min drie"), ("0,5", "Dutch", "een half"), ("-1,5", "Frisian", "min oardel"), ("3,5", "Dutch", "drie en een half"), ("0,05", "Dutch", "nul komma nul vijf"), ("2.125", "Dutch", "twee komma een twee vijf"),
    ("1234567890", "Dutch", None), ("", "Dutch", None), ("-", "Dutch", None), ("7", "Welsh", None), ("x", "Dutch", None), (None, "Dutch", None),
])
def test_number_words(text, language, wanted):
    assert numbers.spoken(text, language) == wanted


def test_number_words_column(spark):
    df = spark.createDataFrame([("5", "Dutch"), ("5", "Frisian")], "n string, l string")
    assert [r.w for r in df.select(numbers.number_words(F.col("n"), F.col("l")).alias("w")).collect()] == ["vijf", "fiif"]


def plain_edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_word_edits(spark):
    pairs = [("a b c", "a x c d"), ("", "a"), ("a a a", "a a a"), ("één twa", "twa één"), ("x", "x")]
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in pairs], "a array<string>, b array<string>")
    for r in df.select("a", "b", similarity.word_edits(F.col("a"), F.col("b")).alias("e"), similarity.word_edits_any(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.e == r.f == plain_edits(r.a, r.b)


def test_ratio(spark):
    assert value(spark, similarity.ratio, "abcd", "abxd") == 0.75
    assert value(spark, similarity.ratio, "", "") == 1.0


def test_scoring_codes(spark):
    assert tuple(value(spark, labels.csid, "3 1 0 x")) == (3, 1, 0, None)
    assert value(spark, labels.eval_codes, "C  S  x D") == ["C", "S", "D"]
    assert value(spark, lambda c: labels.utterance_wer(c, F.lit(1), F.lit(0), F.lit(1)), "a *** b c") == 66.67
    assert value(spark, lambda c: labels.utterance_wer(c, F.lit(0), F.lit(1), F.lit(0)), "***") == 0.0
    assert value(spark, lambda c: labels.utterance_language(F.split(c, " ")), "a-nl b") == "Dutch"


def test_lexicon_labels(spark):
    assert tuple(value(spark, labels.split_label, "foar-sto-fr")) == ("foar-sto", "fr")
    assert tuple(value(spark, labels.split_label, "foar")) == ("foar", "special")
    assert value(spark, lambda w, p: labels.add_label(w, p, F.lit("nl")), "dag", "d  a g") == "dag-nl\td-nl a-nl g-nl"
    assert value(spark, lambda w, p: labels.lexicon_entry(w, p, False), "dag-nl", "d-nl a-nl") == "dag\td a"


def test_tokens(spark):
    kinds = [t.kind for t in value(spark, tx.typed_tokens, "It's 3,5 km² & more.")]
    assert kinds == ["WORD", "NUMBER", "WORD", "SYMBOL", "SYMBOL", "WORD", "PUNCTUATION"]
    clean = lambda c: tx.clean_tokens(c, F.array(F.lit("ta-dy")))
    assert value(spark, clean, "Ta-dy en nij-wurd. Dat -is &") == "ta-dy en nij wurd\ndat is"
    assert value(spark, tx.clean_html, "<p>a &amp; <b>b</b></p><script>x</script>") == "a & b"
    assert value(spark, tx.is_suspect, "a_b") and not value(spark, tx.is_suspect, "a-b")
