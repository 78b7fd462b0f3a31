"""Several templates in a leaf, wordings that ordinary lines outnumber, and lines of documents without an id."""

from corpusmill.llm import line_templates


def lines(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_lines(docs).orderBy("doc_id").collect()}


def test_two_templates_that_begin_alike(spark):
    a, b = "read more about our privacy policy and cookies", "read more about the author of this story"
    own = [" ".join(chr(97 + (i * k) % 26) * k for k in range(1, 7)) for i in range(55)]
    texts = [f"{a if i < 40 else b}\n{own[i]}" for i in range(55)]
    found = lines(spark, texts)
    assert [i for i, t in found.items() if a in t] == [0] and [i for i, t in found.items() if b in t] == [40]
    assert all(own[i] in found[i] for i in range(55))


def test_a_wording_among_many_ordinary_lines(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    ordinary = [f"we went to {letters[i % 26] * 3} {letters[i * 7 % 26] * 4} {letters[i * 3 % 26] * 2} {letters[i * 11 % 26] * 5} {letters[i // 26] * 6}" for i in range(200)]
    notice = "we went to great lengths for this"
    texts = ordinary + [f"{notice} page\n{letters[i] * 9}" for i in range(12)]
    found = lines(spark, texts)
    assert [i for i, t in found.items() if notice in t] == [200]
    assert all(found[i] == t for i, t in enumerate(ordinary))


def test_rows_of_figures_stay(spark):
    texts = [f"{i} 2 {i} x 5 6" for i in range(30)]
    assert list(lines(spark, texts).values()) == texts


def test_without_ids_all_stay(spark):
    docs = spark.createDataFrame([(None, f"the same line in all of them\nown {chr(97 + i)}") for i in range(12)], "doc_id long, text string")
    assert all("the same" in r.text for r in line_templates.drop_lines(docs).collect())


def test_four_templates_in_a_leaf(spark):
    """As many rounds as there are templates in a leaf, the rarest one last."""
    notes = ["go to the office of the mayor today please", "go to the wide open garden behind our house", "go to the small blue door near that bridge", "go to the only baker who sells this bread"]
    texts, of = [], []
    for note, n in zip(notes, (12, 15, 18, 21), strict=True):
        for i in range(n):
            of.append(note)
            texts.append(f"{note}\n{chr(97 + i) * 7} {chr(97 + len(texts) % 26) * 5} own line {chr(97 + len(texts) // 26) * 3}")
    found = lines(spark, texts)
    assert [i for i, t in found.items() if of[i] in t] == [of.index(n) for n in notes]


def test_hot_leaves_are_dealt_into_parts(spark, monkeypatch):
    """The join for tables too large to broadcast gives the same lines."""
    monkeypatch.setattr(line_templates.common, "HOT_ROWS", 5)
    texts = [f"read more about our page of {chr(97 + i % 3) * 3}\nown {chr(97 + i)} {chr(97 + i) * 5}" for i in range(25)]
    wanted = lines(spark, texts)
    monkeypatch.setattr(line_templates.common, "small", lambda *a: False)
    assert lines(spark, texts) == wanted and sum("read more" in t for t in wanted.values()) == 1
