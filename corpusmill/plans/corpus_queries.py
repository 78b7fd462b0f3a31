"""The library's operators at work on the driver's tables, each with the SQL that must give the same rows.

Stand-ins: documents are texts, conversations are meetings with turns as segments and roles as speakers, events are timed
segments (user = meeting, value = seconds), embeddings are segment vectors with labels as groups, pages are markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import brackets, labels, numbers, similarity
from corpusmill.functions import text as tx
from corpusmill.operators import aggregates as ag
from corpusmill.operators import cluster, langid, ngramlm, relational, splits, windows
from corpusmill.sources import sinks
from corpusmill.sources.readers import scan
from corpusmill.sources.scratch import checkpointed, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = f"translate(lower(regexp_replace(text, {_sql_text(tx.SPECIAL_CLASS)}, '', 'g')), 'öäàüùóèïëé', 'oaauuoeiee')"
_WORDS = f"SELECT doc_id, lang, source, unnest(string_split({_NORM}, ' ')) AS word FROM documents"


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return scan(spark, f"{d}/documents.parquet", columns=list(columns) or None)


def _words(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Rows of the normalised words."""
    return _documents(spark, d, *by, "text").select(*by, F.explode(tx.words(tx.normalise(F.col("text")))).alias("word")).filter("word != ''")


# Words and letters


@query(f"""SELECT lang, word, n, rank FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank
FROM (SELECT lang, word, count(*) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY ALL)) WHERE rank <= 20""")
def word_freq_topk_by_lang(spark: SparkSession, d: str) -> DataFrame:
    counts = _words(spark, d, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return ag.top_words(counts, 20, "lang").select("lang", "word", "n", "rank")


@query("SELECT letter, count(*) - CASE WHEN letter = ' ' THEN 1 ELSE 0 END AS n FROM (SELECT unnest(string_split(' ' || text, '')) AS letter FROM documents) WHERE letter <> '' GROUP BY letter")
def letter_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ag.letter_counts(_documents(spark, d, "text"), F.col("text"))


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents), k AS (SELECT char FROM c WHERE char <> ''),
r AS (SELECT CASE WHEN char = ' ' THEN '|' ELSE char END AS char, CAST(row_number() OVER (ORDER BY char) - 1 AS INTEGER) AS id FROM k)
SELECT * FROM r UNION ALL SELECT '[UNK]', CAST(count(*) AS INTEGER) FROM k UNION ALL SELECT '[PAD]', CAST(count(*) + 1 AS INTEGER) FROM k""")
def char_vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    return ag.char_vocabulary(_documents(spark, d, "text"), F.col("text"))


@query(f"SELECT n, count(*) AS n_words, min(word) AS first_word FROM (SELECT word, count(*) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY word) GROUP BY n")
def inverted_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ag.inverted_counts(_words(spark, d).groupBy("word").agg(F.count("*").alias("n")))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), ' ')) AS n_words FROM documents")
def collapsed_word_count(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "doc_id", "text").select("doc_id", tx.collapsed_word_count(F.col("text")).cast("long").alias("n_words"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[11:30], ' ') AS context FROM documents")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "doc_id", "text").select("doc_id", F.array_join(tx.context(tx.words(F.col("text")), 20), " ").alias("context"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT ws[i] AS word, ws[i + 1] AS next FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w))
SELECT word, next, count(*) AS n FROM p GROUP BY ALL""")
def next_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    return windows.next_word_counts(_documents(spark, d, "text"), tx.normalise(F.col("text")))


# Filters


@query("""SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.n_chars BETWEEN 200 AND 5000 AND d.text <> '' AND NOT (l.quality < 1 AND l.quality IS NOT NULL)""")
def filter_texts_range_exclude(spark: SparkSession, d: str) -> DataFrame:
    quality = scan(spark, f"{d}/labels.parquet", columns=["doc_id", "quality"])
    rows = _documents(spark, d, "doc_id", "n_chars", "text").join(quality, "doc_id", "left")
    return relational.quality_filter(rows, 200, 5000, "n_chars", "quality", 1, "text").select("doc_id", "n_chars", "quality")


@query("SELECT source, count(*) AS n FROM documents WHERE source = 'src0' OR source = 'src3' GROUP BY source")
def source_or_union(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "source").filter(relational.either("source", "src0", "src3")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ge%'")
def icontains_filter(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/part.parquet", relational.icontains("p_name", "GE"), ["p_partkey", "p_name"])


@query("""SELECT source, sum(CASE WHEN n_chars >= 500 AND lang IS NOT NULL THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN n_chars >= 500 AND lang IS NOT NULL THEN 0 ELSE 1 END) AS rejected
FROM documents GROUP BY source""")
def accepted_and_rejected(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce((F.col("n_chars") >= 500) & F.col("lang").isNotNull(), F.lit(False))
    return _documents(spark, d, "source", "n_chars", "lang").groupBy("source").agg(F.sum(ok.cast("int")).alias("accepted"), F.sum((~ok).cast("int")).alias("rejected"))


@query("""SELECT r, count(*) AS n FROM (SELECT CASE WHEN nl AND fr THEN 'mx' WHEN nl THEN 'nl' WHEN fr THEN 'fr' ELSE 'unk' END AS r
FROM (SELECT contains(t, '-nl') AS nl, contains(t, '-fr') AS fr FROM (SELECT CASE lang WHEN 'en' THEN 'a-nl b-fr' WHEN 'de' THEN 'a-nl' WHEN 'fr' THEN 'a-fr' ELSE 'a' END AS t FROM documents))) GROUP BY r""")
def language_route(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.when(F.col("lang") == "en", "a-nl b-fr").when(F.col("lang") == "de", "a-nl").when(F.col("lang") == "fr", "a-fr").otherwise("a")
    return _documents(spark, d, "lang").select(labels.text_route(tagged).alias("r")).groupBy("r").agg(F.count("*").alias("n"))


# Joins


@query("""SELECT r.r_name, count(*) AS n_customers, sum(CAST(round(c.c_acctbal * 100) AS BIGINT))::BIGINT AS cents
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def fk_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    customers = scan(spark, f"{d}/customer.parquet", columns=["c_nationkey", "c_acctbal"])
    nations = relational.with_dimension(customers, scan(spark, f"{d}/nation.parquet"), "c_nationkey", "n_nationkey")
    regions = relational.with_dimension(nations, scan(spark, f"{d}/region.parquet"), "n_regionkey", "r_regionkey")
    return regions.groupBy("r_name").agg(F.count("*").alias("n_customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


@query("""WITH b AS (SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM documents GROUP BY source),
s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT s.source, s.n, coalesce(b.languages, '') AS languages FROM s LEFT JOIN b USING (source)""")
def m2m_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d, "source", "lang")
    facts = docs.groupBy("source").agg(F.count("*").alias("n"))
    rows = relational.many_to_many(facts, docs.distinct(), "source", "lang", "found")
    return rows.select("source", "n", relational.display_languages(F.col("found"), F.lit(None).cast("string")).alias("languages"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def insert_if_absent_anti(spark: SparkSession, d: str) -> DataFrame:
    stored = scan(spark, f"{d}/orders.parquet", columns=["o_custkey"]).withColumnRenamed("o_custkey", "c_custkey")
    return sinks.missing_rows(scan(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name"]), stored, ["c_custkey"])


_PARTS = ["red", "ring", "gear", "bl", "hot w"]


@query(f"""WITH k AS (SELECT unnest({_PARTS}) AS prefix)
SELECT coalesce(k.prefix, '(none)') AS prefix, count(*) AS n FROM part p LEFT JOIN k ON contains(p.p_name, k.prefix) GROUP BY 1""")
def theta_contains_join(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name"])
    parts = spark.createDataFrame([(p,) for p in _PARTS], "prefix string")
    met = relational.contains_join(rows, parts, "p_name", "prefix").select("prefix")
    rest = relational.contains_rest(rows, parts, "p_name", "prefix").select(F.lit("(none)").alias("prefix"))
    return met.unionAll(rest).groupBy("prefix").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, accepted, rejected FROM (SELECT c.c_custkey, sum(CASE WHEN o.o_totalprice >= 100000 AND o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS accepted,
sum(CASE WHEN o.o_totalprice >= 100000 AND o.o_orderstatus = 'O' THEN 0 ELSE 1 END) AS rejected FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1) WHERE accepted >= 2""")
def speaker_segment_residual_join(spark: SparkSession, d: str) -> DataFrame:
    orders = scan(spark, f"{d}/orders.parquet", columns=["o_custkey", "o_totalprice", "o_orderstatus"])
    ok = (F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") == "O")
    return relational.kept_children(scan(spark, f"{d}/customer.parquet", columns=["c_custkey"]), orders, "c_custkey", "o_custkey", ok)


@query("""SELECT e.event_id, e.user_id, a.rate, a.rate IS NOT NULL AS has_audio FROM events e LEFT JOIN (SELECT DISTINCT user_id, 8000 * (1 + user_id % 3) AS rate FROM events WHERE user_id % 5 <> 0) a USING (user_id)""")
def tables_with_audio(spark: SparkSession, d: str) -> DataFrame:
    """Events as tables and users as recordings, a fifth of which are missing."""
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id", "user_id"])
    audio = rows.filter("user_id % 5 != 0").select(F.col("user_id").alias("id"), (8000 * (1 + F.col("user_id") % 3)).alias("rate"))
    met, missing = relational.with_audio(rows, audio, "user_id", "id")
    both = met.withColumn("has_audio", F.lit(True)).unionByName(missing.withColumn("has_audio", F.lit(False)), allowMissingColumns=True)
    return both.select("event_id", "user_id", "rate", "has_audio")


@query("SELECT coalesce(l.quality, -1) AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def left_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.lookup(_documents(spark, d, "doc_id"), scan(spark, f"{d}/labels.parquet", columns=["doc_id", "quality"]), "doc_id", "quality", -1)
    return rows.groupBy("quality").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, n_name, coalesce(k.n, 0) AS n_children FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) k ON k.s_nationkey = n_nationkey""")
def counted_children(spark: SparkSession, d: str) -> DataFrame:
    nations = scan(spark, f"{d}/nation.parquet", columns=["n_nationkey", "n_name"])
    suppliers = scan(spark, f"{d}/supplier.parquet", columns=["s_nationkey"]).withColumnRenamed("s_nationkey", "n_nationkey")
    return relational.counted_children(nations, suppliers, "n_nationkey")


_BENCH = f"SELECT DISTINCT word FROM (SELECT unnest(string_split({_NORM}, ' ')) AS word FROM benchmark) WHERE word <> ''"


def _bench_words(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/benchmark.parquet", columns=["text"]).select(F.explode(tx.words(tx.normalise(F.col("text")))).alias("word")).filter("word != ''").distinct()


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE word IN ({_BENCH}) GROUP BY word")
def semi_vocab_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).join(_bench_words(spark, d), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) WHERE word <> '' AND word NOT IN ({_BENCH}) GROUP BY word")
def anti_vocab_new_words(spark: SparkSession, d: str) -> DataFrame:
    counts = _words(spark, d).groupBy("word").agg(F.count("*").alias("n"))
    return relational.absent(counts, _bench_words(spark, d), ["word"])


@query(f"""WITH w AS (SELECT DISTINCT word, lang FROM ({_WORDS}) WHERE word <> ''), f AS (SELECT word, bool_or(lang = 'en') AS en, bool_or(lang = 'de') AS de FROM w GROUP BY word)
SELECT en AS english, de AS german, word IN ({_BENCH}) AS shared, count(*) AS n FROM f GROUP BY ALL""")
def word_list_membership(spark: SparkSession, d: str) -> DataFrame:
    own = _words(spark, d, "lang").distinct()
    lists = {"english": own.filter("lang = 'en'"), "german": own.filter("lang = 'de'"), "shared": _bench_words(spark, d)}
    return relational.membership(own.select("word").distinct(), lists).groupBy("english", "german", "shared").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT DISTINCT lang, word FROM ({_WORDS}) WHERE word <> ''), a AS (SELECT word FROM w WHERE lang = 'en'), b AS (SELECT word FROM w WHERE lang = 'fr')
(SELECT word FROM a EXCEPT SELECT word FROM b) UNION ALL (SELECT word FROM b EXCEPT SELECT word FROM a)""")
def vocab_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return relational.held_by_one(_words(spark, d, "lang").filter("lang in ('en', 'fr')"), "word", "lang")


@query("""WITH a AS (SELECT doc_id AS left_id, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS occurrence FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id AS right_id, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS occurrence FROM documents WHERE doc_id % 2 = 1)
SELECT left_id, right_id, occurrence FROM a JOIN b USING (k, occurrence)""")
def occurrence_number_join(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d, "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    left = docs.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id")
    right = docs.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return relational.occurrence_join(left, right, ["k"], ["left_id"], ["right_id"]).select("left_id", "right_id", F.col("occurrence").cast("long").alias("occurrence"))


# Scores


_PAIRS = """SELECT conv_id, turn, role, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)), ' ') AS b FROM conversations"""
_CSID = f"""SELECT conv_id, turn, role, len(a) AS n_ref, len(list_filter(z, lambda x: x[1] = x[2])) AS c, len(list_filter(z, lambda x: x[1] <> x[2])) AS s,
len(list_filter(z, lambda x: x[1] IS NULL)) AS i, len(list_filter(z, lambda x: x[2] IS NULL)) AS d FROM (SELECT *, list_zip(a, b) AS z FROM ({_PAIRS}) WHERE b IS NOT NULL)"""


def _csid(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next, item by item: C equal, S unequal, I and D where one side is longer."""
    from pyspark.sql.window import Window

    rows = scan(spark, f"{d}/conversations.parquet")
    then = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", F.md5(F.col("text").cast("binary"))))
    rows = rows.select("conv_id", "turn", "role", F.split("text", " ").alias("a"), F.split(then, " ").alias("b")).filter("b is not null")
    z = F.arrays_zip("a", "b")
    n = lambda test: F.size(F.filter(z, test)).cast("long")
    return rows.select(
        "conv_id", "turn", "role", F.size("a").cast("long").alias("n_ref"), n(lambda x: x["a"] == x["b"]).alias("c"), n(lambda x: x["a"] != x["b"]).alias("s"),
        n(lambda x: x["a"].isNull()).alias("i"), n(lambda x: x["b"].isNull()).alias("d"),
    )


@query(_CSID)
def positional_zip_compare(spark: SparkSession, d: str) -> DataFrame:
    return _csid(spark, d)


@query(f"""SELECT role, sum(c)::BIGINT AS c, sum(s)::BIGINT AS s, sum(i)::BIGINT AS i, sum(d)::BIGINT AS d, sum(n_ref)::BIGINT AS n_ref, count(*) AS n_utterances,
sum(CASE WHEN s + i + d > 0 THEN 1 ELSE 0 END)::BIGINT AS n_wrong, CASE WHEN sum(n_ref) > 0 THEN round(100.0::DOUBLE * (sum(s) + sum(i) + sum(d))::DOUBLE / sum(n_ref)::DOUBLE, 2) END AS wer,
round(100.0::DOUBLE * sum(CASE WHEN s + i + d > 0 THEN 1 ELSE 0 END)::DOUBLE / count(*), 2) AS ser FROM ({_CSID}) GROUP BY ROLLUP (role)""")
def wer_rollup_by_group(spark: SparkSession, d: str) -> DataFrame:
    return ag.error_totals(_csid(spark, d), "role")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)), ' ') AS b FROM conversations),
p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, array_to_string(a, chr(32))) AS no FROM t WHERE b IS NOT NULL),
r(no, i, d) AS (SELECT no, 0::BIGINT, range(0, len(b) + 1) FROM p UNION ALL
  SELECT no, i + 1, list_transform(c, lambda x, j: list_min(list_transform(c[1:j], lambda y, t: y + j - t))) FROM (
    SELECT r.no, i, list_concat([i + 1], list_transform(range(1, len(b) + 1), lambda j: least(d[j + 1] + 1, d[j] + (a[i + 1] <> b[j])::BIGINT))) AS c FROM r JOIN p USING (no) WHERE i < len(a)))
SELECT conv_id, turn, d[len(b) + 1] AS edits, len(a) AS n_ref FROM p JOIN r USING (no) WHERE i = len(a)""")
def word_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of each turn's words to the next turn's, in SQL row by row of the dynamic program; tests hold it against a plain one, too."""
    from pyspark.sql.window import Window

    rows = scan(spark, f"{d}/conversations.parquet")
    then = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", F.md5(F.col("text").cast("binary"))))
    rows = rows.select("conv_id", "turn", F.split("text", " ").alias("a"), F.split(then, " ").alias("b")).filter("b is not null")
    return similarity.with_word_edits(rows, "a", "b").select("conv_id", "turn", "edits", F.size("a").alias("n_ref"))


@query()
def corpus_word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Edits over reference words of the corpus, for texts against their own normalised form."""
    return ag.corpus_wer(_documents(spark, d, "text"), F.col("text"), tx.normalise(F.col("text")))


@query()
def string_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each benchmark item to the next, by characters."""
    items = scan(spark, f"{d}/benchmark.parquet")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return items.join(after, "item_id").select("item_id", similarity.ratio(F.col("text"), F.col("other")).alias("ratio"), similarity.levenshtein(F.col("text"), F.col("other")).alias("distance"))


_LABELLED = "SELECT l.doc_id, l.quality, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    truth = scan(spark, f"{d}/labels.parquet", columns=["doc_id", "quality"])
    return truth.join(_documents(spark, d, "doc_id", "n_chars"), "doc_id").select("doc_id", "quality", (F.col("n_chars") >= 300).cast("int").alias("predicted"))


@query(f"SELECT quality, predicted, count(*) AS n FROM ({_LABELLED}) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ag.confusion(_labelled(spark, d), "quality", "predicted")


@query(f"""WITH p AS ({_LABELLED}), k AS (SELECT unnest([0, 1]) AS label),
c AS (SELECT label::VARCHAR AS label, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE predicted = label) AS predicted, count(*) FILTER (WHERE quality = label AND predicted = label) AS correct FROM p, k GROUP BY k.label),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE correct::DOUBLE / support END AS recall FROM c)
SELECT label, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r
UNION ALL SELECT 'accuracy', sum(support)::BIGINT, sum(predicted)::BIGINT, sum(correct)::BIGINT, round(sum(correct)::DOUBLE / sum(support)::DOUBLE, 6), round(sum(correct)::DOUBLE / sum(support)::DOUBLE, 6), round(sum(correct)::DOUBLE / sum(support)::DOUBLE, 6) FROM r""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    rows = ag.class_report(_labelled(spark, d), "quality", "predicted").filter("label not in ('macro', 'weighted')")
    return rows.select("label", "support", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT quality, quality = predicted AS correct, count(*) AS n, min(doc_id) AS first_item FROM ({_LABELLED}) GROUP BY ALL")
def correctness_lists(spark: SparkSession, d: str) -> DataFrame:
    return ag.correctness(_labelled(spark, d), "quality", "predicted", "doc_id")


@query(f"""WITH v AS (SELECT DISTINCT word FROM ({_WORDS}) WHERE source = 'src0' AND word <> '')
SELECT w.lang, count(*) AS n_words, sum(CASE WHEN v.word IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_oov, round(sum(CASE WHEN v.word IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS share
FROM ({_WORDS}) w LEFT JOIN v ON v.word = w.word WHERE w.word <> '' GROUP BY w.lang""")
def oov_share(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d, "lang", "source")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    found = ag.oov(counts, words.filter("source = 'src0'").select("word"), "lang")
    return found.withColumn("share", F.round("share", 6))


@query(f"""WITH w AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(string_split({_NORM}, ' ')) AS word, generate_subscripts(string_split({_NORM}, ' '), 1) AS pos FROM documents)),
v AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS idx FROM (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 500))
SELECT w.doc_id, sum(coalesce(v.idx, 0) * (w.pos % 97))::BIGINT AS mark, count(*) AS n, count(v.idx) AS n_known FROM w LEFT JOIN v ON v.word = w.word GROUP BY w.doc_id""")
def encode_words(spark: SparkSession, d: str) -> DataFrame:
    """Words as numbers of the 500 most frequent, others 0; a digest of the arrays shows their order."""
    rows = written(_documents(spark, d, "doc_id", "text").withColumn("text", tx.normalise(F.col("text"))))  # read twice
    vocabulary = ag.top_words(ag.counted_words(rows, F.col("text")), 500).select("word", F.col("rank").alias("idx"))
    ids = relational.encoded(rows, "doc_id", tx.words(F.col("text")), vocabulary, 0)
    weighted = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * ((i + 1) % 97)), F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("doc_id", weighted.alias("mark"), F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x > 0)).cast("long").alias("n_known"))


# Groups


_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query(f"SELECT user_id, count(*) AS n_segments, sum({_CENTS})::BIGINT AS cents, sum(length(event_type))::BIGINT AS n_words FROM events GROUP BY user_id")
def segment_totals(spark: SparkSession, d: str) -> DataFrame:
    found = ag.segment_totals(_events(spark, d), "user_id", "cents", F.length("event_type"))
    return found.withColumnRenamed("duration", "cents")


@query("SELECT conv_id, sum(length(text))::BIGINT AS duration, count(DISTINCT role) AS n_wavs, count(*) AS n_lines FROM conversations GROUP BY conv_id")
def meeting_totals(spark: SparkSession, d: str) -> DataFrame:
    return ag.meeting_totals(scan(spark, f"{d}/conversations.parquet").withColumn("size", F.length("text")), "conv_id", "size", "role")


@query("""SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) WHERE r = 1""")
def mode_language(spark: SparkSession, d: str) -> DataFrame:
    return ag.mode(_documents(spark, d, "source", "lang"), "source", "lang")


@query("""WITH c AS (SELECT source, lang, count(*) AS n, list_position(['de', 'en', 'fr'], lang) AS p FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, p) AS k FROM c WHERE p > 0)
SELECT s.source, coalesce(r.lang, '') AS lang FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN r ON r.source IS NOT DISTINCT FROM s.source AND r.k = 1""")
def majority_language(spark: SparkSession, d: str) -> DataFrame:
    return ag.majority(_documents(spark, d, "source", "lang"), "source", "lang", ["de", "en", "fr"])


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def multimap_sources(spark: SparkSession, d: str) -> DataFrame:
    return ag.multimap(_documents(spark, d, "lang", "source"), "lang", "source", distinct=True).select("lang", F.array_join("sources", ",").alias("sources"), F.size("sources").cast("long").alias("n"))


@query("SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def doubled_texts(spark: SparkSession, d: str) -> DataFrame:
    return ag.doubles(_documents(spark, d, "text").select(F.md5(F.col("text").cast("binary")).alias("k")), "k")


@query("""WITH e AS (SELECT vec_id, label, vec_id % 7 AS cluster FROM embeddings), c AS (SELECT label, cluster, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT label, cluster FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) = 1), h AS (SELECT cluster, max(label) AS hypothesis FROM m GROUP BY cluster)
SELECT e.label, coalesce(h.hypothesis::VARCHAR, 'unk') AS hypothesis, count(*) AS n FROM e LEFT JOIN h USING (cluster) GROUP BY ALL""")
def majority_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "label"]).withColumn("cluster", F.col("vec_id") % 7)
    mapping = ag.majority_mapping(rows, "label", "cluster")
    return ag.confusion(ag.relabelled(rows, mapping, "label", "cluster"), "label", "hypothesis")


# Order


_TIMED = f"SELECT event_id, user_id, ts, {_CENTS} AS cents FROM events"


@query(f"""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS index, coalesce(sum(cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ({_TIMED})
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def meeting_running_offset(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_offset(_events(spark, d), "user_id", ["ts", "event_id"], "cents").select("event_id", "index", "offset")


_SPANS = f"SELECT event_id, user_id, event_id * 10000 AS s, event_id * 10000 + {_CENTS} AS e, 100000000 AS total FROM events"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", "user_id", (F.col("event_id") * 10000).alias("s"), (F.col("event_id") * 10000 + F.col("cents")).alias("e"), F.lit(100000000).cast("long").alias("total"))


@query(f"""SELECT event_id, s - coalesce(lag(e) OVER w, 0) AS gap_before, coalesce(lead(s) OVER w, total) - e AS gap_after FROM ({_SPANS}) WINDOW w AS (PARTITION BY user_id ORDER BY s)""")
def gap_before_after(spark: SparkSession, d: str) -> DataFrame:
    return windows.gaps(_spans(spark, d), "user_id", ["s"], "s", "e", F.lit(0), F.col("total")).select("event_id", "gap_before", "gap_after")


@query(f"""SELECT event_id, round(s - least((s - coalesce(lag(e) OVER w, 0))::DOUBLE / 2, 50.0::DOUBLE), 2) AS pad_start, round(e + least((coalesce(lead(s) OVER w, total) - e)::DOUBLE / 2, 50.0::DOUBLE), 2) AS pad_end
FROM ({_SPANS}) WINDOW w AS (PARTITION BY user_id ORDER BY s)""")
def gap_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.gaps(_spans(spark, d), "user_id", ["s"], "s", "e", F.lit(0), F.col("total"))
    return windows.padded_chunks(rows, "s", "e", 50.0).select("event_id", "pad_start", "pad_end")


@query(f"""WITH x AS (SELECT user_id, s, e, total, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM ({_SPANS}))
SELECT user_id, f AS start, s AS "end" FROM x WHERE s > f UNION ALL SELECT user_id, max(e), max(total) FROM x GROUP BY user_id HAVING max(total) > max(e)""")
def silent_spans(spark: SparkSession, d: str) -> DataFrame:
    return windows.silences(_spans(spark, d), "user_id", ["s"], "s", "e", F.col("total"))


@query("""WITH a AS (SELECT user_id, event_id, event_type = 'error' AS active FROM events), b AS (SELECT *, CASE WHEN active IS DISTINCT FROM lag(active) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b)
SELECT user_id, island::BIGINT AS island, bool_or(active) AS active, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM c GROUP BY user_id, island""")
def activity_islands(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(_events(spark, d), "user_id", ["event_id"], F.col("event_type") == "error")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
b(user_id, event_id, r, bucket, total) AS (SELECT user_id, event_id, r, 1, CASE WHEN value > 300 THEN -1.0::DOUBLE ELSE value END FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.event_id, e.r, b.bucket + CASE WHEN b.r_over THEN 1 ELSE 0 END, CASE WHEN (CASE WHEN b.r_over THEN 0.0::DOUBLE ELSE b.total END) + e.value > 300 THEN -1.0::DOUBLE ELSE (CASE WHEN b.r_over THEN 0.0::DOUBLE ELSE b.total END) + e.value END
FROM (SELECT *, total < 0 AS r_over FROM b) b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1) SELECT event_id, bucket FROM b""")
def threshold_buckets(spark: SparkSession, d: str) -> DataFrame:
    return windows.threshold_buckets(_events(spark, d).select("event_id", "user_id", "value"), "user_id", ["event_id"], "value", 300.0).select("event_id", "bucket")


@query(f"""SELECT event_id, CASE WHEN e - s < 8000 AND last THEN greatest(e - 8000, 0) ELSE greatest(s, 0) END AS span_start, least(CASE WHEN e - s < 8000 AND NOT last THEN s + 8000 ELSE e END, total) AS span_end
FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) IS NULL AS last FROM ({_SPANS}))""")
def min_length_spans(spark: SparkSession, d: str) -> DataFrame:
    return windows.minimum_spans(_spans(spark, d), "user_id", ["s"], "s", "e", F.col("total")).select("event_id", "span_start", "span_end")


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY t) AS speakers FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_seen(scan(spark, f"{d}/conversations.parquet"), "conv_id", ["turn"], "role").select("conv_id", F.array_join("values", ",").alias("speakers"))


@query("""WITH n AS (SELECT count(*) // 8 AS size FROM events) SELECT event_id, event_id // size AS part, event_id % size AS step FROM events, n WHERE event_id < 8 * size""")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id"])
    return windows.batches(rows, "event_id", rows.count(), 8).select("event_id", "part", "step")


@query("""SELECT event_id, CASE WHEN h < 100 THEN lpad(h::VARCHAR, 2, '0') ELSE h::VARCHAR END || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') AS hms
FROM (SELECT event_id, x // 3600 AS h, x // 60 % 60 AS m, x % 60 AS s FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS x FROM events))""")
def format_hms(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", tx.hms(F.col("value") * 1000).alias("hms"))


@query("SELECT doc_id, source || '@-@' || lang || '_pk-' || CASE WHEN length(doc_id::VARCHAR) >= 6 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 6, '0') END AS id FROM documents")
def utterance_id(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "doc_id", "source", "lang").select("doc_id", tx.utterance_id(F.col("source"), F.concat(F.lit("wav/"), "lang", F.lit(".wav")), F.col("doc_id")).alias("id"))


@query("""SELECT conv_id || '_' || lpad(CAST(turn // 3 AS VARCHAR), 2, '0') || '_' || lpad(CAST(length(role) AS VARCHAR), 2, '0') AS speaker_id, count(*) AS n FROM conversations GROUP BY 1""")
def speaker_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/conversations.parquet").withColumn("b", F.floor(F.col("turn") / 3)).withColumn("s", F.length("role"))
    return rows.groupBy(windows.numbered_speakers(rows, "conv_id", "b", "s").alias("speaker_id")).agg(F.count("*").alias("n"))


# Samples and splits


_FRACTION = "CAST('0x' || substr(md5(doc_id::VARCHAR || ':{seed}'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE"


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id LIMIT 50")
def md5_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample(_documents(spark, d, "doc_id"), "doc_id", 50)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':0'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r < floor(0.8::DOUBLE * n) THEN 'train' WHEN r < floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'dev' ELSE 'test' END AS split FROM r
WHERE r < floor(0.8::DOUBLE * n) + 2 * floor(0.1::DOUBLE * n)""")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.ratio_split(_documents(spark, d, "doc_id"), "doc_id", {"train": 0.8, "dev": 0.1, "test": 0.1}).select("doc_id", "split")


@query(f"""WITH s AS (SELECT md5(text) AS k, CASE WHEN {_FRACTION.format(seed=9)} < 0.33 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT k, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY k HAVING count(DISTINCT split) > 1""")
def split_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.hash_split(_documents(spark, d, "doc_id", "text"), "doc_id").withColumn("k", F.md5(F.col("text").cast("binary")))
    return relational.leakage(rows, "split", ["k"]).select("k", F.array_join("splits", ",").alias("splits"))


@query(f"""WITH e AS (SELECT event_id, user_id, {_CENTS}::DOUBLE AS v FROM events), t AS (SELECT user_id, sum(v) AS total, md5(user_id::VARCHAR || ':0') AS k FROM e GROUP BY user_id),
r AS (SELECT user_id, row_number() OVER (ORDER BY k, user_id) AS r, CAST('0x' || substr(md5(user_id::VARCHAR || ':0:start'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE * greatest(total - 30000.0, 0.0) AS start FROM t QUALIFY row_number() OVER (ORDER BY k, user_id) <= 10),
o AS (SELECT e.*, r.r, coalesce(r.start, 0.0::DOUBLE) AS start, coalesce(sum(v) OVER (PARTITION BY e.user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS o FROM e LEFT JOIN r USING (user_id)),
l AS (SELECT *, o + v >= start AS late FROM o),
b AS (SELECT *, coalesce(sum(CASE WHEN late THEN v END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM l)
SELECT event_id, CASE WHEN late AND before < 30000 AND r <= 5 THEN 'dev' WHEN late AND before < 30000 AND r IS NOT NULL THEN 'test' ELSE 'train' END AS split FROM b""")
def meeting_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", F.col("cents").cast("double").alias("v"))
    return splits.meeting_split(rows, "user_id", ["event_id"], "v", 5, seconds=30000.0).select("event_id", "split")


# Texts


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/pages.parquet", columns=["page_id", "html"]).select("page_id", tx.clean_html(F.col("html")).alias("text"))


_STOPS = ["the", "und", "que", "les"]


@query(f"""SELECT doc_id, array_to_string(list_filter(list_filter(string_split(text, chr(10)), lambda x: x <> '' AND NOT list_has_any(string_split(x, ' '), {_STOPS})), lambda x: length(x) >= 4), chr(10)) AS kept FROM documents""")
def line_filters(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "doc_id", "text").select("doc_id", tx.drop_short_lines(tx.drop_lines_with(F.col("text"), _STOPS)).alias("kept"))


@query("SELECT doc_id, translate(translate(text, '.,?!:;', ''), 'âîôû', 'aiou') AS plain, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short FROM documents")
def strip_and_shorten(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, d, "doc_id", "text").select("doc_id", tx.plain_circumflex(tx.strip_punctuation(t)).alias("plain"), tx.shortened(t).alias("short"))


@query()
def markup_clean(spark: SparkSession, d: str) -> DataFrame:
    """The markup pipeline on pages; golden tests and a plain pipeline in the tests state its rules."""
    return scan(spark, f"{d}/pages.parquet", columns=["page_id", "html"]).select("page_id", tx.clean_wiki(F.col("html")).alias("text"))


@query(r"""SELECT lang, CASE WHEN regexp_matches(t, '^\p{L}') THEN 'WORD' WHEN regexp_matches(t, '^[0-9]') THEN 'NUMBER' WHEN regexp_matches(t, '^[.,?!:;"()''-]$') THEN 'PUNCTUATION' ELSE 'SYMBOL' END AS kind, count(*) AS n
FROM (SELECT lang, unnest(regexp_extract_all(text, '(\p{L}[\p{L}\p{M}]*(?:[''’-][\p{L}\p{M}]+)*|[0-9]+(?:[.,][0-9]+)*|[.,?!:;"()'']|[^ \t\n\x0B\f\r])')) AS t FROM documents) GROUP BY ALL""")
def typed_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of each type by language."""
    rows = _documents(spark, d, "lang", "text").select("lang", F.explode(tx.typed_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("lang", F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


_THREE = "(SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), lambda x: x <> '') AS w FROM documents)"


def _three(spark: SparkSession, d: str) -> DataFrame:
    """The words of texts with three or more, up to the third; what stands behind it changes nothing, and only its head is cleaned."""
    token, gap = "[^ A-Za-z]*+[A-Za-z][^ ]*+", " (?:[^ A-Za-z]*+ )*+"
    head = F.regexp_extract("text", f"^(?:[^ A-Za-z]*+ )*+{token}(?:{gap}{token}){{2}}", 0)
    words = F.filter(F.split(F.lower(F.regexp_replace(F.col("head"), "[^A-Za-z ]", "")), " "), lambda x: x != "")
    return _documents(spark, d, "doc_id", "text").select("doc_id", head.alias("head")).filter("head != ''").select("doc_id", words.alias("w"))


@query(f"SELECT doc_id, w[1] || '-fr ' || w[2] || '-nl ' || w[3] || '-fr' AS tagged, w[1] || ' ' || w[2] || ' ' || w[3] AS bare, true AS switched FROM {_THREE} WHERE len(w) >= 3")
def bracket_parse(spark: SparkSession, d: str) -> DataFrame:
    """Utterances made of a document's first words, the second in a Dutch bracket, parsed and rendered."""
    w = lambda i: F.element_at("w", i)
    raw = F.concat(w(1), F.lit(" [nl: "), w(2), F.lit("] "), w(3))
    rows = _three(spark, d).select("doc_id", brackets.parse(raw, F.lit("Frisian")).alias("p"))
    return rows.select("doc_id", brackets.text_with_tags(F.col("p.words")).alias("tagged"), brackets.text_without_tags(F.col("p.words")).alias("bare"), brackets.any_switch(F.col("p.words")).alias("switched"))


@query("""SELECT kind, speaker, gender, language, count(*) AS n FROM (SELECT CASE WHEN turn = 0 THEN 'background' WHEN turn % 3 = 0 THEN 'rejected' ELSE 'ok' END AS kind,
CASE WHEN turn = 0 THEN NULL ELSE 'spk' || turn END AS speaker, CASE WHEN turn = 0 OR turn % 3 = 0 THEN NULL WHEN turn % 2 = 0 THEN 'male' ELSE 'female' END AS gender, CASE WHEN turn = 0 THEN NULL ELSE 'fr' END AS language FROM conversations) GROUP BY ALL""")
def tier_decode(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    label = F.when(turn == 0, "background").otherwise(F.concat(F.lit("spk"), turn.cast("string"), F.lit("/"), F.when(turn % 3 == 0, "x9").when(turn % 2 == 0, "male").otherwise("female"), F.lit("/fr")))
    rows = scan(spark, f"{d}/conversations.parquet", columns=["turn"]).select(brackets.tier(label).alias("t"))
    return rows.groupBy("t.kind", "t.speaker", "t.gender", "t.language").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT doc_id, w[1] || '-nl' AS entry, w[2] || '-nl ' || w[3] || '-fr ' || w[1] || '-fr' AS pron FROM {_THREE} WHERE len(w) >= 3)
SELECT doc_id, regexp_extract(entry, '^(.*)-', 1) AS name, 'nl' AS language, 'fr' AS dominant, 'fr,nl' AS languages, true AS error, regexp_replace(pron, '-[a-zA-Z]+', '', 'g') AS bare FROM e""")
def lexicon_labels(spark: SparkSession, d: str) -> DataFrame:
    """Entries made up of a document's first three words, with labels, taken apart again."""
    w = lambda i: F.element_at("w", i)
    rows = _three(spark, d).select("doc_id", F.concat(w(1), F.lit("-nl")).alias("entry"), F.concat(w(2), F.lit("-nl "), w(3), F.lit("-fr "), w(1), F.lit("-fr")).alias("pron"))
    own, pron = labels.split_label(F.col("entry")), F.col("pron")
    return rows.select("doc_id", own["name"].alias("name"), own["language"].alias("language"), labels.dominant_language(pron).alias("dominant"), labels.language_set(pron).alias("languages"),
                       labels.language_error(own["language"], F.array(labels.dominant_language(pron))).alias("error"), labels.unlabelled(pron).alias("bare"))


@query("""SELECT conv_id || '-' || turn AS utterance_id, conv_id || '-' || turn || ' c' || conv_id || ' ' || (turn * 10)::DOUBLE::VARCHAR || ' ' || (turn * 10 + 5)::DOUBLE::VARCHAR AS segments, conv_id || '-' || turn || ' ' || role AS utt2spk FROM conversations""")
def kaldi_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/conversations.parquet").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"), "text", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("wav"),
        F.lit("p").alias("path"), F.lit(1).alias("channels"), (F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 5).cast("double").alias("end"), F.col("role").alias("speaker"),
    )
    made = sinks.kaldi_lines(rows)
    return rows.select("utterance_id", made["segments"].alias("segments"), made["utt2spk"].alias("utt2spk"))


@query()
def number_words(spark: SparkSession, d: str) -> DataFrame:
    """Part keys and prices in words, Dutch and Frisian."""
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_retailprice"])
    price = F.format_string("%.1f", "p_retailprice")
    return rows.select("p_partkey", numbers.number_words(F.col("p_partkey"), F.lit("Dutch")).alias("dutch"), numbers.number_words(price, F.lit("Frisian")).alias("frisian"))


# Models


@query(r"""WITH t AS (SELECT doc_id, lang, string_split(lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '') AS t FROM documents),
c AS (SELECT doc_id, lang, unnest(t) AS ch, generate_subscripts(t, 1) AS i FROM t),
w AS (SELECT lang, ch || lead(ch, 1) OVER p AS g2, ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p AS g3, ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p || lead(ch, 3) OVER p AS g4,
  ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p || lead(ch, 3) OVER p || lead(ch, 4) OVER p AS g5 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i))
SELECT gram, lang, count(*) AS n FROM (SELECT lang, unnest([g2, g3, g4, g5]) AS gram FROM w) WHERE gram IS NOT NULL GROUP BY ALL""")
def nb_ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return langid.gram_counts(_documents(spark, d, "lang", "text"), F.col("text"), "lang")


@query(rf"""WITH t AS (SELECT doc_id, lang, {_FRACTION.format(seed=9)} < 0.33 AS held, string_split(lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '') AS t FROM documents),
c AS (SELECT doc_id, lang, held, unnest(t) AS ch, generate_subscripts(t, 1) AS i FROM t),
w AS (SELECT doc_id, lang, held, ch || lead(ch, 1) OVER p AS g2, ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p AS g3, ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p || lead(ch, 3) OVER p AS g4,
  ch || lead(ch, 1) OVER p || lead(ch, 2) OVER p || lead(ch, 3) OVER p || lead(ch, 4) OVER p AS g5 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, held, gram FROM (SELECT doc_id, lang, held, unnest([g2, g3, g4, g5]) AS gram FROM w) WHERE gram IS NOT NULL),
k AS (SELECT gram, lang, count(*) AS n FROM g WHERE NOT held GROUP BY ALL), v AS (SELECT count(DISTINCT gram) AS v FROM k),
o AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang), r AS (SELECT lang, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM t WHERE NOT held GROUP BY lang),
m AS (SELECT doc_id, gram, count(*) AS n FROM g WHERE held AND gram IN (SELECT gram FROM k) GROUP BY ALL),
l AS (SELECT r.lang, r.prior, o.total + v.v AS size FROM r JOIN o ON o.lang = r.lang CROSS JOIN v),
s AS (SELECT t.doc_id, l.lang, any_value(l.prior) + coalesce(sum(m.n * ln((coalesce(k.n, 0) + 1)::DOUBLE / l.size)), 0) AS score
  FROM t CROSS JOIN l LEFT JOIN m ON m.doc_id = t.doc_id LEFT JOIN k ON k.gram = m.gram AND k.lang = l.lang WHERE t.held GROUP BY t.doc_id, l.lang)
SELECT doc_id, lang, round(score, 2) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1""")
def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    """Language of the held-out third; a small fixture is held against a plain naive Bayes, too."""
    rows = splits.hash_split(_documents(spark, d, "doc_id", "lang", "text"), "doc_id")
    model = langid.train(rows.filter("split = 'train'"), F.col("text"), "lang", 2, 5)
    return langid.predict(rows.filter("split = 'test'").select("doc_id", "text"), "doc_id", F.col("text"), model, "lang", 2, 5).select("doc_id", "lang", F.round("score", 2).alias("score"))


@query()
def label_words_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Words labelled by their own majority language, or by the text's where both languages have them."""
    own = checkpointed(ag.word_labels(_words(spark, d, "lang"), "lang"))
    rows = _documents(spark, d, "doc_id", "lang", "text").withColumn("no", F.lit(0))
    return ag.labelled_words(rows, "doc_id", "no", tx.words(tx.normalise(F.col("text"))), "lang", own).select("doc_id", F.md5(F.col("labelled").cast("binary")).alias("digest"))


@query()
def cluster_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Speakers in each label's vectors; tests hold the clustering against a plain one."""
    rows = scan(spark, f"{d}/embeddings.parquet")
    return cluster.cluster_groups(rows, "label", "vec_id", "embedding", 6)


@query()
def ngram_perplexity_grid(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of src2 under mixtures of the models of src0 and src1."""
    docs = _documents(spark, d, "source", "text")
    words = tx.words(tx.normalise(F.col("text")))
    models = [ngramlm.model(docs.filter(F.col("source") == s), words) for s in ("src0", "src1")]
    found = ngramlm.perplexity_grid(docs.filter("source = 'src2'"), words, *models)
    return found.withColumn("perplexity", F.round("perplexity", 6))
