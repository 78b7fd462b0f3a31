"""Queries that write a table to the corpus's own file formats and read it back, each with the SQL of what must come back.

Files go to a new folder in the shared one. Stand-ins are those of the other queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import aggregates as ag
from corpusmill.operators import transcripts
from corpusmill.plans.corpus_queries import _WORDS, _documents, _words, query
from corpusmill.plans.transcript_queries import _CORPUS, _PART, _split_texts
from corpusmill.sources import readers, sinks
from corpusmill.sources.readers import scan
from corpusmill.sources.scratch import new_folder
from corpusmill.sources.store import Store


def _put(df: DataFrame, line: Column, by: str | None = None) -> str:
    """Lines in a new folder; its path."""
    folder = new_folder(df.sparkSession)
    sinks.write_lines(df, line, folder, by)
    return folder


def _text(*parts) -> Column:
    return F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


@query("""SELECT 'good' AS kind, 'f' || user_id AS file_id, 'm' || user_id || '.wav' AS wav, event_type AS lang, event_id::DOUBLE AS start, event_id + 2.5::DOUBLE AS "end", 'said ' || event_type AS text, 2.5::DOUBLE AS duration
FROM events WHERE event_id % 50 <> 0 UNION ALL
SELECT 'rejected', NULL, NULL, NULL, NULL, NULL, 'f' || user_id || chr(9) || 'm' || user_id || '.wav' || chr(9) || event_type || chr(9) || 'x' || chr(9) || '1' || chr(9) || 'said', NULL FROM events WHERE event_id % 50 = 0""")
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Labels by tabs; lines whose times can't be read come back as they are."""
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id", "user_id", "event_type"])
    user, at = F.col("user_id"), F.col("event_id")
    bad = at % 50 == 0
    line = F.concat_ws("\t", _text("f", user), _text("m", user, ".wav"), "event_type", F.when(bad, "x").otherwise(_text(at)), F.when(bad, "1").otherwise(_text(at + F.lit(2.5))), F.when(bad, "said").otherwise(_text("said ", F.col("event_type"))))
    good, rejected = readers.council_labels(spark, _put(rows, line))
    out = good.select(F.lit("good").alias("kind"), "file_id", "wav", "lang", "start", "end", "text", "duration")
    return out.unionByName(rejected.select(F.lit("rejected").alias("kind"), F.col("line").alias("text")), allowMissingColumns=True)


@query("""SELECT CASE user_id % 4 WHEN 0 THEN 'background' WHEN 3 THEN 'rejected' ELSE 'segment' END AS kind, CASE user_id % 4 WHEN 1 THEN 'spk' || user_id WHEN 2 THEN 'spk' || user_id END AS speaker,
CASE user_id % 4 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS gender, count(*) AS n FROM events GROUP BY ALL""")
def annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """Tables of tiers with a header row: segments, background and rejected rows."""
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id", "user_id", "event_type"])
    user, kind = F.col("user_id"), F.col("user_id") % 4
    tier = F.when(kind == 0, "background").when(kind == 1, _text("spk", user, "/male/fr")).when(kind == 2, _text("spk", user, "/female/nl")).otherwise("nobody")
    lines = rows.select(F.concat_ws("\t", _text(F.col("event_id")), tier, "event_type", _text(F.col("event_id") + 1)).alias("line"))
    lines = lines.unionAll(spark.createDataFrame([("tmin\ttier\ttext\ttmax",)], "line string"))
    segments, background, rejected = readers.annotation_tables(spark, _put(lines, F.col("line")))
    named = lambda df, name: df.select(F.lit(name).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ("speaker", "gender")])
    both = named(segments, "segment").unionAll(named(background, "background")).unionAll(named(rejected, "rejected"))
    return both.groupBy("kind", "speaker", "gender").agg(F.count("*").alias("n"))


_SAID = r"trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))"


@query(f"""SELECT conv_id * 100 + turn AS pk, {_SAID} AS ref, role AS hyp, 'C S' AS codes, (conv_id % 7) || ' 1 0 ' || turn AS counts FROM conversations""")
def score_files(spark: SparkSession, d: str) -> DataFrame:
    """Four lines an utterance, as a scorer writes them."""
    rows = scan(spark, f"{d}/conversations.parquet")
    name = _text("spk_w_pk-", F.lpad(_text(F.col("conv_id") * 100 + F.col("turn")), 9, "0"))
    said = F.btrim(F.regexp_replace("text", r"[\s\x0B]+", " "))
    lines = F.array(F.concat_ws(" ", name, F.lit("ref"), said), F.concat_ws(" ", name, F.lit("hyp"), "role"), _text(name, " op C S"), _text(name, " #csid ", F.col("conv_id") % 7, " 1 0 ", F.col("turn")))
    good, _ = readers.scores(spark, _put(rows.select(F.explode(lines).alias("line")), F.col("line")))
    return good


@query(f"""SELECT word, array_to_string(string_split(word, ''), ' ') AS pron FROM (SELECT DISTINCT word FROM ({_WORDS}) WHERE lang = 'fr' AND length(word) BETWEEN 2 AND 12 AND NOT regexp_matches(word, '[\\s\\x0B\\x00-\\x1F]') AND word NOT LIKE '%a')""")
def lexicon_files(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon saved for one language, without the entries that are marked as errors."""
    words = _words(spark, d, "lang").filter((F.length("word") >= 2) & (F.length("word") <= 12) & ~F.col("word").rlike(r"[\s\x0B\x00-\x1F]")).distinct()
    entries = words.select("word", F.array_join(F.split("word", ""), " ").alias("pron"), F.col("lang").alias("language"), F.col("word").endswith("a").alias("error"))
    folder = new_folder(spark)
    sinks.write_lexicon(entries, folder, "fr")
    return readers.pronunciations(spark, folder)[0]


@query(f"""SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS idx FROM (SELECT word, count(*) AS n FROM ({_WORDS}) WHERE lang = 'de' AND regexp_matches(word, '^[a-z]+$') GROUP BY word) UNION ALL SELECT '</s>', 0""")
def vocabulary_files(spark: SparkSession, d: str) -> DataFrame:
    """Words numbered by falling frequency, with the end of a sentence as 0."""
    counts = _words(spark, d, "lang").filter((F.col("lang") == "de") & F.col("word").rlike(r"^[a-z]+\z")).groupBy("word").agg(F.count("*").alias("n"))
    folder = new_folder(spark)
    sinks.write_integer_vocabulary(counts, folder)
    return readers.integer_vocabulary(spark, folder)


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS char FROM benchmark), r AS (SELECT CASE WHEN char = ' ' THEN '|' ELSE char END AS char, CAST(row_number() OVER (ORDER BY char) - 1 AS INTEGER) AS id FROM c WHERE char <> '')
SELECT * FROM r UNION ALL SELECT '[UNK]', CAST(count(*) AS INTEGER) FROM r UNION ALL SELECT '[PAD]', CAST(count(*) + 1 AS INTEGER) FROM r""")
def vocabulary_json(spark: SparkSession, d: str) -> DataFrame:
    """Characters and their numbers as one object."""
    folder = new_folder(spark)
    sinks.write_vocabulary(ag.char_vocabulary(scan(spark, f"{d}/benchmark.parquet"), F.col("text")), folder)
    return spark.read.text(folder).select(F.explode(F.from_json("value", "map<string,int>")).alias("char", "id"))


@query("""SELECT event_type AS sentence, '/w/' || event_id || '.wav' AS audiofilename, 16000 AS sampling_rate, event_id::DOUBLE AS start_time, event_id + 1::DOUBLE AS end_time FROM events""")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """One document of records under a key."""
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id", "event_type"]).select("event_type", F.col("event_id").cast("double").alias("s"), (F.col("event_id") + 1).cast("double").alias("e"), "event_id")
    made = transcripts.manifest_records(rows, "event_type", _text("/w/", F.col("event_id"), ".wav"), F.lit(16000), "s", "e")
    folder = new_folder(spark)
    sinks.write_manifest_document(made.select("record.*"), folder)
    return readers.manifest(spark, folder)


_WAV = f"""SELECT *, CASE source WHEN 'frisian council transcripts' THEN 'council/' || wav WHEN 'frisian radio broadcasts' THEN 'fame/' || CASE part WHEN 'dev' THEN 'devel' ELSE part END || '/' || wav WHEN 'cgn' THEN 'cgn/' || wav END AS path
FROM (SELECT doc_id, {_CORPUS} AS source, {_PART} AS part, 'w' || doc_id || '.wav' AS wav, 1 + doc_id % 2 AS channels, n_chars FROM documents)"""


@query(f"""SELECT 'wav.scp' AS file, wav || ' ' || CASE WHEN channels = 2 AND source = 'cgn' THEN 'sox -t wav ' || path || ' -b 16 -t wav - remix - |' ELSE path END AS line FROM ({_WAV}) WHERE path IS NOT NULL
UNION ALL SELECT 'text', 'u' || doc_id || ' t' || n_chars FROM ({_WAV}) WHERE path IS NOT NULL
UNION ALL SELECT 'segments', 'u' || doc_id || ' ' || wav || ' 0.0 1.5' FROM ({_WAV}) WHERE path IS NOT NULL
UNION ALL SELECT 'utt2spk', 'u' || doc_id || ' s' || (doc_id % 5) FROM ({_WAV}) WHERE path IS NOT NULL""")
def recogniser_files(spark: SparkSession, d: str) -> DataFrame:
    """All four files, with the folder rule of each corpus; spoken Dutch of two channels is mixed."""
    doc, wav = F.col("doc_id"), _text("w", F.col("doc_id"), ".wav")
    rows = _split_texts(spark, d).withColumn("path", sinks.wav_path(F.col("source"), F.col("partition"), wav)).filter("path is not null")
    rows = rows.select(_text("u", doc).alias("utterance_id"), _text("t", F.col("n_chars")).alias("text"), wav.alias("wav"), "path", "source", (1 + doc % 2).alias("channels"), F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), _text("s", doc % 5).alias("speaker"))
    folder, out = new_folder(spark), None
    sinks.write_kaldi(rows, folder)
    for name in sinks.kaldi_lines(rows):
        found = spark.read.text(f"{folder}/{name}").select(F.lit(name).alias("file"), F.col("value").alias("line"))
        out = found if out is None else out.unionAll(found)
    return out


@query(f"""SELECT split, kind, count(*) AS n, min(line) AS first, max(line) AS last FROM (SELECT part AS split, 'used' AS kind, 't' || n_chars AS line FROM ({_WAV}) WHERE n_chars >= 500
UNION ALL SELECT part, 'id', 'u' || doc_id FROM ({_WAV}) WHERE n_chars >= 500 UNION ALL SELECT part, 'not_used', 'u' || doc_id FROM ({_WAV}) WHERE n_chars < 500) GROUP BY ALL""")
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines that can be used, their ids, and the ids of the others, by split."""
    rows, folder, out = _split_texts(spark, d), new_folder(spark), None
    sinks.write_split(rows, F.when(F.col("n_chars") >= 500, _text("t", F.col("n_chars"))), _text("u", F.col("doc_id")), folder, "partition")
    for kind in ("used", "id", "not_used"):
        found = spark.read.text(f"{folder}/{kind}").select(F.col("partition").alias("split"), F.lit(kind).alias("kind"), F.col("value").alias("line"))
        out = found if out is None else out.unionAll(found)
    return out.groupBy("split", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


@query("""SELECT p_partkey::BIGINT AS number, p_name AS word, true AS good FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT NULL, 'x ' || p_name, false FROM part WHERE p_partkey % 10 = 0""")
def number_files(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and their words, and the lines without a number."""
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name"])
    good, bad = readers.number_table(spark, _put(rows, F.concat_ws(" ", F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(_text(F.col("p_partkey"))), "p_name")))
    return good.withColumn("good", F.lit(True)).unionByName(bad.select(F.lit(None).cast("long").alias("number"), F.col("line").alias("word"), F.lit(False).alias("good")))


@query("""SELECT 'a' || event_id AS file_id, '/w/' || event_id AS path, 1 + event_id % 2 AS channels, 8000 * (1 + event_id % 2) AS sample_rate, event_id * 80 AS samples, (event_id * 80)::DOUBLE / (8000 * (1 + event_id % 2)) AS seconds FROM events WHERE event_id % 9 <> 0""")
def audio_info_files(spark: SparkSession, d: str) -> DataFrame:
    """Facts about recordings; every ninth line has a rate that can't be read."""
    at = F.col("event_id")
    rate = F.when(at % 9 == 0, "fast").otherwise(_text(8000 * (1 + at % 2)))
    line = _text("a", at, "\t/w/", at, ",", 1 + at % 2, ",", rate, ",16-bit,00:00:01 = ", at * 80, " samples,9k,128k,PCM")
    good, _ = readers.audio_info(spark, _put(scan(spark, f"{d}/events.parquet", columns=["event_id"]), line))
    return good.select("file_id", "path", F.col("channels").cast("long").alias("channels"), F.col("sample_rate").cast("long").alias("sample_rate"), "samples", "seconds")


@query(r"""SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 2000 - (1900 + c_custkey % 80) END AS age, CASE c_custkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS gender FROM customer""")
def speaker_files(spark: SparkSession, d: str) -> DataFrame:
    """Speakers with the 23 columns of their table; a year of birth that is no number has no age."""
    key = F.col("c_custkey")
    given = {"ID": _text(key), "birthYear": F.when(key % 10 == 0, "?").otherwise(_text(1900 + key % 80)), "sex": _text(F.when(key % 2 == 0, "sex1").otherwise("sex2"))}
    rows, folder = scan(spark, f"{d}/customer.parquet", columns=["c_custkey"]), new_folder(spark)
    rows.select(*[given.get(c, F.lit("x")).alias(c) for c in readers.SPEAKER_COLUMNS]).write.csv(folder, sep="\t", header=True)
    return readers.speakers(spark, folder).select(F.col("ID").cast("long").alias("id"), "age", "gender")


@query(r"""SELECT item_id AS line_no, 'r' || item_id AS ref, 'h' || length(text) AS hyp FROM (SELECT row_number() OVER (ORDER BY item_id) AS item_id, text FROM benchmark)""")
def paired_line_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files of lines, paired by number."""
    rows = transcripts.global_rank(scan(spark, f"{d}/benchmark.parquet"), ["item_id"], "n", 1).coalesce(1).sortWithinPartitions("n")
    return readers.ground_truth(spark, _put(rows, _text("r", F.col("n"))), _put(rows, _text("h", F.length("text")))).select("line_no", "ref", "hyp")


@query("""SELECT 'p' || item_id AS title, item_id::VARCHAR AS id, replace(replace(text, chr(13), ''), chr(10), ' ') AS text FROM benchmark""")
def wiki_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an XML dump."""
    plain = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    rows = scan(spark, f"{d}/benchmark.parquet").select(_text("p", F.col("item_id")).alias("title"), _text(F.col("item_id")).alias("id"), F.struct(plain.alias("text")).alias("revision"))
    folder = new_folder(spark)
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(folder)
    return readers.wiki_pages(spark, folder)


@query("""SELECT word, CASE word_no % 3 WHEN 0 THEN 'Dutch' WHEN 1 THEN 'Frisian' END AS language FROM (SELECT 'w' || p_partkey AS word, p_partkey AS word_no FROM part)""")
def bilingual_files(spark: SparkSession, d: str) -> DataFrame:
    """Words whose language stands at their end."""
    key = F.col("p_partkey")
    line = _text("w", key, F.when(key % 3 == 0, "-nl").when(key % 3 == 1, "-fr").otherwise(""), " x")
    return readers.bilingual_words(spark, _put(scan(spark, f"{d}/part.parquet", columns=["p_partkey"]), line))


@query(f"""SELECT doc_id, {_CORPUS} AS source, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN NULL ELSE 'train' END AS partition, CASE WHEN doc_id % 7 = 0 THEN 's' || doc_id ELSE 'unk' END AS speaker FROM documents""")
def store_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Texts put in a store, half of them twice, whose partition and speaker are then updated in place."""
    rows = _split_texts(spark, d).select("doc_id", "source", F.lit(None).cast("string").alias("partition"), F.lit("unk").alias("speaker"))
    store, at = Store(spark, new_folder(spark), ["doc_id"], 16), F.col("doc_id")
    store.insert(rows.filter(at % 2 == 0))
    store.insert(rows.withColumn("speaker", F.when(at % 2 == 0, "again").otherwise(F.col("speaker"))))
    store.update(rows.select("doc_id", F.when(at % 5 == 0, "test").when(at % 5 != 1, "train").alias("partition")), ["partition"])
    store.update(rows.filter(at % 7 == 0).select("doc_id", _text("s", at).alias("speaker")), ["speaker"])
    return store.read()


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 40 = 0)")
def insert_if_absent_some(spark: SparkSession, d: str) -> DataFrame:
    """Customers that are not stored yet: most of them."""
    stored = scan(spark, f"{d}/orders.parquet", columns=["o_custkey", "o_orderkey"]).filter("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.missing_rows(scan(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name"]), stored, ["c_custkey"])


def _listed(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_SIFTED = rf"""l AS (SELECT line, string_split(line, ' ') AS ws FROM (SELECT unnest(string_split(lower(text), chr(10))) AS line FROM documents) WHERE line <> ''),
k AS (SELECT *, CASE WHEN list_has_any(ws, {_listed(tx.LINE_STOPS)}) THEN 'stop line' WHEN list_has_any(ws, {_listed(tx.ENGLISH_STOPS)}) THEN 'foreign line' END AS rule FROM l),
w AS (SELECT *, list_filter(ws, lambda x: list_contains({_listed(tx.WORD_STOPS)}, x) OR regexp_matches(x, '[/_|$<>]')) AS bad, list_filter(ws, lambda x: NOT (list_contains({_listed(tx.WORD_STOPS)}, x) OR regexp_matches(x, '[/_|$<>]'))) AS good FROM k),
r AS (SELECT rule, line AS item FROM w WHERE rule IS NOT NULL UNION ALL SELECT 'word', unnest(bad) FROM w WHERE rule IS NULL
  UNION ALL SELECT 'short line', array_to_string(good, ' ') FROM w WHERE rule IS NULL AND length(array_to_string(good, ' ')) BETWEEN 1 AND 3)"""


@query(f"""WITH {_SIFTED} SELECT rule, count(*) AS n_rejected, count(DISTINCT item) AS n_distinct, min(item) AS first_item FROM r GROUP BY rule
UNION ALL SELECT 'kept', count(*), count(DISTINCT array_to_string(good, ' ')), min(array_to_string(good, ' ')) FROM w WHERE rule IS NULL AND length(array_to_string(good, ' ')) >= 4""")
def rejects_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """What the cleaning takes out of the lines of all texts, by the rule that struck it, and what it keeps."""
    kept, rejected = transcripts.sifted(_documents(spark, d, "doc_id", "text"), "doc_id", F.lower("text"))
    lines = kept.select(F.lit("kept").alias("rule"), F.explode(tx.sentences(F.col("kept"))).alias("item")).filter("item != ''")
    counts = rejected.select("rule", "item").unionAll(lines).groupBy("rule", "item").agg(F.count("*").alias("n"))
    return counts.groupBy("rule").agg(F.sum("n").alias("n_rejected"), F.count("*").alias("n_distinct"), F.min("item").alias("first_item"))


@query("""SELECT start, speaker_id, text, "end", "end" - start AS duration, true AS good FROM (SELECT event_id::DOUBLE AS start, 'N' || user_id AS speaker_id, event_type AS text, event_id + 0.5::DOUBLE AS "end" FROM events WHERE event_id % 11 <> 0)
UNION ALL SELECT NULL, NULL, 'x' || chr(9) || 'N' || user_id || chr(9) || event_type, NULL, NULL, false FROM events WHERE event_id % 11 = 0""")
def spoken_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of spoken tables; those of three fields are kept apart as they are."""
    rows, at = scan(spark, f"{d}/events.parquet", columns=["event_id", "user_id", "event_type"]), F.col("event_id")
    line = F.when(at % 11 == 0, F.concat_ws("\t", F.lit("x"), _text("N", F.col("user_id")), "event_type")).otherwise(F.concat_ws("\t", _text(at), _text("N", F.col("user_id")), "event_type", _text(at + F.lit(0.5))))
    good, bad = readers.spoken_tables(spark, _put(rows, line))
    good = good.select("start", "speaker_id", "text", "end", "duration", F.lit(True).alias("good"))
    return good.unionByName(bad.select(F.col("line").alias("text"), F.lit(False).alias("good")), allowMissingColumns=True)


@query("SELECT 'p' || p_partkey AS word, p_name AS pron FROM part")
def run_lexicon_files(spark: SparkSession, d: str) -> DataFrame:
    """A word up to the first space, its pronunciation after it."""
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name"])
    return readers.lexicon(spark, _put(rows, _text("p", F.col("p_partkey"), "   ", F.col("p_name"))))


@query("""SELECT 'council' AS name, 'p' || p_partkey AS word, 'p ' || p_partkey AS pron, CASE p_partkey % 3 WHEN 0 THEN 'Dutch' WHEN 1 THEN 'Frisian' END AS language FROM part
UNION ALL SELECT 'frysk', 'p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '-nl' WHEN 1 THEN '-fr' ELSE '' END, 'p' || CASE p_partkey % 3 WHEN 0 THEN '-nl' WHEN 1 THEN '-fr' ELSE '' END || ' ' || p_partkey, 'Frisian' FROM part
UNION ALL SELECT 'overlap', 'p' || p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def named_lexicon_files(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon labelled word by word, the same file as one of a single language, and the list of words of both."""
    rows, key, folder = scan(spark, f"{d}/part.parquet", columns=["p_partkey"]), F.col("p_partkey"), new_folder(spark)
    label = F.when(key % 3 == 0, "-nl").when(key % 3 == 1, "-fr").otherwise("")
    for name in ("council", "frysk"):
        sinks.write_lines(rows, _text("p", key, label, " p", label, " ", key), f"{folder}/{name}")
    sinks.write_lines(rows.filter("p_partkey % 3 = 2"), _text("p", key), f"{folder}/overlap_wordlist")
    found = [readers.named_lexicon(spark, folder, n).withColumn("name", F.lit(n)) for n in ("council", "frysk")]
    both = readers.overlap_words(spark, folder).select("word", F.lit("overlap").alias("name"))
    return found[0].unionByName(found[1]).unionByName(both, allowMissingColumns=True).select("name", "word", "pron", "language")


@query("""SELECT 'w' || p_partkey AS word, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part""")
def word_list_files(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each line, numbered by its first place; each word stands twice."""
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey"]).select(F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") + 10**9)).alias("at"), "p_partkey")
    rows = rows.coalesce(1).sortWithinPartitions("at")  # one file, whose order gives the numbers
    return readers.word_list(spark, _put(rows, _text("w", F.col("p_partkey"), " n", F.col("at"))))


@query("""SELECT 'chunk' || (event_id % 9) || '.wav' AS wav, count(*) AS n, min('chunk' || (event_id % 9) || '_speaker_' || lpad((event_id // 9 + 1)::VARCHAR, 4, '0')) AS first, max('chunk' || (event_id % 9) || '_speaker_' || lpad((event_id // 9 + 1)::VARCHAR, 4, '0')) AS last
FROM events WHERE event_id < 9000 GROUP BY ALL""")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Files for recordings cut into chunks of one speaker each."""
    at = F.col("event_id")
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id"]).filter("event_id < 9000")
    chunks = rows.select(F.floor(at / 9 + 1).cast("int").alias("chunk"), _text("/w/chunk", at % 9, ".wav").alias("path"), at.cast("double").alias("start"), (at + 1).cast("double").alias("end"))
    folder = new_folder(spark)
    sinks.kaldi_for_chunks(chunks, folder, force=True)
    found = spark.read.text(f"{folder}/segments").select(F.split("value", " ").alias("p")).select(F.concat(F.element_at("p", 2), F.lit(".wav")).alias("wav"), F.element_at("p", 1).alias("u"))
    return found.groupBy("wav").agg(F.count("*").alias("n"), F.min("u").alias("first"), F.max("u").alias("last"))


@query("""SELECT row_number() OVER (ORDER BY 'item' || item_id) - 1 || '___item' || item_id || '.txt' AS name, md5(replace(replace(text, chr(13), ''), chr(10), ' ')) AS digest FROM benchmark""")
def one_file_each(spark: SparkSession, d: str) -> DataFrame:
    """A file for each item, found again by listing the folder."""
    plain = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    folder = new_folder(spark)
    sinks.write_each(scan(spark, f"{d}/benchmark.parquet").select(_text("item", F.col("item_id")).alias("name"), plain.alias("text")), folder, "name", "text")
    listed = readers.listed(spark, folder).filter("kind = 'txt'").select(F.regexp_extract("folder", "name=([^/]+)$", 1).alias("name")).distinct()
    texts = spark.read.text(folder).select("name", F.md5(F.col("value").cast("binary")).alias("digest"))
    return texts.join(listed, "name")


@query("""SELECT 'train' AS split, s_suppkey, s_name FROM supplier WHERE s_suppkey % 10 > 1 UNION ALL SELECT 'validation', s_suppkey, NULL FROM supplier WHERE s_suppkey % 10 = 1""")
def dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """Two splits as one table, one without a column of the other, and a column left out."""
    rows, key, folder = scan(spark, f"{d}/supplier.parquet", columns=["s_suppkey", "s_name", "s_acctbal"]), F.col("s_suppkey"), new_folder(spark)
    rows.filter(key % 10 > 1).withColumn("split", F.lit("train")).write.parquet(f"{folder}/train")
    rows.filter(key % 10 == 1).withColumn("split", F.lit("validation")).drop("s_name").write.parquet(f"{folder}/validation")
    rows.filter(key % 10 == 0).write.parquet(f"{folder}/test")
    return readers.dataset(spark, folder, "train+validation", ("s_acctbal",)).select("split", "s_suppkey", "s_name")


@query("""SELECT c_custkey AS line_no, c_name || chr(9) || c_mktsegment AS line FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS c_custkey, c_name, c_mktsegment FROM customer)""")
def log_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and truths by tabs, read back as numbered lines."""
    folder = new_folder(spark)
    rows = scan(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "c_mktsegment"]).coalesce(1).sortWithinPartitions("c_custkey")
    sinks.write_log(rows, ["c_name", "c_mktsegment"], folder)
    return readers.corpus_lines(spark, folder).select("line_no", "line")


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'all' END AS description FROM nation""")
def seeded_dimension(spark: SparkSession, d: str) -> DataFrame:
    """A dimension seeded twice: names that are there keep what they say."""
    rows, folder = scan(spark, f"{d}/nation.parquet", columns=["n_name", "n_nationkey"]), new_folder(spark)
    names = lambda df, text: [(r["n_name"], text) for r in df.collect()]  # noqa: E731  a dimension's names
    sinks.seed_dimension(spark, folder, names(rows.filter("n_nationkey % 2 = 0"), "even"))
    sinks.seed_dimension(spark, folder, names(rows, "all"))
    return spark.read.parquet(folder)


@query("""SELECT o_orderkey AS k, o_orderstatus AS v FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 1000""")
def load_from_start(spark: SparkSession, d: str) -> DataFrame:
    """A load that begins at row 1,000, counted from 0, twice."""
    rows = scan(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_orderstatus"]).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    folder = new_folder(spark)
    for _ in range(2):
        sinks.insert_if_absent(rows, folder, ["k"], start=1000, order=["k"])
    return spark.read.parquet(folder)
