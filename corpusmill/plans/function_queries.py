"""Queries of the column functions, each on a whole table, with the SQL that must give the same rows.

Inputs that the tables lack, such as labels on words, are made from their columns in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import brackets, labels
from corpusmill.functions import text as tx
from corpusmill.operators import aggregates as ag
from corpusmill.operators import relational, splits, transcripts, windows
from corpusmill.plans.corpus_queries import _NORM, _documents, query
from corpusmill.sources import readers
from corpusmill.sources.readers import scan


def _turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return scan(spark, f"{d}/conversations.parquet", columns=["conv_id", "turn", "role", *columns])


def _tagged() -> Column:
    """Three words, each with a label that turn and conversation decide."""
    tag = lambda c, k: F.when(F.col(c) % k == 0, "-nl").when(F.col(c) % k == 1, "-fr").otherwise("")
    return F.concat_ws(" ", F.concat(F.lit("a"), tag("turn", 3)), F.concat("role", tag("conv_id", 3)), F.concat(F.lit("c"), tag("turn", 2)))


def _tag_sql(column: str, k: int) -> str:
    return f"CASE {column} % {k} WHEN 0 THEN '-nl' WHEN 1 THEN '-fr' ELSE '' END"


_TAGGED = f"SELECT conv_id, turn, role, 'a' || {_tag_sql('turn', 3)} || ' ' || role || {_tag_sql('conv_id', 3)} || ' c' || {_tag_sql('turn', 2)} AS t FROM conversations"


@query(f"""SELECT conv_id, turn, CASE WHEN t LIKE '%-nl%' AND t LIKE '%-fr%' THEN 'mix' WHEN t LIKE '%-nl%' THEN 'Dutch' WHEN t LIKE '%-fr%' THEN 'Frisian' ELSE 'unknown' END AS language,
len(regexp_extract_all(t, '-nl')) AS nl, len(regexp_extract_all(t, '-fr')) AS fr, replace(replace(t, '-nl', ''), '-fr', '') AS bare FROM ({_TAGGED})""")
def utterance_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d).select("conv_id", "turn", _tagged().alias("t"))
    n, t = labels.label_counts(F.col("t")), F.col("t")
    return rows.select("conv_id", "turn", labels.utterance_language(F.split(t, " ")).alias("language"), n["nl"].cast("long").alias("nl"), n["fr"].cast("long").alias("fr"), labels.strip_labels(t).alias("bare"))


@query("""SELECT event_id, c, s, i, d, array_to_string(codes, ' ') AS codes, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * (s + i + d)::DOUBLE / n::DOUBLE, 2) END AS wer FROM
(SELECT event_id, CAST(user_id % 7 AS INTEGER) AS c, CAST(event_id % 4 AS INTEGER) AS s, CAST(event_id % 3 AS INTEGER) AS i, CAST(user_id % 2 AS INTEGER) AS d,
CASE event_id % 3 WHEN 0 THEN ['C', 'S'] WHEN 1 THEN ['D'] ELSE ['I', 'C'] END AS codes, CAST(user_id % 7 + event_id % 4 + user_id % 2 AS INTEGER) AS n FROM events)""")
def scoring_lines(spark: SparkSession, d: str) -> DataFrame:
    """Score lines made of keys, read again: counts, codes and the error rate over words that *** is none of."""
    rows = scan(spark, f"{d}/events.parquet", columns=["event_id", "user_id"])
    e, u = F.col("event_id"), F.col("user_id")
    counts = F.concat_ws(" ", *[x.cast("string") for x in (u % 7, e % 4, e % 3, u % 2)])
    line = F.when(e % 3 == 0, "C x  S").when(e % 3 == 1, "- D").otherwise("I cc C")
    reference = F.concat(F.lit("*** "), F.array_join(F.array_repeat(F.lit("w"), (u % 7 + e % 4 + u % 2).cast("int")), "  "))
    k = labels.csid(counts)
    return rows.select("event_id", k["c"].alias("c"), k["s"].alias("s"), k["i"].alias("i"), k["d"].alias("d"), F.array_join(labels.eval_codes(line), " ").alias("codes"), labels.utterance_wer(reference, k["s"], k["i"], k["d"]).alias("wer"))


@query("""SELECT o_orderkey, o_orderkey || ' ' || o_custkey AS compound, 'x ' || o_orderkey || ' y' AS spaced, o_custkey AS number, CAST(trunc(o_totalprice * 16000) AS BIGINT) AS samples,
o_orderkey::DOUBLE / 16000 AS seconds, CAST(2000 - (1900 + o_custkey % 100) AS INTEGER) AS age, CASE o_custkey % 3 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex FROM orders""")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice"])
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    code = F.when(F.col("o_custkey") % 3 == 1, "sex1").when(F.col("o_custkey") % 3 == 2, "F").otherwise("x")
    return rows.select(
        "o_orderkey", tx.split_number_compounds(F.concat_ws("-", key, customer)).alias("compound"), tx.fix_nbsp(F.concat_ws("\u00a0", F.lit("x"), key, F.lit("y"))).alias("spaced"),
        tx.to_int(F.concat(F.lit(" "), customer, F.lit(" "))).alias("number"), tx.samples(F.col("o_totalprice"), 16000).alias("samples"), tx.seconds(F.col("o_orderkey"), 16000).alias("seconds"),
        tx.age((1900 + F.col("o_custkey") % 100).cast("string")).alias("age"), tx.sex_name(code).alias("sex"),
    )


@query(rf"""WITH w AS (SELECT lang, unnest(string_split({_NORM.replace("text", "replace(replace(text, chr(10), ' '), '/', '-')")}, ' ')) AS word FROM documents)
SELECT lang, count(*) FILTER (WHERE regexp_matches(word, '[!-,./:-@\[-`{{-~]')) AS n_suspect, count(*) FILTER (WHERE word = '') AS n_empty, count(*) AS n FROM w GROUP BY lang""")
def suspect_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("/"), F.lit("-"))
    rows = _documents(spark, d, "lang", "text").select("lang", F.explode(tx.words(tx.normalise(text))).alias("word"))
    flag = lambda c: F.sum(c.cast("int")).cast("long")
    return rows.groupBy("lang").agg(flag(tx.is_suspect(F.col("word"))).alias("n_suspect"), flag(F.col("word") == "").alias("n_empty"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN replace(p_name, ' ', ' ') ELSE '' END AS settled FROM part""")
def dash_rule(spark: SparkSession, d: str) -> DataFrame:
    """Names with dashes for blanks: kept where they are known, parted where not, and lone dashes gone."""
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name", "p_size"])
    known, dashed = F.col("p_size") % 3 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    word = F.when(known, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("-"), dashed)).otherwise(F.lit("-"))
    return rows.select("p_partkey", tx.settle_dash(word, known).alias("settled"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def argmax_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).select("vec_id", tx.argmax(F.col("embedding")).alias("best"))


@query("""WITH x AS (SELECT event_id, unnest(string_split(event_id::VARCHAR, '')) AS c, generate_subscripts(string_split(event_id::VARCHAR, ''), 1) AS i FROM events),
y AS (SELECT *, lag(c) OVER (PARTITION BY event_id ORDER BY i) AS b FROM x)
SELECT event_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE c <> '0' AND c IS DISTINCT FROM b), '') AS path FROM y GROUP BY event_id""")
def collapsed_paths(spark: SparkSession, d: str) -> DataFrame:
    digits = F.transform(F.filter(F.split(F.col("event_id").cast("string"), ""), lambda x: x != ""), lambda x: x.cast("int"))
    return scan(spark, f"{d}/events.parquet", columns=["event_id"]).select("event_id", F.array_join(F.transform(tx.collapse_repeats(digits), lambda x: x.cast("string")), "").alias("path"))


@query("""SELECT p_partkey, p_brand || '-nl' || chr(9) || replace(p_name, ' ', '-nl ') || '-nl' AS labelled, p_brand || chr(9) || p_name AS bare FROM part""")
def lexicon_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/part.parquet", columns=["p_partkey", "p_name", "p_brand"])
    label = labels.add_label(F.col("p_brand"), F.col("p_name"), F.lit("nl"))
    both = F.split(label, "\t")
    return rows.select("p_partkey", label.alias("labelled"), labels.lexicon_entry(F.element_at(both, 1), F.element_at(both, 2), False).alias("bare"))


_RADIO = "SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'nl' WHEN 1 THEN 'en' ELSE 'fr' END AS tag FROM conversations"


@query(f"""SELECT conv_id, turn, 'w' || conv_id || '.wav' || chr(9) || turn::DOUBLE::VARCHAR || chr(9) || (turn + 1)::DOUBLE::VARCHAR || chr(9) || 'ien-fr ' || role || '-' || replace(tag, 'en', 'eng') || ' trije-fr' AS line,
'fr,' || replace(tag, 'en', 'eng') || ',fr' AS tags, CASE tag WHEN 'fr' THEN 'Frisian' WHEN 'nl' THEN 'Frisian,Dutch' ELSE 'Frisian,English' END AS languages,
CASE WHEN tag = 'fr' THEN 'ien,' || role || ',trije' ELSE 'ien,trije' END AS frisian, false AS wrong FROM ({_RADIO})""")
def radio_brackets(spark: SparkSession, d: str) -> DataFrame:
    """Utterances with a bracket in the radio corpus's manner, parsed by their source, with the lists that words give."""
    turn, tag = F.col("turn"), F.when(F.col("turn") % 3 == 0, "nl").when(F.col("turn") % 3 == 1, "en").otherwise("fr")
    raw = F.concat(F.lit("ien ["), tag, F.lit(" "), F.col("role"), F.lit("] trije"))
    rows = _turns(spark, d).select("conv_id", "turn", brackets.transcription(F.lit("frisian radio broadcasts"), raw, F.lit("Frisian")).alias("p"))
    words = F.col("p.words")
    line = brackets.line_with_tags(F.concat(F.lit("w"), F.col("conv_id").cast("string"), F.lit(".wav")), turn.cast("double"), (turn + 1).cast("double"), words)
    return rows.select("conv_id", "turn", line.alias("line"), F.array_join(brackets.tag_list(words), ",").alias("tags"), F.array_join(brackets.languages(words), ",").alias("languages"), F.array_join(brackets.words_of(words, "fr"), ",").alias("frisian"), brackets.any_bracket(F.col("p.brackets")).alias("wrong"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<nsn>' ELSE '<spn>' END AS noise, 'a <' || role || '> b' AS spaced FROM conversations""")
def noise_marks(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("turn") % 4 == 0, "de klok").when(F.col("turn") % 4 == 1, "kuch").otherwise("iets")
    return _turns(spark, d).select("conv_id", "turn", brackets.noise_word(tag).alias("noise"), brackets.spaced_noises(F.concat(F.lit("a<"), F.col("role"), F.lit(">b"))).alias("spaced"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE '' END AS text, c_name AS stem FROM customer")
def text_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    clean = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).otherwise("")
    raw = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment"))
    return rows.select("c_custkey", tx.text_choice(clean, raw).alias("text"), tx.stem(F.concat(F.lit("a/b.c/"), F.col("c_name"), F.lit(".wav"))).alias("stem"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY source LIMIT 2)")
def skipped_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.skip_groups(_documents(spark, d, "doc_id", "source"), "source", 2)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Frisian' WHEN doc_id % 3 = 1 THEN 'Dutch' END AS folder FROM documents""")
def folder_languages(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    path = F.concat(F.lit("/data/"), F.when(key % 3 == 0, "Friesland").when(key % 3 == 1, "Nederlands").otherwise("other"), F.lit("/"), key.cast("string"), F.lit(".txt"))
    return _documents(spark, d, "doc_id").select("doc_id", readers.path_language(path).alias("folder"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding[vec_id % 8 + 1:vec_id % 8 + 16], lambda x: CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR)), ' ') AS section FROM embeddings""")
def wave_sections(spark: SparkSession, d: str) -> DataFrame:
    """A second of each vector, taken as a recording of 16 samples a second."""
    rows = scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    start = (F.col("vec_id") % 8).cast("double") / 16
    part = readers.wave_section(F.col("embedding"), start, start + 1, 16)
    return rows.select("vec_id", F.array_join(F.transform(part, lambda x: F.floor(x * F.lit(1000).cast("float")).cast("string")), " ").alias("section"))  # in the samples' own precision


@query("""SELECT vec_id, round(5 * stddev_pop(x), 5) AS reference FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""")
def silence_references(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.operators.windows import silence_reference

    wave = F.transform("embedding", lambda x: x.cast("double"))
    return scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"]).select("vec_id", F.round(silence_reference(wave), 5).alias("reference"))


@query("""SELECT conv_id, string_agg(role, ' ' ORDER BY turn, role, md5(text)) AS roles, count(*) AS n FROM conversations GROUP BY conv_id""")
def bags_of_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d, "text").withColumn("item", F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("k")))
    bag = ag.multimap(rows, "conv_id", "item")
    return bag.select("conv_id", F.array_join(F.transform("items", lambda x: x["role"]), " ").alias("roles"), F.size("items").cast("long").alias("n"))


@query("""SELECT 'train' AS part, 0 AS priority, count(*) AS n FROM orders UNION ALL SELECT 'dev', 1, count(*) FROM orders WHERE o_orderkey % 2 = 0""")
def union_by_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, f"{d}/orders.parquet", columns=["o_orderkey"])
    return relational.by_priority({"train": rows, "dev": rows.filter("o_orderkey % 2 = 0")}, "part").groupBy("part", "priority").agg(F.count("*").alias("n"))


@query("""SELECT lang, n, 'x' || lpad(CAST(r AS VARCHAR), 1, '0') AS speaker FROM (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS r FROM documents GROUP BY lang)""")
def named_speakers(spark: SparkSession, d: str) -> DataFrame:
    """Groups in order with the names of speakers, item by item."""
    groups = _documents(spark, d, "lang").groupBy("lang").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(n.replace("_", ""),) for n in tx.speaker_names(9, "x")], "speaker string")
    return transcripts.zipped(groups, names, ["lang"], ["speaker"]).select("lang", "n", "speaker")


_WAVE = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings"


@query(f"""WITH w AS ({_WAVE}),
f AS (SELECT vec_id, x, unnest(range(0, len(x), 4)) AS i FROM w),
p AS (SELECT vec_id, i, len(x) AS n, list_avg(list_transform(x[i + 1:i + 8], lambda v: v * v)) AS power FROM f),
l AS (SELECT vec_id, i, n, power > max(power) OVER (PARTITION BY vec_id) / 10 AS loud FROM p),
s AS (SELECT vec_id, i, n, loud, loud AND NOT coalesce(lag(loud) OVER k, false) AS begins FROM l WINDOW k AS (PARTITION BY vec_id ORDER BY i)),
r AS (SELECT vec_id, n, sum(begins::INT) OVER (PARTITION BY vec_id ORDER BY i) AS run, i FROM s WHERE loud),
e AS (SELECT vec_id, any_value(n) AS n, min(i) AS a, max(i) + 4 AS b FROM r GROUP BY vec_id, run)
SELECT vec_id, count(*) AS n_spans, sum(least(b, n) - a)::BIGINT AS n_samples FROM e GROUP BY vec_id""")
def loud_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a vector's samples louder than 10 dB below its loudest frame, frames of eight samples, four apart."""
    rows = scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    spans = rows.select("vec_id", windows.sound_spans(F.col("embedding"), F.lit(1), 4, 10.0).alias("s"))
    return spans.select("vec_id", F.size("s").cast("long").alias("n_spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_samples"))


@query(f"""WITH w AS ({_WAVE}), c AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN (x[1] < 0)::INT ELSE ((x[i] < 0) <> (x[i - 1] < 0))::INT END) AS c FROM w),
r AS (SELECT vec_id, list_transform(range(0, len(c) - 7, 2), lambda i: list_sum(c[i + 1:i + 8])::DOUBLE / 8) AS r FROM c),
k AS (SELECT list_transform(range(-12, 13), lambda j: exp(-0.5::DOUBLE * (j / 3.0::DOUBLE) * (j / 3.0::DOUBLE))) AS k),
s AS (SELECT vec_id, list_transform(range(len(r)), lambda i: list_sum(list_transform(range(-12, 13), lambda j: k[j + 13] * r[1 + CASE WHEN i + j < 0 THEN -(i + j) WHEN i + j >= len(r) THEN 2 * (len(r) - 1) - (i + j) ELSE i + j END])) / list_sum(k)) AS s FROM r, k)
SELECT vec_id, len(list_filter(s, lambda v: v < list_avg(s) - 0.000000001::DOUBLE)) AS n_active, len(s) AS n_frames FROM s""")
def speech_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a vector's samples whose signs change less often than they do on the whole."""
    rows = scan(spark, f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    active = rows.select("vec_id", windows.zero_crossing_activity(F.col("embedding"), 8, 2).alias("a"))
    return active.select("vec_id", F.size(F.filter("a", lambda x: x)).cast("long").alias("n_active"), F.size("a").cast("long").alias("n_frames"))
